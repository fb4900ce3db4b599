"""Clients against a scripted local server; settings; the command line."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from paperlode import clients, services
from paperlode.config import settings


@pytest.fixture
def server():
    script, seen = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            status, body = script.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", script, seen
    http.shutdown()


def reply(text):
    return 200, {"choices": [{"message": {"content": text}}]}


def test_chat_falls_back_from_json_mode(server):
    url, script, seen = server
    script += [(400, {"error": "response_format is not supported"}), reply('```json\n{"a": 1}\n```'), reply('{"b": 2}')]
    chat = clients.ChatClient(url, "k", "m")
    assert chat.complete_json("s", "u") == {"a": 1} and chat.complete_json("s", "u") == {"b": 2}
    assert len(seen) == 3 and "response_format" not in seen[2]


def test_embeddings_keep_their_order(server):
    url, script, seen = server
    script += [(200, {"data": [{"index": 1 - i, "embedding": [float(1 - i)]} for i in range(2)]}), (200, {"data": [{"index": 0, "embedding": [7.0]}]})]
    e = clients.EmbeddingClient(url, "k", "m", 1, batch=2)
    assert e.embed_texts(["a", "b", "c"]) == [[0.0], [1.0], [7.0]]
    script.append((200, {"data": [{"index": 0, "embedding": [3.0]}]}))
    assert e.embed_query("a  b") == e.embed_query("a b") == [3.0] and len(seen) == 3


def test_rerank_drops_malformed_items(server):
    url, script, _ = server
    r = clients.RerankClient(url, "k", "m")
    script += [(200, {"output": {"results": [{"index": 1, "relevance_score": 0.5}, {"index": "x"}, 3, {"index": 0, "score": "bad"}]}}), (200, {"results": []}), (200, {"code": "Denied", "message": "no"})]
    assert r.rerank(query="q", documents=["a", "b"]) == [(1, 0.5)] and r.rerank(query="q", documents=[]) == []
    for _ in range(2):
        with pytest.raises(clients.ServiceError):
            r.rerank(query="q", documents=["a"])


def test_retries():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise services.RetryableError("busy")

    with pytest.raises(services.RetryableError):
        services.with_retries(fails, 3, waits.append)
    assert len(calls) == 3 and waits == [1.0, 2.0] and services.retry_delay(9) == 8.0
    assert services.is_retryable(clients.ServiceError("x", 503)) and not services.is_retryable(clients.ServiceError("x", 404))


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nPAPERLODE_CHUNK_SIZE = 900\nPAPERLODE_CHAT_MODEL='m'\n")
    monkeypatch.setenv("PAPERLODE_RRF_K", "10")
    s = settings(tmp_path)
    assert (s.chunk_size, s.chat_model, s.rrf_k, s.top_k_vector) == (900, "m", 10, 30)


def test_command_line(spark, tmp_path, capsys):
    from paperlode.cli import main

    (tmp_path / "a.md").write_text("# A Paper about Growing Crystals\n\n## Abstract\n\nCrystals grow in solution.\n")
    at = ["--index-path", str(tmp_path / "index")]
    assert main([*at, "build", f"file://{tmp_path}"], spark) == 0 and '"processed": 1' in capsys.readouterr().out
    assert main([*at, "search", "crystals", "--mode", "keyword"], spark) == 0 and "A Paper about" in capsys.readouterr().out
    assert main([*at, "delete", "none.md"], spark) == 1 and "no document" in capsys.readouterr().err
    assert main([*at, "delete", "a.md"], spark) == 0


def test_waiting_writes_to_the_output_of_the_moment(monkeypatch):
    import io
    import sys
    import time

    from paperlode.cli import waiting

    class Terminal(io.StringIO):
        def isatty(self):
            return True

    shown = Terminal()
    monkeypatch.setattr(sys, "stdout", shown)
    assert waiting("reading", lambda: time.sleep(0.3) or 7) == 7 and "reading..." in shown.getvalue()
