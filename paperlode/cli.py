"""paperlode build | add | delete | search | answer | research; without a command it asks for questions.

Results and errors of commands are JSON; the interactive mode prints text. A sign turns while something runs, on a terminal.
"""

from __future__ import annotations

import argparse
import json
import shutil
import sys
import threading
from collections.abc import Callable
from typing import Any, TextIO

from .config import Settings, settings

MODES = ("search", "research")


def embedder(conf: Settings):
    from .clients import EmbeddingClient
    from .services import HashEmbedder

    return EmbeddingClient(conf.embedding_url, conf.embedding_key, conf.embedding_model, conf.embedding_dimensions, conf.embedding_batch) if conf.embedding_url else HashEmbedder(conf.embedding_dimensions)


def waiting(message: str, work: Callable[[], Any], out: TextIO | None = None) -> Any:
    """Runs `work`; on a terminal (standard output, as it is now) a sign turns meanwhile."""
    out = out or sys.stdout
    if not out.isatty():
        return work()
    done = threading.Event()

    def turn():
        n = 0
        while not done.wait(0.1):
            out.write(f"\r{'|/-\\'[n % 4]} {message}...")
            out.flush()
            n += 1
        out.write("\r" + " " * max(80, shutil.get_terminal_size((80, 20)).columns) + "\r")
        out.flush()

    sign = threading.Thread(target=turn, daemon=True)
    sign.start()
    try:
        return work()
    finally:
        done.set()
        sign.join()


def seconds(timings: dict[str, float]) -> list[str]:
    return ["Time:", *[f"- {k.removesuffix('_seconds')}: {v:.2f} s" for k, v in timings.items()]]


def shown_answer(a: dict[str, Any]) -> str:
    """An answer as text: its lines, citations, the scan's status, time and counts."""
    n = a["performance_counters"]
    counts = f"Judged: {n['judge_documents_total']} candidates; {n['judge_concurrency_initial']} at a time, {n['judge_concurrency_final']} at the end; {n['provider_pressure_events']} times under pressure"
    return "\n".join([a["answer"], "", *(["References:", *a["citations"], ""] if a["citations"] else []), a["scan_status"], "", *seconds(a["stage_timings"]), counts])


def shown_report(r: dict[str, Any]) -> str:
    counts = [f"- {k.replace('_', ' ')}: {r[k]}" for k in ("chunks_recalled", "chunks_reranked", "chunks_in_context")]
    return "\n".join([r["report"], "", *(["References:", *r["citations"], ""] if r["citations"] else []), "Passages:", *counts, *seconds(r["stage_timings"])])


def error_json(e: Exception) -> str:
    from .plans.errors import StageError

    told = {"error": str(e)} | ({"diagnostics": e.diagnostics()} if isinstance(e, StageError) else {})
    return json.dumps(told, ensure_ascii=False, indent=2, default=str)


def asked(read: Callable[[str], str], prompt: str) -> str:
    """A line from the user; empty at the end of input."""
    try:
        return read(prompt).strip()
    except (EOFError, KeyboardInterrupt):
        return ""


def interactive(store, conf: Settings, read: Callable[[str], str] = input, **services) -> int:
    """Loads the index, asks for a mode, then for questions until an empty one."""
    from .plans import answer as A

    try:
        warm = waiting("loading the index", store.warm)
    except RuntimeError as e:
        print(e, file=sys.stderr)
        return 1
    print(f"Index loaded: {warm['chunks_loaded']} chunks, {warm['vector_dimensions']} dimensions.")
    mode = asked(read, f"Mode ({' or '.join(MODES)}): ") or MODES[0]
    run, show = (A.research, shown_report) if mode == MODES[1] else (A.answer, shown_answer)
    while question := asked(read, "Question (empty to leave): "):
        try:
            print(show(waiting("reading", lambda q=question: run(store, q, conf, **services))))
        except A.StageError as e:
            print(error_json(e), file=sys.stderr)
    return 0


def arguments(conf: Settings) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="paperlode", description="Builds an index of Markdown papers and answers questions from it.")
    parser.add_argument("--index-path", default=conf.index_path)
    commands = parser.add_subparsers(dest="command")
    for name, help_ in (("build", "builds the index anew from folders or files"), ("add", "adds folders or files; unchanged ones are skipped")):
        p = commands.add_parser(name, help=help_)
        p.add_argument("paths", nargs="+")
        p.add_argument("--chunk-size", type=int, default=conf.chunk_size)
        p.add_argument("--chunk-overlap", type=int, default=conf.chunk_overlap)
        p.add_argument("--artifacts", default=conf.artifacts_path)
    p = commands.add_parser("delete", help="removes a document, by title or file name")
    p.add_argument("document")
    p.add_argument("--delete-source", action="store_true", help="also deletes the Markdown file")
    p.add_argument("--artifacts", default=conf.artifacts_path)
    p = commands.add_parser("search", help="prints the best passages")
    p.add_argument("query")
    p.add_argument("--mode", default="hybrid", choices=["hybrid", "vector", "keyword"])
    p.add_argument("--top-k", type=int, default=5)
    for name, help_ in (("answer", "answers from documents that a chat model judges"), ("research", "writes a report")):
        commands.add_parser(name, help=help_).add_argument("question")
    return parser


def address(path: str) -> str:
    from pathlib import Path

    return path if "://" in path else f"file://{Path(path).resolve()}"


def main(argv: list[str] | None = None, spark=None, read: Callable[[str], str] = input, **services) -> int:
    conf = settings()
    args = arguments(conf).parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans import answer as A
    from .sources.store import Store

    store = Store(spark or SparkSession.builder.appName("paperlode").getOrCreate(), address(args.index_path))
    if args.command is None:
        return interactive(store, conf, read, **services)

    def run() -> Any:
        if args.command in ("build", "add"):
            paths = [address(p) for p in args.paths]
            return store.add(*paths, embedder=services.get("embedder") or embedder(conf), chunk_size=args.chunk_size, overlap=args.chunk_overlap, rebuild=args.command == "build", artifacts=address(args.artifacts))
        if args.command == "delete":
            return store.delete(args.document, address(args.artifacts), args.delete_source)
        if args.command == "search":
            hits = A.search(store, args.query, args.mode, args.top_k, conf.top_k_vector, conf.top_k_keyword, services.get("embedder") or embedder(conf))
            return [r.asDict() for r in hits.select("citation", "score_final", "retrieval_source", "text").collect()]  # top_k rows
        return (A.answer if args.command == "answer" else A.research)(store, args.question, conf, **services)

    try:
        out = waiting(args.command, run)
    except (ValueError, RuntimeError) as e:
        print(error_json(e), file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
