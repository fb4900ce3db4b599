"""HTTP clients for chat, embedding and reranking services that speak the common JSON forms; nothing else opens a connection."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections import OrderedDict
from dataclasses import dataclass, field
from typing import Any

from .services import RetryableError, is_retryable, with_retries


class ServiceError(Exception):
    def __init__(self, message: str, status_code: int | None = None):
        super().__init__(message)
        self.status_code = status_code


def post(url: str, key: str, body: dict[str, Any], timeout: float = 60.0) -> dict[str, Any]:
    """One JSON request; errors carry the status and the head of the answer, and say whether they may pass."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.loads(r.read())
    except urllib.error.HTTPError as e:
        raise ServiceError(f"HTTP {e.code}: {' '.join(e.read().decode('utf-8', 'replace').split())[:600]}", e.code) from e
    except (urllib.error.URLError, TimeoutError) as e:
        raise RetryableError(str(e)) from e


def json_object(text: str) -> dict[str, Any]:
    """The JSON object in a model's answer, fenced or bare."""
    if fenced := re.search(r"```json\s*(\{.*?\})\s*```", text, re.DOTALL):
        return json.loads(fenced[1])
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no JSON object in the answer")
    return json.loads(text[start : end + 1])


@dataclass
class ChatClient:
    url: str
    key: str
    model: str
    tries: int = 3
    json_mode: bool = True

    def complete_json(self, system: str, user: str) -> dict[str, Any]:
        """Asks for JSON mode until the service refuses it, then without."""
        body = {"model": self.model, "temperature": 1, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        while True:
            extra = {"response_format": {"type": "json_object"}} if self.json_mode else {}
            try:
                answer = with_retries(lambda body=body | extra: post(f"{self.url}/chat/completions", self.key, body), self.tries)
            except ServiceError as e:
                if self.json_mode and e.status_code == 400 and "response_format" in str(e):
                    self.json_mode = False
                    continue
                raise
            return json_object(answer["choices"][0]["message"]["content"])

    def close(self) -> None:
        """Requests hold no connection; there is nothing to close."""


@dataclass
class EmbeddingClient:
    """Order-preserving, at most ten texts a request; the last queries are remembered."""

    url: str
    key: str
    model: str
    dimensions: int
    batch: int = 10
    tries: int = 3
    _known: OrderedDict = field(default_factory=OrderedDict)

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        step = min(10, max(1, self.batch))
        for at in range(0, len(texts), step):
            body = {"model": self.model, "input": texts[at : at + step], "dimensions": self.dimensions}
            data = with_retries(lambda body=body: post(f"{self.url}/embeddings", self.key, body), self.tries)["data"]
            out += [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]
        if len(out) != len(texts):
            raise ServiceError(f"{len(out)} vectors for {len(texts)} texts")
        return out

    def embed_query(self, query: str) -> list[float]:
        name = " ".join(query.split())
        if name not in self._known:
            self._known[name] = self.embed_texts([name])[0]
            if len(self._known) > 128:
                self._known.popitem(last=False)
        self._known.move_to_end(name)
        return self._known[name]


def scored_item(item: Any) -> tuple[int, float] | None:
    """A reranker's item as (position, score); None for what has no whole position and no number."""
    if not isinstance(item, dict) or not isinstance(item.get("index"), int) or isinstance(item.get("index"), bool):
        return None
    value = item.get("relevance_score", item.get("score"))
    try:
        return item["index"], float(value)
    except (TypeError, ValueError):
        return None


def result_items(answer: dict[str, Any]) -> list[Any]:
    """Where services put their results."""
    output = answer.get("output")
    places = (output.get("results") if isinstance(output, dict) else None, answer.get("results"), answer.get("data"))
    return next((p for p in places if isinstance(p, list) and p), [])


@dataclass
class RerankClient:
    url: str
    key: str
    model: str
    tries: int = 3
    instruct: str = ""

    def rerank(self, *, query: str, documents: list[str], top_n: int | None = None) -> list[tuple[int, float]]:
        """(position, score) pairs. Items without a whole position and a score are dropped; none left is an error."""
        if not documents:
            return []
        body = {"model": self.model, "query": query, "documents": documents, "top_n": top_n or len(documents)} | ({"instruct": self.instruct} if self.instruct else {})
        answer = with_retries(lambda: post(self.url, self.key, body), self.tries)
        if wrong := answer.get("error") or answer.get("code"):
            raise ServiceError(f"the reranker failed: {answer.get('message') or wrong}")
        found = [pair for pair in map(scored_item, result_items(answer)) if pair]
        if not found:
            raise ServiceError("the reranker's answer holds no usable result")
        return found


__all__ = ["ChatClient", "EmbeddingClient", "RerankClient", "ServiceError", "is_retryable", "json_object", "post"]
