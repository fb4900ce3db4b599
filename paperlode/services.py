"""Injected services: protocols, and deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable
from typing import Any, Protocol


class Embedder(Protocol):
    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, query: str) -> list[float]: ...


class Reranker(Protocol):
    def rerank(self, *, query: str, documents: list[str], top_n: int | None = None) -> list[tuple[int, float]]: ...


class LLM(Protocol):
    def complete_json(self, system: str, user: str) -> dict[str, Any]: ...


class RetryableError(Exception):
    """A failure that may pass."""


#: By these a message says that its failure may pass.
PASSING = ("timed out", "timeout", "temporarily unavailable", "temporary failure", "engine is currently overloaded", "engine_overloaded_error", "overloaded", "rate limit", "too many requests", "connection error", "connection reset", "connection aborted", "server error")


def is_retryable(error: Exception) -> bool:
    status = getattr(error, "status_code", None) or getattr(error, "code", None)
    if isinstance(error, (RetryableError, TimeoutError, ConnectionError)):
        return True
    if isinstance(status, int) and (status in (408, 409, 429) or status >= 500):
        return True
    return any(p in str(error).lower() for p in PASSING)


def retry_delay(attempt: int, base: float = 1.0, limit: float = 8.0) -> float:
    return min(base * 2 ** max(attempt - 1, 0), limit)


def with_retries(f: Callable[[], Any], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> Any:
    for attempt in range(1, tries + 1):
        try:
            return f()
        except Exception as e:
            if attempt == tries or not is_retryable(e):
                raise
            sleep(retry_delay(attempt))
    return None


class HashEmbedder:
    """Words hashed into a few signed dimensions: equal texts are equal, texts that share words are near."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed_query(self, query: str) -> list[float]:
        out = [0.0] * self.dimensions
        for word in re.findall(r"\w+", query.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in out))
        return [x / size for x in out] if size else out

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


class WordReranker:
    """Share of the query's words that a document holds."""

    def rerank(self, *, query: str, documents: list[str], top_n: int | None = None) -> list[tuple[int, float]]:
        words = set(re.findall(r"\w+", query.lower()))
        scored = [(i, len(words & set(re.findall(r"\w+", d.lower()))) / max(1, len(words))) for i, d in enumerate(documents)]
        return sorted(scored, key=lambda x: (-x[1], x[0]))[:top_n]


def embedding_input(c):
    """The text that is embedded for a chunk (a struct with title, section_hint, keywords_hint and text): a line for each that is there."""
    from pyspark.sql import functions as F

    from .functions import text as T

    line = lambda name, x: F.concat(F.lit(f"{name}: "), T.present(x))
    return F.concat_ws("\n", line("Title", c["title"]), line("Section", c["section_hint"]), line("Keywords", c["keywords_hint"]), line("Text", c["text"]))


def embed_documents(done, embedder: Embedder, batch: int = 10):
    """Adds `vector` to every chunk of every document, in the workers, `batch` texts a request. A document whose chunks cannot
    be embedded gets an error instead, and the others go on. Vectors of a wrong number are an error too."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.functions import pandas_udf

    def vectors(texts):
        import pandas as pd

        out = []
        for own in texts:
            found, error = [], None
            try:
                for i in range(0, len(own), batch):
                    found += [list(map(float, v)) for v in embedder.embed_texts(list(own[i : i + batch]))]
                if len(found) != len(own):
                    raise ValueError(f"{len(found)} vectors for {len(own)} chunks")
            except Exception as e:
                found, error = [], f"embedding failed: {e}"
            out.append((found, error))
        return pd.DataFrame(out, columns=["vectors", "error"])

    source = F.transform("chunks", lambda c: embedding_input({"title": F.col("title"), "section_hint": c["section_hint"], "keywords_hint": c["keywords_hint"], "text": c["text"]}))
    made = done.withColumn("_e", pandas_udf(vectors, "vectors array<array<float>>, error string")(source))
    with_vectors = F.transform("chunks", lambda c, i: c.withField("vector", F.get("_e.vectors", i)))
    return made.withColumn("chunks", with_vectors).withColumn("error", F.col("_e.error")).drop("_e")
