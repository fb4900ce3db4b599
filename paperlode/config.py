"""Settings: defaults, then a .env file, then the environment (PAPERLODE_<NAME>)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    index_path: str = "index"
    artifacts_path: str = "index-artifacts"
    chunk_size: int = 2200
    chunk_overlap: int = 100
    top_k_vector: int = 30
    top_k_keyword: int = 30
    rrf_k: int = 60
    co_occurrence_bonus: float = 0.15
    document_recall_limit: int = 300
    document_judge_limit: int = 100
    document_answer_stride: int = 2
    judge_concurrency: int = 5
    rerank_token_budget: int = 3600
    rerank_document_chunks: int = 3
    rerank_document_text_limit: int = 0
    rerank_instruct: str = "Rank papers first whose passages answer the question under its conditions."
    research_rerank_chunks: int = 500
    research_context_chunks: int = 100
    research_context_tokens: int = 120000
    research_least_chars: int = 500
    embedding_batch: int = 10
    chat_url: str = ""
    chat_model: str = ""
    chat_key: str = ""
    embedding_url: str = ""
    embedding_model: str = ""
    embedding_key: str = ""
    embedding_dimensions: int = 64
    rerank_url: str = ""
    rerank_model: str = ""
    rerank_key: str = ""

    def resolved(self, root: str | Path = ".") -> Settings:
        """Relative paths start at root; addresses with a scheme stay."""
        whole = lambda p: p if "://" in p else str(Path(root).resolve() / p)
        return replace(self, index_path=whole(self.index_path), artifacts_path=whole(self.artifacts_path))


def env_file(start: str | Path = ".") -> dict[str, str]:
    """The nearest .env at or above a folder."""
    for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
        if (folder / ".env").is_file():
            pairs = (line.split("=", 1) for line in (folder / ".env").read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
            return {k.strip(): v.strip().strip("'\"") for k, v in pairs}
    return {}


def settings(start: str | Path = ".") -> Settings:
    """The settings that hold at a folder, their paths resolved against it. A value of the wrong type is an error that names it."""
    found = env_file(start) | dict(os.environ)
    types = {"int": int, "float": float, "str": str}
    given = {}
    for f in fields(Settings):
        name = f"PAPERLODE_{f.name.upper()}"
        if name in found:
            try:
                given[f.name] = types[str(f.type)](found[name])
            except ValueError as e:
                raise ValueError(f"{name}={found[name]!r} is no {f.type}") from e
    return Settings(**given).resolved(start)
