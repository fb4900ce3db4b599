"""A document-evidence index on Spark. The names below are the library's front door; each is loaded when it is first used."""

from __future__ import annotations

from importlib import import_module

_HOMES = {
    "Store": "sources.store", "Artifacts": "sources.store", "Settings": "config", "settings": "config",
    "search": "plans.recall", "Answerer": "plans.answer", "answer": "plans.answer", "answer_stream": "plans.answer", "research": "plans.answer",
    "StageError": "plans.errors", "MissingService": "plans.errors", "Plan": "plans.planning", "make_plan": "plans.planning",
    "Embedder": "services", "Reranker": "services", "LLM": "services", "HashEmbedder": "services", "WordReranker": "services",
}

__all__ = sorted([*_HOMES, "add_documents", "build_index", "delete_document", "warm_index"])


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)


def build_index(store, *paths: str, rebuild: bool = False, **options) -> dict:
    """Indexes the Markdown files under the paths; rebuild: the store then holds these only."""
    return store.add(*paths, rebuild=rebuild, **options)


def add_documents(store, *paths: str, **options) -> dict:
    return store.add(*paths, **options)


def delete_document(store, wanted: str, **options) -> dict:
    return store.delete(wanted, **options)


def warm_index(store) -> dict:
    return store.warm()
