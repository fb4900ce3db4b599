"""Search and recall over a store: DataFrames up to bounded lists of hits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, lexical, ranking, vector
from ..services import Embedder, HashEmbedder
from .planning import Bundle, Plan, query_key

#: A run of one query: (query, mode, top_k_vector, top_k_keyword, phrases) -> chunk_id, doc_id, scores and ranks.
Search = Callable[..., DataFrame]

CARRIED = ("chunk_id", "doc_id", "score_vector", "score_keyword", "score_final", "retrieval_source", "rank")


def searched(chunks: DataFrame) -> DataFrame:
    """chunk_id and the text that keyword search sees: title, text, keywords and path."""
    return chunks.select("chunk_id", "doc_id", F.concat_ws(" ", "title", "text", "keywords_hint", "source_path").alias("_all"))


def candidates(chunks: DataFrame, query: str, mode: str = "hybrid", top_k_vector: int | None = 30, top_k_keyword: int | None = 30, phrases: list[str] | None = None, vector_of: Callable[[str], list[float]] | None = None) -> DataFrame:
    """One run: the fused lists, ids and scores only. phrases: what the keyword list asks for instead of the query's words."""
    if mode not in ("hybrid", "vector", "keyword"):
        raise ValueError(f"unknown mode {mode!r}")
    keyword = vectors = None
    if mode != "vector":
        keyword = lexical.search_phrases(searched(chunks), phrases, top_k_keyword, "chunk_id", "_all") if phrases else lexical.search(searched(chunks), lexical.query_words(query), top_k_keyword, "chunk_id", "_all")
    if mode != "keyword":
        vectors = vector.search(chunks, (vector_of or HashEmbedder().embed_query)(query), top_k_vector, "chunk_id", "vector")
    none = F.lit(None).cast("double")
    if keyword is None:
        found = vectors.select("chunk_id", "score_vector", none.alias("score_keyword"), F.col("score_vector").alias("score_final"), F.lit("vector").alias("retrieval_source"), F.col("vector_rank").alias("rank"))
    elif vectors is None:
        found = keyword.select("chunk_id", none.alias("score_vector"), "score_keyword", F.col("score_keyword").alias("score_final"), F.lit("keyword").alias("retrieval_source"), F.col("keyword_rank").alias("rank"))
    else:
        found = fusion.reciprocal_rank(vectors, keyword, None).withColumn("rank", F.coalesce("vector_rank", "keyword_rank")).select("chunk_id", "score_vector", "score_keyword", "score_final", "retrieval_source", "rank")
    return chunks.select("chunk_id", "doc_id").join(found, "chunk_id").select(*CARRIED)


def search(store, query: str, mode: str = "hybrid", top_k: int | None = 5, top_k_vector: int | None = 30, top_k_keyword: int | None = 30, embedder: Embedder | None = None, phrases: list[str] | None = None) -> DataFrame:
    """The best chunks with scores and citation. The ranked lists carry ids only; texts join the final few."""
    found = candidates(store.table("chunks"), query, mode, top_k_vector, top_k_keyword, phrases, (embedder or HashEmbedder()).embed_query)
    order = [F.desc("score_final"), "rank", "chunk_id"]
    best = found.orderBy(*order).limit(top_k) if top_k is not None else found
    return hydrated(store, best).orderBy(*order)


def hydrated(store, hits: DataFrame) -> DataFrame:
    """Hits with the chunks' own columns and the citation."""
    chunks = store.table("chunks").drop("vector", "doc_id")
    return hits.join(chunks, "chunk_id").withColumn("citation", T.citation("title", "page_start", "page_end", "chunk_id"))


def store_search(store, embedder: Embedder | None = None) -> Search:
    """The search of one question: each query is embedded once."""
    embed, known = (embedder or HashEmbedder()).embed_query, {}

    def vector_of(query: str) -> list[float]:
        name = " ".join(query.split())
        if name not in known:
            known[name] = embed(query)
        return known[name]

    return lambda query, mode="hybrid", top_k_vector=None, top_k_keyword=None, phrases=None: candidates(store.table("chunks"), query, mode, top_k_vector, top_k_keyword, phrases, vector_of)


def runs(find: Search, bundles: list[Bundle], top_k_vector: int, top_k_keyword: int) -> tuple[DataFrame, list[str]]:
    """The hits of every bundle, with bundle_name and arrival: the run by its phrases, if it has any, then the run by its words."""
    parts, used = [], {}
    for b in bundles:
        if query_key(b.query) in used:
            continue
        used[query_key(b.query)] = b.query
        for phrases in ([b.phrases, None] if b.phrases else [None]):
            hits = find(b.query, "hybrid", top_k_vector, top_k_keyword, phrases)
            parts.append(hits.withColumn("bundle_name", F.lit(b.name)).withColumn("arrival", F.lit(len(parts))))
    return reduce(DataFrame.unionByName, parts), list(used.values())


def rescored(store, hits: DataFrame, plan: Plan) -> DataFrame:
    """Each chunk once at its best score, hydrated and rescored by the plan's constraints."""
    text = F.concat_ws("\n", T.present("title"), T.present("section_hint"), T.present("text"))
    best = hydrated(store, ranking.best_per_chunk(hits)).withColumn("_raw", text)
    return fusion.constraint_scores(best, plan.entities, plan.hard, plan.relations, plan.groups, "_raw").drop("_raw")


def recall(store, plan: Plan, find: Search | None = None, limit: int = 500, embedder: Embedder | None = None) -> tuple[DataFrame, list[str]]:
    """Chunks of all bundles, rescored, and the queries used. Each list of a run is as long as the stage behind it can use."""
    hits, used = runs(find or store_search(store, embedder), plan.bundles, max(plan.top_k_vector, limit), max(plan.top_k_keyword, limit))
    return rescored(store, hits, plan), used


def by_priority() -> list:
    """The order of rescored hits: entity and condition together, then the condition, then the score."""
    both = F.col("entity_match") & F.col("condition_match")
    return [F.desc(both), F.desc("condition_match"), F.desc("score_final"), F.col("arrival"), F.col("rank"), F.col("chunk_id")]


def recall_documents(store, plan: Plan, find: Search | None = None, limit: int = 300, embedder: Embedder | None = None) -> tuple[DataFrame, list[str]]:
    """Documents by the mean of their best three chunks: doc_id, title, source_path, aggregate_score, matched_bundle_count (bundles
    that have the document among their best 20 by the score before rescoring), top_chunks (hits, best first)."""
    hits, used = runs(find or store_search(store, embedder), plan.bundles, max(plan.top_k_vector, limit), max(plan.top_k_keyword, limit))
    hits = hits.withColumn("doc_id", T.document_key("doc_id", F.lit(""), F.lit(""), "chunk_id"))
    counts = ranking.bundle_documents(hits)
    found = ranking.top_hits(rescored(store, hits, plan))
    rows = found.join(counts, "doc_id", "left").withColumn("matched_bundle_count", F.coalesce("matched_bundle_count", F.lit(0)))
    rows = rows.select("doc_id", F.col("top_chunks")[0]["title"].alias("title"), F.col("top_chunks")[0]["source_path"].alias("source_path"), "aggregate_score", "matched_bundle_count", "top_chunks")
    return rows.orderBy(F.desc("aggregate_score"), F.desc("matched_bundle_count"), F.desc(F.col("top_chunks")[0]["score_final"]), "doc_id").limit(limit), used
