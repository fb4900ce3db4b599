"""Judged documents as tables: assessments in one form, answers, and citations numbered by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

LABELS = ("direct_support", "background_only", "off_target")


def assessments(judged: DataFrame) -> DataFrame:
    """From doc_id, label, answer_line, supporting_chunk_ids, chunk_ids (those shown): the same in one form, and `error`.

    Unknown labels are off target; support is kept to the chunks shown, in the order named, and falls back on the first one
    unless the document is off target; a line stays for direct support alone, where an empty one is an error."""
    label = F.trim(F.lower("label"))
    df = judged.withColumn("label", F.when(label.isin(*LABELS), label).otherwise("off_target"))
    own = F.filter(F.coalesce("supporting_chunk_ids", F.array()), lambda x: F.array_contains("chunk_ids", x))
    own = F.when((F.size(own) == 0) & (F.col("label") != "off_target"), F.slice("chunk_ids", 1, 1)).otherwise(own)
    direct, line = F.col("label") == "direct_support", F.trim(F.coalesce("answer_line", F.lit("")))
    return df.withColumns({"supporting_chunk_ids": own, "answer_line": F.when(direct, line).otherwise(""), "error": F.when(direct & (line == ""), "direct_support without an answer_line")})


def answers(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """From ranked documents (doc_id, rank, title, chunks: array of chunk_id, score_final, page_start, page_end) and their
    assessments: rank, doc_id, answer_line and citation of those that support the answer, best chunks first."""
    kept = judged.where((F.col("label") == "direct_support") & F.col("error").isNull())
    both = docs.join(kept.select("doc_id", "answer_line", "supporting_chunk_ids"), "doc_id")
    named = F.filter("chunks", lambda c: F.array_contains("supporting_chunk_ids", c["chunk_id"]))
    hits = F.when(F.size(named) == 0, F.slice("chunks", 1, 1)).otherwise(named)
    ordered = F.transform(F.array_sort(F.transform(hits, lambda c: F.struct((-c["score_final"]).alias("s"), c["chunk_id"].alias("chunk_id"), c["page_start"].alias("page_start"), c["page_end"].alias("page_end")))), lambda c: F.struct(c["page_start"], c["page_end"], c["chunk_id"]))
    out = both.withColumn("answer_line", T.answer_line("answer_line")).where((F.col("answer_line") != "") & (F.size("chunks") > 0))
    return out.select("rank", "doc_id", "answer_line", T.merged_citation("title", ordered).alias("citation"))


def assembled(found: DataFrame, key: str) -> DataFrame:
    """For each question: its numbered answer and numbered citations, by rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "answer_line", "citation")))
    each = found.groupBy(key).agg(rows.alias("_r"))
    return each.select(key, T.numbered(F.transform("_r", lambda x: x["answer_line"])).alias("answer"), T.numbered(F.transform("_r", lambda x: x["citation"]), "[{}] ", "\n").alias("citations"))


def first_queries(bundles: DataFrame, key: str, order: str, most: int = 8) -> DataFrame:
    """Of the queries of a key those that differ (by query_key), in order, `most` at most."""
    keyed = bundles.withColumn("_k", T.query_key("query"))
    first = keyed.groupBy(key, "_k").agg(F.min_by(F.struct(*bundles.columns), order).alias("b"), F.min(order).alias("_o")).where("_k <> ''")
    placed = first.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("_o"))).where(F.col("place") <= most)
    return placed.select("b.*", "place")
