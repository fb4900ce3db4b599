"""Index maintenance: per-file status, upsert, delete, duplicate titles, exact-text dedupe."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.titles import normal_title


def file_status(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """incoming: source_path, file_hash, normalized_title, error (null if it was parsed). state: the indexed documents.

    status: failed, skipped (same path and hash), conflict (its title belongs to another path and its own path is known),
    duplicate (the title belongs to another path, or an earlier incoming file has it) or processed.
    """
    own = state.select(F.col("source_path").alias("_p"), F.col("file_hash").alias("_h"))
    owner = state.select(F.col("normalized_title").alias("_t"), F.col("source_path").alias("_owner"))
    df = incoming.join(own, F.col("source_path") == F.col("_p"), "left").join(owner, F.col("normalized_title") == F.col("_t"), "left")
    # the first incoming file of a title owns it: an aggregate, so a title that many files share is combined before the shuffle
    first = incoming.where("error is null").groupBy("normalized_title").agg(F.min("source_path").alias("_first")).select(F.col("normalized_title").alias("_nt"), "_first")
    df = df.join(first, F.col("normalized_title") == F.col("_nt"), "left")
    taken = F.col("_owner").isNotNull() & (F.col("_owner") != F.col("source_path"))
    status = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("_h") == F.col("file_hash"), "skipped")
        .when(taken & F.col("_p").isNotNull(), "conflict")
        .when(taken | (F.col("_owner").isNull() & (F.col("_first") != F.col("source_path"))), "duplicate")
        .otherwise("processed")
    )
    return df.withColumn("status", status).drop("_p", "_h", "_t", "_owner", "_nt", "_first")


def build_stats(status: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return status.agg(count("processed").alias("processed"), count("skipped").alias("skipped"), count("duplicate").alias("duplicates_skipped"), count("failed").alias("failed"))


def replaced(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents after an upsert: whatever shares an id, a path or a title with an incoming one goes. Three equi-anti-joins, since one join on an OR could not be hashed."""
    kept = existing
    for key in ("doc_id", "source_path", "normalized_title"):
        kept = kept.join(incoming.select(key).distinct(), key, "left_anti").select(existing.columns)
    return kept.unionByName(incoming)


def deleted(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the documents of `ids` (doc_id)."""
    return {name: t.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(t.columns) for name, t in tables.items()}


def first_of_equal_texts(chunks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregate of the ordering columns."""
    first = F.min(F.struct(*order)).alias("_f")
    return chunks.groupBy(*key).agg(first, F.count("*").alias("copies")).select(*key, "_f.*", "copies")


def duplicate_titles(docs: DataFrame) -> DataFrame:
    return docs.groupBy("normalized_title").agg(F.count("*").alias("n"), F.min("doc_id").alias("kept_doc_id")).where("n > 1")


def delete_keys(wanted: str) -> list[str]:
    """The normal forms of a delete request: as a title, as a file name, and as one without its ending."""
    name = PurePath(wanted.strip()).name
    return [k for k in dict.fromkeys(normal_title(x) for x in (wanted.strip(), name, PurePath(name).stem)) if k]


def delete_matches(docs: DataFrame, wanted: str) -> DataFrame:
    """Documents that a delete request names, by title, else by file name; matched_by says how."""
    keys, name = delete_keys(wanted), F.substring_index("source_path", "/", -1)
    # the title's rule for a file name without its ending, on the column
    stem = T.normalize_title(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    by_name = (F.lower(name) == PurePath(wanted.strip()).name.lower()) | stem.isin(keys)
    by = F.when(F.col("normalized_title").isin(keys), F.lit("title")).when(by_name, F.lit("filename"))
    return docs.withColumn("matched_by", by).where("matched_by is not null")
