"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents.

In every stage null texts count as empty, rows are told apart by their content and not by their ids (so null and repeated ids
are as good as others), an empty table gives an empty one, and columns besides those of documents, whatever their names, are
left behind by the first stage that would meet them. Texts of any length are worked through in bounded pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, secrets as scans, simhash
from . import quality as classifier
from .common import sieve, sifted, staged

#: Documents that score lower than this are rejected (the classifier's even odds).
QUALITY = 0.5
#: Word shingles and similarity of near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows of this stage's input and keeps what scores well. Every row is judged by its own text alone:
    empty texts, repeated rows and texts that are not valid UTF-8 (taken as their bytes) too. Without labels all rows stay."""
    docs = docs.select(*COLUMNS)
    net = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.keep(docs, net, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near duplicates: the one of least id (null last), then of least text hash. Rows count by
    their texts: rows that share an id (null as well) and differ in text are different documents. All texts without words are
    one group; of rows equal in id and text one stays."""
    rows = staged(simhash.groups(docs, SIMILARITY, SHINGLE).groupBy("root", "doc_id", "part").agg(F.count("*").alias("n")), "near-rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "part")).alias("m"), F.sum("n").alias("all"))
    best = staged(best.select(F.col("root").alias("_root"), F.col("m.doc_id").alias("_id"), F.col("m.part").alias("_best"), "all"), "near-best")
    grouped = staged(rows.join(best.where("all > 1"), F.col("root") == F.col("_root"), "left_semi").select("part").distinct(), "near-grouped")
    some = sieve(grouped)  # rows outside it are groups of their own, and stay where they are
    parted = docs.select(*COLUMNS).withColumn("_part", F.xxhash64(F.col("text").cast("binary")))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_part") == F.col("_best"))
    kept = sifted(parted, "_part", some).join(best, here, "left_semi").dropDuplicates(["doc_id", "_part"])
    return sifted(parted, "_part", some, inside=False).unionByName(kept).drop("_part")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows. Null texts stay null (and so does their n_chars); no row goes."""
    return scans.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it. Rows equal in every column are one row with the sum of their copies, which
    are what the mix drew for each of them; rows that share an id but not the rest are different rows. Rows without words are
    taken no times; a null source is a source, the last one."""
    drawn = mixing.mix(docs, also=("lang", "n_chars")).where("copies > 0")
    drawn = drawn.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("part").alias("_part")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_equal"))
    drawn = staged(drawn, "mix-drawn")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.xxhash64("text", "lang", "n_chars") == F.col("_part"))
    docs = docs.select(*COLUMNS)
    taken = docs.join(drawn, same)
    taken = taken.where("_equal = 1").unionByName(taken.where("_equal > 1").dropDuplicates(["_id", "_source", "_part"]))
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens and checksums, a row for each row. Null and empty texts have no tokens;
    text that is not valid UTF-8 is read with U+FFFD in the place of what is not."""
    import public_tokenizers

    return bpe.round_trip(docs, bpe.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
