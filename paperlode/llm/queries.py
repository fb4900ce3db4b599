"""The queries opN_<name> over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, ctw, embeddings, mixing, preferences, quality, secrets, simhash, suffix
from .common import documents


def tokenizer() -> bpe.Tokenizer:
    import public_tokenizers

    return bpe.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer())


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preferences.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return preferences.formatted(preferences.with_other_reply(turns))


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_ctw_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir))


def op8_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(documents(spark, sf_dir)).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k[:2] == "op" and callable(f)}
#: The others can't be put as plain SQL with whole results: they are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op5_preference_format": preferences.SQL}
