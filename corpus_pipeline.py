"""The corpus pipeline: each stage works on all documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlode.llm import stages
from paperlode.llm.common import documents, staged

STAGES = [
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("secrets", stages.secrets),
    ("mix", stages.mix),
    ("tokens", stages.tokens),
]
#: SQL can express neither the classifier nor the rounding; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
