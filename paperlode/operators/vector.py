"""Exact vector retrieval: cosine of a query against every row, top-k by a heap in each task."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import ranked

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Zero for zero vectors."""
    return dot(a, b) / F.greatest(norm(a) * F.greatest(norm(b), F.lit(EPS)), F.lit(EPS))


def scores(vectors: DataFrame, query: list[float], vector_col: str = "embedding") -> DataFrame:
    """score_vector = (cosine + 1) / 2 against one query given as literals."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score_vector", (cosine(F.col(vector_col), q) + 1) / 2)


def search(vectors: DataFrame, query: list[float], limit: int | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    if limit is not None and limit <= 0:
        return scores(vectors, query, vector_col).select(id_col, "score_vector", F.lit(0).alias("vector_rank")).limit(0)
    found = scores(vectors, query, vector_col).select(id_col, F.round("score_vector", 9).alias("score_vector"))
    return ranked(found, "score_vector", "vector_rank", limit, id_col)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 1 << 15) -> DataFrame:
    """For a stated set of query rows: the nearest other row (by cosine, then id). The queries go out in blocks of a bounded
    size, each compared with all rows as matrices, in one scan a block; a task sends back one best row for each query."""
    q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    edges = sorted(q.approxQuantile("id", [i / n for i in range(1, n)], 0.001)) if (n := max(1, -(-q.count() // block))) > 1 else []
    bounds = [None, *edges, None]
    parts = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        mine = q if low is None else q.where(F.col("id") > low)
        rows = (mine if high is None else mine.where(F.col("id") <= high)).collect()  # about one block
        if rows:
            parts.append(_best(vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")), [r["id"] for r in rows], [r["v"] for r in rows]))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, match_id long, cosine double")
    every = reduce(DataFrame.unionByName, parts)
    best = every.groupBy("query_id").agg(F.max_by(F.struct("match_id", "cosine"), F.struct("cosine", (-F.col("match_id")).alias("m"))).alias("b"))
    return best.select("query_id", "b.match_id", "b.cosine")


def _best(vectors: DataFrame, ids: list[int], found: list[list[float]]) -> DataFrame:
    """query_id, match_id, cosine: the best row of each task for each query of a block."""
    own = vectors.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), np.array(found, np.float64)))

    def unit(x):
        return x / np.maximum(np.sqrt((x * x).sum(1)), EPS)[:, None]

    def apply(batches):
        number, q = own.value
        q = unit(q).T
        cosine, match = np.full(len(number), -np.inf), np.full(len(number), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [(i, v) for i, v in zip(*(c.to_pylist() for c in part.columns), strict=True) if v is not None and len(v) == len(q)]
                if not rows:
                    continue
                row = np.array([i for i, _ in rows], np.int64)
                c = np.round(unit(np.array([v for _, v in rows], np.float64)) @ q, 9)
                c[row[:, None] == number[None, :]] = -np.inf
                best = c.max(0)
                least = np.where(c == best, row[:, None], np.iinfo(np.int64).max).min(0)
                better = (best > cosine) | ((best == cosine) & (least < match))
                cosine, match = np.where(better, best, cosine), np.where(better, least, match)
        some = cosine > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(number[some]), pa.array(match[some]), pa.array(cosine[some])], ["query_id", "match_id", "cosine"])

    return vectors.mapInArrow(apply, "query_id long, match_id long, cosine double")


def stats(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    return vectors.agg(F.count("*").alias("chunks_loaded"), F.coalesce(F.max(F.size(vector_col)), F.lit(0)).cast("long").alias("vector_dimensions"), F.count_distinct(F.size(vector_col)).alias("distinct_dimensions"))


def packed(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Adds `packed`: the vector as little-endian float32 bytes, as other stores keep them."""
    from pyspark.sql.pandas.functions import pandas_udf

    def pack(v):
        import numpy as np

        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return vectors.withColumn("packed", pandas_udf(pack, "binary")(F.col(vector_col)))


def unpacked(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The column from `packed`."""
    from pyspark.sql.pandas.functions import pandas_udf

    def unpack(b):
        import numpy as np

        return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4").tolist())

    return vectors.withColumn(vector_col, pandas_udf(unpack, "array<float>")(F.col("packed")))
