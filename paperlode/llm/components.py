"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), on narrow tables of edges.

Every round is two aggregations and two joins over (node, node) pairs. Node keys can be hot: minima are taken by partial
aggregation before the shuffle, and the joins leave nothing above them that needs a key's rows together, so that adaptive
execution can split a hot node. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b). Large: every neighbour above a node joins the least of its neighbourhood; small: those below it do."""
    u, v = F.col("u"), F.col("v")
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.where(v > u).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        out = near.join(least, "u").select(F.explode(F.array(F.struct(v.alias("a"), F.col("m").alias("b")), F.struct(u.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where(F.col("a") != F.col("b")).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component) for every node that has an edge to another; the others are their own roots."""
    held = staged(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    state = _sum(held)
    while state[0]:
        after = staged(_star(_star(held, True), False), "edges")
        new = _sum(after)
        discard(held)
        held = after
        if new == state:
            break
        state = new
    return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
