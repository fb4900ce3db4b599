"""Embedding near-duplicates: Euclidean p-stable hashing of normalised vectors in several tables, then exact cosines.

Equal vectors form one class. Classes within the angle acos(THRESHOLD) / 2 of a pivot form a ball: all of a ball's vectors
link with one another, so a crowd of near copies costs its members and not their pairs. Pivots are the least members of
buckets of the hashing's first tables, in two rounds; who finds no pivot is a ball of its own.

Each class's normalised vector is projected on tables x functions Gaussian directions; floor((projection + shift) / WIDTH),
`functions` of them together, is its bucket in a table. Buckets hold balls, each once. The number of functions grows with the
logarithm of the number of classes, so that buckets of unrelated vectors stay small, and the number of tables follows from
MISS, the chance that two vectors at the threshold share no bucket (1e-4; nearer pairs much less). Within a bucket,
128-bit sign sketches drop pairs of balls that are far apart (bound: five standard deviations, 3e-7, for a pair at the
threshold). Every pair of balls that is left goes, once, to exact cosines: pivots that are too far apart for any link of
their members, or near enough for all of them, are settled by the triangle inequality; else the members are compared.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows without an id. Vectors are
scaled by their largest component first, so neither huge nor tiny ones leave the range of doubles. Vectors of different
lengths never link. vec_id is a key: a row that repeats with the same vector counts once. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import compared, differing
from .common import map_rows, staged
from .components import components

THRESHOLD, WIDTH, MISS, SEED = 0.9, 2.0, 1e-4, 7
#: Tables of a round that looks for pivots, rounds, and bits of a sketch.
FIRST, ROUNDS, SKETCH = 8, 2, 128
#: Beyond rounding errors of an angle.
NEAR = 1e-7


def _usable(v) -> np.ndarray | None:
    if v is None or not len(v) or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64) + 0.0
    return a if np.isfinite(a).all() and a.any() else None


def unit(a: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max()
    return a / np.sqrt(a @ a)


def prepared(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, cls (digest of the vector; null where it links with nothing), unit (the normalised vector)."""

    def make():
        def f(c):
            got = [None if i is None else _usable(v) for i, v in zip(c[0], c[1], strict=True)]
            return {
                "vec_id": c[0],
                "cls": [None if a is None else hashlib.blake2b(a.tobytes(), digest_size=16).digest() for a in got],
                "unit": [None if a is None else unit(a) for a in got],
            }

        return f

    return map_rows(df.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")), make, "vec_id long, cls binary, unit array<double>")


def chance(distance: float, width: float) -> float:
    """That one function gives two vectors at this distance the same value (Datar et al., 2004)."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(classes: int, threshold: float = THRESHOLD, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """Tables and functions for so many classes: about 64 unrelated ones share a bucket."""
    near, far = chance(math.sqrt(2 - 2 * threshold), width), chance(math.sqrt(2), width)
    functions = max(8, math.ceil(math.log(max(classes, 64) / 64) / -math.log(far)))
    return math.ceil(math.log(miss) / math.log(1 - near**functions)), functions


class Hashes:
    """The random functions for vectors of one length, the same in every task."""

    def __init__(self, length: int, width: float, functions: int, tables: int, seed: int):
        rng = np.random.default_rng([seed, length])
        self.signs = np.random.default_rng([SEED, length]).normal(size=(length, SKETCH))
        self.a, self.shift = rng.normal(size=(length, tables * functions)), rng.uniform(0, width, tables * functions)
        self.mix = rng.integers(1, 2**63, functions, np.int64) | 1
        self.width, self.shape = width, (tables, functions)
        self.salt = rng.integers(1, 2**63, tables, np.int64)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(n, tables): the bucket in each table, the table's number mixed in."""
        h = np.floor((x @ self.a + self.shift) / self.width).astype(np.int64).reshape(len(x), *self.shape)
        with np.errstate(over="ignore"):
            k = ((h * self.mix).sum(2) ^ self.salt) * np.int64(0x5851F42D4C957F2D)
            k ^= k >> 29
            return k * np.int64(0x14057B7EF767814F)

    def sketch(self, x: np.ndarray) -> list[bytes]:
        return [b.tobytes() for b in np.packbits(x @ self.signs > 0, axis=1)]


def hashed(classes: DataFrame, functions: int, tables: int, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """From rep, unit: rep, sketch, keys (one a table)."""

    def make():
        made: dict[int, Hashes] = {}

        def f(c):
            out: dict = {"rep": c[0], "sketch": [b""] * len(c[0]), "keys": [None] * len(c[0])}
            lengths = np.array([len(v) for v in c[1]])
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                if n not in made:
                    made[n] = Hashes(n, width, functions, tables, seed)
                x = np.array([c[1][i] for i in at.tolist()])
                for i, s, k in zip(at.tolist(), made[n].sketch(x), made[n].keys(x), strict=True):
                    out["sketch"][i], out["keys"][i] = s, k
            return out

        return f

    return map_rows(classes.select("rep", "unit"), make, "rep long, sketch binary, keys array<long>", 1024)


def bound(angle):
    """Differing bits of the sketches of two vectors at this angle, at most: the mean and five standard deviations."""
    share = np.minimum(np.asarray(angle) / math.pi, 0.5)
    return SKETCH * share + 5 * np.sqrt(SKETCH * share * (1 - share))


def with_cosine(pairs: DataFrame, classes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds `cosine` of the classes a and b, in double precision; pairs of different lengths go."""
    for end in (a, b):
        pairs = pairs.join(classes.select(F.col("rep").alias(end), F.col("unit").alias(f"_{end}")), end)
    dot = F.aggregate(F.zip_with(f"_{a}", f"_{b}", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.where(F.size(f"_{a}") == F.size(f"_{b}")).withColumn("cosine", dot).drop(f"_{a}", f"_{b}")


def balls(classes: DataFrame, functions: int, threshold: float = THRESHOLD) -> DataFrame:
    """rep, pivot, angle: of the classes that belong to another's ball."""
    inner = math.acos(threshold) / 2
    far, inside = int(bound(inner)), math.cos(inner)
    found, left = None, classes.select("rep", "unit")
    for k in range(ROUNDS):
        filed = hashed(left, functions, FIRST, seed=SEED + 1 + k).select("rep", "sketch", F.explode("keys").alias("key"))
        halves = [F.conv(F.hex(F.substring("sketch", 1 + 8 * h, 8)), 16, -10).cast("long") for h in range(SKETCH // 64)]
        filed = staged(filed.select("key", "rep", F.array(*halves).alias("s")), "pivot-buckets")
        least = filed.groupBy("key").agg(F.min(F.struct("rep", "s")).alias("p"), F.count("*").alias("n")).where("n > 1")
        bits = sum((F.bit_count(F.col("s")[h].bitwiseXOR(F.col("p.s")[h])) for h in range(SKETCH // 64)), F.lit(0))
        tried = filed.join(least.select("key", "p"), "key").where((F.col("rep") > F.col("p.rep")) & (bits <= far)).select("rep", F.col("p.rep").alias("pivot")).distinct()
        if found is not None:  # who is a pivot stays one
            tried = tried.join(found.select(F.col("pivot").alias("rep")), "rep", "left_anti")
        near = with_cosine(tried, classes, "rep", "pivot").where(F.col("cosine") >= inside)
        best = staged(near.groupBy("rep").agg(F.min(F.struct("pivot", "cosine")).alias("m")).select("rep", "m.pivot", F.acos(F.least(F.lit(1.0), "m.cosine")).alias("angle")), "pivots")
        good = best.join(best.select(F.col("rep").alias("pivot")), "pivot", "left_anti").select("rep", "pivot", "angle")
        found = staged(good if found is None else found.unionByName(good), "balls")
        left = classes.select("rep", "unit").join(found.select("rep"), "rep", "left_anti")
    return found


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = staged(prepared(df, id_col, vector_col), "vectors")
    good = rows.where("cls is not null").select("vec_id", "cls").distinct()
    first = good.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    units = rows.where("cls is not null").select(F.col("vec_id").alias("rep"), "cls", "unit").join(first.select("rep", "cls", "copies"), ["rep", "cls"]).dropDuplicates(["rep", "cls"])
    classes = staged(units, "classes")
    tables, functions = shape(classes.count(), threshold, miss=miss)
    limit = math.acos(threshold)

    inside = balls(classes, functions, threshold)
    member = classes.select("rep", "copies").join(inside.withColumnRenamed("rep", "_r"), F.col("rep") == F.col("_r"), "left")
    member = staged(member.select("rep", "copies", F.coalesce("pivot", "rep").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "members")
    ball = staged(member.groupBy("ball").agg(F.max("angle").alias("r"), F.sum("copies").alias("total"), F.count("*").alias("n")), "ball-sizes")

    seen = staged(hashed(classes, functions, tables), "lsh")
    pivot = seen.select(F.col("rep").alias("ball"), "sketch").join(ball, "ball")
    alone = seen.join(ball.where("n = 1").select(F.col("ball").alias("rep")), "rep").select("rep", F.col("rep").alias("ball"), "keys")
    crowd = seen.join(member.select("rep", "ball").join(ball.where("n > 1").select("ball"), "ball"), "rep").select("ball", F.explode("keys").alias("key")).distinct()
    shown = pivot.select("ball", "sketch", F.col("r").cast("float").alias("r"))
    filed = alone.select("ball", F.explode("keys").alias("key")).join(shown, "ball").unionByName(crowd.join(shown, "ball")).select("key", "ball", "sketch", "r")

    def near(c, i, j):
        return differing(c["sketch"][i], c["sketch"][j]) <= bound(limit + c["r"][i] + c["r"][j])

    pairs = staged(compared(filed, near, "ball").distinct(), "ball-pairs")
    for end in "ab":
        pairs = pairs.join(ball.select(F.col("ball").alias(end), F.col("r").alias(f"r{end}"), F.col("total").alias(f"t{end}"), F.col("n").alias(f"n{end}")), end)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine")))
    wide = F.col("ra") + F.col("rb")
    single = (F.col("na") == 1) & (F.col("nb") == 1)
    told = F.when(single, F.col("cosine") >= threshold).when(apart + wide < limit - NEAR, True).when(apart - wide > limit + NEAR, False)
    pairs = staged(with_cosine(pairs, classes).withColumn("all", told), "ball-links")
    whole = pairs.where("all").select("a", "b", "ta", "tb")
    some = pairs.where("all is null").select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    for end in "ab":
        some = some.join(member.select(F.col("ball").alias(f"p{end}"), F.col("rep").alias(end), F.col("copies").alias(f"c{end}")), f"p{end}")
    some = staged(with_cosine(some, classes).where(F.col("cosine") >= threshold).select("pa", "pb", "a", "b", "ca", "cb"), "member-links")

    by_ball = whole.select(F.col("a").alias("ball"), F.col("tb").alias("m")).unionByName(whole.select(F.col("b").alias("ball"), F.col("ta").alias("m"))).groupBy("ball").agg(F.sum("m").alias("others"))
    by_rep = some.select(F.col("a").alias("rep"), F.col("cb").alias("m")).unionByName(some.select(F.col("b").alias("rep"), F.col("ca").alias("m"))).groupBy("rep").agg(F.sum("m").alias("more"))
    roots = components(whole.select("a", "b").unionByName(some.select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    told = classes.select("cls", "rep").join(member.select("rep", "ball"), "rep").join(ball.select("ball", "total"), "ball")
    told = told.join(by_ball, "ball", "left").join(by_rep, "rep", "left").join(roots, F.col("ball") == F.col("node"), "left")
    links = F.col("total") - 1 + F.coalesce("others", F.lit(0)) + F.coalesce("more", F.lit(0))
    told = told.select(F.col("cls").alias("_cls"), links.alias("n_links"), F.coalesce("root", "ball").alias("component_id"))
    out = rows.select("vec_id", "cls").join(told, F.col("cls") == F.col("_cls"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
