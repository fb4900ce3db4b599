"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at CAP times
its source's size and the excess is shared again by weight: target = least(CAP * size, level * weight), where the level rises
until no further source reaches its limit. Each step of it is one aggregate over the sources, of which there may be many:
they are numbered by range partitions and offsets, not in one window.

Copies: every document of a source should appear target / size times. The whole part is kept; the fractions are rounded
dependently. Two documents exchange words at random, in proportions that keep every document's expected copies, until
one of them is integral; the other goes on to the next. This runs inside small buckets of a source (dealt by hash, so a
hot source is many buckets) along decreasing sizes; the one document that each bucket leaves fractional goes up a level,
where FAN of them meet, until a source has one left, which is rounded at random. Documents that are a large part of their
source are rounded among themselves first, and the fractions of the others shift to make up for the last of them. So a
source's words miss its target by less than one document, and that one under 1 / 400 of the source where such are left.

Randomness is a hash of the row and SEED: reruns agree, whatever the partitions. A row is told from others by its id, text
and source and by its number among equal rows, so neither null ids nor repeated rows meet in one bucket. What comes to the
driver are sums, range sizes and the largest bucket number, which sets the number of levels. Null texts have size 0 and are
taken 0 times; repeated rows are separate rows; other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, staged

WEIGHTS, CAP, FAN, SEED = (1, 2, 3), 3, 256, 20240
#: Documents over these shares (1 / 20, then 1 / 400) of their source are rounded before the others, which make up for them.
CUTS = (20, 400)

#: The fold's state: rows decided so far, and the one that is still fractional. Each row: id, size, x (fraction), u (random), copies.
_ROW = "struct<doc_id: bigint, part: bigint, size: bigint, x: double, u: double>"


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, part (hash of text and the columns `also`), and h, a hash by which the row is dealt out."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col, *also).alias("part"))
    rows = rows.groupBy("doc_id", "source", "size", "part").agg(F.count("*").alias("equal"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "equal")))
    return rows.select("doc_id", "source", "size", "part", F.xxhash64("doc_id", "source", "part", "copy", F.lit(SEED)).alias("h"))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """Adds `place`: 0 and on by the column, nulls last. Ranges are numbered within themselves and shifted by the sizes of those before."""
    ranged = df.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("_range", F.spark_partition_id())
    ranged = staged(ranged, "mix-ranges")
    before, shift = 0, []
    for r in sorted(ranged.groupBy("_range").count().collect()):  # one row for each range
        shift.append((r["_range"], before))
        before += r["count"]
    shifts = df.sparkSession.createDataFrame(shift, "_range int, _before long")
    own = F.row_number().over(W.partitionBy("_range").orderBy(F.col(column).asc_nulls_last())) - 1
    return ranged.join(F.broadcast(shifts), "_range").withColumn("place", own + F.col("_before")).drop("_range", "_before")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, staged."""
    t = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    t = staged(t.select("source", "source_size", weight.alias("weight"), (cap * F.col("source_size").cast("double")).alias("limit")), "mix-sources")
    full, level = -1, 0.0
    every = float(t.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        stop = F.col("limit") <= F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        spent, open_, now = t.agg(F.coalesce(F.sum(F.when(stop, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~stop, F.col("weight"))), F.lit(0.0)), F.count_if(stop)).first()
        if now == full or not open_:
            break
        full, level = now, (every - spent) / open_
    return staged(t.select("source", "source_size", F.least("limit", F.lit(level) * F.col("weight")).alias("target")), "mix-targets")


def _unit(h: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def _fold(rows: str) -> str:
    """SQL: struct(done, held) after pairing an array of fractional rows in order."""
    put = "named_struct('doc_id', {0}.doc_id, 'part', {0}.part, 'size', {0}.size, 'x', {1}, 'u', {0}.u)"
    up = "least(a.held.size * (1 - a.held.x), r.size * r.x)"  # words that the held row can win
    down = "least(a.held.size * a.held.x, r.size * (1 - r.x))"  # words that it can lose
    won = "r.u * (up + down) < down"
    held_up = f"struct(array_append(a.done, if(a.held.size * (1 - a.held.x) <= r.size * r.x, {put.format('a.held', '1D')}, {put.format('r', '0D')})) as done, if(a.held.size * (1 - a.held.x) <= r.size * r.x, {put.format('r', 'r.x - up / r.size')}, {put.format('a.held', 'a.held.x + up / a.held.size')}) as held)"
    held_down = f"struct(array_append(a.done, if(a.held.size * a.held.x <= r.size * (1 - r.x), {put.format('a.held', '0D')}, {put.format('r', '1D')})) as done, if(a.held.size * a.held.x <= r.size * (1 - r.x), {put.format('r', 'r.x + down / r.size')}, {put.format('a.held', 'a.held.x - down / a.held.size')}) as held)"
    step = f"if(a.held is null, struct(a.done as done, r as held), if({won}, {held_up}, {held_down}))"
    # `up` and `down` are spelled out below, since a lambda has no local names
    step = step.replace("up + down", f"{up} + {down}").replace("< down", f"< {down}").replace("up /", f"{up} /").replace("down /", f"{down} /")
    return f"aggregate({rows}, struct(cast(array() as array<{_ROW}>) as done, cast(null as {_ROW}) as held), (a, r) -> {step})"


_ORDER = "array_sort(collect_list(row), (p, q) -> case when p.size <> q.size then if(p.size > q.size, -1, 1) when p.u <> q.u then if(p.u < q.u, -1, 1) else 0 end)"
_LAST = "if({0} is null, array(), array(named_struct('doc_id', {0}.doc_id, 'part', {0}.part, 'size', {0}.size, 'x', if({0}.u < {0}.x, 1D, 0D), 'u', {0}.u)))"


def _of_source(rows: DataFrame, per_source: DataFrame, *names: str) -> DataFrame:
    return rows.join(per_source.select(F.col("source").alias("_s"), *names), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _row() -> Column:
    return F.struct("doc_id", "part", "size", "x", _unit(F.xxhash64("h", F.lit(SEED + 1))).alias("u")).alias("row")


def _large_first(rest: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    """Rounds the documents over 1 / cut of their source (under cut a source); the words by which that misses go, evenly, to the rest."""
    large = F.col("size") * cut > F.col("source_size")
    words = "aggregate({0}, 0D, (a, r) -> a + r.size * r.x)"
    level = rest.where(large).select("source", _row()).groupBy("source").agg(F.expr(_ORDER).alias("rows"))
    level = level.withColumn("f", F.expr(_fold("rows"))).withColumn("done", F.expr(f"concat(f.done, {_LAST.format('f.held')})"))
    level = staged(level.select("source", "done", F.expr(f"{words.format('done')} - {words.format('rows')}").alias("over")), "mix-large")
    rest = rest.where(~large)
    mass = rest.groupBy("source").agg(F.sum("size").alias("mass"))
    shift = staged(_of_source(mass, level, "over").select("source", "mass", "over"), "mix-shift")
    rest = _of_source(rest, shift, "over", "mass")
    x = F.col("x") - F.coalesce(F.col("over") / F.col("mass"), F.lit(0.0))
    return level.select("source", F.explode("done").alias("row")), rest.withColumn("x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).drop("over", "mass")


def rounded(fractions: DataFrame, fan: int = FAN, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """From doc_id, part, source, source_size, size > 0, x in (0, 1), h: doc_id, part, size, source, more (0 or 1), one row for each."""
    done, rest = [], fractions
    for cut in cuts:
        large, rest = _large_first(rest, cut)
        done.append(large)
    buckets = rest.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / fan)).cast("long").alias("buckets"))
    rows = _of_source(rest, staged(buckets, "mix-buckets"), "buckets")
    rows = rows.select("source", "buckets", F.pmod("h", "buckets").alias("bucket"), _row())
    levels = 0
    while True:
        level = rows.groupBy("source", "buckets", "bucket").agg(F.expr(_ORDER).alias("rows"))
        level = staged(level.select("source", "buckets", "bucket", F.expr(_fold("rows")).alias("f")).select("source", "buckets", "bucket", "f.done", "f.held"), "mix-level")
        levels += 1
        top = level.agg(F.max("buckets")).first()[0]
        if top is None or top <= 1:
            done.append(level.select("source", F.explode(F.expr(f"concat(done, {_LAST.format('held')})")).alias("row")))
            break
        done.append(level.select("source", F.explode("done").alias("row")))
        fresh = _unit(F.xxhash64("row.u", F.lit(levels)))
        rows = level.where("held is not null").select("source", "buckets", "bucket", F.col("held").alias("row"))
        rows = rows.select("source", F.greatest(F.lit(1), F.ceil(F.col("buckets") / fan)).cast("long").alias("buckets"), F.floor(F.col("bucket") / fan).cast("long").alias("bucket"), F.col("row").withField("u", fresh).alias("row"))
    out = functools.reduce(DataFrame.unionByName, done)
    return out.select("source", "row.doc_id", "row.part", "row.size", F.col("row.x").cast("long").alias("more"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, part (hash of the text and the columns `also`), source, size, source_size, target (the source's), copies (whole),
    taken (words: copies * size); one row for each row."""
    rows = staged(sizes(df, id_col, text_col, source_col, also), "mix-sizes")
    goal = targets(rows, weights, cap)
    goal = goal.select(F.col("source").alias("_s"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_f"))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_whole", F.floor("_f").cast("long")).withColumn("_x", F.col("_f") - F.floor("_f"))
    fixed = (F.col("size") == 0) | (F.col("_x") <= 0)
    more = rounded(rows.where(~fixed).select("doc_id", "part", "source", "source_size", "size", F.col("_x").alias("x"), "h"))
    again = more.join(goal, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "part", "source", "size", "source_size", "target", (F.floor("_f").cast("long") + F.col("more")).alias("copies"))
    plain = rows.where(fixed).select("doc_id", "part", "source", "size", "source_size", "target", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("_whole")).cast("long").alias("copies"))
    return plain.unionByName(again).withColumn("taken", F.col("copies") * F.col("size"))
