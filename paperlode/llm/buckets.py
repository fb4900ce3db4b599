"""Comparing the members of buckets: every pair within a bucket once, in numpy, whatever a bucket's size.

A bucket of over LIMIT members is cut: its members are dealt to parts by a hash, and each pair of parts is a cell of its own,
so no task holds more than two parts at a time, and a hot bucket is as many tasks as its pairs need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_groups

LIMIT, AT_ONCE = 4096, 1 << 18


def pairs_of(group: np.ndarray, kind: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j), i < j, of all pairs that share a value of the sorted array `group`, some at a time. kind: sorted
    within each group; members of one kind are not paired, and cost nothing."""
    if not len(group):
        return
    new = np.concatenate([[True], group[1:] != group[:-1]])
    run = new | (True if kind is None else np.concatenate([[True], kind[1:] != kind[:-1]]))
    ends = lambda at: np.repeat(np.append(at[1:], len(group)), np.diff(np.append(at, len(group))))
    end, first = ends(np.flatnonzero(new)), ends(np.flatnonzero(run))
    live, gap = np.arange(len(group)), 0
    held, size = [], 0
    while len(live := live[first[live] + gap < end[live]]):
        for at in range(0, len(live), AT_ONCE):
            i = live[at : at + AT_ONCE]
            held.append((i, first[i] + gap))
            size += len(i)
            if size >= AT_ONCE:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
        gap += 1
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def column(values: pa.Array) -> np.ndarray:
    """A numeric column as it is; a binary column of one width as a matrix of bytes."""
    if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type):
        rows = values.to_pylist()
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return values.to_numpy(zero_copy_only=False)


def dealt(filed: DataFrame, member: str | list[str], kind: str | None = None, limit: int = LIMIT, parts: Column | None = None) -> DataFrame:
    """key, cell, part and the other columns: members in the cells of their buckets, each bucket's cells together and in order.
    parts: how many a bucket is cut into, an aggregate (of `limit` members each, if it is left out)."""
    names = [c for c in filed.columns if c != "key"]
    parts = F.ceil(F.count("*") / limit) if parts is None else parts
    big = filed.groupBy(F.col("key").alias("_k")).agg(parts.cast("int").alias("parts")).where("parts > 1")
    big = staged(big, "big-buckets")
    parts = F.coalesce("parts", F.lit(1))
    rows = filed.join(big, F.col("key") == F.col("_k"), "left").withColumn("part", F.pmod(F.xxhash64(*([member] if isinstance(member, str) else member)), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("part", "other").cast("long"), F.greatest("part", "other").cast("long")
    return rows.select("key", (low * (1 << 31) + high).alias("cell"), "part", *names).repartition("key", "cell").sortWithinPartitions("key", "cell", *([kind] if kind else []))


def compared(filed: DataFrame, keep: Callable[[dict, np.ndarray, np.ndarray], np.ndarray], member: str, kind: str | None = None, limit: int = LIMIT) -> DataFrame:
    """From `key` (long), `member` (long) and columns that `keep` needs: pairs (a < b) of members of one key for which
    keep(columns, i, j) holds; a pair that shares several keys may come several times. A member is in a key once; nothing is
    null. kind: a column (long); members that agree in it are not compared."""

    def found(batches):
        for t in whole_groups(batches, "key", "cell"):
            c = {n: column(t.column(n).combine_chunks()) for n in t.column_names}
            new = np.concatenate([[True], (c["key"][1:] != c["key"][:-1]) | (c["cell"][1:] != c["cell"][:-1])])
            for i, j in pairs_of(np.cumsum(new), c[kind] if kind else None):
                split = (c["cell"][i] >> 31) != (c["cell"][i] & 0x7FFFFFFF)
                ok = ~(split & (c["part"][i] == c["part"][j]))  # such a pair meets in its own part's cell
                i, j = i[ok], j[ok]
                good = keep(c, i, j)
                yield _pairs(c[member][i[good]], c[member][j[good]])

    return dealt(filed, member, kind, limit).mapInArrow(found, "a long, b long")


def chained(filed: DataFrame, keep: Callable[[dict, np.ndarray, np.ndarray], np.ndarray], kind: str, member: str | list[str], limit: int = LIMIT, parts: Column | None = None, sure: Callable[[dict, int, int], bool] | None = None, whole: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a < b) of kinds (long) that connect what all pairs of members of one key with keep(columns, i, j) connect, and
    sure(columns, i, j) where that is given. Every pair of members is tried unless its kinds are connected already, and only
    what connects more is returned, so a task's rows are fewer than its members. member: columns by whose hash a bucket is
    cut. whole: columns that come as lists."""

    def found(batches):
        for t in whole_groups(batches, "key", "cell"):
            c = {n: t.column(n).to_pylist() if n in whole else column(t.column(n).combine_chunks()) for n in t.column_names}
            new = np.concatenate([[True], (c["key"][1:] != c["key"][:-1]) | (c["cell"][1:] != c["cell"][:-1])])
            split = (c["cell"] >> 31) != (c["cell"] & 0x7FFFFFFF)
            names, at = np.unique(c[kind], return_inverse=True)
            up, edges = np.arange(len(names)), []

            def top(x):
                while up[x] != x:  # noqa: B023
                    up[x] = x = up[up[x]]  # noqa: B023
                return x

            for i, j in pairs_of(np.cumsum(new), c[kind]):
                open_ = (up[at[i]] != up[at[j]]) & ~(split[i] & (c["part"][i] == c["part"][j]))  # a pair of one part meets in its own cell
                i, j = i[open_], j[open_]
                good = keep(c, i, j)
                i, j = i[good], j[good]
                if sure is None:
                    once = np.unique(at[i] * len(names) + at[j], return_index=True)[1]
                    i, j = i[once], j[once]
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    a, b = top(at[x]), top(at[y])
                    if a != b and (sure is None or sure(c, x, y)):
                        up[max(a, b)] = min(a, b)
                        edges.append((at[x], at[y]))
                while not np.array_equal(up, up[up]):
                    up = up[up]
            if edges:
                ends = names[np.array(edges)]
                yield _pairs(ends[:, 0], ends[:, 1])

    return dealt(filed, member, kind, limit, parts).mapInArrow(found, "a long, b long")


def starred(filed: DataFrame, bits: list[str], keep: Callable[[dict, np.ndarray, np.ndarray], np.ndarray], member: str, limit: int = LIMIT) -> DataFrame:
    """Pairs (a < b) of each member of a key with the key's middle, where keep() holds: the member whose bits (long columns)
    differ least from what most members have. Of a bucket of over `limit` members each part has a middle of its own."""

    def found(batches):
        for t in whole_groups(batches, "key", "cell"):
            c = {n: column(t.column(n).combine_chunks()) for n in t.column_names}
            own = (c["cell"] >> 31) == (c["cell"] & 0x7FFFFFFF)
            c = {n: x[own] for n, x in c.items()}
            if not len(c["key"]):
                continue
            group = np.cumsum(np.concatenate([[True], (c["key"][1:] != c["key"][:-1]) | (c["cell"][1:] != c["cell"][:-1])])) - 1
            size = np.bincount(group)
            some = size[group] > 1
            c, group = {n: x[some] for n, x in c.items()}, group[some]
            if not len(group):
                continue
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(head, len(group)))
            word = np.ascontiguousarray(np.stack([c[b] for b in bits], 1))
            far = np.empty(len(group), np.int64)
            for at in range(0, len(head), 2048):  # so many buckets at a time
                lo, hi = head[at], head[at + 2048] if at + 2048 < len(head) else len(group)
                ones = np.unpackbits(word[lo:hi].view(np.uint8).reshape(hi - lo, -1), axis=1)
                many = 2 * np.add.reduceat(ones, head[at : at + 2048] - lo, 0, dtype=np.int32) > size[at : at + 2048, None]
                far[lo:hi] = (ones != np.repeat(many, size[at : at + 2048], 0)).sum(1)
            middle = np.lexsort((c[member], far, group))[head]
            i, j = np.arange(len(group)), np.repeat(middle, size)
            i, j = i[i != j], j[i != j]
            good = keep(c, i, j)
            yield _pairs(c[member][i[good]], c[member][j[good]])

    return dealt(filed, member, None, limit).mapInArrow(found, "a long, b long")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["a", "b"])


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of bytes whose width is a multiple of eight."""
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint64) ^ np.ascontiguousarray(y).view(np.uint64)).sum(1, dtype=np.int64)
