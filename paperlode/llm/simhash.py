"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming check, components.

Fingerprints are 64-bit. Two that differ in at most BITS bits agree wholly on at least BLOCKS - BITS of BLOCKS blocks, so
each fingerprint is filed under every choice of that many blocks, joined there, and pairs are then checked exactly. Only
distinct fingerprints are filed: copies meet before any join, and one text's thousand copies are one entry.

The check is part of the join's condition, and a pair is made only at the first choice of blocks that it shares, so the
join returns each link once. A member of a block value is compared with at most CROWDED others. In a more crowded value
(CROWDED distinct fingerprints around one much-edited text) no pairs are tried: each member instead sends itself to the
2,081 values within two bits of it. Two fingerprints within four bits meet at such a value, and any two that meet are
within four bits, so a link from each to the least one there keeps components exact at a cost that grows with the members,
not with their square. Nothing is dropped on either way; CROWDED only chooses between them, at about where they cost
the same (a comparison takes nanoseconds, a row sent to a value a microsecond).

Null texts count as empty: fingerprint zero, linked like any other. Rows repeat as they come; null doc_ids get the
component of their fingerprint. Columns other than the id and text are not read.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import LIMIT, chained, differing, starred
from .common import discard, map_rows, sieve, sifted, staged, text_bytes
from .components import components

BITS, BLOCKS, WIDTH, SEED, CROWDED = 4, 6, 4, 42, 4096

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, width: int = WIDTH, seed: int = SEED) -> list[int]:
    """Unsigned XXH64 of each shingle of the lower-cased words, repeats included."""
    import xxhash

    words = _WORDS(text.translate(_LOWER))
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: bytes | None, width: int = WIDTH, seed: int = SEED) -> int:
    hashes = shingle_hashes(text or b"", width, seed)
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        part = np.array(hashes[start : start + 65536], np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def make():
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda c: {"doc_id": c[0], "fp": [signed(fingerprint(t, width, seed)) for t in c[1]]}

    return map_rows(text_bytes(df, id_col, text_col), make, "doc_id long, fp long")


def block_masks(bits: int = BITS, blocks: int = BLOCKS) -> list[int]:
    """The masks of every choice of blocks - bits blocks, as signed longs."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(single, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS, crowded: int = CROWDED) -> DataFrame:
    """From distinct `fp`: pairs (a, b) within `bits` bits whose components are those of all such pairs."""
    masks = F.array(*[F.lit(m) for m in block_masks(bits, blocks)])
    filed = fps.select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = filed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    filed = staged(filed.join(sizes, ["k", "key"]), "simhash-blocks")
    few = filed.where(F.col("n") <= crowded).select("k", "key", "fp")
    left, right = few.select("k", "key", F.col("fp").alias("a")), few.select(F.col("k").alias("k2"), F.col("key").alias("key2"), F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first_shared = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(block_masks(bits, blocks))])
    pairs = left.join(right, (F.col("k") == F.col("k2")) & (F.col("key") == F.col("key2")) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= bits) & (F.col("k") == first_shared)).select("a", "b")
    half = bits // 2
    ones = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    flips = F.array(*[F.lit(_xor(c)) for n in range(half + 1) for c in itertools.combinations(ones, n)])
    far = bits - 2 * half  # an odd bound: one side may flip one more
    if far:
        flips = F.array(*[F.lit(_xor(c)) for n in range(half + 2) for c in itertools.combinations(ones, n)])
    many = filed.where(F.col("n") > crowded).select("fp").distinct()
    near = many.select("fp", F.explode(flips).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("at"))
    least = near.groupBy("at").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("at", "a")
    star = near.join(least, "at").where("a <> fp").select("a", F.col("fp").alias("b"))
    if far:
        star = star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return pairs.unionByName(star.distinct())


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links)."""
    docs = staged(fingerprints(df, id_col, text_col, width), "simhash")
    first = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(docs.select("fp").distinct(), bits, blocks))
    every = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = every.join(every.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Wide fingerprints: the chance that a pair at the similarity shares no block, and how far their Hamming distance may lie
#: above its mean, in standard deviations (3e-5). Of the blocks, FIRST make stars.
MISS, SPREAD, FIRST = 1e-2, 4, 8
#: Bits of a fingerprint that are compared within a block before the whole.
SKETCH = 256
#: Texts that are compared themselves are dealt in parts of so many, into so many parts before parts grow, and so many bytes.
PART, PARTS, PART_BYTES = 512, 16, 8 << 20


def differing_share(similarity: float) -> float:
    """Share of the bits that differ between the fingerprints of two sets of one size with this Jaccard similarity: the
    angle between them over pi (Charikar, 2002)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_shape(rows: int, similarity: float, miss: float = MISS) -> tuple[int, int]:
    """Blocks and bits of a block: fewer than one unrelated text shares a block's value, however many there are."""
    width = max(16, math.ceil(math.log2(max(1, rows))) + 1)
    agree = (1 - differing_share(similarity)) ** width
    return math.ceil(math.log(miss) / math.log(1 - agree)), width


def most_differing(bits: int, similarity: float) -> int:
    p = differing_share(similarity)
    return math.floor(bits * p + SPREAD * math.sqrt(bits * p * (1 - p)))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text or b"", width), np.uint64))


def wide_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set in words * 64 bits, as bytes."""
    salts = np.random.default_rng(SEED).integers(0, 1 << 64, words, np.uint64)
    ones = np.zeros(64 * words, np.int64)
    for start in range(0, len(h), 2048):
        x = (h[start : start + 2048, None] ^ salts) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(h))


def block_keys(fp: np.ndarray, blocks: int, width: int) -> np.ndarray:
    """(n, blocks) from (n, bytes): each block's value with the block's number, as longs."""
    bits = np.unpackbits(fp, axis=1)[:, : blocks * width].reshape(len(fp), blocks, width)
    value = np.zeros((len(fp), blocks), np.int64)
    for k in range(width):
        value = (value << 1) | bits[:, :, k]
    return (value << 20) | np.arange(blocks)


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of shingle hashes, not both empty, have this Jaccard similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """Of pairs (a, b) of nodes those whose shingle sets are alike, staged. texts: part, text; only those of the pairs go on."""
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = staged(ids.join(nodes.select("node", "part"), "node"), "near-ids")
    some = sifted(texts, "part", sieve(ids.select("part")))
    need = staged(some.join(ids, "part").dropDuplicates(["part"]).select("node", "text"), "near-texts")

    def make():
        held: dict[bytes, np.ndarray] = {}

        def known(t):
            if t not in held:
                if len(held) >= 64:
                    held.clear()
                held[t] = shingle_set(t, width)
            return held[t]

        def f(c):
            good = [(a, b) for a, b, x, y in zip(*c, strict=True) if alike(known(x), known(y), similarity)]
            return {"a": [a for a, _ in good], "b": [b for _, b in good]}

        return f

    both = pairs.join(need.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(need.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    out = staged(map_rows(both.select("a", "b", "x", "y"), make, "a long, b long"), "near-links")
    discard(need)
    discard(ids)
    return out


def joined(members: DataFrame, texts: DataFrame, similarity: float, width: int, most: int) -> DataFrame:
    """From key, node, root, part, size and fp: pairs (a, b) of roots that join all roots whose members, of one key, are alike,
    staged. Texts (part, text) come once to each cell of a key, where the sets themselves are compared."""
    ids = staged(members.select("key", "root", "size", "fp", "part"), "near-ids")
    some = sifted(texts, "part", sieve(ids.select("part")))
    need = staged(some.join(ids, "part").dropDuplicates(["part"]).select("key", "root", "size", "fp", "text"), "near-texts")

    def near(c, i, j):
        x, y = c["size"][i], c["size"][j]
        good = np.flatnonzero(np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9)
        out = np.zeros(len(i), bool)
        for at in range(0, len(good), 1 << 16):
            k = good[at : at + (1 << 16)]
            out[k] = differing(c["fp"][i[k]], c["fp"][j[k]]) <= most
        return out

    def sure(c, i, j):
        held = c.setdefault("_sets", {})
        for k in (i, j):
            if k not in held:
                held[k] = shingle_set(c["text"][k], width)
        return alike(held[i], held[j], similarity)

    n, size = F.count("*"), F.sum(F.octet_length("text"))
    parts = F.greatest(F.least(F.ceil(n / PART), F.lit(PARTS)), F.ceil(n / LIMIT), F.ceil(size / PART_BYTES))
    out = staged(chained(need, near, "root", "fp", parts=parts, sure=sure, whole=("text",)), "near-links")
    discard(need)
    discard(ids)
    return out


def groups(df: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """doc_id, part (a hash of the text), root: one row for each row; rows share a root if links of this Jaccard similarity
    join their shingle sets.

    A node is a distinct shingle set, whatever ids its rows have. Its SimHash is wide enough for so many blocks that a pair at
    the similarity shares one but for `miss`. In the first blocks each member of a value is tried with the middle one there,
    which makes the copies of a text one component at a cost that grows with their number. Then in all blocks every pair of
    different components is tried by its sketch, and what connects components by sketches makes ranges of them, a row for
    each step and not for each pair. Within a range every pair of different components is tried by its Hamming distance,
    then by the sets themselves, so that every link is a true one. Null and empty texts are one node.
    """
    blocks, bits = wide_shape(df.count(), similarity, miss)
    words = -(-blocks * bits // 64)
    most = most_differing(64 * words, similarity)

    def make():
        import xxhash

        signed = lambda x: x - (1 << 64) if x >> 63 else x

        def f(c):
            sets = [shingle_set(t, width) for t in c[2]]
            return {
                "doc_id": c[0], "part": c[1], "node": [signed(xxhash.xxh64_intdigest(h.tobytes(), width)) for h in sets], "size": [len(h) for h in sets],
                "fp": [wide_fingerprint(h, words).tobytes() if len(h) else None for h in sets],
            }

        return f

    text = F.col(text_col).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("part"), text.alias("text"))
    docs = staged(map_rows(rows, make, "doc_id long, part long, node long, size long, fp binary"), "near")
    nodes = staged(docs.where("size > 0").select("node", "part", "size", "fp").dropDuplicates(["node"]), "near-nodes")
    texts = rows.select("part", "text")

    def filed(df: DataFrame, some: int) -> DataFrame:
        """From node, fp and more: key, node and more, for the first `some` blocks."""

        names = df.columns

        def keys():
            def f(c):
                out = dict(zip(names, c, strict=True))
                fp = np.frombuffer(b"".join(out["fp"]), np.uint8).reshape(len(out["fp"]), -1)
                return out | {"keys": list(block_keys(fp, some, bits))}

            return f

        kinds = ", ".join(f"{n} {t}" for n, t in df.dtypes)
        return map_rows(df, keys, f"{kinds}, keys array<bigint>").select(*names, F.explode("keys").alias("key"))

    def fits(a: str, b: str):
        return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9

    def closer(pairs: DataFrame) -> DataFrame:
        """Pairs of nodes whose sizes and whole fingerprints allow the similarity, staged."""
        for end in "ab":
            pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("fp").alias(f"fp_{end}")), end)
        return staged(map_rows(pairs.where(fits("size_a", "size_b")).select("a", "b", "fp_a", "fp_b"), close, "a long, b long"), "near-pairs")

    def close():
        def f(c):
            x, y = (np.frombuffer(b"".join(m), np.uint8).reshape(len(m), -1) for m in c[2:])
            keep = differing(x, y) <= most if len(x) else np.zeros(0, bool)
            return {"a": np.array(c[0], np.int64)[keep], "b": np.array(c[1], np.int64)[keep]}

        return f

    halves = [F.conv(F.hex(F.substring("fp", 1 + 8 * k, 8)), 16, -10).cast("long").alias(f"s{k}") for k in range(SKETCH // 64)]
    some = most_differing(SKETCH, similarity)

    def near(c, i, j):
        x, y = c["size"][i], c["size"][j]
        differ = sum(np.bitwise_count((c[f"s{k}"][i] ^ c[f"s{k}"][j]).view(np.uint64)).astype(np.int64) for k in range(SKETCH // 64))
        return (differ <= some) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9)

    first = filed(nodes.select("node", "size", "fp"), min(FIRST, blocks)).select("key", "node", "size", *halves)
    star = starred(first, [f"s{k}" for k in range(SKETCH // 64)], near, "node").distinct()
    star = closer(star)
    sure = verified(star, nodes, texts, similarity, width)
    known = components(sure).withColumnRenamed("node", "_n")

    rooted = nodes.join(known, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("root", "node").alias("root"), "part", F.col("size").cast("int").alias("size"), "fp")
    rooted = staged(rooted, "near-rooted")
    entries = filed(rooted.select("root", "size", "fp"), blocks).select("key", "root", "size", *halves)
    ranges = components(chained(entries, near, "root", [f"s{k}" for k in range(SKETCH // 64)]))
    ranges = ranges.unionByName(ranges.select(F.col("root").alias("node"), "root").distinct())  # the least of each, too
    members = rooted.join(ranges.select(F.col("node").alias("root"), F.col("root").alias("key")), "root")
    more = joined(members, texts, similarity, width, most)
    roots = components(sure.unionByName(more)).withColumnRenamed("node", "_n")
    return docs.select("doc_id", "part", "node").join(roots, F.col("node") == F.col("_n"), "left").select("doc_id", "part", F.coalesce("root", "node").alias("root"))


def similar(df: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: the least doc_id (null if all are) of a row's group, see groups()."""
    docs = staged(groups(df, similarity, width, id_col, text_col), "near-groups")
    least = docs.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return docs.join(least, "root").select("doc_id", "component_id")
