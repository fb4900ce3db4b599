"""Language-model scores: context-tree weighting over bytes, and a word-unigram base score.

Every byte is eight binary decisions; each of the 255 decision nodes has its own context tree over the DEPTH bytes before.
Each node of a tree has a Krichevsky-Trofimov estimate from the training counts; a node's weighted probability is half its
own block probability and half the product of its children's, and the prediction mixes the estimates of all depths by the
weights that this gives. A context never seen predicts as its parent. A text ends with a byte 255, which UTF-8 has not, so
that the scores are those of one distribution over texts.

The trees grow with the corpus: a row for every context seen, holding the decision nodes seen there. They are never brought
together: each depth is one table, made from the next deeper one by summing over a context's at most 256 children, and then,
from the root down, each depth takes its mixture from the one above. A (context, byte) pair that training lacks asks the
depths from the deepest up.

Texts are cut into slices of about SLICE bytes. A slice knows its distinct words and its distinct (context, byte) pairs; it
sends each once, with its training count, packed by parts of the key space. A part sums the counts of all slices; then each
slice's packs meet the finished values there, and the values alone go back, in the order that the slice can make again. So
what is shuffled grows with the distinct keys of slices at a few bytes each, a part holds its distinct keys and streams the
packs, and nothing is broadcast. Words are told apart by 63-bit hashes.

Null texts count as empty: one end token and byte 255. Repeated rows each get the same scores. Rows with null ids count as
training rows. Without training rows every decision has probability one half. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, slices, staged, text_bytes, whole_groups

DEPTH, SLICE = 4, 4 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The decision nodes of each byte (1..255, the root is 1), and the bits taken there.
_PATH = np.array([[(256 + b) >> (8 - k) for k in range(8)] for b in range(256)], np.int64)
_BITS = np.array([[(b >> (7 - k)) & 1 for k in range(8)] for b in range(256)], np.int64)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def coded(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """For each byte of each text and its end: byte << 8 * depth | the bytes before, the nearest highest."""
    if not texts:
        return np.zeros(0, np.int64)
    raw = b"".join(b"\0" * depth + t + b"\xff" for t in texts)
    n = len(raw) - depth
    code = np.ndarray((n,), "<u8", raw + bytes(8), strides=(1,)) & np.uint64((1 << 8 * (depth + 1)) - 1)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    keep = np.ones(n, bool)
    between = (np.cumsum(size)[:-1] + depth * np.arange(len(texts) - 1))[:, None] + np.arange(depth)
    keep[between.ravel()] = False
    return code[keep].view(np.int64)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x >= 0.5 by Stirling's series after a shift by 7."""
    shift = np.zeros_like(x)
    for k in range(7):
        shift += np.log(x + k)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov block probability."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - math.log(math.pi) - lgamma(zeros + ones + 1.0)


#: A row for each context: its nodes (a byte each), and for each node the zeros and ones seen, the log weighted probability
#: and the weight of the own estimate against the children's (float64 each).
LEVEL = "ctx long, nodes binary, zeros binary, ones binary, weighted binary, own binary"
#: From the root down: the chance of a one if the context ends here, and for the children the mixture so far and what is left.
MIXED = "ctx long, nodes binary, chance binary, mixed binary, left binary"


def _flat(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64)


def _nodes(column) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of all rows, and the row of each."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), np.uint8).astype(np.int64), np.repeat(np.arange(len(held)), [len(x) for x in held])


def _packed(row: np.ndarray, rows: int, *flat: np.ndarray) -> list[list[bytes]]:
    """Cuts flat arrays, sorted by row, into a byte string a row."""
    cuts = np.searchsorted(row, np.arange(rows + 1)).tolist()
    return [[f[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for f in flat]


def _level(ctx: np.ndarray, row: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> pa.RecordBatch:
    """The batch of a level from sums over (row, node) pairs, in any order: row is an index into ctx."""
    key, at = np.unique(row * 256 + node, return_inverse=True)
    z, o = np.bincount(at, zeros, len(key)), np.bincount(at, ones, len(key))
    own = log_kt(z, o)
    total, weight = own, np.ones_like(own)
    if children is not None:
        total = np.logaddexp(own, np.bincount(at, children, len(key))) - math.log(2)
        weight = np.exp(own - math.log(2) - total)
    packed = _packed(key // 256, len(ctx), (key % 256).astype(np.uint8), z, o, total, weight)
    return pa.RecordBatch.from_arrays([pa.array(ctx), *map(pa.array, packed)], ["ctx", "nodes", "zeros", "ones", "weighted", "own"])


def leaves(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The deepest level, from code, n > 0."""
    shift = 8 * depth

    def apply(batches):
        for t in whole_groups(batches, "ctx"):
            code, n = t.column("code").to_numpy(), t.column("n").to_numpy()
            ctx, row = np.unique(t.column("ctx").to_numpy(), return_inverse=True)
            byte = code >> shift
            bits = _BITS[byte]
            yield _level(ctx, np.repeat(row, 8), _PATH[byte].ravel(), ((1 - bits) * n[:, None]).ravel(), (bits * n[:, None]).ravel(), None)

    rows = counts.select((F.col("code") % (1 << shift)).alias("ctx"), "code", "n")
    return rows.repartition("ctx").sortWithinPartitions("ctx").mapInArrow(apply, LEVEL)


def above(level: DataFrame) -> DataFrame:
    """The level above: contexts without their farthest byte."""

    def apply(batches):
        for t in whole_groups(batches, "parent"):
            parent, row = np.unique(t.column("parent").to_numpy(), return_inverse=True)
            node, of = _nodes(t.column("nodes"))
            yield _level(parent, row[of], node, _flat(t.column("zeros")), _flat(t.column("ones")), _flat(t.column("weighted")))

    rows = level.select(F.shiftright("ctx", 8).alias("parent"), "nodes", "zeros", "ones", "weighted")
    return rows.repartition("parent").sortWithinPartitions("parent").mapInArrow(apply, LEVEL)


def below(level: DataFrame, parents: DataFrame | None) -> DataFrame:
    """MIXED rows of a level from those of the level above it (None at the root)."""
    root = parents is None

    def apply(batches):
        for t in whole_groups(batches, "parent"):
            mine = t.filter(t.column("ctx").is_valid())
            node, of = _nodes(mine.column("nodes"))
            zeros, ones, own = (_flat(mine.column(c)) for c in ("zeros", "ones", "own"))
            mixed, left = np.zeros(len(node)), np.ones(len(node))
            if not root:
                theirs = t.filter(t.column("ctx").is_null())
                over, by = _nodes(theirs.column("nodes"))
                number = theirs.column("parent").to_numpy()
                place = np.searchsorted(number * 256, mine.column("parent").to_numpy() * 256)
                at = np.searchsorted(by * 256 + over, place[of] * 256 + node)  # a child's nodes are among its parent's
                mixed, left = _flat(theirs.column("mixed"))[at], _flat(theirs.column("left"))[at]
            chance = (ones + 0.5) / (zeros + ones + 1)
            packed = _packed(of, mine.num_rows, mixed + left * chance, mixed + left * own * chance, left * (1 - own))
            yield pa.RecordBatch.from_arrays([mine.column("ctx").combine_chunks(), mine.column("nodes").combine_chunks(), *map(pa.array, packed)], ["ctx", "nodes", "chance", "mixed", "left"])

    none = F.lit(None).cast("binary")
    rows = level.select(F.shiftright("ctx", 8).alias("parent"), "ctx", "nodes", "zeros", "ones", "own", none.alias("mixed"), none.alias("left"))
    if not root:
        rows = rows.unionByName(parents.select(F.col("ctx").alias("parent"), F.lit(None).cast("long").alias("ctx"), "nodes", none.alias("zeros"), none.alias("ones"), none.alias("own"), "mixed", "left"))
    return rows.repartition("parent").sortWithinPartitions("parent", F.col("ctx").asc_nulls_first()).mapInArrow(apply, MIXED)


def trees(counts: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """MIXED tables by depth, staged, from code, n > 0."""
    levels = [staged(leaves(counts, depth), "ctw-level")]
    for _ in range(depth):
        levels.append(staged(above(levels[-1]), "ctw-level"))
    out: list[DataFrame] = []
    for level in levels[::-1]:
        out.append(staged(below(level, out[-1] if out else None), "ctw-mixed"))
        discard(level)
    return out


def asked(codes: DataFrame, mixed: list[DataFrame]) -> DataFrame:
    """code, value (log10 of the byte's probability after its context) for distinct `code`s, by the depths from the deepest up."""
    depth = len(mixed) - 1
    shift = 8 * depth

    def make():
        def f(c):
            out = []
            for code, chance, nodes, ones in zip(*c, strict=True):
                p = np.frombuffer(chance, np.float64)
                if nodes is not None and np.isnan(p).any():
                    have, path = np.frombuffer(nodes, np.uint8), _PATH[code >> shift]
                    at = np.minimum(np.searchsorted(have, path), len(have) - 1)
                    p = np.where(np.isnan(p) & (have[at] == path), np.frombuffer(ones, np.float64)[at], p)
                out.append(p.tobytes())
            return {"code": c[0], "chance": out}

        return f

    rows = codes.select("code", F.lit(np.full(8, np.nan).tobytes()).alias("chance"))
    for d in range(depth, -1, -1):
        level = mixed[d].select("ctx", "nodes", F.col("chance").alias("ones"))
        joined = rows.join(level, F.shiftright(F.col("code") % (1 << shift), 8 * (depth - d)) == F.col("ctx"), "left").select("code", "chance", "nodes", "ones")
        rows = staged(map_rows(joined, make, "code long, chance binary"), "ctw-asked")  # no task runs two of these at once

    def valued():
        def f(c):
            p = np.frombuffer(b"".join(c[1]), np.float64).reshape(-1, 8)
            code = np.array(c[0], np.int64)
            p = np.where(np.isnan(p), 0.5, p)
            return {"code": code, "value": np.log10(np.where(_BITS[code >> shift] == 1, p, 1 - p)).sum(1)}

        return f

    return map_rows(rows, valued, "code long, value double")


def known(mixed: DataFrame, depth: int) -> DataFrame:
    """code, value for every pair that training has, from the deepest level (a byte was seen where its last decision was)."""
    shift = 8 * depth

    def apply(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                ctx = part.column(0).to_numpy()
                node, row = _nodes(part.column(1))
                chance = np.full((len(ctx), 256), np.nan)
                chance[row, node] = _flat(part.column(2))
                value = np.zeros((len(ctx), 256))
                for k in range(8):
                    p = chance[:, _PATH[:, k]]
                    value += np.log10(np.where(_BITS[:, k] == 1, p, 1 - p))
                r, byte = np.nonzero(~np.isnan(value))
                yield pa.RecordBatch.from_arrays([pa.array(byte << shift | ctx[r]), pa.array(value[r, byte])], ["code", "value"])

    return mixed.select("ctx", "nodes", "chance").mapInArrow(apply, "code long, value double")


def values(codes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """code, value for distinct codes with their training counts n (0 for those that only held-out texts have)."""
    mixed = trees(codes.where("n > 0"), depth)
    # a byte's last decision also stands for its sibling: the pairs that were not asked for go in the join
    seen = staged(known(mixed[-1], depth), "ctw-known").join(codes.where("n > 0").select("code"), "code")
    return seen.unionByName(asked(codes.where("n = 0"), mixed))


def sliced(docs: DataFrame, size: int = SLICE) -> DataFrame:
    """sid, ids, lengths, pack: consecutive texts of together about `size` bytes (one may be longer), zstd-compressed."""

    def apply(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        ids, texts, total = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([z.compress(b"".join(texts))])], ["ids", "lengths", "pack"])

        for batch in batches:
            for part in slices(batch):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if texts and total + len(t or b"") > size:
                        yield row()
                        ids, texts, total = [], [], 0
                    ids.append(i)
                    texts.append(t or b"")
                    total += len(texts[-1])
        if texts:
            yield row()

    return docs.mapInArrow(apply, "ids array<long>, lengths array<long>, pack binary").select(F.monotonically_increasing_id().alias("sid"), "*")


def _texts(lengths: list[int], pack: bytes) -> list[bytes]:
    import zstandard

    raw, cuts = zstandard.ZstdDecompressor().decompress(pack), np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Numbers:
    """Numbers (not negative) to ids in the order in which they first came, by open addressing."""

    def __init__(self):
        self.bits, self.count = 12, 0
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.found = np.zeros(1 << self.bits, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).view(np.int64)

    def _grow(self, more: int) -> None:
        """Room for so many new numbers at half load."""
        if 2 * (self.count + more) <= len(self.keys):
            return
        while 2 * (self.count + more) > 1 << self.bits:
            self.bits += 1
        old, self.count = self.found[: self.count], 0
        self.keys, self.values, self.found = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int64)
        self._ids(old)

    def ids(self, key: np.ndarray) -> np.ndarray:
        out = np.empty(len(key), np.int32)
        for at in range(0, len(key), 1 << 17):
            part = key[at : at + (1 << 17)]
            out[at : at + (1 << 17)] = self._ids(part)
        return out

    def _ids(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        missing = np.flatnonzero(self.keys[slot] != key)
        if len(missing):
            # each missing number once, in the order of its first place
            number, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            by = np.argsort(first)
            bits = self.bits
            self._grow(len(number))
            if bits != self.bits:
                slot = self._slot(key)
            ids = np.empty(len(number), np.int32)
            ids[by] = self._put(number[by])
        out = self.values[slot]
        if len(missing):
            out[missing] = ids[back]
        return out

    def _put(self, number: np.ndarray) -> np.ndarray:
        """Ids of distinct numbers, each looked up and put in if it is new."""
        slot, out = self._slot(number), np.full(len(number), -1, np.int32)
        new = np.zeros(len(number), bool)
        todo = np.arange(len(number))
        while len(todo):
            held = self.keys[slot[todo]]
            hit = held == number[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            free = todo[held == -1]
            take = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[take]], new[take] = number[take], True
            todo = todo[~hit & ~new[todo]]
            busy = self.keys[slot[todo]] != number[todo]
            slot[todo[busy]] = (slot[todo[busy]] + 1) & (len(self.keys) - 1)
        at = np.flatnonzero(new)
        out[at] = self.count + np.arange(len(at), dtype=np.int32)
        self.values[slot[at]] = out[at]
        self.found[self.count : self.count + len(at)] = number[at]
        self.count += len(at)
        return out

    def numbers(self) -> np.ndarray:
        return self.found[: self.count]


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.random.default_rng(17).integers(0, 1 << 64, 256, np.uint64)
_POWERS: list[np.ndarray] = []
#: The key of the end of a text; parts of a slice that are worked through at once.
END, PART = 0, 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        base = np.array([int(_MULTIPLIER), pow(int(_MULTIPLIER), -1, 1 << 64)], np.uint64)
        p = np.repeat(base[:, None], max(n, 2 * PART) + 1, 1)
        p[:, 0] = 1
        _POWERS[:] = list(np.multiply.accumulate(p, 1))
    return _POWERS[0], _POWERS[1]


_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, A-Z in lower case, and how many words each text has."""
    low = np.frombuffer(b" ".join([*texts, b""]).translate(_LOWER), np.uint8)
    gap = np.concatenate([[True], _GAP[low]])
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    power, inverse = _powers(len(low))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[low] * power[: len(low)], dtype=np.uint64)])
    key = (total[end] - total[start]) * inverse[start]
    key = (key ^ (key >> np.uint64(31))) * _MULTIPLIER >> np.uint64(1)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    return key.view(np.int64), np.diff(np.searchsorted(start, edges))


def _parts(texts: list[bytes]):
    """Runs of texts of about PART bytes."""
    at = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > PART:
            yield texts[at:i]
            at, total = i, 0
        total += len(t)
    yield texts[at:]


def worded(texts: list[bytes], held: Numbers):
    """For runs of texts: the id of each token's key in `held` (a text's end comes last, as END) and the tokens of each text."""
    ends = held.ids(np.array([END], np.int64))
    for part in _parts(texts):
        key, n = word_keys(part)
        yield np.insert(held.ids(key), np.cumsum(n), ends[0]), n + 1


def paired(texts: list[bytes], held: Numbers, depth: int):
    """For runs of texts: the id of each byte's code in `held` and the bytes of each text, its end counted."""
    for part in _parts(texts):
        yield held.ids(coded(part, depth)), np.array([len(t) + 1 for t in part], np.int64)


def counted(runs, held: Numbers, train: np.ndarray) -> np.ndarray:
    """How often each number occurs in the training texts."""
    out, at = np.zeros(0, np.int64), 0
    for ids, sizes in runs:
        more = np.bincount(ids[np.repeat(train[at : at + len(sizes)], sizes)], minlength=held.count)
        more[: len(out)] += out
        out, at = more, at + len(sizes)
    return out


def added(runs, *values: np.ndarray) -> list[np.ndarray]:
    """For each text the sums of the values of its ids, and how many there are."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(values) + 1)]
    for ids, sizes in runs:
        starts = np.cumsum(sizes) - sizes
        for k, v in enumerate(values):
            out[k].append(np.add.reduceat(v[ids], starts))
        out[-1].append(sizes)
    return [np.concatenate(x) for x in out]


def part_of(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by part and number, and the part of each number in it."""
    part = part_of(key, bits)
    by = np.lexsort((key, part))
    return by, part[by]


def _squeezed(x: np.ndarray, z) -> bytes:
    """Differences of sorted numbers, or plain ones, compressed; bytes of one place stand together."""
    wide = np.diff(x, prepend=x.dtype.type(0))
    return z.compress(wide.view(np.uint8).reshape(len(x), -1).T.tobytes())


def _loose(data: bytes, dtype, z) -> np.ndarray:
    raw = np.frombuffer(z.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype)[:, 0], dtype=dtype)


#: A slice's keys of one kind (0 words, 1 codes) in one part, sorted, with their training counts.
PACKS = "kind int, part long, sid long, keys binary, n binary"


def packs(cut: DataFrame, depth: int, bits: int) -> DataFrame:
    def apply(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for sid, ids, lengths, pack in _one_by_one(batches):
            texts = _texts(lengths, pack)
            train = np.array([not is_held_out(i) for i in ids])
            for kind in (0, 1):
                held = Numbers()
                n = counted(paired(texts, held, depth) if kind else worded(texts, held), held, train)
                by, part = ordered(held.numbers(), bits)
                key, n = held.numbers()[by], n[by]
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
                rows = [(kind, int(part[a]), sid, _squeezed(key[a:b], z), _squeezed(n[a:b], z)) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["kind", "part", "sid", "keys", "n"])

    return cut.select("sid", "ids", "lengths", "pack").mapInArrow(apply, PACKS)


def summed(packed: DataFrame) -> DataFrame:
    """kind, part, keys, n: the counts of all slices, a row a kind and part; total and distinct: the sum, and how many are not 0."""
    target = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])

    def apply(batches):
        import zstandard

        z, y = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)

        def merged(held):
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)

        def row(of, held):
            key, n = merged(held)
            return pa.RecordBatch.from_pylist([{"kind": of[0], "part": of[1], "keys": _squeezed(key, y), "n": _squeezed(n, y), "total": int(n.sum()), "distinct": int((n > 0).sum())}], schema=target)

        of, held, size = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                kind, part, keys, n = (c[i].as_py() for c in batch.columns)
                if (kind, part) != of:
                    if held:
                        yield row(of, held)
                    of, held, size = (kind, part), [], 0
                held.append((_loose(keys, np.int64, z), _loose(n, np.int64, z)))
                size += len(held[-1][0])
                if size > 1 << 20 and len(held) > 1 and size > 2 * len(held[0][0]):
                    held = [merged(held)]
                    size = len(held[0][0])
        if held:
            yield row(of, held)

    rows = packed.select("kind", "part", "keys", "n").repartition("kind", "part").sortWithinPartitions("kind", "part")
    return rows.mapInArrow(apply, "kind int, part long, keys binary, n binary, total long, distinct long")


def unpacked(table: DataFrame) -> DataFrame:
    """code, n of the rows of summed() that hold codes."""

    def apply(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for keys, n in _one_by_one(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_loose(keys, np.int64, z)), pa.array(_loose(n, np.int64, z))], ["code", "n"])

    return table.where("kind = 1").select("keys", "n").mapInArrow(apply, "code long, n long")


def repacked(value: DataFrame, bits: int) -> DataFrame:
    """kind, part, keys, n: values (float32) packed as summed() packs counts."""

    def placed(batches):
        for batch in batches:
            code = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(part_of(code, bits)), batch.column(0), batch.column(1)], ["part", "code", "value"])

    def apply(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for t in whole_groups(batches, "part"):
            part = t.column("part").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
            code, value = t.column("code").to_numpy(), t.column("value").to_numpy().astype(np.float32)
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([int(part[a])]), pa.array([_squeezed(code[a:b], z)]), pa.array([z.compress(value[a:b].tobytes())])], ["kind", "part", "keys", "n"])

    rows = value.select("code", "value").mapInArrow(placed, "part long, code long, value double")
    return rows.repartition("part").sortWithinPartitions("part", "code").mapInArrow(apply, "kind int, part long, keys binary, n binary")


def answered(packed: DataFrame, table: DataFrame) -> DataFrame:
    """sid, kind, part, values: for each pack what the table has for its keys (counts as int64, values as float32), in their order."""

    def apply(batches):
        import zstandard

        z, y = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        key = value = None
        for kind, part, sid, keys, n in _one_by_one(batches):
            if sid is None:
                key = _loose(keys, np.int64, z)
                value = np.frombuffer(z.decompress(n), np.float32) if kind else _loose(n, np.int64, z)
                continue
            got = value[np.searchsorted(key, _loose(keys, np.int64, z))]
            yield pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([kind], pa.int32()), pa.array([part]), pa.array([y.compress(got.tobytes()) if kind else _squeezed(got, y)])], ["sid", "kind", "part", "values"])

    rows = table.select("kind", "part", F.lit(None).cast("long").alias("sid"), "keys", "n").unionByName(packed.select("kind", "part", "sid", "keys", F.lit(None).cast("binary").alias("n")))
    return rows.repartition("kind", "part").sortWithinPartitions("kind", "part", F.col("sid").asc_nulls_first()).mapInArrow(apply, "sid long, kind int, part long, values binary")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, size: int = SLICE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (code length, the end counted as a byte)."""
    cut = staged(sliced(text_bytes(df, id_col, text_col), size), "ctw-slices")
    bits = max(4, math.ceil(math.log2(max(1, cut.count()) / 16 + 1)))  # a part has at most some million keys, even if slices share none
    packed = staged(packs(cut, depth, bits), "ctw-packs")
    sums = staged(summed(packed), "ctw-sums")
    total, distinct = sums.where("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    value = repacked(staged(values(staged(unpacked(sums), "ctw-codes"), depth), "ctw-code-values"), bits)
    table = staged(sums.where("kind = 0").select("kind", "part", "keys", "n").unionByName(value), "ctw-values")
    answers = answered(packed, table).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("kind", "part", "values"))).alias("got"))

    def apply(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for ids, lengths, pack, got in _one_by_one(batches):
            texts = _texts(lengths, pack)
            sums = []
            for kind in (0, 1):
                held = Numbers()
                runs = list(paired(texts, held, depth) if kind else worded(texts, held))  # the numbers come in the order in which they were packed
                mine = [z.decompress(g["values"]) if kind else _loose(g["values"], np.int64, z) for g in got if g["kind"] == kind]
                value = np.empty(held.count)
                value[ordered(held.numbers(), bits)[0]] = np.frombuffer(b"".join(mine), np.float32) if kind else np.concatenate(mine)
                sums.append(added(runs, value) if kind else added(runs, (value > 0).astype(np.int64), np.log10(value + 1)))
            (known_, base, sizes), (bits_, _) = sums
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(known_), pa.array(base), pa.array(bits_), pa.array(bits_ * -math.log2(10) / (np.array(lengths) + 1))],
                ["doc_id", "n_tokens", "n_known", "base", "score", "bits_per_byte"],
            )

    rows = cut.join(answers, "sid").select("ids", "lengths", "pack", "got")
    rows = rows.mapInArrow(apply, "doc_id long, n_tokens long, n_known long, base double, score double, bits_per_byte double")
    out_of = math.log10(total + distinct + 1)
    return rows.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * out_of).alias("base_score"), "score", "bits_per_byte")


def _one_by_one(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]
