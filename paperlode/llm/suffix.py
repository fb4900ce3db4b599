"""Suffix-array dedup: removes every byte covered by a SPAN-byte string that also starts earlier in the corpus.

Sharding by content. Each window of SPAN bytes has an anchor: the leftmost least hash among its GRAM-byte substrings.
Equal windows have equal anchors, so a window need only meet the windows of its anchor's hash. Anchors that occur once
are dropped by a count; for the rest, the stretch of windows that an anchor serves is cut out (under 2 * SPAN bytes) and
sent to the shard of its hash. An anchor hash with over SALT occurrences is dealt to several shards.

In a shard: equal stretches are folded into their first; a suffix array of the rest is built by Larsson-Sadakane
refinement (groups of equal prefixes are split by the ranks of the suffixes behind them, doubling the prefix each round,
and sorted groups drop out); common prefixes come from Kasai's scan, run over all stretches in step. Neighbours with SPAN
or more common bytes are equal windows; all but the earliest are repeats.

Across shards: where an anchor was dealt to several shards, each shard passes on one window for each of its groups; these
are sorted by a 128-bit digest and the shards' lists merged by binary search for each digest's first entry.

The order is (doc_id, start); null ids come last, and rows that share an id but not a text are separate documents, in the
order of a hash of the text. Rows equal in both are one document and share its result. A text that repeats itself on and on
is one row for each run of repeats, not one for each place. Null texts count as empty; texts
under SPAN bytes lose nothing. Other columns are not read. Every group is bounded by SALT occurrences in expectation, and
a worker holds BATCH bytes of stretches at a time.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, staged

SPAN, GRAM, SALT, BATCH = 100, 32, 512, 2 << 20
LAST_ID = (1 << 63) - 1
_TABLE = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position (GRAM is a power of two, at most 32)."""
    h, width = _TABLE[raw], 1
    for factor in _FACTORS:
        if width == GRAM:
            break
        h = h[:-width] * factor + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over all texts: h (of each anchor), text (its index), first (window start in the text), windows (how many in a row)."""
    none = np.zeros(0, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    if not len(size) or size.max() < SPAN:
        return none.astype(np.uint64), none, none, none
    raw = np.frombuffer(b"".join(texts) + bytes(2 * SPAN), np.uint8)
    h = gram_hashes(raw)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, width = SPAN - GRAM + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    starts = np.cumsum(size) - size
    n = np.maximum(size - SPAN + 1, 0)
    at = low[: int(starts[-1] + size[-1])].astype(np.uint32)  # the place of each window's anchor
    new = np.empty(len(at) + 1, bool)
    new[0] = new[-1] = True
    new[1:-1] = at[1:] != at[:-1]
    new[starts] = new[starts + n] = True
    cut = np.flatnonzero(new)
    length, cut = np.diff(cut), cut[:-1]
    text = np.searchsorted(starts, cut, "right") - 1
    inside = cut - starts[text]
    keep = inside < n[text]
    cut, text = cut[keep], text[keep]
    return h[at[cut]], text, inside[keep], length[keep]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of `text` (small non-negative ints) in the order of their suffixes; a suffix that is another's prefix comes first."""
    n = len(text)
    bits = max(1, int(text.max(initial=1)).bit_length())
    width = 63 // bits
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, np.int64)])
    for i in range(width):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    split = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    place = np.arange(n)  # places in `order` of groups that are not settled, group by group
    while len(place):
        head = np.flatnonzero(split)
        size = np.diff(np.append(head, len(place)))
        rank[order[place]] = np.repeat(place[head], size)
        place = place[np.repeat(size, size) > 1]
        at = order[place]
        key = rank[at] * (n + 1) + rank[np.minimum(at + width, n)] + 1
        by = np.argsort(key)
        order[place], key = at[by], key[by]
        split = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        width *= 2
    return order


def _leading(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes of each word, from the highest, are zero."""
    return sum((x >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(8))


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Kasai's scan, one step at a time over all stretches: common symbols (up to `most`) of order[i - 1] and order[i].

    A stretch runs from starts[k] for lengths[k] symbols; the scan moves along each, losing at most one common symbol a
    step. Symbols are below 256 and compared eight at a time; none beyond the end of the text is common.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    word = np.zeros(n + 1, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + n + 1]
    held = np.zeros(len(starts), np.int64)
    for step in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(step < lengths)
        at = starts[live] + step
        where = place[at]
        before = order[np.maximum(where - 1, 0)]
        common = np.where(where > 0, held[live], 0)
        grow = np.flatnonzero((where > 0) & (common < most))
        while len(grow):
            a, b, c = at[grow], before[grow], common[grow]
            equal = _leading(word[np.minimum(a + c, n)] ^ word[np.minimum(b + c, n)])
            common[grow] = c + equal
            grow = grow[(equal == 8) & (c + 8 < most) & (np.maximum(a, b) + c + 8 < n)]
        common = np.minimum(np.minimum(common, most), n - np.maximum(at, before))
        out[where] = common
        held[live] = np.maximum(common - 1, 0)
    return out


def shard(stretches: list[bytes], owner: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows among distinct stretches. owner and first give each one's document rank and start there.

    Returns stretch and offset of every window that repeats an earlier one, and of the earliest of every group.
    """
    length = np.array([len(s) for s in stretches], np.int64)
    text = np.frombuffer(b"".join(s + b"\0" for s in stretches), np.uint8).astype(np.int32)
    starts = np.cumsum(length + 1) - (length + 1)
    order = suffix_array(text)
    lcp = common_prefixes(text, order, starts, length + 1, SPAN)
    stretch = np.repeat(np.arange(len(stretches)), length + 1)[order]
    offset = order - starts[stretch]
    window = offset + SPAN <= length[stretch]
    group = np.cumsum(lcp < SPAN)[window]
    order, stretch, offset = order[window], stretch[window], offset[window]
    new = np.ones(len(order), bool)
    new[1:] = group[1:] != group[:-1]
    key = (owner[stretch] << 32) + first[stretch] + offset
    head = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(key)))) if len(head) else key
    again = key != least
    # the same place can be in two stretches only through equal rows; one of them stands for it
    rep = np.flatnonzero(~again)
    rep = rep[np.unique(key[rep], return_index=True)[1]]
    return stretch[again], offset[again], stretch[rep], offset[rep]


def _runs(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges intervals of window starts that touch, for each owner."""
    if not len(owner):
        return owner, start, end
    by = np.lexsort((end, start, owner))
    owner, start, end = owner[by], start[by], end[by]
    reach = np.maximum.accumulate(owner * (1 << 40) + end)
    cut = np.flatnonzero(np.concatenate([[True], (owner * (1 << 40) + start)[1:] > reach[:-1]]))
    last = np.append(cut[1:], len(owner)) - 1
    return owner[cut], start[cut], reach[last] - owner[cut] * (1 << 40)


ROWS = "id long, part long, s long, e long, w1 long, w2 long"


def _shards(batches):
    """Input sorted by (h, salt): h, salt, salts, id, part, first, windows, stretch. Output: repeats, and group heads (w1, w2) of dealt anchors."""
    held, size, last = [], 0, None

    def flush():
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        document, ids = pd.factorize(pd.MultiIndex.from_arrays([frame["id"], frame["part"]]), sort=True)
        document = document.astype(np.int64)
        start, windows = frame["first"].to_numpy(np.int64), frame["windows"].to_numpy(np.int64)
        done = [(document[none], start[none], (start + windows)[none])] if (none := frame["stretch"].isna().to_numpy()).any() else []
        at = np.flatnonzero(~none)
        heads = []
        if len(at):
            at = at[np.lexsort((start[at], document[at]))]
            content = frame["stretch"].to_numpy(object)[at]
            which, distinct = pd.factorize(content)
            one = np.zeros(len(distinct), np.int64)
            one[which[::-1]] = np.arange(len(at) - 1, -1, -1)
            later = np.ones(len(at), bool)
            later[one] = False
            # equal rows are one document: its own stretch again is no repeat
            later &= (document[at] != document[at][one][which]) | (start[at] != start[at][one][which])
            done.append((document[at][later], start[at][later], (start + windows)[at][later]))
            keep, h = at[one], frame["h"].to_numpy()[at[one]]
            # a stretch's windows differ, as they hold one anchor at different places; with no other stretch there is nothing to compare
            by, number = np.unique(h, return_inverse=True, return_counts=True)[1:]
            alone = number[by] == 1
            several = np.flatnonzero(~alone)
            a, ao, r, ro = shard([distinct[i] for i in several.tolist()], document[keep][several], start[keep][several])
            s = start[keep][several][a] + ao
            done.append((document[keep][several][a], s, s + 1))
            salts = frame["salts"].to_numpy()[keep]
            dealt = salts[several][r] > 1
            own = np.flatnonzero(alone & (salts > 1)).tolist()
            for k, o in chain(zip(several[r[dealt]].tolist(), ro[dealt].tolist(), strict=True), ((k, o) for k in own for o in range(len(distinct[k]) - SPAN + 1))):
                d = hashlib.blake2b(distinct[k][o : o + SPAN], digest_size=16).digest()
                heads.append((document[keep[k]], start[keep[k]] + o, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
        owner, s, e = _runs(*(np.concatenate(x) for x in zip(*done, strict=True)))
        h = np.array(heads, np.int64).reshape(-1, 4)
        doc = np.concatenate([owner, h[:, 0]])
        no = [None] * len(owner)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids.get_level_values(0).to_numpy(np.int64)[doc]),
                pa.array(ids.get_level_values(1).to_numpy(np.int64)[doc]),
                pa.array(np.concatenate([s, h[:, 1]])),
                pa.array(np.concatenate([e, h[:, 1] + 1])),
                pa.array(no + h[:, 2].tolist(), pa.int64()),
                pa.array(no + h[:, 3].tolist(), pa.int64()),
            ],
            ["id", "part", "s", "e", "w1", "w2"],
        )

    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        h, salt = frame["h"].to_numpy(), frame["salt"].to_numpy()
        length = frame["stretch"].str.len().fillna(0).to_numpy(np.int64)
        new = np.concatenate([[last != (h[0], salt[0])], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
        cuts, begin = np.flatnonzero(new), 0
        total = np.cumsum(length)
        for cut in cuts.tolist():
            if size + (total[cut - 1] if cut else 0) - (total[begin - 1] if begin else 0) >= BATCH and (held or cut > begin):
                if cut > begin:
                    held.append(frame.iloc[begin:cut])
                yield flush()
                held, size, begin = [], 0, cut
        if begin < len(frame):
            held.append(frame.iloc[begin:])
            size += int(total[-1] - (total[begin - 1] if begin else 0))
        last = (h[-1], salt[-1])
    if held:
        yield flush()


def _merged(batches):
    """Input sorted by (w1, w2, id, part, s): every entry but each digest's first is a repeat."""
    last = None
    for batch in batches:
        t = batch.to_pandas()
        if not len(t):
            continue
        key = np.rec.fromarrays([t["w1"].to_numpy(), t["w2"].to_numpy()])
        wide = (t["w1"].to_numpy().astype(np.uint64) ^ np.uint64(1 << 63)).astype(np.uint64)
        low = np.searchsorted(wide, wide, "left")  # equal first halves; the second halves settle the rest below
        own = np.arange(len(t))
        again = (low < own) & np.concatenate([[False], (key[1:] == key[:-1])])
        if last is not None and last[:2] == (t["w1"].iloc[0], t["w2"].iloc[0]):
            again[0] = True
        # an equal row passed on by two shards is one place: not a repeat of itself
        place = t[["w1", "w2", "id", "part", "s"]].to_numpy()
        head = np.maximum.accumulate(np.where(again, -1, own))
        again &= np.where(head >= 0, (place[head] != place).any(1), True)
        if last is not None:
            again &= ~((head < 0) & (place == np.array(last)).all(1))
        first = place[head[-1]] if head[-1] >= 0 else np.array(last)
        last = tuple(first.tolist())
        yield pa.RecordBatch.from_pandas(t.loc[again, ["id", "part", "s", "e"]], preserve_index=False)


def _keyed(c) -> tuple[list[bytes], list[int], list[int]]:
    import xxhash

    texts = [t or b"" for t in c[1]]
    return texts, [LAST_ID if i is None else i for i in c[0]], [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts]


def repeats(docs: DataFrame) -> DataFrame:
    """From doc_id, text (binary): id, part, s, e; window starts s..e-1 of that document repeat an earlier window."""

    def count(batches):
        for batch in batches:
            for p in slices(batch):
                which, found = pd.factorize(anchors([t or b"" for t in p.column(1).to_pylist()])[0].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(which, minlength=len(found)).astype(np.int64))], ["h", "n"])

    def place(batches):
        for batch in batches:
            for p in slices(batch):
                texts, ids, parts = _keyed([c.to_pylist() for c in p.columns])
                h, text, _, _ = anchors(texts)
                once = pd.DataFrame({"h": h.view(np.int64), "text": text}).drop_duplicates()
                at = once["text"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(once["h"].to_numpy()), pa.array(np.array(ids, np.int64)[at]), pa.array(np.array(parts, np.int64)[at])], ["h", "id", "part"])

    common = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    common = staged(common, "anchors")
    lists = docs.mapInArrow(place, "h long, id long, part long").join(common, "h").groupBy(F.col("id").alias("_id"), F.col("part").alias("_part")).agg(F.collect_set(F.struct("h", "n")).alias("common"))

    def packed():
        import zstandard

        z = zstandard.ZstdCompressor(level=1)

        def f(c):
            texts, ids, parts = _keyed(c)
            return {"id": ids, "part": parts, "z": [z.compress(t) for t in texts]}

        return f

    joined = map_rows(docs, packed, "id long, part long, z binary").join(lists, (F.col("id") == F.col("_id")) & (F.col("part") == F.col("_part")))

    def cut(batches):
        import xxhash
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for p in slices(batch, 256, 1 << 20):
                ids, packs, found = (c.to_pylist() for c in p.columns)
                out: list[list] = [[] for _ in range(8)]
                texts = [z.decompress(pack) for pack in packs]
                parts = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts]
                number = [{x["h"]: x["n"] for x in common_} for common_ in found]
                h, text, first, windows = anchors(texts)
                wanted = np.isin(h.view(np.int64), np.fromiter(chain.from_iterable(number), np.int64))
                seen: set = set()
                last = -1
                for a, d, f, w in zip(*(x[wanted].tolist() for x in (h.view(np.int64), text, first, windows)), strict=True):
                    if (n := number[d].get(a)) is None:
                        continue
                    if d != last:
                        seen, last, again = set(), d, False
                    s = texts[d][f : f + w + SPAN - 1]
                    if s in seen and again and out[5][-1] + out[6][-1] == f:
                        out[6][-1] += w  # the text repeats itself on and on: one row for all of it
                        continue
                    again = s in seen
                    salts = max(1, n // SALT)
                    row = (a, (parts[d] ^ ids[d] * 0x9E3779B97F4A7C15) % salts, salts, ids[d], parts[d], f, w, None if again else s)
                    seen.add(s)
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                types = [pa.int64()] * 7 + [pa.binary()]
                names = ["h", "salt", "salts", "id", "part", "first", "windows", "stretch"]
                yield pa.RecordBatch.from_arrays([pa.array(o, ty) for o, ty in zip(out, types, strict=True)], names)

    pieces = joined.select("id", "z", "common").mapInArrow(cut, "h long, salt long, salts long, id long, part long, first long, windows long, stretch binary")
    found = staged(pieces.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_shards, ROWS), "repeats")
    heads = found.where("w1 is not null").repartition("w1").sortWithinPartitions("w1", "w2", "id", "part", "s")
    return found.where("w1 is null").select("id", "part", "s", "e").unionByName(heads.mapInArrow(_merged, "id long, part long, s long, e long"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay, zstd-compressed), kept_sha256."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    by_doc = staged(repeats(docs).groupBy(F.col("id").alias("_id"), F.col("part").alias("_part")).agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")

    def packed():
        import zstandard

        z = zstandard.ZstdCompressor(level=1)

        def f(c):
            texts, ids, parts = _keyed(c)
            return {"doc_id": c[0], "id": ids, "part": parts, "z": [z.compress(t) for t in texts]}

        return f

    rows = map_rows(docs, packed, "doc_id long, id long, part long, z binary")
    rows = rows.join(by_doc, (F.col("id") == F.col("_id")) & (F.col("part") == F.col("_part")), "left").select("doc_id", "z", "spans")

    def removed():
        import zstandard

        z, y = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)

        def f(c):
            out: dict = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
            for pack, spans in zip(c[1], c[2], strict=True):
                t = z.decompress(pack)
                left, at, gone, runs = [], 0, 0, 0
                for s, e in sorted((x["s"], x["e"]) for x in spans or []):
                    e += SPAN - 1
                    if s > at or not runs:
                        left.append(t[at:s])
                        runs += 1
                        gone += e - s
                        at = e
                    elif e > at:
                        gone += e - at
                        at = e
                left.append(t[at:])
                kept = b"".join(left)
                for k, v in zip(out, (len(t), gone, runs, y.compress(kept), hashlib.sha256(kept).hexdigest()), strict=True):
                    out[k].append(v)
            return {"doc_id": c[0]} | out

        return f

    return map_rows(rows, removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string", 512)
