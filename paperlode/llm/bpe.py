"""Byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

The text is split by a regular expression; each distinct piece becomes a row of token ids in a matrix of rows of like
length. In every round each row merges its leftmost pair of minimum rank, found through a hashed pair table; rows with
nothing left to merge leave the matrix (compaction). Rows of over 192 bytes merge all places of that pair, left to right, in
one round, where no pair that this makes on the way ranks before it: then the pair's next place is what would come next
anyway. Where one does, that round merges the leftmost place alone.

Nulls and empty texts give no tokens. Ids decode to exactly the bytes of the text. Invalid UTF-8, which Spark strings
can hold, is replaced by U+FFFD as str decoding does. Repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_rows, text_bytes

#: Widths of the matrices for short pieces; longer ones double.
WIDTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 192)
#: Distinct pieces in each of a worker's two cache generations; the older one goes when the younger is full.
CACHE_PIECES = 120_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
NONE = np.int32(2**31 - 1)


#: Fixed value: the published pattern that cut_vector() implements; any other pattern goes through the regex module.
VECTOR_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE, BETWEEN = range(5)
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, as the regex module has it."""
    if not _CLASSES:
        import regex

        every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "!" for i in range(0x110000))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def piece_starts(code: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where VECTOR_PATTERN's matches start in code points of the given classes; BETWEEN separates texts and stands alone."""
    n = len(code)
    starts = np.zeros(n + 1, bool)
    starts[0] = starts[n] = True
    starts[1:n] = kind[1:] != kind[:-1]
    starts[:n] |= kind == BETWEEN
    run = np.flatnonzero(starts)
    first, last = run[:-1], run[1:] - 1
    of = kind[first]
    follows = np.append(of[1:], BETWEEN)
    # white space before other text gives up its last character: a blank starts the next piece, any other stands alone
    gives = np.flatnonzero((of == SPACE) & (follows != BETWEEN))
    starts[last[gives]] = True
    blank = gives[code[last[gives]] == 32]
    starts[last[blank] + 1] = False
    # an apostrophe alone, with no blank before it, and certain letters after it
    alone = np.flatnonzero((of == OTHER) & (first == last) & (follows == LETTER))
    at = first[alone]
    at = at[(code[at] == 39) & starts[at]]
    if len(at):
        padded = np.append(code, [0, 0])
        one, two = padded[at + 1], padded[at + 2]
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        short = np.isin(one, [115, 116, 109, 100])
        starts[at[short | long] + 1] = False
        after = np.concatenate([at[short] + 2, at[long] + 3])
        after = after[after < n]
        starts[after[kind[after] == LETTER]] = True
    return np.flatnonzero(starts[:n])


def cut_vector(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Codec.cut() for VECTOR_PATTERN, over all texts at once. Equal pieces are found by hash and then compared."""
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = classes()[code]
    kind[ends] = BETWEEN
    start = piece_starts(code, kind)
    keep = kind[start] != BETWEEN
    size = np.diff(np.append(start, len(code)))
    per_text = np.diff(np.concatenate([[0], np.searchsorted(start[keep], ends)]))
    place = np.arange(len(code), dtype=np.int32) - np.repeat(start.astype(np.int32), size)
    power = np.ones(int(size.max(initial=1)), np.uint64)
    power[1:] = MULTIPLIER
    power = np.multiply.accumulate(power)
    mixed = (code.astype(np.uint64) + np.uint64(0x632BE5)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    key = np.add.reduceat(mixed * power[place], start)[keep] if len(start) else np.zeros(0, np.uint64)
    start, size = start[keep], size[keep]
    which, held = pd.factorize(key)
    rep = np.empty(len(held), np.int64)
    rep[which[::-1]] = np.arange(len(key) - 1, -1, -1)
    text = code[kind != BETWEEN]
    shift = np.arange(len(text), dtype=np.int32) + np.repeat((start[rep][which] - (np.cumsum(size) - size)).astype(np.int32), size)
    if len(key) and ((size[rep][which] != size).any() or (text != code[np.minimum(shift, len(code) - 1)]).any()):  # two pieces share a hash: compare as strings
        index: dict[str, int] = {}
        which = np.fromiter((index.setdefault(joined[a : a + n], len(index)) for a, n in zip(start.tolist(), size.tolist(), strict=True)), np.int64)
        return list(index), which, per_text
    return [joined[a : a + n] for a, n in zip(start[rep].tolist(), size[rep].tolist(), strict=True)], which, per_text


class PairTable:
    """Open addressing over (left id, right id) -> id of the merged token, which is its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, todo = self.pack(left, right), np.arange(len(left))
        slot = self.slot(key)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            first = np.unique(slot[todo[free]], return_index=True)[1]
            put = todo[free][first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], merged[put]
            placed = np.zeros(len(key), bool)
            placed[put] = True
            todo = todo[~placed[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def pack(left, right):
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def slot(self, key):
        return ((key.astype(np.uint64) * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self.pack(left, right)
        slot = self.slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], NONE)
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split, self.vector = regex.compile(pattern).findall, pattern == VECTOR_PATTERN
        size = max(ranks.values()) + 1
        self.words: list[bytes] = [b""] * size
        for word, rank in ranks.items():
            self.words[rank] = word
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, rank) for word, rank in ranks.items() for k in range(1, len(word)) if (a := ranks.get(word[:k])) is not None and (b := ranks.get(word[k:])) is not None]
        table = np.array(pairs, np.int32).reshape(-1, 3)
        self.table = PairTable(table[:, 0], table[:, 1], table[:, 2])
        self.decimal = [str(i) for i in range(size)]
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        bound, bounds = WIDTHS[-1], list(WIDTHS)
        while bound < lengths.max(initial=0):
            bounds.append(bound := 2 * bound)
        for bound in bounds:
            rows = np.flatnonzero((lengths <= bound) & (lengths > 0))
            lengths[rows] = 0
            merge = self.encode_wide if bound > WIDTHS[-1] else self.encode_matrix
            at_once = max(1, min(32768, (1 << 21) // bound))
            for start in range(0, len(rows), at_once):
                part = rows[start : start + at_once]
                for i, ids in zip(part.tolist(), merge([pieces[i] for i in part.tolist()], bound), strict=True):
                    out[i] = ids
        return out

    def encode_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        size = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_id[raw]
        column = np.arange(width, dtype=np.int16)
        done: list = [None] * n
        row = np.arange(n)
        rank = np.full((n, max(width - 1, 1)), NONE, np.int32)
        if width > 1:
            at = np.nonzero(column[None, : width - 1] < size[:, None] - 1)
            rank[at] = self.table.find(ids[at], ids[at[0], at[1] + 1])
        while len(row):
            best = rank.argmin(1)
            every = np.arange(len(row))
            alive = rank[every, best] != NONE
            if not alive.all():
                ended = ~alive
                for k, r, m in zip(row[ended].tolist(), ids[ended].tolist(), size[ended].tolist(), strict=True):
                    done[k] = r[:m]
                row, ids, size, rank, best = row[alive], ids[alive], size[alive], rank[alive], best[alive]
                if not len(row):
                    break
                every = every[: len(row)]
            w = ids.shape[1]
            ids[every, best] = rank[every, best]
            best = best.astype(np.int16)[:, None]
            ids = ids[column[None, :w] != best + 1].reshape(-1, w - 1)
            rank = rank[column[None, : w - 1] != best].reshape(-1, w - 2) if w > 2 else np.full((len(row), 1), NONE, np.int32)
            size = size - 1
            best = best[:, 0].astype(np.int64)
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < size - 1))
                rank[ok, at[ok]] = self.table.find(ids[ok, at[ok]], ids[ok, at[ok] + 1])
            end = np.flatnonzero((best >= size - 1) & (best < rank.shape[1]))
            rank[end, best[end]] = NONE
        return done

    def encode_wide(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """As encode_matrix, but a round merges every place of a row's minimum-rank pair, from the left, where that is the same."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        width = int(size.max())
        ids = self.byte_id[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)]
        rank = np.full((n, width), NONE, np.int32)  # of the pair that starts here
        at = np.nonzero(np.arange(width) < size[:, None] - 1)
        rank[at] = self.table.find(ids[at], ids[at[0], at[1] + 1])
        done: list = [None] * n
        row = np.arange(n)
        while len(row):
            best = rank.min(1)
            ended = best == NONE
            if ended.any():
                for k, r, m in zip(row[ended].tolist(), ids[ended], size[ended].tolist(), strict=True):
                    done[k] = r[:m].tolist()
                row, ids, size, rank, best = row[~ended], ids[~ended], size[~ended], rank[~ended], best[~ended]
                if not len(row):
                    break
            place = np.arange(ids.shape[1])
            hit = rank == best[:, None]
            # in a run of equal tokens pairs overlap: every other one is taken
            first = hit.copy()
            first[:, 1:] &= ~hit[:, :-1]
            take = hit & ((place - np.maximum.accumulate(np.where(first, place, 0), 1)) % 2 == 0)
            after = self.merged(ids, rank, size, take, best)
            low = after[3] < best
            for k in np.flatnonzero(~low & (take.sum(1) > 1)).tolist():  # the merged token before the pair's next place
                left = np.array([ids[k, int(take[k].argmax())]])
                low[k] = self.table.find(best[k : k + 1], left)[0] < best[k]
            if low.any():
                leftmost = np.zeros_like(take)
                leftmost[np.arange(len(row)), take.argmax(1)] = True
                after = self.merged(ids, rank, size, np.where(low[:, None], leftmost, take), best)
            ids, rank, size = after[:3]
        return done

    def merged(self, ids: np.ndarray, rank: np.ndarray, size: np.ndarray, take: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, ranks and sizes after merging the pairs that start where `take` is set, and the least rank of a new pair in each row."""
        keep = np.arange(ids.shape[1]) < size[:, None]
        keep[:, 1:] &= ~take[:, :-1]
        r, c = np.nonzero(keep)
        size = keep.sum(1)
        to = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
        made = take[r, c]
        shape = (len(ids), int(size.max()))
        new_ids, new_rank = np.zeros(shape, np.int32), np.full(shape, NONE, np.int32)
        new_ids[r, to], new_rank[r, to] = np.where(made, best[r], ids[r, c]), rank[r, c]
        again = np.zeros(shape, bool)
        again[r[made], to[made]] = again[r[made], np.maximum(to[made] - 1, 0)] = True
        new_rank[again] = NONE
        again &= np.arange(shape[1]) < size[:, None] - 1
        at = np.nonzero(again)
        found = self.table.find(new_ids[at], new_ids[at[0], at[1] + 1])
        new_rank[at] = found
        new_rank[np.arange(len(ids)), size - 1] = NONE
        least = np.full(len(ids), NONE, np.int32)
        np.minimum.at(least, at[0], found)
        return new_ids, new_rank, size, least

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        distinct, which, per_text = self.cut(texts)
        need = dict.fromkeys(distinct)
        if len(self.young) + len(need) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        new = []
        for p in need:
            if p not in self.young:
                if (held := self.old.get(p)) is not None:
                    self.young[p] = held
                else:
                    new.append(p)
        self.young.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        ids = [self.young[p] for p in distinct]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        each = size[which]
        ends = np.cumsum(each)
        flat = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(size) - size)[which] - (ends - each), each)]
        cuts = np.concatenate([[0], ends])[np.cumsum(per_text)]
        return np.split(flat, cuts[:-1]) if len(cuts) else []

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces, the index of each piece in them, and the number of pieces of each text."""
        if self.vector:
            return cut_vector(texts)
        split = [self.split(t) for t in texts]
        index: dict[str, int] = {}
        which = np.fromiter((index.setdefault(p, len(index)) for p in chain.from_iterable(split)), np.int64)
        return list(index), which, np.array([len(x) for x in split], np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Tokenizer:
    """A rank file and a pattern, read on the driver and carried with the tasks (under 1 MB, whatever the input)."""

    def __init__(self, data: bytes, pattern: str):
        self.packed, self.pattern, self.key = zlib.compress(data), pattern, hashlib.sha256(data).hexdigest()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Tokenizer:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def codec(self) -> Codec:
        if (self.key, self.pattern) not in _CODECS:
            _CODECS[self.key, self.pattern] = Codec(parse_ranks(zlib.decompress(self.packed)), self.pattern)
        return _CODECS[self.key, self.pattern]


def encode(df: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int)."""

    def make():
        codec = tokenizer.codec()
        return lambda c: {"doc_id": c[0], "ids": codec.encode([(t or b"").decode("utf-8", "replace") for t in c[1]])}

    return map_rows(text_bytes(df, id_col, text_col), make, "doc_id long, ids array<int>")


def decode(df: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """From doc_id, ids: doc_id, bytes. A null list decodes to no bytes."""

    def make():
        codec = tokenizer.codec()
        return lambda c: {"doc_id": c[0], "bytes": [codec.decode(x or []) for x in c[1]]}

    return map_rows(df.select("doc_id", "ids"), make, "doc_id long, bytes binary")


def round_trip(df: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        codec = tokenizer.codec()

        def f(c):
            ids = [x.tolist() for x in codec.encode([(t or b"").decode("utf-8", "replace") for t in c[1]])]
            return {
                "doc_id": c[0],
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(" ".join(map(codec.decimal.__getitem__, x)).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
            }

        return f

    return map_rows(text_bytes(df, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
