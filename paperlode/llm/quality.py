"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover the whole of it. Learned filters over learned byte embeddings run
along each chunk; each filter's maximum in a chunk is kept, and the mean and the maximum of these over all chunks, with the
logarithm of the length (short texts reach lower maxima), go through one logistic unit. Gradients pass through the maxima only, so training costs little more than scoring.

Training rows are a bounded sample: SAMPLE labelled ids of each class with texts up to SAMPLE_BYTES (one for each id), in the order of a
hash of their ids, from those that are not held out (crc32 of the id's decimal digits mod 4 is 2). The labels enter
nothing else; a score depends on the text alone. With one class only in the sample every score is that class's share,
smoothed; with no labels at all it is 0.5.

Null and empty texts are scored as one chunk of padding. Rows with null ids are not held out. Every row of the input gets
a row, repeated ones too; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, text_bytes

SAMPLE, SAMPLE_BYTES = 1000, 1 << 18
CHUNK, OVERLAP, WIDTH, STRIDE, EMBED, FILTERS = 512, 64, 8, 2, 6, 24
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 32, 0.01, 1e-4, 11
THRESHOLD = 0.7
#: How often a training text of class 0 or 1 is cut to a short passage.
CROP = (0.1, 0.4)
PAD = 256
#: Chunks that go through the network at once.
AT_ONCE = 128


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes (n, CHUNK) padded with PAD, how many positions of each are inside the text, and the text of each."""
    data = [np.frombuffer(t, np.uint8) for t in texts]
    number = [max(1, -(-(len(d) - OVERLAP) // (CHUNK - OVERLAP))) for d in data]
    out = np.full((sum(number), CHUNK), PAD, np.int16)
    inside = np.ones(len(out), np.int64)
    k = 0
    for d, n in zip(data, number, strict=True):
        for i in range(n):
            part = d[i * (CHUNK - OVERLAP) : i * (CHUNK - OVERLAP) + CHUNK]
            out[k, : len(part)] = part
            inside[k] = max(1, -(-(len(part) - WIDTH + 1) // STRIDE))
            k += 1
    return out, inside, np.repeat(np.arange(len(texts)), number)


class Network:
    NAMES = ("embed", "filters", "bias", "head", "offset")

    def __init__(self, rng: np.random.Generator):
        self.embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.head = rng.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.constant: float | None = None

    def maxima(self, code: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum in each chunk, and where it is."""
        best, where = np.empty((len(code), FILTERS), np.float32), np.empty((len(code), FILTERS), np.int64)
        for at in range(0, len(code), AT_ONCE):
            x = self.embed[code[at : at + AT_ONCE]].reshape(-1, CHUNK * EMBED)
            windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, 1)[:, :: STRIDE * EMBED]
            y = windows.reshape(-1, WIDTH * EMBED) @ self.filters
            y = y.reshape(len(x), -1, FILTERS)
            y[np.arange(y.shape[1])[None, :] >= inside[at : at + AT_ONCE, None]] = -np.inf
            where[at : at + AT_ONCE] = y.argmax(1)
            best[at : at + AT_ONCE] = np.take_along_axis(y, where[at : at + AT_ONCE, None], 1)[:, 0]
        return best + self.bias, where

    def pooled(self, best: np.ndarray, owner: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, 2 * FILTERS + 1): mean and maximum over a text's chunks of the rectified maxima, and its log length; chunks a text; those maxima."""
        n, length = len(texts), np.log2(np.array([[len(t)] for t in texts], np.float32) + 8) / 8
        r = np.maximum(best, 0)
        starts = np.searchsorted(owner, np.arange(n))
        count = np.bincount(owner, minlength=n)[:, None].astype(np.float32)
        return np.concatenate([np.add.reduceat(r, starts) / count, np.maximum.reduceat(r, starts), length], 1), count, r

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.5)
        code, inside, owner = chunks(texts)
        z, _, _ = self.pooled(self.maxima(code, inside)[0], owner, texts)
        return 1 / (1 + np.exp(-(z.astype(np.float64) @ self.head + float(self.offset[0]))))

    def gradients(self, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        code, inside, owner = chunks(texts)
        best, where = self.maxima(code, inside)
        z, count, r = self.pooled(best, owner, texts)
        p = 1 / (1 + np.exp(-(z @ self.head + self.offset)))
        error = ((p - label) * weight / len(texts)).astype(np.float32)
        dz = error[:, None] * self.head
        top = z[:, FILTERS : 2 * FILTERS][owner] == r
        dr = (dz[:, :FILTERS] / count)[owner] + dz[:, FILTERS : 2 * FILTERS][owner] * top
        dr *= best > 0
        c, f = np.nonzero(dr)
        g = dr[c, f]
        spot = where[c, f][:, None] * STRIDE + np.arange(WIDTH)
        bytes_ = code[c[:, None], spot]
        rows = self.embed[bytes_].reshape(len(c), -1)
        dfilters = np.zeros_like(self.filters)
        np.add.at(dfilters.T, f, g[:, None] * rows)
        dembed = np.zeros_like(self.embed)
        np.add.at(dembed, bytes_.ravel(), (g[:, None] * self.filters.T[f]).reshape(-1, EMBED))
        dembed[PAD] = 0
        return {"embed": dembed, "filters": dfilters, "bias": dr.sum(0), "head": z.T @ error + DECAY * self.head, "offset": error.sum(keepdims=True)}


def cropped(text: bytes, share: float, rng: np.random.Generator) -> bytes:
    """Sometimes a short passage of the text, so that short texts are learned too."""
    if rng.random() >= share or len(text) < 40:
        return text
    size = int(2 ** rng.uniform(4, 9))
    at = int(rng.integers(0, max(1, len(text) - size)))
    return text[at : at + size]


def train(texts: list[bytes], labels: list[int], seed: int = SEED) -> Network:
    """Adam over class-balanced weights; the same rows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    net, y = Network(rng), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    first = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    second, step = {k: v.copy() for k, v in first.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            step += 1
            for k, g in net.gradients([cropped(texts[i], CROP[int(y[i])], rng) for i in pick], y[pick], weight[pick]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                getattr(net, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Trains on at most `sample` labelled rows of each class (so the driver holds at most 2 * sample * SAMPLE_BYTES)."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    picked = [known.where(F.col("label") == k).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where(F.length("text") <= SAMPLE_BYTES)
    # bounded: at most 2 * sample ids, and of each id the least text
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["text"])))
    return train([bytes(r["text"]) for r in rows], [r["label"] for r in rows])


def score(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    return map_rows(text_bytes(df, id_col, text_col), lambda: lambda c: {"doc_id": c[0], "score": net.scores([t or b"" for t in c[1]])}, "doc_id long, score double", 512)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(df: DataFrame, net: Network, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text scores at least the threshold. A text is taken as its bytes, whatever they are."""
    import pyarrow as pa

    kind, at = df.schema[text_col].dataType, df.columns.index(text_col)

    def apply(batches):
        for batch in batches:
            for part in slices(batch, 512):
                good = net.scores([t or b"" for t in part.column(at).to_pylist()]) >= threshold
                yield part.filter(pa.array(good))

    raw = df.withColumn(text_col, F.col(text_col).cast("binary"))
    return raw.mapInArrow(apply, raw.schema).withColumn(text_col, F.col(text_col).cast(kind))
