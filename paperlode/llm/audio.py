"""Media columns: a lossless 8-bit audio form of a payload, and log-mel features of what is read back.

The payload is the text's UTF-8 bytes followed by bytes 255 up to a positive multiple of FRAME; each byte is one unsigned
8-bit sample of a mono WAV file. Features come from the samples read back out of the stored bytes: polyphase resampling
16 kHz -> 12 kHz, overlapped Hann frames, log-mel filterbanks, and hysteresis segmentation of the frame energies. They
are kept as an Arrow IPC stream whose tensor column has the fixed shape (PATCH, MELS), with the time span of each patch
and of each segment.

Null and empty texts become one frame of bytes 255. Long texts are worked through in blocks of BLOCK samples, so memory
beyond the text itself is bounded. Everything is computed per row: equal texts give equal values, repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, text_bytes

FRAME = 576
RATE, UP, DOWN = 16000, 3, 4
TARGET = RATE * UP // DOWN
TAPS = 12
WINDOW, HOP, FFT, MELS, PATCH = 300, 120, 512, 40, 32
BLOCK = 1 << 18
#: Segmentation thresholds over the mean frame energy, in standard deviations.
ENTER, LEAVE = 0.5, -0.25


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + b"\xff" * (-len(text) % FRAME or (0 if text else FRAME))


def to_wav(samples: bytes) -> bytes:
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at < len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def _low_pass() -> np.ndarray:
    """Rows: input offsets of a window; columns: the UP outputs made from it."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(TAPS * UP)
    h *= UP / h.sum()
    bank = np.zeros((TAPS + UP - 1, UP))
    for r in range(UP):
        phase, base = r * DOWN % UP, r * DOWN // UP
        bank[base : base + TAPS, r] = h[phase::UP][::-1]
    return bank.astype(np.float32)


def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(0.0), mel(TARGET / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * TARGET / FFT
    low, mid, high = points[:-2, None], points[1:-1, None], points[2:, None]
    return np.clip(np.minimum((f - low) / (mid - low), (high - f) / (high - mid)), 0, None).T.astype(np.float32)


BANK, MEL, HANN = _low_pass(), _mel_bank(), np.hanning(WINDOW).astype(np.float32)


def resampled(samples: np.ndarray):
    """Blocks of the signal at TARGET; blocks follow one another without a seam."""
    width = len(BANK)
    for start in range(0, len(samples), BLOCK):
        part = samples[start : start + BLOCK + width]
        n = -(-min(BLOCK, len(samples) - start) // DOWN)
        x = np.zeros((n - 1) * DOWN + width, np.float32)
        m = min(len(part), len(x))
        x[:m] = (part[:m].astype(np.float32) - 128) / 128
        yield (np.lib.stride_tricks.sliding_window_view(x, width)[::DOWN] @ BANK).ravel()


def log_mel(samples: np.ndarray) -> np.ndarray:
    """(frames, MELS); the signal's end is padded with zeros to whole frames."""
    out, held = [], np.zeros(0, np.float32)
    for y in resampled(samples):
        held = np.concatenate([held, y]) if len(held) else y
        n = (len(held) - WINDOW) // HOP + 1
        if n > 0:
            out.append(_frames(held, n))
            held = held[n * HOP :]
    if len(held) > WINDOW - HOP or not out:
        out.append(_frames(np.pad(held, (0, WINDOW)), 1))
    return np.concatenate(out) if len(out) > 1 else out[0]


def _frames(y: np.ndarray, n: int) -> np.ndarray:
    frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[: n * HOP : HOP] * HANN
    spectrum = np.fft.rfft(frames, FFT)
    return np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ MEL + np.float32(1e-6))


def segments(energy: np.ndarray) -> np.ndarray:
    """(k, 2) first and last-plus-one frames of active spans: entered above the upper threshold, left below the lower one."""
    mean, spread = energy.mean(), energy.std()
    mark = np.where(energy > mean + ENTER * spread, 1, np.where(energy < mean + LEAVE * spread, 0, -1))
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    active = np.concatenate([[0], np.where(known >= 0, mark[known], 0), [0]])
    edge = np.diff(active)
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def patches(mel: np.ndarray) -> np.ndarray:
    n = -(-len(mel) // PATCH)
    out = np.full((n * PATCH, MELS), np.log(np.float32(1e-6)), np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, PATCH, MELS)


TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))
SCHEMA = pa.schema([("tensor", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64()), ("segments", pa.list_(pa.float64()))])


def tensors(mel: np.ndarray, spans: np.ndarray) -> bytes:
    """An Arrow IPC stream of one batch: a patch a row, its time span, and the segments (start, end, ...) that begin in it."""
    tensor = patches(mel)
    n = len(tensor)
    start = np.arange(n) * PATCH * HOP / TARGET
    end = np.minimum((np.arange(n) + 1) * PATCH, len(mel)) * HOP / TARGET + (WINDOW - HOP) / TARGET
    flat = (spans * (HOP / TARGET)).ravel()
    offsets = 2 * np.searchsorted(spans[:, 0], np.arange(n + 1) * PATCH)
    columns = [
        pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(tensor.ravel()), PATCH * MELS)),
        pa.array(start),
        pa.array(end),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float64())),
    ]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SCHEMA) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=SCHEMA))
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def described(text: bytes | None) -> dict:
    media = to_wav(payload(text))
    back = from_wav(media)
    mel = log_mel(np.frombuffer(back, np.uint8))
    spans = segments(mel.mean(1))
    stream = tensors(mel, spans)
    return {"n_bytes": len(text or b""), "media": media, "back": back, "mel": mel, "spans": spans, "features": stream}


def media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (WAV bytes), features (Arrow IPC stream; see read_tensors)."""

    def make():
        def f(c):
            got = [described(t) for t in c[1]]
            return {"doc_id": c[0]} | {k: [x[k] for x in got] for k in ("n_bytes", "media", "features")}

        return f

    return map_rows(text_bytes(df, id_col, text_col), make, "doc_id long, n_bytes long, media binary, features binary", 256)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media() reduced to checksums within the same pass, so that no media leaves the workers."""

    def make():
        def one(text):
            x = described(text)
            sha = lambda b: hashlib.sha256(b).hexdigest()
            active = float((x["spans"][:, 1] - x["spans"][:, 0]).sum() * HOP / TARGET)
            return (x["n_bytes"], len(x["back"]), sha(x["back"]), zlib.crc32(x["back"][-32:]), len(x["media"]), sha(x["media"]), f"frames={len(x['mel'])};segments={len(x['spans'])};active_s={active:.3f};tensors={sha(x['features'])}")

        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        return lambda c: {"doc_id": c[0]} | dict(zip(names, map(list, zip(*map(one, c[1]), strict=True)), strict=True))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(text_bytes(df, id_col, text_col), make, schema)
