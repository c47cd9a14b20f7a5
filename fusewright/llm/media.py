"""Media columns: texts stored as WAV sound, read back, and fingerprinted by spectral peaks.

A payload's bytes are 8-bit samples. The stored file is read by the wave module; short-time
Fourier transforms of what was read give peaks, and pairs of near peaks give the fingerprint, an
array of (time, code).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, tenant

UNIT, RATE = 192, 8000
#: Samples of a transform's window and of its step.
WINDOW, STEP = 384, 192
#: Peaks kept of a frame; frames that a pair may span; frames transformed at once.
PEAKS, REACH, BLOCK = 2, 3, 4096
_HANN = np.hanning(WINDOW).astype(np.float64)

SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string, n_pairs bigint, fingerprint array<struct<time:int,code:int>>"
)
FULL_SCHEMA = "doc_id bigint, n_bytes bigint, media binary, fingerprint array<struct<time:int,code:int>>"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 with spaces up to a positive multiple of 192; null is empty."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def store(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Frequency bins of each frame's strongest local maxima: frames x PEAKS, -1 where there are fewer."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128.0
    frames = -(-len(x) // STEP)
    x = np.concatenate([x, np.zeros(WINDOW)])
    out = np.full((frames, PEAKS), -1, np.int32)
    for a in range(0, frames, BLOCK):
        b = min(frames, a + BLOCK)
        view = np.lib.stride_tricks.sliding_window_view(x[a * STEP : (b - 1) * STEP + WINDOW], WINDOW)[::STEP]
        power = np.abs(np.fft.rfft(view * _HANN, axis=1))
        inner = power[:, 1:-1]
        inner = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0.0)
        for k in range(PEAKS):
            best = inner.argmax(axis=1)
            rows = np.arange(b - a)
            there = inner[rows, best] > 0
            out[a:b, k] = np.where(there, best + 1, -1)
            inner[rows, best] = 0.0
    return out


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of peak pairs, by time: a code holds both bins and the frames between."""
    p = peaks(samples)
    times, codes = [], []
    for gap in range(1, REACH + 1):
        for i in range(PEAKS):
            for j in range(PEAKS):
                f, g = p[:-gap, i] if gap < len(p) else p[:0, i], p[gap:, j]
                t = np.flatnonzero((f >= 0) & (g >= 0))
                times.append(t)
                codes.append((f[t].astype(np.int64) << 12) | (g[t] << 2) | gap)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def _arrays(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """A column of arrays of (time, code)."""
    at = np.cumsum([0, *(len(t) for t, _ in found)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([f[i] for f in found]), pa.int32()) for i in (0, 1)], names=["time", "code"])
    return pa.ListArray.from_arrays(pa.array(at), pairs)


def _rows(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    tenant("media")
    for b in slices(batches, 1, 4 << 20):
        rows, found = [], []
        for text in b.column(1).to_pylist():
            n, payload = payload_of(text)
            media = store(payload)
            back = read(media)
            times, codes = fingerprint(back)
            found.append((times, codes))
            if full:
                rows.append((n, media))
            else:
                digest = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), digest, len(times)))
        kinds = [pa.int64(), pa.binary()] if full else [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in (FULL_SCHEMA if full else SCHEMA).split(", ")]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), _arrays(found)], names=names)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the WAV file), fingerprint (array of time and code) of every row.

    Null text is empty; an empty text's payload is 192 spaces. Very long texts are stored whole and
    transformed block by block. Of peaks that are equally strong the lower counts first. Repeated
    rows and equal texts give equal values. Null doc_id stays null. Empty table: empty result. Other
    columns are ignored, whatever their names.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: _rows(it, True), FULL_SCHEMA)


def media_digest(docs: DataFrame) -> DataFrame:
    """media_column() with digests in place of the file, and one of the fingerprint beside it (feature)."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _rows(it, False), SCHEMA)
