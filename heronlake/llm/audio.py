"""Media columns: WAV bytes in a column, spectra and spectral-peak pair fingerprints.

A WAV is mono, 8 bits a sample.  Reading and writing use the standard
``wave`` module.  A fingerprint is an array of longs ``time << 32 | f1 << 20 |
f2 << 8 | gap``: a peak, a later peak in its target zone, and when.
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
from pyspark.sql import types as T

from heronlake.llm.common import by_bytes, passed

RATE = 8000
FRAME, HOP = 256, 128
BANDS = ((1, 12), (12, 36), (36, 72), (72, 129))
FAN_OUT, MAX_GAP = 3, 32
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    """Bytes stored losslessly as the 8-bit samples of a WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV as bytes."""
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectrum(samples: np.ndarray) -> np.ndarray:
    """Magnitudes of the short-time Fourier transform, a row for each frame; the last frame is padded with silence."""
    n = max(1, -(-max(len(samples) - FRAME, 0) // HOP) + 1)
    padded = np.full((n - 1) * HOP + FRAME, 128, dtype=np.uint8)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP].astype(np.float32)
    frames -= 128.0
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1))


def fingerprint(payload: bytes) -> np.ndarray:
    """Peak-pair hashes with their times.

    A peak is the strongest bin of a band of a frame, if it is above the mean
    of the frame and not below the same band of the frames beside it.  Each
    peak pairs with up to FAN_OUT later ones within MAX_GAP frames.
    """
    samples = np.frombuffer(payload, dtype=np.uint8)
    times, bins = [], []
    step = 4096
    n = max(1, -(-max(len(samples) - FRAME, 0) // HOP) + 1)
    for first in range(0, n, step):
        low, high = max(0, first - 1), min(n, first + step + 1)
        power = spectrum(samples[low * HOP : (high - 1) * HOP + FRAME])[: high - low]
        own = slice(first - low, min(n, first + step) - low)
        floor = power.mean(axis=1)
        for a, b in BANDS:
            best = power[:, a:b].argmax(axis=1) + a
            top = power[np.arange(len(power)), best]
            edge = np.pad(top, 1, constant_values=-1.0)
            peak = (top > 2 * floor) & (top >= edge[:-2]) & (top >= edge[2:])
            at = np.flatnonzero(peak[own])
            times.append(at + first)
            bins.append(best[own][at])
    when, what = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((what, when))
    when, what = when[order].astype(np.int64), what[order].astype(np.int64)
    pairs = []
    for k in range(1, FAN_OUT + 1):
        gap = when[k:] - when[:-k]
        near = gap <= MAX_GAP
        pairs.append((when[:-k] << 32 | what[:-k] << 20 | what[k:] << 8 | gap)[near])
    return np.sort(np.concatenate(pairs))


def text_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def store_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add a binary column ``media``: every whole text as a WAV.  Null texts count as empty; a column of that name is replaced."""
    keep = list(passed(tuple(docs.columns), (media,)))
    source = docs.select(*keep)
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, at, 4 << 20):
            stored = [to_wav(text_payload(t)[0]) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(stored, pa.binary())], names=[*keep, media])

    return source.mapInArrow(run, docs.select(*keep).schema.add(media, "binary"))


def media_features(media_rows: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Read stored WAVs back: ``keep``, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, fingerprints.

    A null WAV gives null features.  A kept column with the name of one made
    here gives way to it.  Rows are independent; there is no shuffle.
    """
    keep = passed(keep, ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprints"))
    source = media_rows.select(*keep, media)
    schema = media_rows.select(*keep).schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("fingerprints", T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, len(keep), 4 << 20):
            rows = []
            for m in part.column(len(keep)).to_pylist():
                if m is None:
                    rows.append((None,) * 6)
                    continue
                p = from_wav(m)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), fingerprint(p)))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names=schema.names)

    return source.mapInArrow(run, schema)
