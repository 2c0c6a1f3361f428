"""Media columns: texts as 8-bit mono WAV, and landmark fingerprints from short-time spectra."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, freed

BLOCK, RATE, FRAME, HOP, AHEAD = 64, 8000, 128, 64, 3


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


_HANN = np.hanning(FRAME).astype(np.float32)


def landmarks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time (in hops) and code of each pair of spectral peaks: both peaks' bins and the hops between them.

    The strongest bin of a frame is a peak when no neighbouring frame's strongest is stronger.
    Each peak is paired with the next AHEAD ones.
    """
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    samples = np.concatenate([samples, np.zeros(FRAME - HOP, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    codes, times, bins, strong = [], [], [], []
    for i in range(0, len(frames), 4096):  # long texts in parts, one spectrum at a time
        spectrum = np.fft.rfft(frames[i : i + 4096] * _HANN, axis=1)[:, 2:]  # without the mean's bins
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        best = power.argmax(axis=1)
        bins.append(best)
        strong.append(power[np.arange(len(best)), best])
    f, p = np.concatenate(bins), np.concatenate(strong)
    left, right = np.concatenate([[-1], p[:-1]]), np.concatenate([p[1:], [-1]])
    t = np.flatnonzero((p >= left) & (p >= right) & (p > 0))
    f = f[t]
    for j in range(1, AHEAD + 1):
        gap = np.minimum(t[j:] - t[:-j], 63) if len(t) > j else np.zeros(0, np.int64)
        codes.append((f[: len(gap)] << 13) | (f[j : j + len(gap)] << 6) | gap)
        times.append(t[: len(gap)])
    return np.concatenate(times), np.concatenate(codes).astype(np.int64)


def feature_text(times: np.ndarray, codes: np.ndarray) -> str:
    """Count of the landmarks, and each one's time and code in order of time, then of code."""
    order = np.lexsort((codes, times))
    return f"{len(codes)};" + " ".join(f"{t}:{c:x}" for t, c in zip(times[order].tolist(), codes[order].tolist()))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Per document the stored media and what reading it back gives.

    Columns: doc_id, n_bytes, media (binary, if keep_media), media_bytes, media_sha256,
    payload_bytes, payload_sha256, tail_crc32, landmarks array<struct<time, code>> of the whole
    payload, feature, their text. The payload is the text in UTF-8 (null: empty) with bytes 0 up to a
    positive multiple of 64. Every row stands for itself: ties, repeats and other columns play
    no part; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", landmarks array<struct<time: bigint, code: bigint>>" + (", media binary" if keep_media else "")
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string{extra}"

    def row(text: bytes) -> tuple:
        payload = text + bytes(BLOCK - len(text) % BLOCK if len(text) % BLOCK or not text else 0)
        media = to_wav(payload)
        back = from_wav(media)
        times, codes = landmarks(back)
        base = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(times, codes))
        return base, times, codes, media if keep_media else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(freed(batches), "text"):
            rows = [row(t) for t in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
            columns = [pa.array(c) for c in zip(*(r[0] for r in rows))]
            inner = pa.StructArray.from_arrays([pa.array(np.concatenate([r[k] for r in rows]), pa.int64()) for k in (1, 2)], ["time", "code"])
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[1]) for r in rows)]), pa.int32()), inner))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "landmarks"]
            if keep_media:
                columns.append(pa.array([r[3] for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names + ["media"] * keep_media)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
