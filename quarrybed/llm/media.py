"""Media columns: payloads as 8-bit WAV, read back with the wave module, and spectral fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

FRAME, RATE, PAD = 576, 8000, 255
#: Samples from one frame to the next, frames ahead in which a peak is paired, peaks a frame, and the least share of a frame's largest magnitude that a peak has.
HOP, AHEAD, PEAKS, FLOOR = 288, 4, 2, 1e-3
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes, unit: int = FRAME) -> bytes:
    """The bytes with 255 appended up to a positive multiple of ``unit``."""
    size = max(unit, -(-len(data) // unit) * unit)
    return data + bytes([PAD]) * (size - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray, frame: int = FRAME, hop: int = HOP, count: int = PEAKS) -> np.ndarray:
    """Bins of the strongest local maxima of each frame's spectrum: frames x count, strongest first, -1 for none.

    The transform is short-time: frames of ``frame`` samples that overlap by half, Hann
    window, real FFT, a block of frames at a time. Bin 0 (the mean) never counts, nor what is
    under FLOOR of the frame's largest magnitude; of equal magnitudes the lower bin leads.
    """
    out = []
    frames = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    for k in range(0, len(frames), 512):
        x = frames[k : k + 512].astype(np.float32) - 128
        power = np.abs(np.fft.rfft(x * _WINDOW, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner >= FLOOR * power.max(axis=1, keepdims=True)), inner, -1)
        found = np.empty((len(x), count), np.int64)
        rows = np.arange(len(x))
        for j in range(count):
            at = top.argmax(axis=1)
            found[:, j] = np.where(top[rows, at] > 0, at + 1, -1)
            top[rows, at] = -1
        out.append(found)
    return np.concatenate(out)


def landmarks(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of peaks: time << 32 | bin << 20 | later bin << 8 | frames between.

    Each peak of a frame is paired with each peak of the next AHEAD frames, and the two of a
    frame with each other (no frames between), so that one frame has a pair too.
    """
    p = peaks(samples)
    t = np.flatnonzero((p >= 0).all(axis=1))
    out = [t << 32 | p[t, 0] << 20 | p[t, 1] << 8]
    for gap in range(1, min(AHEAD, len(p) - 1) + 1):
        t = np.arange(len(p) - gap)
        for i in range(PEAKS):
            for j in range(PEAKS):
                a, b = p[:-gap, i], p[gap:, j]
                good = (a >= 0) & (b >= 0)
                out.append((t << 32 | a << 20 | b << 8 | gap)[good])
    return np.sort(np.concatenate(out))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, media (a WAV file), payload_bytes, payload_sha256, tail_crc32, landmarks.

    The payload is the text's UTF-8 with 255 appended up to a positive multiple of 576; its
    columns are computed from the samples that the wave module reads out of ``media``. A null
    text counts as empty (one frame of padding, which has no peaks). Equal texts give equal
    values, repeated rows repeat, a very long text is one medium, an empty table gives no rows
    and other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession, 1000)

    def run(batches):
        for b in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                data = text.encode()
                media = to_wav(padded(data))
                payload = from_wav(media)
                marks = landmarks(np.frombuffer(payload, np.uint8))
                for column, value in zip(columns, (len(data), media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), marks)):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "landmarks"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    out = out.mapInArrow(run, "id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, landmarks array<long>")
    return out.withColumnRenamed("id", id_col)


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The media columns as sums: media_bytes, media_sha256 and feature, which holds the number of landmarks and their digest."""
    marks = F.array_join("landmarks", ",")
    return media.select(
        id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("landmarks").cast("string"), F.sha2(marks, 256)).alias("feature"),
    )
