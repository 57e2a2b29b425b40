"""Media columns: WAV bytes in a binary column, and fingerprints of spectral-peak pairs.

encode() turns a payload into a mono WAV of 8-bit samples, one byte a sample, so the payload is stored
without loss. analyse() opens the stored bytes with the wave module, takes a short-time Fourier transform
(Hann windows of WINDOW samples, HOP apart), keeps in every frame the strongest bin of each band that rises
above the frame's mean, and pairs each peak with the next band's peak in the FAN_OUT frames after it.
Fingerprints are time-coded arrays, stored as columns: frames (frame numbers, rising) and codes of (bin, later bin,
frames between) of equal length. The feature is their number and digest.

A text is transformed on its own, in blocks of BLOCK frames, so memory is bounded by the longest value and
equal texts get equal values wherever they stand. Magnitudes are rounded to 1/16 of an octave and ties go to
the lowest bin.

Defined results: a null text is the empty text, 64 zero bytes; a payload shorter than a window is padded to
one; media that isn't 8-bit mono WAV gives null features and sums, not an error; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import arrow_map, table, written

RATE, WINDOW, HOP, BLOCK = 8000, 512, 256, 1024
#: First bins of the bands; the last ends at WINDOW // 2.
BANDS = (1, 16, 48, 112, 257)
FAN_OUT = 3
PAD = 64


def pad(payload: bytes) -> bytes:
    return payload + bytes((-len(payload)) % PAD or (PAD if not payload else 0))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise wave.Error("not 8-bit mono")
        return w.readframes(w.getnframes())


_HANN = np.hanning(WINDOW)


def spectrum(samples: np.ndarray) -> np.ndarray:
    """Rounded log magnitudes, a row a frame; 0 for silence."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    parts = [np.rint(16 * np.log2(1 + np.abs(np.fft.rfft(frames[k : k + BLOCK] * _HANN)))).astype(np.int16) for k in range(0, len(frames), BLOCK)]
    return np.concatenate(parts)


def peaks(levels: np.ndarray) -> np.ndarray:
    """The bin of each frame's and band's peak, -1 where nothing rises above the frame's mean."""
    mean, out = levels.mean(axis=1), np.empty((len(levels), len(BANDS) - 1), np.int32)
    for b, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
        at = levels[:, low:high].argmax(axis=1)
        top = levels[np.arange(len(levels)), low + at]
        out[:, b] = np.where(top > mean, low + at, -1)
    return out


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and codes, in order of (frame, code)."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    short = max(WINDOW, -(-len(samples) // HOP) * HOP) - len(samples)
    found = peaks(spectrum(np.pad(samples, (0, short))))
    times, codes = [], []
    for gap in range(1, FAN_OUT + 1):
        first, later = found[:-gap], np.roll(found, -1, axis=1)[gap:]
        t, b = np.nonzero((first >= 0) & (later >= 0))
        times.append(t)
        codes.append((first[t, b].astype(np.int64) << 11) | (later[t, b].astype(np.int64) << 2) | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text padded with zero bytes and stored as WAV."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([to_wav(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_map(docs.select("doc_id", "text"), kernel, "doc_id long, n_bytes long, media binary")


def analyse(media: DataFrame) -> DataFrame:
    """Sums of the stored bytes and of their payload, and the fingerprint arrays."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "codes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def one(doc_id: int, n_bytes: int, data: bytes | None) -> tuple:
        stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
        try:
            payload = from_wav(data or b"")
        except (wave.Error, EOFError):
            return doc_id, n_bytes, None, None, None, *stored, None, None, None
        t, c = fingerprint(payload)
        feature = f"{len(t)}:{hashlib.sha256(t.tobytes() + c.tobytes()).hexdigest()[:32]}"
        return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), *stored, feature, t, c

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names) if rows else None

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<int>, codes array<int>"
    return arrow_map(media.select("doc_id", "n_bytes", "media"), kernel, schema)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the media, then their sums and time-coded fingerprints; gives the stored rows."""
    stored = written(encode(table(spark, sf_dir, "documents")), "media")
    return written(analyse(stored), "fingerprints")
