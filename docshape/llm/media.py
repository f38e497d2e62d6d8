"""Media columns: documents stored as WAV, read back, and fingerprinted by spectral peaks.

Method: the stored bytes are read by the ``wave`` module; a short-time Fourier
transform (windows of 128 samples, hop 64, Hann) gives a spectrum per frame; the
strongest bin of each of three bands is a peak where it outdoes the frames beside
it; each peak is paired with the next peaks, and a pair (bin, bin, distance) with
its frame is one number of the document's time-coded array.

Both steps are Arrow maps without a shuffle: texts go in, a binary media column
comes out (which the registered query writes as a table and reads back), and the
features read nothing but that column; ``media`` and ``fingerprint``, the time-coded
array, stay columns of the result. Frames are transformed
in blocks that cross documents and cut long ones, so memory is bounded.

Defined cases: null or empty text is a payload of 64 zero bytes; long texts are
stored whole; ids are passed through (null too), other columns are ignored;
repeated rows give repeated results; an empty table gives no rows.
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
from pyspark.sql import functions as F

from docshape.llm.common import texts

UNIT, WINDOW, RATE = 64, 128, 8000
#: First and last-but-one bin of each band; the lowest bins hold the mean.
BANDS = ((3, 16), (16, 33), (33, 65))
#: A peak is paired with this many next peaks, at most this many frames away.
FAN, REACH = 4, 15
#: Least power of a peak: below it lies the rounding of a constant signal.
FLOOR = 16
BLOCK_FRAMES = 16_384


def padded(data: bytes) -> bytes:
    """The payload: ``data`` and zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Lossless: one 8-bit mono sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every hop of 64 samples, each band's strongest bin and its power, rounded to whole numbers.

    ``samples`` is a uint8 array of hops; a frame spans its hop and the next one.
    """
    frames = len(samples) // UNIT - 1
    window = np.hanning(WINDOW + 1)[:-1]
    bins, power = np.empty((frames, len(BANDS)), np.int64), np.empty((frames, len(BANDS)), np.int64)
    for a in range(0, frames, BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, frames - a)
        x = samples[a * UNIT : (a + n + 1) * UNIT].astype(np.float64) - 128.0
        s = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::UNIT] * window, axis=1)
        p = np.rint(s.real**2 + s.imag**2)
        for k, (lo, hi) in enumerate(BANDS):
            top = p[:, lo:hi].argmax(axis=1)
            bins[a : a + n, k] = top + lo
            power[a : a + n, k] = p[np.arange(n), top + lo]
    return bins, power


def fingerprints(payloads: list[bytes]) -> list[np.ndarray]:
    """Each payload's time-coded array: frame << 16 | bin << 10 | later bin << 4 | distance, in order of time."""
    if not payloads:
        return []
    hops = np.array([len(p) // UNIT for p in payloads])
    # A hop of zeros ends each document; the frame that begins there belongs to none.
    samples = np.frombuffer(b"".join(x for p in payloads for x in (p, bytes(UNIT))) + bytes(UNIT), np.uint8)
    bins, power = spectral_peaks(samples)
    doc = np.repeat(np.arange(len(payloads)), hops + 1)
    first = np.concatenate(([0], np.cumsum(hops + 1)[:-1]))
    time = np.arange(len(doc)) - first[doc]
    power[time == hops[doc]] = -1
    before, after = np.full_like(power, -1), np.full_like(power, -1)
    before[1:], after[:-1] = power[:-1], power[1:]
    at, band = np.nonzero((power >= FLOOR) & (power > before) & (power >= after))
    bin_, t, d = bins[at, band], time[at], doc[at]
    codes, owners = [], []
    for k in range(1, FAN + 1):
        dt = t[k:] - t[:-k] if k < len(t) else np.empty(0, np.int64)
        ok = np.flatnonzero((d[k:] == d[:-k]) & (dt > 0) & (dt <= REACH)) if len(dt) else np.empty(0, np.int64)
        codes.append(t[ok] << 16 | (bin_[ok] - 1) << 10 | (bin_[ok + k] - 1) << 4 | dt[ok])
        owners.append(d[ok])
    code, owner = np.concatenate(codes), np.concatenate(owners)
    order = np.lexsort((code, owner))
    return np.split(code[order], np.searchsorted(owner[order], np.arange(1, len(payloads))))


def store_wav(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` of the text as UTF-8 and ``media``, its padded payload as a WAV file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = texts(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array((to_wav(padded(t)) for t in data), pa.binary())], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def audio_features(stored: DataFrame) -> DataFrame:
    """Reads ``media`` back: the payload's size and digests, ``fingerprint``, the time-coded array of peak pairs, and ``media`` itself."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint", "media"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 1000):
                batch = whole.slice(a, 1000)
                media = batch.column(2).to_pylist()
                read = [from_wav(m) for m in media]
                columns = [
                    batch.column(0), batch.column(1), [len(p) for p in read], [hashlib.sha256(p).hexdigest() for p in read],
                    [zlib.crc32(p[-UNIT:]) for p in read], [len(m) for m in media], [hashlib.sha256(m).hexdigest() for m in media], fingerprints(read), batch.column(2),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>, media binary")


def with_feature_digest(features: DataFrame) -> DataFrame:
    """Adds ``feature``, the fingerprint as one string: its length and the SHA-256 of its numbers."""
    digest = F.sha2(F.array_join("fingerprint", ","), 256)
    return features.withColumn("feature", F.concat_ws(":", F.size("fingerprint").cast("string"), digest))
