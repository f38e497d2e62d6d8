import hashlib
import zlib

import numpy as np

from docshape.llm.media import BANDS, FAN, FLOOR, REACH, UNIT, WINDOW, audio_features, fingerprints, from_wav, padded, store_wav, to_wav, with_feature_digest

TEXTS = ["", "a", "x" * 64, "x" * 65, "hello wörld " * 40, "the quick brown fox\n" * 300, "日本" * 100, "\x00" * 128]


def brute(payload: bytes) -> list[int]:
    """One document alone, frame by frame."""
    x = np.frombuffer(payload + bytes(UNIT), np.uint8).astype(float) - 128
    window = np.hanning(WINDOW + 1)[:-1]
    rows = [np.rint(np.abs(np.fft.fft(x[a : a + WINDOW] * window)) ** 2) for a in range(0, len(payload), UNIT)]
    best = [[max(range(lo, hi), key=lambda b: (r[b], -b)) for lo, hi in BANDS] for r in rows]
    peaks = []
    for t, r in enumerate(rows):
        for k in range(len(BANDS)):
            v = r[best[t][k]]
            left = rows[t - 1][best[t - 1][k]] if t else -1
            right = rows[t + 1][best[t + 1][k]] if t + 1 < len(rows) else -1
            if v >= FLOOR and v > left and v >= right:
                peaks.append((t, best[t][k]))
    return sorted(t << 16 | (b - 1) << 10 | (c - 1) << 4 | u - t for i, (t, b) in enumerate(peaks) for u, c in peaks[i + 1 : i + 1 + FAN] if 0 < u - t <= REACH)


def test_round_trip():
    for t in TEXTS:
        p = padded(t.encode())
        assert len(p) % 64 == 0 and len(p) > 0 and p.rstrip(b"\0") == t.encode().rstrip(b"\0")
        assert from_wav(to_wav(p)) == p


def test_fingerprints_equal_brute_force_and_do_not_depend_on_neighbours():
    payloads = [padded(t.encode()) for t in TEXTS]
    together = fingerprints(payloads)
    for p, got in zip(payloads, together):
        assert got.tolist() == fingerprints([p])[0].tolist() == brute(p)
    assert fingerprints([]) == [] and any(len(x) for x in together)


def test_a_very_long_text(spark):
    text = "a line of some words, \n" * 200_000
    (r,) = audio_features(store_wav(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert from_wav(r.media)[: r.n_bytes] == text.encode() and r.fingerprint[-1] >> 16 > len(text) // UNIT - 100


def test_table(spark):
    rows = list(enumerate(TEXTS)) + [(None, None), (1, "a"), (1, "a")]
    docs = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, media string")
    got = with_feature_digest(audio_features(store_wav(docs))).collect()
    assert len(got) == len(rows)
    for (doc, text), r in zip(rows, got):
        p = padded((text or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc, len((text or "").encode()), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
        assert r.media_bytes == len(to_wav(p)) and r.media_sha256 == hashlib.sha256(to_wav(p)).hexdigest()
        assert r.fingerprint == brute(p) and r.media == to_wav(p) and r.feature.startswith(f"{len(r.fingerprint)}:")
    assert got[1].feature == got[-1].feature == got[-2].feature
    assert with_feature_digest(audio_features(store_wav(docs.limit(0)))).count() == 0
