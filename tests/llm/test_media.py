import hashlib
import zlib

import numpy as np

from tessera.llm import media

from .helpers import docs, rows, saved


def test_round_trip_and_digests(spark, tmp_path):
    texts = {1: "abc", 2: None, 3: "", 4: "x" * 64, 5: "é" * 300_000, 6: "abc"}
    path = saved(tmp_path, documents=docs(spark, [*texts.items(), (1, "abc"), (None, "q")], extra=True))
    got = media.op6_media_columns(spark, path).collect()
    assert len(got) == 8
    for r in got:
        text = ("q" if r["doc_id"] is None else texts[r["doc_id"]] or "").encode()
        padded = text + bytes(-len(text) % 64 or (64 if not text else 0))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(text), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        wav = media.to_wav(padded)
        frames, codes = map(np.array, media.fingerprint(padded))
        assert r["frames"] == frames.tolist() and r["codes"] == codes.tolist() and r["feature"].split(":")[0] == str(len(codes))
        assert (r["media_bytes"], r["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest())
    assert len({r["feature"] for r in got if r["doc_id"] in (1, 6)}) == 1


def test_broken_media_and_empty_table(spark):
    broken = spark.createDataFrame([(1, 3, bytearray(b"RIFF")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r[2:5] for r in rows(media.analyse(broken))] == [(None, None, None)] * 2
    assert rows(media.analyse(media.encode(docs(spark, [])))) == []


def test_peaks_find_a_tone():
    t = np.arange(64 * 64)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * t / media.WINDOW)).astype(np.uint8)
    found = media.peaks(media.spectrum(tone.astype(np.float32) - 128))
    assert (found[:, 1] == 40).all()
    times, codes = media.fingerprint(tone.tobytes())
    assert (np.diff(times) >= 0).all() and len(times) == len(codes) > 0


def test_blocks_do_not_change_results(monkeypatch):
    data = np.random.default_rng(0).integers(0, 256, 64 * 300, np.uint8).tobytes()
    one = media.fingerprint(data)
    monkeypatch.setattr(media, "BLOCK", 7)
    two = media.fingerprint(data)
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()


def test_fingerprint_equals_plain_loops():
    """A plain discrete Fourier transform, a loop over bands and a loop over pairs."""
    payload = b"The quick brown fox jumps over the lazy dog, 1234567890. " * 27
    samples = [b - 128 for b in payload] + [0] * (-len(payload) % media.HOP)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * k / (media.WINDOW - 1)) for k in range(media.WINDOW)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.WINDOW // 2 + 1), np.arange(media.WINDOW)) / media.WINDOW)
    tops = []
    for start in range(0, len(samples) - media.WINDOW + 1, media.HOP):
        level = [round(16 * np.log2(1 + abs((row * [s * w for s, w in zip(samples[start : start + media.WINDOW], window)]).sum()))) for row in turn]
        mean, row = sum(level) / len(level), []
        for low, high in zip(media.BANDS, media.BANDS[1:]):
            best = max(range(low, high), key=lambda k: (level[k], -k))
            row.append(best if level[best] > mean else -1)
        tops.append(row)
    want = []
    for t, row in enumerate(tops):
        for gap in range(1, media.FAN_OUT + 1):
            for b, first in enumerate(row):
                if t + gap < len(tops) and first >= 0 and (later := tops[t + gap][(b + 1) % len(row)]) >= 0:
                    want.append((t, first << 11 | later << 2 | gap))
    frames, codes = media.fingerprint(payload)
    assert sorted(want) == list(zip(frames.tolist(), codes.tolist())) and want
