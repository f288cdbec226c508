"""Headers of made-up media files, decode hooks, scene detection and the Hamming join's plan."""

from __future__ import annotations

import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import dedupe, kernels, scenes
from lakeloom.sources import probe


def _el(number: int, body: bytes, size: bytes | None = None) -> bytes:
    n = number.to_bytes((number.bit_length() + 7) // 8, "big")
    return n + (size or (len(body) | 1 << 56).to_bytes(8, "big")) + body


def _mkv(codec: str, video: bool, unknown: bool = False) -> bytes:
    detail = _el(0xE0, _el(0xB0, b"\x02\x80") + _el(0xBA, b"\x01\x68")) if video else _el(0xE1, _el(0xB5, struct.pack(">f", 48000)) + _el(0x9F, b"\x02") + _el(0x6264, b"\x18"))
    track = _el(0xAE, _el(0xD7, b"\x01") + _el(0x83, b"\x01" if video else b"\x02") + _el(0x86, codec.encode()) + detail)
    second = _el(0xAE, _el(0x86, b"A_MPEG/L3"))
    body = _el(0xEC, b"\0" * 40) + _el(0x1549A966, _el(0x2AD7B1, (1_000_000).to_bytes(3, "big")) + _el(0x4489, struct.pack(">d", 2500.0))) + _el(0x1654AE6B, track + second) + b"\x1f\x43\xb6\x75\x01\xff\xff"
    return _el(0x1A45DFA3, _el(0x4282, b"webm")) + _el(0x18538067, body, b"\x01" + b"\xff" * 7 if unknown else None)


def _ogg(packet: bytes, granule: int) -> bytes:
    page = lambda g, data: b"OggS\0\2" + struct.pack("<q", g) + b"\0" * 12 + bytes([1, len(data)]) + data
    return page(0, packet) + page(granule, b"\0" * 50)


_WAV = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"LIST\3\0\0\0abc\0data" + struct.pack("<I", 44100 * 4)
_FLAC = b"fLaC\0\0\0\x22" + b"\0" * 10 + ((96000 << 44) | (1 << 41) | (23 << 36) | 48000).to_bytes(8, "big") + b"\0" * 16
_OPUS = _ogg(b"OpusHead\1\2" + struct.pack("<HIhB", 312, 44100, 0, 0), 48000 + 312)
_VORBIS = _ogg(b"\x01vorbis" + struct.pack("<IBIiiiB", 0, 1, 22050, 0, 0, 0, 0xB8) + b"\1", 44100)
FILES = {
    "a.mkv": (_mkv("V_AV1", True), ("video", "webm", "av1", 640, 360, None, None, None, 2.5, True, "ok")),
    "b.dat": (_mkv("V_MPEG4/ISO/AVC", True, unknown=True), ("video", "webm", "v_mpeg4/iso/avc", 640, 360, None, None, None, 2.5, False, "unsupported")),
    "c.mkv": (_mkv("A_OPUS", False), ("audio", "webm", "opus", None, None, 48000, 2, 24, 2.5, True, "ok")),
    "d.wav": (_WAV, ("audio", "wav", "wav", None, None, 44100, 2, 16, 1.0, True, "ok")),
    "e.flac": (_FLAC, ("audio", "flac", "flac", None, None, 96000, 2, 24, 0.5, True, "ok")),
    "f.opus": (_OPUS, ("audio", "ogg", "opus", None, None, 48000, 2, None, 1.0, True, "ok")),
    "g.ogg": (_VORBIS, ("audio", "ogg", "vorbis", None, None, 22050, 1, None, 2.0, True, "ok")),
    "h.MP4": (b"\0\0\0\x18ftypisom", ("video", "mp4", None, None, None, None, None, None, None, False, "unsupported")),
    "i.mov": (b"", ("video", "mov", None, None, None, None, None, None, None, False, "unsupported")),
    "j.txt": (b"just text", (None,) * 9 + (False, "unsupported")),
    "k.mkv": (b"\x1a\x45\xdf\xa3\x01", (None,) * 9 + (False, "unsupported")),
    "l.wav": (b"RIFF\0\0\0\0WAVE", (None,) * 9 + (False, "unsupported")),
}
COLUMNS = [*probe.FIELDS, "supported", "status"]


def test_headers(spark, tmp_path):
    for name, (body, _) in FILES.items():
        (tmp_path / name).write_bytes(body)
    paths = [(str(tmp_path / n), "old") for n in FILES] + [(str(tmp_path / "missing.wav"), "old"), (None, "old"), (str(tmp_path / "d.wav"), "again")]
    rows = probe.probe_files(spark.createDataFrame(paths, "path string, codec string")).collect()
    assert len(rows) == len(paths)
    by_path = {r["path"]: r for r in rows}
    for name, (_, want) in FILES.items():
        got = by_path[str(tmp_path / name)]
        assert tuple(got[c] for c in COLUMNS) == want, name
    lost = by_path[str(tmp_path / "missing.wav")]
    assert lost["status"] == "failed" and "FileNotFoundError" in lost["probe_error"]
    assert by_path[None]["status"] == "unsupported"


@pytest.mark.parametrize("name", list(FILES))
def test_cut_or_broken_headers_never_raise(name):
    body = FILES[name][0]
    rng = random.Random(name)
    for cut in range(len(body)):
        probe.probe_bytes(body[:cut], body[:cut], "bin")
        broken = bytearray(body)
        broken[cut] = rng.randrange(256)
        probe.probe_bytes(bytes(broken), bytes(broken), "bin")


def test_technical_of(spark):
    rows = spark.createDataFrame([("video", "av1", 4, 3, 1.5), ("audio", "MP3", 4, 3, None), ("image", None, 4, 3, None), (None, None, None, None, None)], "k string, c string, w int, h int, s double")
    got = [tuple(r[0]) for r in rows.select(probe.technical_of(F.col("k"), F.col("c"), F.col("w"), F.col("h"), F.col("s"))).collect()]
    assert got == [("video", "av1", "", True, 4, 3, 1.5), ("audio", "MP3", "", False, None, None, None), ("unknown", "image", "", False, None, None, None), ("unknown", "", "", False, None, None, None)]


def test_decode_hooks(spark):
    def middle(path):
        return None if path == "none" else (bytes(range(256)) * 4, 16, 16)

    def samples(path):
        return None if path == "none" else ([0.5, -0.5] * 4096, 2)

    def film(path):
        dark, bright = bytes([0, 0, 0, 255]) * 64, bytes([(x * 37 + y) % 256 for x in range(64) for y in range(4)])
        yield from ((dark if i % 50 < 25 else bright, 8, 8) for i in range(0 if path == "none" else 120))

    files = spark.createDataFrame([("one",), ("none",), (None,)], "path string")
    assert {tuple(r) for r in probe.hash_videos(files, middle).collect()} == {("one", kernels.dhash(*middle("one"))), ("none", None)}
    got = {r["path"]: r["fingerprint"] for r in probe.fingerprint_audio(files, samples, 3).collect()}
    assert got["none"] is None and got["one"] == pytest.approx(kernels.audio_fingerprint(*samples("one"), 3))
    frames = probe.decode_frames(files, film, 100, stride=5)
    assert sorted(r["frame"] for r in frames.select("frame").collect()) == list(range(0, 100, 5))
    distance = bin((kernels.dhash(*next(film("one"))) ^ kernels.dhash(*list(film("one"))[25])) & (1 << 64) - 1).count("1")
    found = scenes.SceneDetector(hash_distance=distance - 1, every_nth_frame=5).detect(frames, 25.0)
    assert [tuple(r) for r in found.orderBy("scene").collect()] == [("one", 0, 0.0, 1.0), ("one", 1, 1.0, 2.0), ("one", 2, 2.0, 3.0), ("one", 3, 3.0, None)]
    assert scenes.SceneDetector(hash_distance=distance).detect(frames, 25.0).count() == 1


def test_short_scenes_are_judged_by_the_open_scene(spark):
    cuts = spark.createDataFrame([("a", i, x, None) for i, x in enumerate([0.0, 0.6, 1.2, 1.8, 5.0])] + [("b", 0, 0.0, None)], "asset_id string, scene int, start_s double, end_s double")
    got = sorted(tuple(r) for r in scenes.merge_short_scenes(cuts, 1.0).collect())
    assert got == [("a", 0, 0.0, 1.2), ("a", 1, 1.2, 5.0), ("a", 2, 5.0, None), ("b", 0, 0.0, None)]


@pytest.mark.parametrize("k", [0, 3, 8, 18, 64])
@pytest.mark.parametrize("bands", [0, 2, 4, 7])
def test_hamming_candidates_are_complete(spark, k, bands, monkeypatch):
    if bands and dedupe._near(64 // bands + 1, min(k // bands, 64)) > dedupe.NEAR_VALUES:
        pytest.skip("too many near values")
    monkeypatch.setattr(dedupe, "TILE_ROWS", 13)
    rng = random.Random(k)
    base = [rng.getrandbits(64) for _ in range(15)]
    hashes = [h ^ sum(1 << b for b in rng.sample(range(64), d)) for h in base for d in (0, 1, k // 2, min(k, 64))]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    rows = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    want = {(a, b) for a, b in itertools.combinations(range(len(hashes)), 2) if bin(hashes[a] ^ hashes[b]).count("1") <= k}
    met = dedupe.hamming_candidates(rows, k, bands, len(hashes))
    got = [(r["a"], r["b"]) for r in met.where(dedupe.hamming(F.col("ha"), F.col("hb")) <= k).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert all(signed[r["a"]] == r["ha"] and signed[r["b"]] == r["hb"] for r in met.limit(20).collect())


def test_hamming_plan_makes_few_candidates(spark):
    for n in (10_000, 10**6, 10**9):
        assert dedupe.hamming_plan(n, 8)[1] < 0.1 * n * n / 2
        assert dedupe.hamming_plan(n, 18)[1] <= n * n / 2
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.getrandbits(63)) for i in range(3000)], "id long, h long").persist()
    every = 3000 * 2999 / 2
    assert dedupe.hamming_candidates(rows, 8, dedupe.hamming_plan(10**6, 8)[0], 3000).count() < 0.1 * every
    assert dedupe.hamming_candidates(rows, 18, dedupe.hamming_plan(3000, 18)[0], 3000).count() <= every


def test_wide_hamming_joins_meet_in_tiles(spark):
    """At k = 18 of 64 bits bands would send each row 10,072 times: all pairs are compared in tiles, and no row is joined."""
    for n in (10**5, 6 * 10**5, 10**8):
        assert dedupe.hamming_plan(n, 18)[0] == 0
    rng = random.Random(6)
    hashes = [rng.getrandbits(64) for _ in range(700)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), 18)) for h in hashes[:50]] + hashes[:5]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    rows = spark.createDataFrame([(f"{i:04d}", h) for i, h in enumerate(signed)], "id string, hash long").repartition(5)
    pairs = dedupe.hamming_pairs(rows, 18)
    got = {(int(r["a"]), int(r["b"])): r["distance"] for r in pairs.collect()}
    want = {(a, b): d for a, b in itertools.combinations(range(len(hashes)), 2) if (d := (hashes[a] ^ hashes[b]).bit_count()) <= 18}
    assert got == want and len(want) >= 55
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_blocks_hold_no_more_as_rows_grow(spark):
    """A task of the wide Hamming join holds two blocks; their size is bounded and doesn't follow the number of rows."""
    from lakeloom.operators import tiles

    for n in (10**5, 6 * 10**5, 10**7):
        assert n / tiles.blocks_of(spark.range(1), n, dedupe.TILE_ROWS) <= dedupe.TILE_ROWS == 1 << 15
