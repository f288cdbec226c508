"""The queries that SQL can express against DuckDB; every query runs on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lakeloom.llm import bpe, packing, registry, suffix_dedup
from tests.llm import test_operators

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name not in registry.ORACLES:
        return
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(str(r[n]) for n in names) for r in got), key=repr) == sorted((tuple(map(str, r)) for r in found.fetchall()), key=repr)


def _documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_bpe_query_equals_the_tokenizer(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in _documents(spark):
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = registry.op3_bpe(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_splits_are_the_tokenizer_s_on_every_code_point():
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    split, piece = bpe._splitter(public_tokenizers.PATTERN), enc._encode_single_piece
    ids = lambda t: [i for w in split(t) for i in piece(w.encode())]
    assert ids("\U0003d11a\u9718") == enc.encode_ordinary("\U0003d11a\u9718") == [172, 121, 226, 248, 165, 250, 246]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 64):
        text = "".join(f"a{chr(c)}b1{chr(c)}1 {chr(c)}! {chr(c)} x" for c in points[lo : lo + 64])
        assert ids(text) == enc.encode_ordinary(text)
    rng = random.Random(1)
    pool = [*range(0x300), *range(0x600, 0x700), 0x558, 0x88F, 0xA7CE, 0x11DE0, 0x3D11A, *range(0x2000, 0x2070), 0x3000, 0x10FFFF]
    for _ in range(100_000):
        text = "".join(chr(rng.choice(pool)) if rng.random() < 0.8 else rng.choice(" \n\t'sreaZ1") for _ in range(rng.randint(0, 20)))
        assert ids(text) == enc.encode_ordinary(text)


def test_join_query_equals_all_pairs(spark):
    want = test_operators._components(_documents(spark), 4, 85)
    assert sorted(map(tuple, registry.op4_ngram_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect())) == sorted(want)


def test_passage_query_equals_the_plain_cut(spark):
    want = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in test_operators._cut(sorted(_documents(spark)))]
    assert sorted(map(tuple, registry.op9_suffix_dedup(spark, SF).collect())) == sorted(want)


def test_packing_query_equals_the_tokenizer(spark):
    tokenizer = packing._tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want, lengths = [], []
    for i, t in _documents(spark):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 4096):
            part = np.array(ids[s : s + 4096], "<u4")
            want.append((i, s, len(part), zlib.crc32(part.tobytes()), len(ids)))
            lengths.append(len(part))
    got = registry.op10_packing(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(want)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((4096 if fit is None else fit) - n)
    assert len(sequences) == len(rooms)


def test_texts_beyond_a_batch(spark):
    rng = np.random.default_rng(0)
    letters = np.frombuffer(b"abcdefghijklmnop qrstuvwxyz    ", np.uint8)
    noise = lambda n: rng.choice(letters, n).tobytes().decode()
    passage = "!" + noise(1000) + "!"
    text = noise(9 << 20) + passage + noise(9 << 20) + passage
    docs = spark.createDataFrame([(2, passage), (1, text), (3, None)], "doc_id long, text string").repartition(1)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    coded = {r["doc_id"]: r for r in bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True).collect()}
    assert bytes(coded[1]["ids"]) == np.array(enc.encode_ordinary(text), "<u4").tobytes() and bytes(coded[1]["decoded"]) == text.encode()
    cut = {r["doc_id"]: r for r in suffix_dedup.deduplicate(docs).collect()}
    assert (cut[1]["n_removed"], cut[2]["n_removed"], cut[3]["n_bytes"]) == (len(passage), len(passage), 0)
    assert bytes(cut[1]["kept"]).decode() == text[: -len(passage)]
