"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import bpe, class_lm, exact_dedup, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, key long, flag int, kind string, n long, body string, batch long, score double, label int, cls long, list long, bucket int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts():
    base = [f"word{i % 17} thing{i % 23} and{i} so on {i * i}" for i in range(400)]
    passage = " ".join(base[:12])
    return [
        None, "", " \t\n", "one", "One  ONE one", "é́ ü 中文字 \U0001f600 ok", passage, passage.upper(), passage + " tail", "head " + passage, " ".join(base), " ".join(base[5:] + ["new"]),
        "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q", "a  b c d e f g h i j k l m n o p", "x" * 5000, "line one\nline one\nline two\n\nline one", "<|endoftext|> it's don't x\x1c y",
        passage, passage, "x y " * 3000, "# * $ % & | < > !!",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(_texts())] + [(5, _texts()[5]), (None, "no id at all but ten words of text in here"), (None, None)]
    return spark.createDataFrame([(*r, "en" if k % 3 else None, None, None, "c", 1, 1, "k", 2, "b", 3, 0.5, 1, 4, 5, 6) for k, r in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def _input(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("key_bits", [64, 3, 1])
def test_exact_dedup(docs, empty, key_bits):
    rows = _input(docs)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, i))
    want, seen = [], set()
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        best = min(groups[norm])
        first = (i, t) not in seen  # of rows alike one may stay
        seen.add((i, t))
        want.append((i, best[3], len(groups[norm]), first and i == best[3] and len(t) == -best[0], hashlib.sha256(norm.encode()).hexdigest()))
    found = exact_dedup.deduplicate(docs, capacity=2, key_bits=key_bits).persist()
    assert _rows(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    # With few bits many texts share a slot, and only the chain tells them apart.
    assert found.agg(F.max("chain")).first()[0] >= {64: 0, 3: 1, 1: 4}[key_bits]
    assert exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_writes_many_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "REPEATS", 4)
    rows = [(1, "a b")] * 11 + [(2, "ab")] * 4 + [(None, "c")] * 5
    got = _rows(exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([(1, 1, 15, True)] + [(1, 1, 15, False)] * 10 + [(2, 1, 15, False)] * 4 + [(None, None, 5, True)] + [(None, None, 5, False)] * 4, key=repr)


def test_directory_doubles_and_splits():
    cells = {i: 1 for i in range(64)} | {5: 1000}
    directory = exact_dedup.build_directory(cells, 6, 8)
    assert len(directory) == 64 and sorted(set(directory)) == list(range(max(directory) + 1))
    assert directory == sorted(directory)  # buckets are ranges
    assert exact_dedup.build_directory({0: 3}, 4, 8) == [0]
    full = collections.Counter()
    for cell, n in cells.items():
        full[directory[cell]] += n
    assert all(n <= 8 or b == directory[5] for b, n in full.items())


def test_bpe_round_trip(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    reference = bpe._encoding(path, public_tokenizers.PATTERN)
    out = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    got = sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out.collect()), key=repr)
    assert got == sorted(((i, np.array(reference.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in _input(docs)), key=repr)
    both = bpe.encode(docs, path, public_tokenizers.PATTERN, with_decoded=True)
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in both.collect()), key=repr) == got
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def _components(rows, words, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall(t.translate(ASCII))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("words", "percent"), [(5, 80), (4, 85), (2, 60)])
def test_ngram_join(docs, empty, words, percent):
    got = _rows(ngram_join.join(docs, words, percent), "doc_id", "n_shingles", "component_id")
    assert got == sorted(_components(_input(docs), words, percent), key=repr)
    if words == 5:
        assert ngram_join.join(empty).count() == 0


def test_ngram_join_deals_long_lists(spark, monkeypatch):
    """Sets that share blocks, and so a list, without being similar to each other."""
    monkeypatch.setattr(ngram_join, "DEALT", 3)
    rng = np.random.default_rng(5)
    core = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join(core + [f"w{rng.integers(10**6)}" for _ in range(int(rng.integers(2, 14)))])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 60, 7)]
    got = _rows(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85), "doc_id", "n_shingles", "component_id")
    assert got == sorted(_components(rows, 4, 85), key=repr)


def test_ngram_join_on_random_families(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(8, 400))]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.integers(0, max(2, len(t) // 40))):
                t[rng.integers(len(t))] = f"e{rng.integers(100)}"
            rows.append((len(rows), " ".join(t)))
    got = _rows(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85), "doc_id", "n_shingles", "component_id")
    assert got == sorted(_components(rows, 4, 85), key=repr)


def _cut(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_suffix_dedup(docs, empty):
    rows = sorted((r for r in _input(docs)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.deduplicate(docs).collect()), key=repr)
    assert got == sorted(_cut(rows), key=repr)
    assert suffix_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("hot", [2, 5, 1000])
def test_suffix_dedup_with_hot_anchors(spark, monkeypatch, hot):
    rng = np.random.default_rng(hot)
    noise = lambda n: "".join(rng.choice(list("abcdefghij klmn"), n))
    line, passage = noise(60), noise(260)
    rows = [(int(i) if i % 9 else None, noise(rng.integers(0, 200)) + line + noise(90) + (passage if i % 2 else passage[: 150 + i]) + noise(40) + line) for i in rng.permutation(60)]
    rows += [rows[3], (7, passage), (8, line + line), (9, "\u4e2d" * 90)]
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_PART", 1000)
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = _cut(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])))
    known = lambda found: sorted((r for r in found if r[0] is not None), key=repr)  # noqa: E731  rows of one id, or none, stand in any fixed order
    assert known((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got if r["doc_id"] != rows[3][0]) == known(w for w in want if w[0] != rows[3][0])
    assert sum(r["n_removed"] for r in got) == sum(w[2] for w in want)


def test_multikey_quicksort_and_tries():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(97, 99, 3000).astype(np.uint8)] * 2 + [np.zeros(8, np.uint8)])
    w = suffix_dedup.words8(text)
    at = np.arange(5000)
    order, group = suffix_dedup.multikey_quicksort([w[at + d].byteswap() for d in (0, 8, 16)])
    keys = [text[i : i + 24].tobytes() for i in order]
    assert keys == sorted(keys)
    assert all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], group, group[1:]))
    starts = np.arange(4000)
    hit = suffix_dedup.blind_tries(w, starts, np.zeros(len(starts), np.int64), 40)
    seen, want = set(), []
    for s in starts:
        k = text[s : s + 40].tobytes()
        want.append(k in seen)
        seen.add(k)
    assert hit.tolist() == want


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    window = 64
    got = packing.pack(docs, path, window=window).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"], r["doc_tokens"], r["start"]].append(bytes(r["ids"]))
    want = collections.defaultdict(list)
    for i, t in _input(docs):
        ids = [*packing._tokenizer(path).encode(t, add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), window):
            want[i, len(ids), s].append(np.array(ids[s : s + window], "<u4").tobytes())
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    windows = collections.defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert packing.pack(empty, path).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = sorted(rng.integers(1, 65, 300).tolist(), reverse=True)
        rooms: list[int] = []
        for n in lengths:
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(64 - n)
        histogram = collections.Counter(lengths)
        filled = collections.Counter()
        moves = packing.plan(histogram, 64)
        for k, (length, rank, each, first, _) in enumerate(moves):
            end = moves[k + 1][1] if k + 1 < len(moves) and moves[k + 1][0] == length else histogram[length]
            for j in range(end - rank):
                filled[first + j // each] += length
        assert sorted(64 - v for v in filled.values()) == sorted(rooms)


def test_class_lm(docs, empty):
    rows = _input(docs)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    out = class_lm.score(docs, held, classes=8).collect()
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0
    count = collections.Counter()
    toks = lambda t: [*WORD.findall(t.translate(ASCII)), ""]
    for i, t in rows:
        if not is_held(i):
            count.update(toks(t))
    total, kinds = sum(count.values()), len(count)
    want = sorted(((i, is_held(i), len(toks(t)), sum(count[w] > 0 for w in toks(t)), total, round(sum(np.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in toks(t)), 6)) for i, t in rows), key=repr)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in out)
    assert class_lm.score(empty, held).count() == 0
    assert {round(r["base_score"], 9) for r in class_lm.score(docs, F.lit(True)).collect()} == {0.0}


def test_class_lm_beats_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = class_lm.score(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0)
    base, model = out.where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert model > base


def test_class_lm_clusters_words_beyond_the_frequent_ones(spark):
    rng, n = np.random.default_rng(3), 3000
    name = [f"w{i:04}zzz" for i in range(n)]  # one ending, one frequency; even and odd words take turns
    rows = []
    for _ in range(12):
        words = np.stack([rng.permutation(np.arange(0, n, 2)), rng.permutation(np.arange(1, n, 2))], 1).ravel()
        rows += [(len(rows) + k, " ".join(name[i] for i in w)) for k, w in enumerate(words.reshape(-1, 60))]
    turns, apart = [x for i in range(2000, 2060, 2) for x in (i, i + 901)], [*range(2000, 2060, 2), *range(2901, 2961, 2)]
    rows += [(-1, " ".join(name[i] for i in turns)), (-2, " ".join(name[i] for i in apart))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in class_lm.score(docs, F.col("doc_id") < 0, classes=8).where("held_out").collect()}
    assert got[-1] > got[-2] + 15  # the same words, in and out of turn


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    group = rng.integers(0, 3, 30)
    p = np.array([[0.1, 0.8, 0.1], [0.1, 0.1, 0.8], [0.8, 0.1, 0.1]])
    table = rng.poisson(20 * p[group][:, group]).astype(float)
    cls = class_lm.exchange(table, 3, 20)
    assert len({(a, b) for a, b in zip(group, cls)}) == 3  # the classes are found again


def test_quality_rules(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    out = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in quality_rules.judge(docs, labels).collect()}
    for i, t in _input(docs):
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = out[i, len(w), sum(map(len, w))]
        assert (r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert r["kept"] == (not r["base_failed"])  # without labels no further rule is active
    assert quality_rules.judge(empty, labels.limit(0)).count() == 0


def test_risk_controlled_cutoffs():
    assert abs(quality_rules.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0
    rule = "symbols_per_word"
    above = [0] * 10 + [200] * (quality_rules.GRID - 10)
    chosen = quality_rules.select_cutoffs({("en", rule): (20_000, above), ("fr", rule): (10, above)})
    assert chosen == {("en", rule): quality_rules.cutoffs(rule)[9]}


def test_url_filter(spark):
    caps = spark.createDataFrame(
        [(1, "http://a.b.example.com/x/y.html?q#f", "2024-02-01"), (1, "http://a.b.example.com/x/y.html?q#f", "2024-02-01"), (2, "HTTPS://User@B.example.com:80/", "2024-03-05"), (3, "nothing", "2024-02-01"), (None, None, None), (4, "http://a.b.example.com/x/", "2024-04-01"), (5, "http://example.com", None)],
        "capture_id long, url string, fetched_at string",
    ).withColumn("pattern", F.lit("clash")).withColumn("copies", F.lit(9))
    lists = spark.createDataFrame(
        [("l", "domain", "b.example.com", "add", "2024-01-01"), ("l", "domain", "b.example.com", "remove", "2024-03-01"), ("l", "domain", "B.Example.com", "add", "2024-03-05"), ("m", "prefix", "a.b.example.com/x/", "add", "2024-02-01"), ("n", "domain", "example.com", "add", "2024-01-05"), ("n", "domain", "example.com", "remove", "2024-01-05")],
        "list string, kind string, pattern string, action string, at string",
    ).withColumn("at", F.col("at").cast("timestamp"))
    got = _rows(url_filter.evaluate(caps, lists), "capture_id", "blocked", "n_active", "lists", "pattern")
    assert got == sorted([(1, True, 2, "l,m", "a.b.example.com/x/")] * 2 + [(2, True, 1, "l", "b.example.com"), (3, False, 0, "", None), (None, False, 0, "", None), (4, True, 2, "l,m", "a.b.example.com/x/"), (5, False, 0, "", None)], key=repr)
    slash = spark.createDataFrame([("p", "prefix", x, "add", "2024-01-01") for x in ("a.com/ads", "a.com/dir/", "a.com/x/page.html", "b.com/")], "list string, kind string, pattern string, action string, at string")
    urls = {"http://a.com/ads": True, "http://a.com/ads/1": True, "http://a.com/adsense": False, "http://a.com/dir": False, "http://a.com/dir/": True, "http://a.com/dir/y": True, "http://a.com/x/page.html?q": True, "http://a.com/x/page.htm": False, "http://b.com": False, "http://b.com/": True, "http://a.com/X/Page.html/z": True}
    asked = spark.createDataFrame([(i, u, "2024-02-01") for i, u in enumerate(urls)], "capture_id long, url string, fetched_at string")
    assert [r["blocked"] for r in url_filter.evaluate(asked, slash).orderBy("capture_id").collect()] == list(urls.values())
    assert url_filter.evaluate(caps.limit(0), lists).count() == 0
    assert not any(r["blocked"] for r in url_filter.evaluate(caps, lists.limit(0)).collect())


def test_url_filter_against_intervals(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "HOT_ROWS", 5)
    monkeypatch.setattr(url_filter, "COPIES", 3)
    rng = np.random.default_rng(2)
    events = sorted({(str(rng.choice(["l", "m"])), "domain", str(rng.choice(["a.com", "b.a.com", "c.org"])), str(rng.choice(["add", "remove"])), f"2024-01-{d:02d}") for d in rng.integers(1, 29, 60)})
    caps = [(int(i % 40), str(rng.choice(["http://b.a.com/x", "http://a.com", "http://c.org/", "http://d.org"])), f"2024-01-{rng.integers(1, 29):02d}") for i in range(120)] + [(1, "http://a.com", "2024-01-09")] * 8
    want = []
    for i, url, at in caps:
        host = url.split("/")[2]
        active = set()
        for name in ("l", "m"):
            for pattern in ("a.com", "b.a.com", "c.org"):
                past = [(e[4], e[3] != "add") for e in events if e[0] == name and e[2] == pattern and e[4] <= at]
                if (host == pattern or host.endswith("." + pattern)) and past and not max(past)[1]:
                    active.add((name, pattern))
        want.append((i, bool(active), len(active), ",".join(sorted({a for a, _ in active})), min(((-len(p), p) for _, p in active), default=(0, None))[1]))
    got = _rows(url_filter.evaluate(spark.createDataFrame(caps, "capture_id long, url string, fetched_at string"), spark.createDataFrame(events, "list string, kind string, pattern string, action string, at string")), "capture_id", "blocked", "n_active", "lists", "pattern")
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize(("operator", "label", "threshold"), [(toxicity, "toxic", 0.3), (quality_classifier, "quality", 0.5)])
def test_classifiers_on_odd_rows(spark, docs, empty, operator, label, threshold):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    none = spark.createDataFrame([(None, 1), (3, None)], f"doc_id long, {label} int")
    some = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(22)] + [(3, 1), (None, 1)], f"doc_id long, {label} int")
    for labels in (none, some):
        out = operator.classify(docs, labels, held).collect()
        assert len(out) == docs.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in out)
    assert operator.classify(empty, some, held).count() == 0


@pytest.mark.parametrize(("operator", "label", "least"), [(toxicity, "toxic", 0.9), (quality_classifier, "quality", 0.95)])
def test_classifiers_hold_out(spark, operator, label, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    scored = operator.classify(docs, labels, held).where("held_out").join(labels, "doc_id")
    right = scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).persist()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.count() <= docs.count()
            assert out.select("doc_id").distinct().count() == out.count()
            docs = out
    assert out.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def _kept_exact(rows):
    best = {}
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[norm] = min(best.get(norm, (1, True, 0, None)), (-len(t or ""), i is None, i or 0, i))
    stays = [(i, t) for i, t in rows if best[re.sub(r"[\x20\x09-\x0D]", "", t or "")] == (-len(t or ""), i is None, i or 0, i)]
    return list({(i, t or ""): (i, t) for i, t in stays}.values())


def _kept_near(rows):
    return [r for r, (i, _, least) in zip(rows, _components([(i, t or "") for i, t in rows], 5, 80)) if i == least]


def _kept_passages(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    cut = [(i, t, gone, kept.decode(errors="ignore")) for (i, t), (_, _, gone, _, kept) in zip(rows, _cut([(i, t or "") for i, t in rows]))]
    return [(i, new if gone else t) for i, t, gone, new in cut if new or not gone]


@pytest.mark.parametrize("odd", [True, False])
def test_pipeline_stages_against_loops(spark, docs, odd):
    import corpus_pipeline

    now = docs if odd else spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, plain in (("exact_dedup", _kept_exact), ("ngram_join", _kept_near), ("suffix_dedup", _kept_passages)):
        rows = [(r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()]
        out = stages[name](spark, now, SF).persist()
        assert out.columns == corpus_pipeline.COLUMNS
        assert _rows(out, "doc_id", "text") == sorted(plain(rows), key=repr)
        if not odd:  # each stage works on what the one before kept
            now = out
    other = {(r["doc_id"], r["lang"], r["source"]) for r in now.select("doc_id", "lang", "source").collect()}
    assert {(r["doc_id"], r["lang"], r["source"]) for r in out.select("doc_id", "lang", "source").collect()} <= other
    assert out.where("n_chars <> length(text)").count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, docs, empty):
    import corpus_pipeline

    for table in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert (out.count() == 0) == (table is empty)
