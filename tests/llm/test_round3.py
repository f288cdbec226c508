"""Vector codes, importance resampling and decontamination against brute force, on odd rows; their parts on random ones."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import decontamination, exact_dedup, importance, vector_codes
from lakeloom.llm.common import Workspace

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return WORD.findall((text or "").translate(ASCII))


# Vector codes.


def _plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, label, components) to [(vec_id, label, code, error)] and the codebooks, by plain integers."""
    whole = [(i, label, [math.floor(scale * x) if abs(x) < 1e300 else scale * int(x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0))
    if not whole:
        return [], []
    size = len(whole[0][2])
    whole = [r for r in whole if len(r[2]) == size]
    w = size // parts
    cut = [[r[2][p * w : (p + 1) * w] for p in range(parts)] for r in whole]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, v: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        mine = defaultdict(list)
        for c in cut:
            for p in range(parts):
                mine[p, best(p, c[p])].append(c[p])
        for (p, e), some in mine.items():
            books[p][e] = [sum(x) // len(some) for x in zip(*some)]
    out = []
    for (i, label, _), c in zip(whole, cut):
        codes = [best(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for e in codes), sum(far(c[p], books[p][e]) for p, e in enumerate(codes))))
    return out, books


def _check_codes(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], f"vec_id long, label int, embedding {kind}, size int, code string, body binary").repartition(3)
    got, books = vector_codes.encode(df)
    got = got.collect()
    clean = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) if "float" in kind else x for x in v]) for i, label, v in rows]
    want, plain = _plain_codes(clean)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    top = vector_codes.GREATEST
    assert Counter((r["vec_id"], r["label"], bytes(r["code"]).hex(), r["error"], r["label_error"]) for r in got) == Counter((i, label, c, min(e, top), min(sums[label], top)) for i, label, c, e in want)
    assert vector_codes.books_sha256(books) == hashlib.sha256(",".join(str(x) for b in plain for e in b for x in e).encode()).hexdigest()


def test_vector_codes(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 2, None]), [rng.gauss(0, 0.2) for _ in range(24)]) for i in range(80)]
    odd = [(200, 1, None), (201, 1, []), (202, 2, [None] * 24), (203, 2, [math.nan] * 24), (204, 2, [math.inf] + [0.0] * 23), (205, 1, [0.5] * 23), (206, 1, [0.5] * 16), (None, 7, [0.1] * 24)]
    same = [(300 + i % 3, 4, [0.25] * 24) for i in range(30)] + [(400, None, rows[5][2])]  # repeats, ties
    _check_codes(spark, rows + odd + same)
    _check_codes(spark, rows[:3])
    _check_codes(spark, odd[:4])
    _check_codes(spark, [(0, 1, [0.0] * 8), (1, 1, [1.0] * 8)])


def test_vector_codes_of_large_numbers(spark):
    rng = random.Random(2)
    wide = [(i, i % 2, [rng.choice([1e30, -3.5e17, 0.1, 5000.25]) * rng.random() for _ in range(16)]) for i in range(25)]
    _check_codes(spark, wide, "array<double>")
    _check_codes(spark, [(i, 1, [rng.random() * (5000 if i == 20 else 1) for _ in range(16)]) for i in range(25)], "array<double>")


def test_nearest_is_exact_and_spares_distances():
    rng = np.random.default_rng(3)
    for width, spread in ((1, 9), (2, 3), (7, 50), (8, 4000), (33, 1 << 23)):
        centres = rng.integers(-spread, spread + 1, (16, width))
        x = centres[rng.integers(0, 16, 500)] + rng.integers(-max(1, spread // 50), max(2, spread // 50), (500, width))
        for book in (centres, np.repeat(centres[:4], 4, axis=0), centres[:1]):
            code, dist, measured = vector_codes.nearest(x, book)
            plain = ((x[:, None, :].astype(object) - book[None].astype(object)) ** 2).sum(2)
            want = np.array([min(range(len(book)), key=lambda e: (row[e], e)) for row in plain.tolist()])
            assert (code == want).all() and (dist == plain[np.arange(500), want]).all()
            if width >= 7 and book is centres:
                assert measured < 500 * 16 / 4


# Importance resampling.


def _plain_sample(docs, items, grams=1, buckets=10_000, percent=10, least=20, seed=2024):
    def feats(text):
        w = _words(text)
        return len(w), [" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]

    hit = lambda f: zlib.crc32(f.encode()) % buckets
    have = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(hit(f) for *_, fs in have for f in fs), Counter(hit(f) for _, x in items for f in feats(x)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    out = []
    for i, n, fs in have:
        weight = sum(gain(hit(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [(tuple(r[:4]), k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able)]
    return Counter(ranks + [(tuple(r[:4]), None) for r in out if not r[4]])


@pytest.mark.parametrize(("grams", "percent"), [(1, 10), (3, 50)])
def test_importance(spark, grams, percent):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["The", "of", "Wörld", "x1", "中文", "zz", "question", "É"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(90)] + [(200, None), (201, ""), (202, " \n\x00-!"), (203, "one"), (None, text(30)), (204, "big " * 60_000)]
    docs += [(5, docs[5][1])] * 4 + [(300 + i % 2, docs[7][1]) for i in range(6)]
    items = [(0, "question of the wörld"), (1, None), (None, "Question x1")]
    df = spark.createDataFrame([(*d, "s", 1, 2) for d in docs], "doc_id long, text string, source string, score long, rank long").repartition(3)
    target = spark.createDataFrame(items, "item_id long, text string")
    got = importance.resample(df, target, grams=grams, percent=percent)
    assert Counter(((r["doc_id"], r["n_features"], r["weight"], r["score"]), r["rank"]) for r in got.collect()) == _plain_sample(docs, items, grams, percent=percent)
    empty = importance.resample(df.limit(0), target)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    alone = importance.resample(df, target.limit(0), grams=grams, percent=percent)
    assert Counter(((r["doc_id"], r["n_features"], r["weight"], r["score"]), r["rank"]) for r in alone.collect()) == _plain_sample(docs, [], grams, percent=percent)


def test_sort_count_runs():
    rng = np.random.default_rng(5)
    for n in (0, 1, 1000):
        stream = rng.integers(0, 65536 if n else 1, n).astype(np.uint16)
        value, length = importance.runs(stream)
        assert dict(zip(value.tolist(), length.tolist())) == Counter(stream.tolist())
    with pytest.raises(ValueError, match="uint16"):
        importance.streams(None, buckets=65537)


# Decontamination.


def _plain_hits(docs, items, window):
    out = []
    have = [(i, _words(t)) for i, t in items]
    for doc_id, text in docs:
        words, hit, found = _words(text), set(), set()
        for i, item in have:
            n = min(window, len(item))
            runs = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
            at = [k for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in runs] if n else []
            hit.update(p for k in at for p in range(k, k + n))
            if at and i is not None:
                found.add(str(i))
        out.append((doc_id, len(words), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return out


@pytest.mark.parametrize(("window", "bound"), [(4, 1 << 18), (4, 0), (10, 1 << 18), (1, 1 << 18)])
def test_decontamination(spark, monkeypatch, window, bound):
    """With a bound of no rows every join is a shuffle."""
    monkeypatch.setattr(decontamination, "SENT_ROWS", bound)
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["a", "B", "the", "Ä", "中", "x9", "the", "the"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 14))) for i in range(8)] + [(8, None), (9, "!!"), (None, "rare words stand here and there a b c d e"), (10, items_text := "Some quite long passage that is nowhere else, of FIFTEEN words or so it seems to be")]
    items += [(10, items_text), (11, items_text), (12, "nowhere to be found " * 3), (13, "é É e"), (14, "the the the the the the the the the the the")]
    docs = [(i, text(rng.randint(0, 80))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "...!"), (103, "x-" + items_text.upper() + "-x"), (104, items_text[:40]), (105, "é É e"), (106, "é É e".upper()), (107, "rare words stand here and there A B C D E"), (None, items_text), (None, items_text), (103, "again " + items_text)]
    docs += [(108, "the " * 4000 + items_text + " the" * 3000), (109, " " + items_text), (110, "\x00words\x7fa")]
    df = spark.createDataFrame([(*d, "k", 1, 2, 3) for d in docs], "doc_id long, text string, item_id string, key long, pos int, term long").repartition(4)
    bench = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, doc_id long")
    got = decontamination.decontaminate(df, bench, window)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(_plain_hits(docs, items, window), key=repr)
    if window == 10 and bound:
        assert decontamination.decontaminate(df.limit(0), bench, window).count() == 0
        clean = decontamination.decontaminate(df, bench.limit(0), window).collect()
        assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)


def test_proximity(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 25)))) for i in range(30)]
    queries = [(0, "a b c"), (1, "H g"), (2, "a"), (3, "z a"), (4, ""), (5, "a a b")]
    df, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query long, text string")
    ws = Workspace(spark, "near_test")
    terms = ws.put(decontamination.vocabulary(q.unionByName(df.select(F.col("doc_id").alias("query"), "text").limit(0))), "v")
    postings = ws.put(decontamination.index(df, terms), "p")
    names = {r["key"]: r["doc_id"] for r in postings.where("term = -1").collect()}
    for span in (2, 4):
        got = Counter((r["query"], names[r["key"]], r["start"] - 1) for r in decontamination.near(postings, terms, q, span, ws).collect())
        want = Counter()
        for n, text in queries:
            words = set(_words(text))
            for i, t in docs:
                have = _words(t)
                for k in range(len(have)):
                    if words and have[k] in words and words <= set(have[k : k + span]):
                        want[n, i, k] += 1
        assert got == want


# Exact deduplication: its owners.


def test_owners_hold_ranges_of_buckets_and_shuffle_once(spark):
    """Each file of the index holds the buckets of one owner, copies of a hot text come from many salts, and no exchange stands above the owners' deal."""
    rows = [(i, f"text {i % 300}" if i % 3 else "the hot one") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = exact_dedup.deduplicate(docs, capacity=40)
        index = spark.read.parquet(f"{spark._lakeloom_works[-1]}/index")
        spans = sorted(map(tuple, index.groupBy(F.input_file_name().alias("f")).agg(F.min("bucket"), F.max("bucket")).drop("f").collect()))
        assert len(spans) > 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        assert got.where("text_sha256 = sha2('thehotone', 256)").select("group_size").distinct().first()[0] == 1000 and got.where("kept").count() == index.count() == 201
        salted = spark.read.parquet(f"{spark._lakeloom_works[-1]}/index").select("bucket", "key", F.lit("x").alias("norm"), F.lit(1).alias("n"), F.lit("1").cast("decimal(38,0)").alias("best"))
        plan = exact_dedup.slots(salted, 4, 100)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


# N-gram join: shingles stand rarest first.


@pytest.mark.parametrize("n", [500, 2000])
def test_a_common_phrase_makes_no_lists(spark, n):
    """Short texts that share a phrase of 14 words and are otherwise unlike are not compared; those that are near copies are."""
    from lakeloom.llm import ngram_join
    from lakeloom.llm.common import documents

    rng = random.Random(12)
    phrase = " ".join(f"common{i}" for i in range(14))
    texts = [f"{' '.join(f'w{rng.randrange(10**6)}' for _ in range(rng.randint(8, 20)))} {phrase} {' '.join(f'v{rng.randrange(10**6)}' for _ in range(rng.randint(8, 20)))}" for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    ws = Workspace(spark, "phrase_test")
    rows = ngram_join._sets(documents(df).withColumn("text_key", F.xxhash64("text")), ws, 5, 0)
    sizes = ngram_join.Sizes(80, {r["n"]: r["count"] for r in rows.where("kind = 'doc'").groupBy("n").count().collect()})
    level = ngram_join._levels(rows.where("kind = 'count'"))
    lists = ngram_join._lists(rows.where("kind = 'text'").select("cls", "body"), sizes, level, 5, 0, 4)
    pairs = lists.groupBy("list").count().selectExpr("coalesce(sum(count * (count - 1) div 2), 0)").first()[0]
    assert pairs < 20_000
    near = [(n + i, texts[i] + " end") for i in range(0, n, 50)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(df.unionByName(spark.createDataFrame(near, "doc_id long, text string"))).collect()}
    assert {i: c for i, c in got.items() if c != i} == {n + i: i for i in range(0, n, 50)}


# Texts longer than any batch.


def test_texts_longer_than_a_batch(spark):
    """Operators of words read whole texts of some 3 MB: their ends count as much as their beginnings."""
    from lakeloom.llm import class_lm, ngram_join, quality_rules

    words = [f"w{i * 7919 % 90001:05d}" for i in range(400_000)]
    long_, near, other = " ".join(words), " ".join(words[:-1] + ["last"]), " ".join(words[:200_000] + words[:200_000])
    assert len(long_) > 2_700_000
    docs = spark.createDataFrame([(1, long_), (2, near), (3, other), (4, "short and plain"), (5, None)], "doc_id long, text string")
    joined = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, words=4, percent=85).collect()}
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in ((1, words), (2, words[:-1] + ["last"]), (3, words[:200_000] * 2))}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    assert {i: joined[i][0] for i in sets} == {i: len(s) for i, s in sets.items()}
    assert joined[2][1] == 1 and joined[3][1] == (1 if link(1, 3) or link(2, 3) else 3) and joined[4][1] == 4
    scored = {r["doc_id"]: r for r in class_lm.score(docs, F.col("doc_id") == 2).collect()}
    assert scored[1]["n_tokens"] == 400_001 and scored[2]["n_tokens"] == 400_001 and scored[2]["n_known"] == 400_000 and scored[1]["train_tokens"] == 800_002 + 4 + 1
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    judged = {r["doc_id"]: r for r in quality_rules.judge(docs.withColumn("lang", F.lit("en")), labels).collect()}
    assert judged[1]["n_words"] == 400_000 and judged[3]["n_repeat_words"] == 400_000 and judged[3]["base_failed"]


# URL filters: keys are bounded by the lists.


def test_long_urls_have_few_keys(spark):
    """A path of 30,000 segments and a host of 500 labels send no more keys than patterns have lengths; each rule of an end holds."""
    from lakeloom.llm import url_filter

    host = ".".join(["a"] * 500) + ".example.org"
    urls = ["http://" + host + "/x" * 30_000, "http://example.org/ads", "http://example.org/ads/", "http://example.org/adsx", "http://example.org/ads/x?q", "http://example.org", "http://example.org/", "http://notexample.org/ads", "HTTP://U@EXAMPLE.org.:80/Ads", "x", None]
    captures = spark.createDataFrame(list(enumerate(urls)), "capture_id long, url string").withColumn("fetched_at", F.lit("2024-05-01").cast("timestamp"))
    rules = [("domain", "example.org"), ("prefix", "example.org/ads"), ("prefix", "example.org/ads/"), ("prefix", "example.org/"), ("prefix", host + "/x/x/x"), ("prefix", "example.org/ad"), ("domain", "xample.org"), ("prefix", "")]
    entries = spark.createDataFrame([(f"l{i}", k, p, "add") for i, (k, p) in enumerate(rules)], "list string, kind string, pattern string, action string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    got = {r["capture_id"]: r["lists"] for r in url_filter.evaluate(captures, entries).collect()}
    assert got == {0: "l0,l4", 1: "l0,l1,l3", 2: "l0,l1,l2,l3", 3: "l0,l3", 4: "l0,l1,l2,l3", 5: "l0", 6: "l0,l3", 7: "", 8: "l0,l1,l3", 9: "", 10: ""}
    n, w = url_filter._parts(F.col("url"))
    sent = captures.select(F.size(url_filter._keys(n, w, [10, 11], [14, 15, 16, 1020])).alias("n")).agg(F.max("n")).first()[0]
    assert sent <= 6
