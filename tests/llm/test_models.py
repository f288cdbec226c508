"""Trained models against plain versions of their formulas, and probabilities that add up to one."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from lakeloom.llm import class_lm, common, quality_classifier, quality_rules, toxicity
from lakeloom.llm.wordblocks import numbering

START = b""


def _pairs(texts):
    """Counts of (word before, word) by class, the start of a text being the empty word."""
    n = collections.Counter()
    for text, label in texts:
        words = toxicity.units(text)
        n.update((label, v, w) for v, w in zip([START, *words], words))
    return n


def _fit(texts, parts=3):
    lists = []
    for part in range(parts):
        number, found = numbering(), collections.Counter()
        for text, label in texts[part::parts]:
            code = [number[w] for w in toxicity.units(text)]
            found.update(zip([-1, *code], code, [label] * len(code)))
        keys = sorted(found)
        n = np.zeros((len(keys), 2))
        for i, k in enumerate(keys):
            n[i, k[2]] = found[k]
        before = np.array([k[0] if k[0] >= 0 else len(number) for k in keys], np.uint32)
        lists.append((list(number), before, np.array([k[1] for k in keys], np.uint32), n))
    return toxicity.ClassModels.load(toxicity.ClassModels.fit(lists).dump())


class Plain:
    """The same chain by dictionaries, a probability at a time."""

    def __init__(self, texts):
        self.pairs = _pairs(texts)
        self.words = {(c, w) for c, _, w in self.pairs}
        self.byte = collections.Counter()
        for c, w in self.words:
            spelt, head = toxicity._spell(w)
            for i in range(head, len(spelt)):
                for k in range(min(i + 1, toxicity.ORDER)):
                    self.byte[c, spelt[i - k : i + 1]] += 1

    def grams(self, c, gram):
        return sum(self.byte[x, gram] for x in (0, 1)) if len(gram) <= toxicity.SHARED_ORDER else self.byte[c, gram]

    def byte_p(self, c, context, b):
        if not context:
            every = sum(n for (_, g), n in self.byte.items() if len(g) == 1)
            return (self.grams(c, b) + 1) / (every + 256)
        after = [n for x in range(256) if (n := self.grams(c, context + bytes([x])))]
        low = self.byte_p(c, context[1:], b)
        if not after:
            return low
        d = toxicity.SPELLING_DISCOUNT
        return (max(self.grams(c, context + b) - d, 0) + d * len(after) * low) / sum(after)

    def spelling(self, c, unit):
        spelt, head = toxicity._spell(unit)
        return math.prod(self.byte_p(c, spelt[max(0, i - toxicity.ORDER + 1) : i], spelt[i : i + 1]) for i in range(head, len(spelt)))

    def word(self, c, w, spelt=None):
        kinds = collections.Counter(x for k, _, x in self.pairs if k == c)
        d, size = toxicity.DISCOUNT, sum(kinds.values())
        return max(kinds[w] - d, 0) / size + d * len(kinds) / size * (self.spelling(c, w) if spelt is None else spelt)

    def after(self, c, v, w, spelt=None):
        follow = {x: n for (k, u, x), n in self.pairs.items() if k == c and u == v}
        low = self.word(c, w, spelt)
        if not follow:
            return low
        d, t = toxicity.DISCOUNT, sum(follow.values())
        return max(follow.get(w, 0) - d, 0) / t + d * len(follow) / t * low


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcd"), rng.integers(1, 5))) for _ in range(30)] + ["caf\u00e9", "x" * 90 + "abc", "ab" * 50]
    return [(" ".join(rng.choice(words[8 * label :], 12)), int(label)) for label in rng.integers(0, 2, 25)]


def test_chain_equals_the_plain_formulas(texts):
    models, plain = _fit(texts), Plain(texts)
    ask = [*{w for t, _ in texts for w in toxicity.units(t)}, b"zz", b"abz", "\u4e2d".encode(), b"q"]
    place, log = models.words(ask)
    for i, w in enumerate(ask):
        for c in (0, 1):
            assert math.isclose(math.exp(log[i, c]), plain.word(c, w), rel_tol=1e-5)
    number = dict(zip(ask, range(len(ask))))
    for text, _ in [*texts[:6], ("zz abz q abc zz", 0), ("", 0)]:
        units = toxicity.units(text)
        (single, paired), = toxicity.Evidence(models)([units])
        for i, (v, w) in enumerate(zip([START, *units], units)):
            if w in number and (v in number or v == START):
                assert math.isclose(single[i], math.log(plain.word(1, w) / plain.word(0, w)), abs_tol=1e-4)
                assert math.isclose(paired[i], math.log(plain.after(1, v, w) / plain.after(0, v, w)), abs_tol=1e-4)


def test_probabilities_add_up_to_one(texts):
    models, plain = _fit(texts), Plain(texts)
    for context in (b"", b"a", b"ab", b"dc", b"zzz", b"abcd"):
        ask = [context + bytes([b]) + b"x" for b in range(256) if b != 32 or len(context) != toxicity.ORDER - 1]
        _, _, p = models.spelling.byte_probabilities(ask)
        sizes = np.array([len(toxicity._spell(w)[0]) for w in ask])
        at = np.cumsum(sizes) - sizes + 1 + len(context)
        if len(ask) == 256:
            assert np.allclose(p[at].sum(0), 1, atol=1e-6)
        for i in (0, 97, 98):
            assert np.allclose(p[at[i]], [plain.byte_p(c, (b"\x01" + context)[-toxicity.ORDER + 1 :], ask[i][len(context) : len(context) + 1]) for c in (0, 1)], rtol=1e-5)
    for c in (0, 1):
        known = {w for k, _, w in plain.pairs if k == c}
        for v in [START, *sorted(known)[:8], b"never"]:
            seen = sum(plain.after(c, v, w, 0.0) for w in known)
            # An unseen word's probability is its spelling's times what is left over.
            assert math.isclose(seen + plain.after(c, v, b"never seen", 1.0), 1, rel_tol=1e-9)


def test_rare_expressions_are_not_thrown_away():
    same = [("the cat sat on the mat", c) for c in (0, 1)] * 3
    models = _fit([*same, ("the brazzle sat", 1)])
    (single, _), (_, paired), (_, apart) = toxicity.Evidence(models)([[b"brazzle"], [b"brazzle", b"sat"], [b"cat", b"sat"]])
    assert single[0] > 1  # a word that was counted once
    assert paired[1] > apart[1] - 1e-9
    (other, _), = toxicity.Evidence(models)([[b"brazzles"]])
    assert other[0] > 0.5  # no such word, but its spelling has more in common with one class


def test_toxicity_reads_long_words_to_their_end():
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    bad = ["".join(rng.choice(list("uvwxyz"), 6)) for _ in range(300)]
    models = _fit([(w, 0) for w in plain] + [(w, 1) for w in bad])
    long = "".join(plain[:40])
    clean, toxic = (toxicity.units(t) for t in (long, long + "".join(bad[:8]) + long))
    assert all(len(u) <= toxicity.PIECE + toxicity.ORDER + 1 for u in clean + toxic)
    (of_clean, _), (of_toxic, _) = toxicity.Evidence(models)([clean, toxic])
    assert of_clean.max() < 0 < of_toxic.max()
    whole, _ = toxicity._spell(long.encode())
    assert b"".join(s[n:] for s, n in map(toxicity._spell, clean)) == whole[1:]


def test_words_beyond_the_cache_and_pairs_beyond_a_block(monkeypatch, texts):
    models = _fit(texts)
    lists = [toxicity.units(t) for t, _ in texts]
    want = [x for pair in toxicity.Evidence(models)(lists) for x in pair]
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 3)
    monkeypatch.setattr(toxicity, "PAIRS", 7)
    monkeypatch.setattr(toxicity, "SPELT_UNITS", 5)
    evidence = toxicity.Evidence(models)
    got = [x for one in lists for pair in evidence([one]) for x in pair]
    assert all(np.allclose(a, b) for a, b in zip(want, got))


def test_class_lm_with_one_class_equals_the_plain_formula(spark):
    rng = np.random.default_rng(8)
    rows = [(i if i % 7 else None, None if i == 3 else " ".join(rng.choice([f"Word{k}" for k in range(40)], int(rng.integers(0, 20))))) for i in range(60)] + [(61, "new words"), (62, "")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").lower().split(), ""]
    count = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n = sum(count.values())
    unseen = (sum(c == 1 for c in count.values()) + 0.5) / (n + 1)
    want = sorted(sum(math.log10((1 - unseen) * count[w] / n if count[w] else unseen) for w in tokens(t)) for _, t in rows)
    out = class_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), common.crc_mod(F.col("doc_id"), 10) == 0, classes=1)
    assert np.allclose(sorted(r["score"] for r in out.collect()), want)
    common.clean_up(spark)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("class_lm_")]


def test_class_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    words, classes = 50, 6
    group, text = rng.integers(0, classes, words), rng.zipf(1.5, 4000) % words
    moves = np.zeros((classes, classes))
    np.add.at(moves, (group[np.roll(text, 1)], group[text]), 1)
    count, size = np.bincount(text, minlength=words), moves.sum(0)
    emit = count / np.maximum(size[group], 1)
    assert np.allclose((class_lm.transitions(moves)[:, group] * emit[None, :]).sum(1), 1, atol=1e-6)
    assert class_lm.ending("caf\u00e9s".encode()) == "\u00e9s".encode() and class_lm.ending("\u4e2d\u6587".encode()) == "\u6587".encode() and class_lm.ending(b"ab") == b"ab"


def test_compiled_rules_equal_the_rules(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 8, (600, len(quality_classifier.STATISTICS))).astype(float)
    y = ((x[:, 0] > 3) ^ (x[:, 1] > 4)).astype(float)
    rules = quality_classifier.grow_rules(x, y)
    holds = np.column_stack([quality_classifier.holds(r, x) for r in rules]).astype(float)
    b, w = quality_classifier.lasso(holds, y)
    names = list(quality_classifier.STATISTICS)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"{s} double" for s in names))
    got = [r[0] for r in rows.orderBy("i").select(quality_classifier.compile_rules(b, list(w), rules)).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-(holds @ w + b))))
    assert ((np.array(got) > 0.5) == y).mean() > 0.95


def test_quality_rules_with_active_cutoffs(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        words = [f"w{k}" for k in rng.integers(0, 10**6, int(rng.integers(12, 40)))]
        marks = rng.choice(list("#*$%&|<>!?"), int(rng.integers(0, 80 if bad else 3)))
        rows.append((i, " ".join([*words, *marks]), "en" if i % 2 else "fr" if i % 3 else None))
        if rng.random() < 0.8:
            labels.append((i, int(not bad)))
    good = {i for i, q in labels if q}
    stat = {}
    for i, t, _ in rows:
        w = t.split()
        n = lambda chars: sum(c in chars for c in t)
        stat[i] = {"symbols_per_word": n("#*$%&|<>") / len(w), "marks_per_word": n("!?") / len(w), "upper_per_char": 0.0, "dup_lines_per_line": 0.0, "chars_per_word": sum(map(len, w)) / len(w)}
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in quality_rules.judge(table, spark.createDataFrame(labels, "doc_id long, quality int"), risk=0.3).collect()}
    repeats = {i: r["n_repeat_words"] / r["n_words"] for i, r in out.items()}
    counts = {}
    for stratum in ("en", "fr"):
        mine = [i for i, _, s in rows if s == stratum and i in good and not out[i]["base_failed"]]
        for rule in quality_rules.RULES:
            value = lambda i: repeats[i] if rule == "repeats_per_word" else stat[i][rule]  # noqa: E731, B023
            counts[stratum, rule] = len(mine), [sum(value(i) > c for i in mine) for c in quality_rules.cutoffs(rule)]
    chosen = quality_rules.select_cutoffs(counts, 0.3)
    assert {r for _, r in chosen} >= {"symbols_per_word", "marks_per_word"}
    rejected = 0
    for i, _, stratum in rows:
        failed = [rule for (s, rule), c in sorted(chosen.items()) if s == stratum and (repeats[i] if rule == "repeats_per_word" else stat[i][rule]) > c]
        assert sorted(filter(None, out[i]["failed_rules"].split(","))) == sorted(failed)
        assert out[i]["kept"] == (not out[i]["base_failed"] and not failed)
        rejected += bool(failed)
    assert rejected > 100
    lost = [i for i in good if out[i]["failed_rules"]]
    assert len(lost) <= 0.3 * len(good)
