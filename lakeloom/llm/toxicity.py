"""Toxicity by class-conditional Kneser-Ney models.

Two language models, one of toxic and one of ordinary labelled texts, each an interpolated Kneser-Ney chain:

    word after word     discounted counts of the class, back-off weight of the context
    word                discounted numbers of different words before it in the class (continuation counts)
    spelling            Kneser-Ney over the bytes of the class's distinct words, five bytes at most
    single bytes        counts that both classes share

Every order hands what it discounts to the next, so each model's probabilities add up to one. A rare expression is
judged by what its words, then its spelling, have in common with a class, and at the end by counts that both
classes share, which speak for neither. What is compared is the log-likelihood per word, of the whole text
and of its most suspicious stretches; a logistic curve, fitted on labelled texts kept apart from the counts,
makes it a score.

All bytes of a word count: a long one, as in text without spaces, is a run of pieces of at most PIECE bytes,
each a unit of evidence like a word and spelt with the ORDER - 1 bytes before it as context.

Models are fitted on a sample of labelled rows, bounded in rows and in bytes, by tasks that count and one that
adds up; the driver only passes the finished tables on, so what it and tasks receive is bounded too.

Defined results: a null or empty text has no evidence and gets the score of neutral evidence; without
labels of both kinds every score is 0; labels of repeated ids are combined by their maximum; repeated
rows score alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Workspace, documents, partitions
from lakeloom.llm.wordblocks import numbering, pack, pack_words, trim, unpack, unpack_words

#: Labelled rows of each class that are learnt from at most, and bytes of their texts, drawn by a hash of the id.
CLASS_ROWS, CLASS_BYTES = 8000, 32 << 20
#: Bytes of the longest n-gram of the spelling model; up to which length its counts are shared by the classes.
ORDER, SHARED_ORDER = 5, 1
#: Discount of words and of spellings.
DISCOUNT, SPELLING_DISCOUNT = 0.75, 0.75
#: Words of the stretches that are compared besides the whole text.
STRETCHES = (4, 16)
#: Numbers by which a text is judged.
FEATURES = len(STRETCHES) + 4
#: Of the labelled sample, one part in CALIBRATION fits the curve and the others the counts.
CALIBRATION = 4
#: Words a task keeps scored; beyond them it starts anew.
CACHED_WORDS = 200_000
#: Bytes of the pieces of long words; units whose spelling, and pairs whose evidence, is computed at once.
PIECE, SPELT_UNITS, PAIRS = 32, 1 << 14, 1 << 16
#: Words that a task counts before it sends them on.
COUNTED = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STRIP = b".,;:!?\"'()[]{}*_-#$%&|<>"


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without punctuation around them."""
    return [s for w in text.encode().translate(_LOWER).split() if (s := w.strip(_STRIP))]


def units(text: str) -> list[bytes]:
    """Words, and pieces of long words. A piece is its context, a space if it starts inside the word, its bytes, a space if the word goes on."""
    out = []
    for w in words_of(text):
        if len(w) <= PIECE:
            out.append(w)
            continue
        for at in range(0, len(w), PIECE):
            head = w[at - ORDER + 1 : at] + b" " if at else b""
            out.append(head + w[at : at + PIECE] + (b" " if at + PIECE < len(w) else b""))
    return out


def _spell(unit: bytes) -> tuple[bytes, int]:
    """Bytes of a unit between the marks of a word's start and end, and how many of them are context."""
    head, inside = b"\x01", unit[ORDER - 1 : ORDER] == b" "
    if inside:
        head, unit = unit[: ORDER - 1], unit[ORDER:]
    return head + (unit[:-1] if unit.endswith(b" ") else unit + b"\x02"), len(head)


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Unit of each byte (ends included), whether it is more than context and, by order, the packed gram that ends there, or -1."""
    spelt, heads = zip(*map(_spell, words)) if words else ((), ())
    b = np.frombuffer(b"".join(spelt), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, spelt), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(b)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams, packed = [b], b
    for k in range(1, ORDER):
        packed = packed + (np.concatenate([np.zeros(k, np.int64), b[:-k]])[: len(b)] << (8 * k))
        grams.append(np.where(inside >= k, packed, -1))
    return word, inside >= np.repeat(np.array(heads, np.int64), sizes), grams


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their rows of counts."""
    every = np.concatenate([np.zeros(0, np.int64), *keys])
    found, where = np.unique(every, return_inverse=True)
    n = np.concatenate([np.zeros((0, 2)), *counts])
    return found, np.stack([np.bincount(where, n[:, c], len(found)) for c in (0, 1)], 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted keys among sorted ones, or -1; looked up in order, which is kinder to the cache."""
    if not len(keys) or not len(wanted):
        return np.full(len(wanted), -1)
    order = np.argsort(wanted)
    asked = wanted[order]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    out = np.empty(len(wanted), np.int64)
    out[order] = np.where(keys[at] == asked, at, -1)
    return out


class SpellingModel:
    """Interpolated Kneser-Ney over bytes for two classes. Orders up to SHARED_ORDER are counted over both together.

    tables[k]: sorted grams of k + 1 bytes, their counts and, as contexts, what follows them: total and kinds, by class.
    """

    def __init__(self, unigram: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> None:
        self.unigram, self.tables = unigram, tables

    @staticmethod
    def fit(words: list[bytes], present: np.ndarray) -> SpellingModel:
        """present[word, class]: whether the class has the word. Each word counts once a class."""
        keys, counts = [[] for _ in range(ORDER)], [[] for _ in range(ORDER)]
        for lo in range(0, len(words), SPELT_UNITS):
            word, real, grams = _grams(words[lo : lo + SPELT_UNITS])
            here = present[lo : lo + SPELT_UNITS][word] & real[:, None]
            for k in range(ORDER):  # all grams serve as contexts; only those that end in what a unit spells count
                ok = grams[k] >= 0
                found, where = np.unique(grams[k][ok], return_inverse=True)
                keys[k].append(found)
                counts[k].append(np.stack([np.bincount(where, here[ok, c], len(found)) for c in (0, 1)], 1))
        grams, n = zip(*(_merged(keys[k], counts[k]) for k in range(ORDER)))
        one = np.zeros((256, 2))
        one[grams[0]] = n[0]
        unigram = (one.sum(1) + 1) / (one.sum() + 256)
        grams, n = [np.arange(256), *grams[1:]], [one, *n[1:]]
        n = [np.repeat(x.sum(1, keepdims=True), 2, 1) if k < SHARED_ORDER else x for k, x in enumerate(n)]
        tables = []
        for k in range(ORDER):
            after = np.zeros((2, len(grams[k]), 2))
            if k + 1 < ORDER:
                context = np.searchsorted(grams[k], grams[k + 1] >> 8)
                for c in (0, 1):
                    after[0, :, c] = np.bincount(context, n[k + 1][:, c], len(grams[k]))
                    after[1, :, c] = np.bincount(context, n[k + 1][:, c] > 0, len(grams[k]))
            tables.append((grams[k], n[k].astype(np.float32), after[0].astype(np.float32), after[1].astype(np.float32)))
        return SpellingModel(unigram, tables)

    def log(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each unit's spelling in both classes."""
        parts = [self._log(words[lo : lo + SPELT_UNITS]) for lo in range(0, len(words), SPELT_UNITS)]
        return np.concatenate(parts) if parts else np.zeros((0, 2))

    def byte_probabilities(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit of each byte, whether it is more than context, and its probability after those before it, by class."""
        word, real, grams = _grams(words)
        p = np.repeat(self.unigram[grams[0]][:, None], 2, 1)
        shorter = grams[0]  # places of the grams one byte shorter, in their table
        for k in range(1, ORDER):
            keys, n, _, _ = self.tables[k]
            _, _, total, kinds = self.tables[k - 1]
            own = np.full(len(p), -1)
            may = np.flatnonzero((grams[k] >= 0) & (shorter >= 0))  # a gram is known only if its end is
            own[may] = _find(keys, grams[k][may])
            at = np.flatnonzero((grams[k] >= 0) & real)
            context = shorter[at - 1]
            at, context = at[context >= 0], context[context >= 0]
            count = np.where(own[at][:, None] >= 0, n[own[at]], 0) if len(keys) else np.zeros((len(at), 2))
            t = total[context].astype(np.float64)
            q = np.maximum(count - SPELLING_DISCOUNT, 0) + SPELLING_DISCOUNT * kinds[context] * p[at]
            p[at] = np.where(t > 0, q / np.maximum(t, 1), p[at])
            shorter = own
        return word, real, p

    def _log(self, words: list[bytes]) -> np.ndarray:
        word, real, p = self.byte_probabilities(words)
        out = np.log(p)
        out[~real] = 0
        return np.stack([np.bincount(word, out[:, c], len(words)) for c in (0, 1)], 1)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


class ClassModels:
    """Both classes' chains of word pairs, words and spellings.

    Words are known by 64-bit hashes, in sorted order; the number after the last stands for a text's start.
    """

    def __init__(self, spelling: SpellingModel, hashes: np.ndarray, words: tuple[np.ndarray, ...], pairs: tuple[np.ndarray, np.ndarray]) -> None:
        self.spelling, self.hashes, self.pairs = spelling, hashes, pairs
        self.continuation, self.total, self.kinds = words
        self.size = self.continuation.sum(0, dtype=np.float64)  # different pairs of a class
        self.novel = DISCOUNT * (self.continuation > 0).sum(0) / self.size

    @staticmethod
    def fit(lists: list[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]) -> ClassModels | None:
        """lists: words of a part, pairs (place before, place; the place before the first is their number), counts by class."""
        spelt = list({w for words, _, _, _ in lists for w in words})
        hashes = _hashes(spelt)
        order = np.argsort(hashes)
        spelt, hashes = [spelt[i] for i in order.tolist()], hashes[order]
        v = len(spelt)
        keys, counts = [], []
        for words, before, after, n in lists:
            place = np.concatenate([np.searchsorted(hashes, _hashes(words)), [v]])
            keys.append(place[before] * (v + 1) + place[after])
            counts.append(n)
        pairs, n = _merged(keys, counts)
        before, after = pairs // (v + 1), pairs % (v + 1)
        by = lambda at, x: np.stack([np.bincount(at, x[:, c], v + 1) for c in (0, 1)], 1).astype(np.float32)
        continuation, total, kinds = by(after, n > 0), by(before, n), by(before, n > 0)
        if not continuation.any(0).all():
            return None
        spelling = SpellingModel.fit(spelt, continuation[:v] > 0)
        return ClassModels(spelling, hashes, (continuation, total, kinds), (pairs, n.astype(np.float32)))

    def dump(self) -> bytes:
        arrays = [self.hashes, self.continuation, self.total, self.kinds, *self.pairs, self.spelling.unigram]
        return pack(*arrays, *(x for t in self.spelling.tables for x in t))

    @staticmethod
    def load(body: bytes) -> ClassModels:
        raw = unpack(body)
        two = lambda x: np.frombuffer(x, np.float32).reshape(-1, 2)
        tables = [(np.frombuffer(raw[i], np.int64), *map(two, raw[i + 1 : i + 4])) for i in range(7, len(raw), 4)]
        spelling = SpellingModel(np.frombuffer(raw[6], np.float64), tables)
        return ClassModels(spelling, np.frombuffer(raw[0], np.int64), tuple(map(two, raw[1:4])), (np.frombuffer(raw[4], np.int64), two(raw[5])))

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number, or -1, and its log-probability in both classes without context."""
        at = _find(self.hashes, _hashes(words))
        n = np.where(at[:, None] >= 0, self.continuation[at], 0).astype(np.float64)
        with np.errstate(divide="ignore"):
            return at, np.logaddexp(np.log(np.maximum(n - DISCOUNT, 0) / self.size), np.log(self.novel) + self.spelling.log(words))

    def after(self, before: np.ndarray, word: np.ndarray, log: np.ndarray) -> np.ndarray:
        """Log-probability in both classes of words (numbers, and logs without context) after others (numbers, or -1)."""
        out = log.copy()
        at = np.flatnonzero(before >= 0)
        b, w = before[at], word[at]
        count = np.zeros((len(at), 2))
        both = np.flatnonzero(w >= 0)
        place = _find(self.pairs[0], b[both] * len(self.continuation) + w[both])
        count[both[place >= 0]] = self.pairs[1][place[place >= 0]]
        t = self.total[b].astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            q = np.logaddexp(np.log(np.maximum(count - DISCOUNT, 0) / t), np.log(DISCOUNT * self.kinds[b] / t) + log[at])
        out[at] = np.where(t > 0, q, log[at])
        return out


class Evidence:
    """log p(word | toxic) - log p(word | ordinary) of texts' words, alone and after the word before; keeps words scored."""

    def __init__(self, models: ClassModels) -> None:
        self.models = models
        self._clear()

    def _clear(self) -> None:
        self.number = numbering()
        self.place, self.log = np.zeros(0, np.int64), np.zeros((0, 2))

    def __call__(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, given as its units: evidence of each without and with the unit before it."""
        if len(self.number) > CACHED_WORDS:
            self._clear()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        if len(self.number) > len(self.place):
            place, log = self.models.words(list(islice(self.number, len(self.place), None)))
            self.place, self.log = np.concatenate([self.place, place]), np.concatenate([self.log, log])
        start = len(self.models.continuation) - 1
        ends = np.cumsum(sizes)
        word = self.place[code]
        before = np.concatenate([[start], word[:-1]])[: len(word)]
        before[(ends - sizes)[sizes > 0]] = start
        log = self.log[code]
        single, paired = log[:, 1] - log[:, 0], np.empty(len(code))
        for lo in range(0, len(code), PAIRS):
            at = slice(lo, lo + PAIRS)
            p = self.models.after(before[at], word[at], log[at])
            paired[at] = p[:, 1] - p[:, 0]
        return list(zip(np.split(single, ends[:-1]), np.split(paired, ends[:-1])))


def features(single: np.ndarray, paired: np.ndarray) -> tuple[float, ...]:
    """Mean evidence a word: of the text, of its best stretches and of its clearly toxic words, from words alone; of the
    text and of its best stretch, from words after words."""
    n = len(single)
    if not n:
        return (0.0,) * FEATURES
    def best(e: np.ndarray, k: int) -> float:
        total = np.concatenate([[0.0], np.cumsum(e)])
        return float((total[k:] - total[:-k]).max() / k) if n >= k else float(total[-1] / k)
    clear = np.minimum(single[single > 1.5], 6.0)
    return (float(single.mean()), *(best(single, k) for k in STRETCHES), float(np.log1p(clear.sum() / n * 20)), float(paired.mean()), best(paired, STRETCHES[0]))


def evidence_features(docs: DataFrame, models, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """(doc_id, text, extra...) to doc_id, extra and the features; models is a broadcast of what ClassModels.dump() gives."""
    k = FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(ClassModels.load(models.value))
        for rb in batches:
            texts = rb.column(1)
            for at in range(0, max(1, len(texts)), 256):
                found = [features(*e) for e in evidence([units(t.as_py()) for t in texts[at : at + 256]])]
                cols = [pa.array([f[i] for f in found], pa.float64()) for i in range(k)]
                part = rb.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(2 + i) for i in range(len(extra))), *cols], names=["doc_id", *extra, *(f"f{i}" for i in range(k))])
        del evidence
        trim()

    schema = ", ".join(["doc_id long", *(f"{e} {docs.schema[e].dataType.simpleString()}" for e in extra), *(f"f{i} double" for i in range(k))])
    return docs.select("doc_id", "text", *extra).mapInArrow(run, schema)


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps on standardised features; weights in the features' own scale."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(y)), (x - mean) / scale])
    w, pen = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge * len(y) ** 0.5] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * np.maximum(p * (1 - p), 1e-9)[:, None]) + pen
        d = np.linalg.solve(h, z.T @ (y - p) - pen @ w)
        w += d
        if np.abs(d).max() < 1e-8:
            break
    return float(w[0] - (w[1:] * mean / scale).sum()), w[1:] / scale


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, class_rows: int = CLASS_ROWS, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, mean_evidence, text_key (a hash of the text). held_out is a boolean column over doc_id."""
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    base = documents(docs, id_col, text_col)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out)
    size = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    out_held = F.coalesce(held_out, F.lit(False)).alias("held_out")
    if not size.get(0) or not size.get(1):
        return base.select("doc_id", out_held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("mean_evidence"), F.xxhash64("text").alias("text_key"))
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = lambda label: int((1 << 30) * min(1.0, class_rows / size[label]))
    drawn = marks.where(((F.col("label") == 1) & (dice < share(1))) | ((F.col("label") == 0) & (dice < share(0))))
    sample = base.join(F.broadcast(drawn), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)).cast("int"))  # at most about 2 * class_rows ids
    sample = sample.repartition(partitions(spark), "doc_id").persist()
    held = {r["label"]: r["b"] for r in sample.groupBy("label").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    thin = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30))
    keep = {c: int((1 << 30) * min(1.0, class_bytes / max(1, held.get(c, 0)))) for c in (0, 1)}
    sample = sample.where(((F.col("label") == 1) & (thin < keep[1])) | ((F.col("label") == 0) & (thin < keep[0])))

    # 1. Pairs of words by class, counted in parts; one task adds the bounded sample's parts up.
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, codes, ends, classes, held = numbering(), [], [], [], 0

        def out() -> pa.RecordBatch:
            code = np.concatenate(codes)
            sizes = np.array(ends, np.int64)
            before = np.concatenate([code[-1:], code[:-1]]) + 1
            before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
            label = np.repeat(np.array(classes, np.int64), sizes)
            keys, n = np.unique(((before * (len(number) + 1) + code) << 1) + label, return_counts=True)
            place = (keys >> 1) // (len(number) + 1) - 1
            place[place < 0] = len(number)  # the start of a text
            body = pack_words(list(number), place.astype(np.uint32), ((keys >> 1) % (len(number) + 1)).astype(np.uint32), (keys & 1).astype(np.uint8), n.astype(np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["body"])

        for rb in batches:
            for text, label in zip(rb.column(0), rb.column(1).to_pylist()):
                found = units(text.as_py())
                codes.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
                ends.append(len(found))
                classes.append(label)
                held += len(found)
                if held >= COUNTED:
                    yield out()
                    number, codes, ends, classes, held = numbering(), [], [], [], 0
        if held:
            yield out()
        trim()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = []
        for rb in batches:
            for body in rb.column(0):
                words, (before, after, label, n) = unpack_words(body.as_py())
                label, n = np.frombuffer(label, np.uint8), np.frombuffer(n, np.uint32)
                by_class = np.zeros((len(n), 2))
                by_class[np.arange(len(n)), label] = n
                lists.append((words, np.frombuffer(before, np.uint32), np.frombuffer(after, np.uint32), by_class))
        fitted = ClassModels.fit(lists) if lists else None
        bodies = [] if fitted is None else [fitted.dump()]
        yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], names=["body"])
        del lists, fitted
        trim()

    counted = ws.put(sample.where("fold > 0").select("text", "label").mapInArrow(count, "body binary"), "counted")
    fitted = counted.repartition(1).mapInArrow(add_up, "body binary").toArrow()
    if not len(fitted):
        sample.unpersist()
        return base.select("doc_id", out_held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("mean_evidence"), F.xxhash64("text").alias("text_key"))
    models = spark.sparkContext.broadcast(fitted.column(0)[0].as_py())
    del fitted

    # 2. The curve, on texts that the counts have not seen; classes are weighted back to their shares.
    seen = evidence_features(sample.where("fold = 0").select("doc_id", "text", "label"), models, ["label"]).toArrow()
    sample.unpersist()
    k = FEATURES
    x = np.column_stack([seen.column(f"f{i}").to_numpy() for i in range(k)]) if len(seen) else np.zeros((0, k))
    y = seen.column("label").to_numpy().astype(np.float64)
    if len(y) and 0 < y.sum() < len(y):
        b, w = _curve(x, y)
        drawn_n = {c: min(size[c], class_rows) for c in (0, 1)}
        b += np.log((size[1] / drawn_n[1]) / (size[0] / drawn_n[0]))
    else:
        b, w = -2.0, np.array([20.0] + [1.0] * (FEATURES - 3) + [0.0, 0.0])

    # 3. Scores of all documents.
    z = F.lit(float(b))
    for i in range(k):
        z = z + F.lit(float(w[i])) * F.col(f"f{i}")
    found = evidence_features(base.withColumn("text_key", F.xxhash64("text")), models, ["text_key"]).withColumn("score", 1.0 / (1.0 + F.exp(-z)))
    return found.select("doc_id", out_held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("f0").alias("mean_evidence"), "text_key")
