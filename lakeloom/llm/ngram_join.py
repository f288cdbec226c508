"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Documents with equal sets form a class, and classes are joined. Light classes (small sets) enumerate the
2-subsets of a prefix: two sets similar enough share 2 of their n - ceil(t n) + 2 first shingles in an order that is
one for all sets. The order is rarest first, by counts over all rows in 2^20 cells of the hash, so a phrase that
thousands of short texts share stands last in each and makes no list. Heavy
classes (large sets) are scanned through inverted lists. Their keys are blocks of a set: a set of sizes up
to s is dealt into K blocks by a hash of the shingle, and since similar sets differ in at most
H = 2 s (1 - t) / (1 + t) shingles, more than K - H blocks are equal in both. One passage that thousands of
documents share fills no block of theirs, so it makes no candidates. A block of common shingles alone is not listed
either, but by sets that have so many of these, or empty ones, that all equal blocks may be among them; a set with so
many empty ones lists its prefix besides. The boundary between light and heavy is the one with the
least total of keys over the sizes that occur.

In a list, each class is first compared with the list's least class alone, and in lists that still
hold several components then with a few more members. Lists whose classes are in one component by then
need nothing more; of the others, all pairs across components are compared that
neither sizes nor parity sketches rule out (both are exact bounds). So groups of thousands of near copies cost a few comparisons a member, and no link between components is lost.
Comparisons are exact, on the whole sets.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing;
with fewer words than a shingle has, the whole sequence is the one shingle; repeated rows share a
component; null ids don't name a component; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Workspace, documents, join_hot, partitions
from lakeloom.llm.components import components
from lakeloom.llm.wordblocks import trim

WORDS, PERCENT = 5, 80
#: Size of the subsets that light sets enumerate.
SUBSET = 2
#: Rounds in which the lists still open are compared with one more of their members.
PIVOTS = 2
#: Members of an open list that one task compares with all others of it, on the average.
DEALT = 1000
#: Shingles are counted in 2 ** CELL_BITS cells, which travel in so many ranges.
CELL_BITS, RANGES = 20, 64
#: A cell is common if it has so many shingles and so many times the mean of all cells.
COMMON_LEAST, COMMON_TIMES = 32, 4
#: Keys that a task gathers before it sends them on, and words whose hash it keeps.
SEND, CACHED_WORDS = 1 << 20, 300_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing step of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, words: int, seed: int) -> None:
        self.words, self.seed, self.known = words, seed, {}

    def __call__(self, text: str) -> np.ndarray:
        tokens = text.encode().translate(_LOWER).split()
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w, self.seed)
        h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        n = len(tokens) - self.words + 1
        if n < 1:
            n, width = min(1, len(tokens)), len(tokens)
        else:
            width = self.words
        out = np.full(n, np.uint64(width))
        with np.errstate(over="ignore"):
            for k in range(width):
                out = mix(out * _M3 + h[k : k + n])
        return np.unique(out)


#: 64-bit words of a sketch.
SKETCH = 16


def sketch(u: np.ndarray) -> list[int]:
    """Parity of the number of shingles in each of 64 * SKETCH cells: sets differ in as many at least as their sketches do."""
    with np.errstate(over="ignore"):
        cell = (mix(u + _M2) % np.uint64(64 * SKETCH)).astype(np.int64)
    odd = np.bincount(cell, minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


def _possible(x: str, y: str, nx: str, ny: str, percent: int) -> Column:
    """Neither sizes nor sketches rule out that the sets are similar enough (an exact bound)."""
    differ = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & ((100 + percent) * differ <= (100 - percent) * (F.col(nx) + F.col(ny)))


class Sizes:
    """Classes of set sizes, their numbers of blocks, and the boundary of light and heavy sets."""

    def __init__(self, percent: int, histogram: dict[int, int]) -> None:
        self.percent = percent
        top = max(histogram, default=1)
        edges = [1]
        while edges[-1] <= top * 2:
            edges.append(max(edges[-1] + 1, -(-100 * edges[-1] // percent)))
        edges += [max(edges[-1] + 1, -(-100 * edges[-1] // percent))]
        self.edges = np.array(edges)
        differ = 2 * (self.edges[1:] - 1) * (100 - percent) // (100 + percent)  # of sets below the class's end
        self.differ = differ
        self.blocks = -(-115 * differ // 100) + 3
        light = {n: math.comb(self.spare(n) + SUBSET, SUBSET) for n in histogram}
        heavy = {n: int(self.blocks[self.of(n)] + self.blocks[self.of(n) + 1]) for n in histogram}
        # Sets up to boundary / t take part on the light side, those above the boundary on the heavy side.
        sizes = sorted(histogram)
        cost = lambda x: sum(histogram[n] * (light[n] * (n * percent <= 100 * x) + heavy[n] * (n > x)) for n in sizes)
        tried = sorted({1, *(int(v) for v in self.edges if v <= 4096)})
        self.boundary = min(tried, key=lambda x: (cost(x), x))

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def spare(self, n: int) -> int:
        """Shingles of a set of n that a similar set may lack."""
        return n - -(-self.percent * n // 100)

    def alone(self, n: int) -> bool:
        """No other set of any size is similar to a set of n."""
        return self.spare(n) == 0 and 100 * n // self.percent == n


def rarest(u: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    """The first n shingles of a sorted set in the order of all sets: by the level of their cell, then by hash."""
    place = (level[u & np.uint64(len(level) - 1)].astype(np.uint64) << np.uint64(56)) | (u >> np.uint64(8))
    return u[np.argsort(place, kind="stable")[:n]]


def common(level: np.ndarray) -> float:
    """The level from which on a cell's shingles are common: well beyond what as many different shingles as there are put into each cell."""
    return float(4 * np.log2(COMMON_LEAST + COMMON_TIMES * np.mean(2.0 ** (level.astype(np.float64) / 4) - 1)))


def light_keys(u: np.ndarray, sizes: Sizes, level: np.ndarray) -> np.ndarray:
    """Keys of the 2-subsets of the prefix of a sorted set."""
    prefix = rarest(u, level, sizes.spare(len(u)) + SUBSET)
    i, j = np.triu_indices(len(prefix), 1)
    with np.errstate(over="ignore"):
        return mix(mix(prefix[i]) * _M3 + prefix[j])


def heavy_keys(sets: list[np.ndarray], sizes: Sizes, level: np.ndarray, often: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the blocks of many sets, and the set each belongs to. Shingles of the level `often` are common."""
    n = np.array([len(u) for u in sets])
    own = np.searchsorted(sizes.edges, n, side="right") - 1
    u, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    rare = level[u & np.uint64(len(level) - 1)] < often
    keys, owners = [], []
    with np.errstate(over="ignore"):
        content = mix(u + _M3)
        for tag in (own, own + 1):  # a partner's size is of the same class or a neighbouring one
            k = sizes.blocks[tag]
            first = np.cumsum(k) - k
            block = (mix(u ^ mix((tag[doc] + 1).astype(np.uint64))) % k[doc].astype(np.uint64)).astype(np.int64)
            cell = first[doc] + block
            total = int(k.sum())
            sums = np.zeros(total, np.uint64)
            np.add.at(sums, cell, content)
            filled, telling = np.zeros(total, bool), np.zeros(total, bool)
            filled[cell], telling[cell[rare]] = True, True
            owner = np.repeat(np.arange(len(sets)), k)
            # Of two similar sets one equal block at least tells, unless one of them has this many that don't: it lists all.
            mute = np.bincount(owner[~telling], minlength=len(sets)) >= k - sizes.differ[tag]
            listed = np.where(mute[owner], filled, telling)
            index = np.arange(total) - np.repeat(first, k)
            keys.append(mix(sums + mix((np.repeat(tag, k) * (1 << 32) + index).astype(np.uint64)))[listed])
            owners.append(owner[listed])
            empty = np.bincount(owner[~filled], minlength=len(sets))
            for d in np.flatnonzero(empty >= k - sizes.differ[tag]).tolist():  # equal blocks may all be empty
                prefix = rarest(sets[d], level, sizes.spare(len(sets[d])) + 1)
                keys.append(mix(prefix + mix(np.uint64(tag[d]) + _M2)))
                owners.append(np.full(len(prefix), d))
    return np.concatenate(keys), np.concatenate(owners)


def _sets(docs: DataFrame, ws: Workspace, words: int, seed: int) -> DataFrame:
    """Rows of kind doc (doc_id, text_key, cls, check, n); once a task for each class, of kind text (cls, n, body, sketch); of kind count (cls: range, body: shingles of those classes by cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, press, seen = Shingler(words, seed), zstandard.ZstdCompressor(level=3), set()
        count, kinds = np.zeros(1 << CELL_BITS, np.uint32), (*[pa.int64()] * 5, pa.binary(), pa.list_(pa.int64()), pa.string())
        names = ["doc_id", "text_key", "cls", "check", "n", "body", "sketch", "kind"]
        for rb in batches:
            rows: list[tuple] = []
            for doc_id, text, text_key in zip(rb.column(0).to_pylist(), rb.column(1), rb.column(2).to_pylist()):
                text = text.as_py()
                u = shingle(text)
                with np.errstate(over="ignore"):
                    cls, check = (int(mix(u + c).sum(dtype=np.uint64).astype(np.int64)) for c in (_M1, _M2))
                rows.append((doc_id, text_key, cls, check, len(u), None, None, "doc"))
                if len(u) and cls not in seen:
                    if len(seen) > CACHED_WORDS:
                        seen.clear()
                    seen.add(cls)
                    np.add.at(count, u & np.uint64(len(count) - 1), 1)
                    rows.append((None, None, cls, check, len(u), press.compress(text.encode()), sketch(u), "text"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, kinds)], names=names)
        if count.any():
            rows = [(None, None, i, None, None, press.compress(part.tobytes()), None, "count") for i, part in enumerate(np.split(count, RANGES))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        trim()

    return ws.put(docs.mapInArrow(run, "doc_id long, text_key long, cls long, check long, n long, body binary, sketch array<long>, kind string"), "sets", "kind")


def _levels(counts: DataFrame) -> np.ndarray:
    """Of each cell four times the logarithm of its shingles: a byte a cell comes to the driver, 2 ** CELL_BITS in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, total = zstandard.ZstdDecompressor(), {}
        for rb in batches:
            for i, body in zip(rb.column(0).to_pylist(), rb.column(1)):
                total.setdefault(i, np.zeros((1 << CELL_BITS) // RANGES, np.int64))[:] += np.frombuffer(expand.decompress(body.as_py()), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([np.minimum(255, 4 * np.log2(t + 1.0)).astype(np.uint8).tobytes() for t in total.values()], pa.binary())], names=["range", "body"])

    out = np.zeros((RANGES, (1 << CELL_BITS) // RANGES), np.uint8)
    for r in counts.select(F.col("cls").cast("int").alias("range"), "body").repartitionById(RANGES, F.col("range")).mapInArrow(run, "range int, body binary").collect():
        out[r["range"]] = np.frombuffer(r["body"], np.uint8)
    return out.reshape(-1)


def _lists(texts: DataFrame, sizes: Sizes, level: np.ndarray, words: int, seed: int, parts: int) -> DataFrame:
    """(list, cls, leader): the members of each inverted list of two classes or more; equal lists of a task once."""
    often = common(level)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, expand = Shingler(words, seed), zstandard.ZstdDecompressor()
        held, count = [], 0

        def send() -> pa.RecordBatch:
            key, cls = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            key, cls = key[order], cls[order]
            bodies = [key[a:b].tobytes() + cls[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(bodies, pa.binary())], names=["part", "body"])

        for rb in batches:
            for at in range(0, rb.num_rows, 128):
                ids, bodies = rb.column(0)[at : at + 128].to_numpy(), rb.column(1)[at : at + 128]
                heavy, who = [], []
                for c, body in zip(ids, bodies):
                    u = shingle(expand.decompress(body.as_py()).decode())
                    n = len(u)
                    if sizes.alone(n):
                        continue
                    if n * sizes.percent <= 100 * sizes.boundary:
                        k = light_keys(u, sizes, level)
                        held.append((k, np.full(len(k), c)))
                        count += len(k)
                    if n > sizes.boundary:
                        heavy.append(u)
                        who.append(c)
                if heavy:
                    k, owner = heavy_keys(heavy, sizes, level, often)
                    held.append((k, np.array(who, np.int64)[owner]))
                    count += len(k)
                if count >= SEND:
                    yield send()
                    held, count = [], 0
        if held:
            yield send()
        del held
        trim()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [b.as_py() for rb in batches for b in rb.column(1)]
        if not raw:
            return
        key = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16) for b in raw])
        cls = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in raw])
        del raw
        order = np.argsort(key)
        key, cls = key[order], cls[order]
        near = np.zeros(len(key) + 1, bool)
        near[1:-1] = key[1:] == key[:-1]
        keep = near[1:] | near[:-1]  # keys that stand twice or more
        key, cls = key[keep], cls[keep]
        order = np.lexsort((cls, key))
        key, cls = key[order], cls[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls = key[first], cls[first]
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([starts, [len(key)]]))
        with np.errstate(over="ignore"):
            name = np.add.reduceat(mix(cls.view(np.uint64) + _M2), starts).view(np.int64)
        _, once = np.unique(name, return_index=True)
        chosen = np.zeros(len(starts), bool)
        chosen[once] = True
        chosen &= size > 1
        member = np.repeat(chosen, size)
        out = pa.table([pa.array(np.repeat(name, size)[member]), pa.array(cls[member]), pa.array(np.repeat(cls[starts], size)[member])], names=["list", "cls", "leader"])
        yield from out.to_batches(max_chunksize=100_000)
        trim()

    sent = texts.select("cls", "body").mapInArrow(keys, "part int, body binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(scan, "list long, cls long, leader long")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int, seed: int, checked: bool = False) -> DataFrame:
    """Of the pairs (a, b) of classes those whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, expand = Shingler(words, seed), zstandard.ZstdDecompressor()
        last: tuple = (None, None)
        for rb in batches:
            a, b, kept = rb.column(0).to_pylist(), rb.column(1).to_pylist(), []
            for i, (ta, tb) in enumerate(zip(rb.column(2), rb.column(3))):
                if last[0] != a[i]:
                    last = (a[i], shingle(expand.decompress(ta.as_py()).decode()))
                x, y = last[1], shingle(expand.decompress(tb.as_py()).decode())
                same = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * same >= percent * (len(x) + len(y) - same):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([rb.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["a", "b"])
        trim()

    t = lambda name, *cols: texts.select(F.col("cls").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in cols))
    if not checked:
        pairs = pairs.join(t("a", "n", "sketch"), "a").join(t("b", "n", "sketch"), "b").where(_possible("sketch_a", "sketch_b", "n_a", "n_b", percent))
    met = pairs.select("a", "b").join(t("a", "body"), "a").join(t("b", "body"), "b")
    return met.select("a", "b", "body_a", "body_b").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, cls (the class of equal sets), text_key (a hash of the text).

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "ngram_join")
    parts = partitions(spark)
    rows = _sets(documents(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text")), ws, words, seed)
    members = rows.where("kind = 'doc'").select("doc_id", "text_key", "cls", "check", "n")
    texts = rows.where("kind = 'text'").select("cls", "n", "body", "sketch")
    classes = ws.put(members.where("n > 0").groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("check").alias("c1"), F.max("check").alias("c2")), "classes")
    total, clash = classes.agg(F.sum("copies"), F.sum((F.col("c1") != F.col("c2")).cast("long"))).first()
    if clash:  # two sets under one name of 64 bits: name them anew
        return join(docs, words, percent, id_col, text_col, seed + 1)
    sizes = Sizes(percent, {r["n"]: r["count"] for r in classes.groupBy("n").count().collect()})

    # 1. Inverted lists; each class against the least class of its lists.
    lists = ws.put(_lists(texts, sizes, _levels(rows.where("kind = 'count'")), words, seed, parts), "lists")
    candidates = lists.select("cls").distinct()
    held = ws.put(texts.join(candidates, "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("body").alias("body"), F.first("sketch").alias("sketch")), "texts")
    pairs = lists.where("cls <> leader").select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct()
    edges = ws.put(_verify(pairs, held, words, percent, seed), "edges_1")
    labels = components(edges, ws, "first")

    # 2. Lists that still hold several components: a few rounds with other pivots, and then all pairs across.
    def still_open(labels: DataFrame, name: str) -> DataFrame:
        labelled = lists.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("list", "cls", F.coalesce("label", "cls").alias("label")).distinct()
        per = labelled.groupBy("list", "label").agg(F.count(F.lit(1)).alias("k"))
        several = per.groupBy("list").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("k", "label")).getField("label").alias("main")).where("kinds > 1").select("list", "main")
        return ws.put(labelled.join(several, "list").join(held.select("cls", "n", "sketch"), "cls"), name)

    for r in range(PIVOTS):
        open_ = still_open(labels, f"open_{r}")
        pivot = open_.groupBy("list").agg(F.min(F.struct(F.xxhash64("cls", F.lit(r)), F.col("cls").alias("a"), F.col("label").alias("la"))).alias("p")).select("list", "p.a", "p.la")
        pairs = open_.join(pivot, "list").where("label <> la").select("a", F.col("cls").alias("b")).distinct()
        more = ws.put(_verify(pairs, held, words, percent, seed), f"edges_pivot_{r}")
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), ws, f"pivot_{r}")
    open_ = still_open(labels, "open")
    # Long lists are dealt: each part of the minor ones meets all others.
    parts_of = open_.groupBy("list").agg((F.count(F.lit(1)) / DEALT).cast("int").alias("more"))
    open_ = open_.join(parts_of, "list")
    minor = open_.where("label <> main").select("list", F.pmod(F.xxhash64("cls"), F.col("more") + 1).cast("int").alias("deal"), F.col("cls").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("sketch").alias("sx"), "main")
    other = open_.select("list", F.explode(F.sequence(F.lit(0), "more")).alias("deal"), F.col("cls").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    # A pair of two minor components is found from both sides: it is kept from one.
    cross = minor.join(other, ["list", "deal"]).where((F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("main")) | (F.col("x") < F.col("y"))) & _possible("sx", "sy", "nx", "ny", percent))
    rest = cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    edges_2 = ws.put(_verify(rest, held, words, percent, seed, checked=True), "edges_2")
    final = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(edges_2), ws, "final")

    # 3. Components by their least document.
    named = classes.select("cls", "copies", "least").join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    index = ws.put(named.join(names, "label").select("cls", "copies", "component_id"), "index")
    for done in ("sets/kind=text", "sets/kind=count", "lists", "texts", "open", "edges_1", "edges_2", *(f"edges_pivot_{r}" for r in range(PIVOTS)), *(f"open_{r}" for r in range(PIVOTS))):
        ws.drop(done)  # the result needs the index and the members alone
    found = join_hot(members, index, ["cls"], "copies", int(total or 0))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "cls", "text_key")
