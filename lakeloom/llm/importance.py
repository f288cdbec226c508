"""Target-distribution importance resampling by an external sort-count over packed bucket streams.

A feature (a run of consecutive words) falls into a bucket by its crc32. The corpus is read once: each Arrow batch
becomes one row of a table, its features' buckets packed as uint16 in order of position, with the offset at which each
document begins. Counting sorts each stream and run-length encodes it; the runs are added up by bucket. Buckets that
the target holds more often than the corpus have a high gain. A second pass gathers the gains of each stream and sums
them document by document with np.add.reduceat. Weighted sampling without replacement is a top-k of weight plus
Gumbel noise, which a hash of the id makes; ranks come from a sort by ranges, so no task sees all documents.

Defined results: null texts are empty, and so are texts without words: weight 0, never drawn. A null id is hashed as
no characters, and comes last among ties. Rows alike in id and score are ranked in the order in which they were
written, each by itself. Long texts are rows like others: a stream is bounded by its batch or by one text. Without a target all gains
follow from the corpus alone; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Workspace, documents, partitions
from lakeloom.llm.wordblocks import trim

#: Fixed values of the contract: features, buckets, share drawn, least words, seed.
GRAMS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Lower-cases A-Z and makes a space of every other byte below 80 that is neither a digit nor a small letter.
_FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
#: Words whose bucket a task keeps in memory.
KNOWN_WORDS = 1 << 18

STREAM = "ids binary, known binary, starts binary, words binary, stream binary"


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Buckets(dict):
    """Bucket of a feature; kept for words that come again, up to KNOWN_WORDS of them."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def features(words: list[bytes], grams: int) -> Iterator[bytes]:
    """All runs of 1 to `grams` words."""
    yield from words
    for n in range(2, grams + 1):
        yield from map(b" ".join, zip(*(words[i:] for i in range(n))))


def streams(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """Rows of STREAM, one for each Arrow batch of (doc_id, text): ids (int64; known: not null), starts (int64, one more than ids), numbers of words (int64), buckets (uint16)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit uint16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(buckets)
        for rb in batches:
            packed, words = [], []
            for text in rb.column(1):
                found = split_words(text.as_py())
                words.append(len(found))
                packed.append(np.fromiter(map(bucket.__getitem__, features(found, grams)), np.uint16))
            starts = np.cumsum([0, *map(len, packed)], dtype=np.int64)
            ids = rb.column(0)
            row = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), starts, np.array(words, np.int64), np.concatenate(packed) if packed else np.zeros(0, np.uint16)]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in row], names=["ids", "known", "starts", "words", "stream"])
        trim()

    return texts.select("doc_id", "text").mapInArrow(run, STREAM)


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted stream, run-length encoded: values and lengths."""
    ordered = np.sort(stream, kind="stable")  # a radix sort for uint16
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def counts(table: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket of a table of streams: at most `buckets` rows a task and on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for rb in batches:
            for stream in rb.column(0):
                value, length = runs(np.frombuffer(stream.as_buffer(), np.uint16))
                total[value] += length
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = table.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio) of each bucket, in doubles."""
    n, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document of a table of streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for ids, known, starts, words, stream in zip(*(c.to_pylist() for c in rb.columns)):
                starts = np.frombuffer(starts, np.int64)
                length = np.diff(starts)
                weight = np.zeros(len(length), np.int64)
                if starts[-1]:
                    some = length > 0  # reduceat would take the next document's first feature for an empty one
                    weight[some] = np.add.reduceat(gain[np.frombuffer(stream, np.uint16)], starts[:-1][some])
                doc_id = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(known, np.uint8) == 0)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.frombuffer(words, np.int64)), pa.array(length), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
        trim()

    return table.select("ids", "known", "starts", "words", "stream").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "item_id", target_text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (1, 2, ... of those drawn, null for the rest)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "importance")
    corpus = ws.put(streams(documents(docs, id_col, text_col), grams, buckets), "corpus")
    aim = ws.put(streams(documents(target, target_id_col, target_text_col), grams, buckets), "target")
    gain = gains(counts(corpus, buckets), counts(aim, buckets))

    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = ws.put(weights(corpus, gain).withColumn("score", F.col("weight") + gumbel).withColumn("row", F.monotonically_increasing_id()), "scored")
    for step in ("corpus", "target"):
        ws.drop(step)

    able, unable = scored.where(F.col("n_words") >= least_words), scored.where(F.col("n_words") < least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = able.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = ws.put(placed, "placed")
    # A row's place is its task and its number there; as many rows come to the driver as there are tasks.
    tasks = sorted(map(tuple, placed.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()))
    drawn, before, bases = percent * sum(n for _, n in tasks) // 100, 0, []
    for task, n in tasks:
        bases.append((task, before + 1))
        before += n
    base = spark.createDataFrame(bases, "task long, base long")
    ranked = placed.withColumn("task", F.shiftright("at", 33)).join(F.broadcast(base), "task", "left")
    place = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(place <= drawn, place).alias("rank")).unionByName(unable.select(*columns, F.lit(None).cast("long").alias("rank")))
