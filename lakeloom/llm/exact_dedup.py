"""Exact deduplication by an extendible-hash index on shared files (DataFrame operations only).

A text's key is the 64-bit hash of the text without white space. Its leading bits select a cell of the
directory and the cell names the bucket: `build_directory` splits overfull buckets, and doubles the
directory when a bucket that splits already uses all its bits. Each bucket is a range of keys.

Owner tasks take ranges of buckets. What reaches an owner are texts of which copies are collapsed already, in the map
tasks and, so that a text of a third of all rows goes through many tasks, by salt; it compares the texts of its buckets
byte by byte (the normalised text is a grouping key), adds up what the salts have of each, and writes slots, one a key,
sorted: a slot holds the chain of all different texts that collide in its key, with the row of each that stays. All that
an owner does follows one shuffle by bucket range. A document's fingerprint finds its bucket by the directory, its slot
by the key, and its entry by walking the chain, where its SHA-256 names its text.

Defined results: a null text counts as empty and empty texts form one group; null ids sort last; of rows that
repeat id and text alike one may stay; rows of one id, equal without white space and of one length but not alike, carry
the same decision; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import SPACES, Workspace, documents, join_hot, partitions

#: Directory cells at most: 2 ** MAX_DEPTH rows of metadata on the driver.
MAX_DEPTH = 16
#: Rows a bucket holds before it splits.
BUCKET_CAPACITY = 8192
#: Tasks that share the copies of one text before its owner has them.
SALTS = 16
#: Rows alike that are written out at once.
REPEATS = 1 << 16

_SHIFT = 10**20
_BIAS = 2**63


def build_directory(cells: dict[int, int], depth: int, capacity: int) -> list[int]:
    """Bucket number of each cell of a directory of 2**g entries, g <= depth.

    cells: number of keys by their `depth` leading bits. A bucket at local depth d owns the keys that
    share its d leading bits. A bucket that is overfull at full depth stays so: its keys are chained.
    """
    count = [0] * (1 << depth)
    for cell, n in cells.items():
        count[cell] += n
    levels = [count]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([last[i] + last[i + 1] for i in range(0, len(last), 2)])
    levels.reverse()  # levels[d][prefix]: keys below a prefix of d bits
    directory, local, global_depth = [0], {0: 0}, 0
    overfull = [(0, 0)]  # prefix, local depth
    while overfull:
        prefix, d = overfull.pop()
        if levels[d][prefix] <= capacity or d == depth:
            continue
        if d == global_depth:
            directory = [b for b in directory for _ in (0, 1)]
            global_depth += 1
        width = 1 << (global_depth - d - 1)
        old, new = directory[prefix << (global_depth - d)], len(local)
        upper = (2 * prefix + 1) << (global_depth - d - 1)
        directory[upper : upper + width] = [new] * width
        local[old] = local[new] = d + 1
        overfull += [(2 * prefix, d + 1), (2 * prefix + 1, d + 1)]
    order: dict[int, int] = {}
    return [order.setdefault(b, len(order)) for b in directory]  # numbered in key order: owners take ranges


def _normalised(text):
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _cell(key, depth: int):
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def _sha256():
    return F.sha2(F.col("norm").cast("binary"), 256)


def slots(salted: DataFrame, parts: int, buckets: int) -> DataFrame:
    """(owner, bucket, key, entries, slot_size) of (bucket, key, norm, n, best).

    One shuffle sends ranges of buckets to their owners; with the owner among the keys, both groupings stay where it put the rows.
    """
    owner = F.expr(f"cast(bucket * {parts}L div {buckets} as int)").alias("owner")
    texts = salted.select(owner, "bucket", "key", "norm", "n", "best").repartitionById(parts, F.col("owner")).groupBy("owner", "bucket", "key", "norm").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    shift, top = F.lit(str(_SHIFT)).cast("decimal(21,0)"), F.lit(str(_SHIFT - 1)).cast("decimal(20,0)")
    rest = F.col("best") % shift
    entry = F.struct(
        _sha256().alias("text_sha256"), F.col("group_size"), F.when(rest > 0, (top - rest - F.lit(str(_BIAS)).cast("decimal(20,0)")).cast("long")).alias("keep_id"),
        ((F.col("best") - rest) / shift).cast("int").alias("keep_points"),
    ).alias("entry")
    chains = texts.select("owner", "bucket", "key", entry).groupBy("owner", "bucket", "key")
    return chains.agg(F.array_sort(F.collect_list("entry")).alias("entries"), F.sum("entry.group_size").alias("slot_size"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain (place in it), text_key.

    Of texts equal without white space the one with most code points stays, then the smallest id; of rows
    alike in id and text one. text_key is a hash of the original text. Keys have key_bits bits: few make texts collide.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact_dedup")
    parts = partitions(spark)
    base = documents(docs, id_col, text_col)
    key = F.xxhash64("norm").bitwiseAND(F.lit(-1 << (64 - key_bits)))
    keyed = base.select("doc_id", F.length("text").alias("points"), F.xxhash64("text").alias("text_key"), _normalised(F.col("text")).alias("norm")).withColumn("key", key)

    # 1. Fingerprints, without texts, rows alike being one; the directory comes from their histogram.
    sha = _sha256().alias("text_sha256")
    prints = ws.put(keyed.select("doc_id", "points", "text_key", "key", sha).groupBy("doc_id", "points", "text_key", "key", "text_sha256").agg(F.count(F.lit(1)).alias("copies")), "fingerprints")
    histogram = prints.groupBy(_cell(F.col("key"), MAX_DEPTH).alias("cell")).agg(F.sum("copies").alias("n")).collect()
    total = sum(r["n"] for r in histogram)
    directory = build_directory({r["cell"]: r["n"] for r in histogram}, MAX_DEPTH, capacity)
    depth, buckets = len(directory).bit_length() - 1, max(directory) + 1
    entries = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, directory))), ",")).alias("cell", "bucket")).select("cell", F.col("bucket").cast("int").alias("bucket"))

    def hashed(rows: DataFrame) -> DataFrame:
        """Rows with the bucket that the directory names for their key."""
        return rows.withColumn("cell", _cell(F.col("key"), depth)).join(F.broadcast(entries), "cell").drop("cell")

    # 2. Copies collapse in the map tasks and by salt, on the way to the owners of bucket ranges.
    top = F.lit(str(_SHIFT - 1)).cast("decimal(20,0)")
    after = top - F.coalesce(F.col("doc_id").cast("decimal(20,0)") + F.lit(str(_BIAS)).cast("decimal(20,0)"), top)
    salted = (
        hashed(keyed.withColumn("rank", (F.col("points").cast("decimal(10,0)") * F.lit(str(_SHIFT)).cast("decimal(21,0)") + after).cast("decimal(38,0)")))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
        .groupBy("salt", "bucket", "key", "norm")
        .agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("best"))
    )

    # 3. Owners compare bytes and write slots.
    index = ws.put(slots(salted, parts, buckets).drop("owner").sortWithinPartitions("bucket", "key"), "index")

    # 4. Every document goes to its bucket and slot, and walks the chain to the entry of its own text.
    found = join_hot(hashed(prints), index, ["bucket", "key"], "slot_size", total)
    place = F.array_position(F.transform("entries", lambda e: e["text_sha256"]), F.col("text_sha256"))
    walked = found.withColumn("chain", (place - 1).cast("int")).withColumn("e", F.get("entries", F.col("chain"))).drop("entries")
    stays = F.col("doc_id").eqNullSafe(F.col("e.keep_id")) & (F.col("points") == F.col("e.keep_points"))
    # Rows alike were one: blocks of them, and in these each again, the first of which may stay.
    again = walked.withColumn("block", F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / REPEATS).cast("int"))))
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least(F.lit(REPEATS), F.col("copies") - F.col("block") * REPEATS).cast("int") - 1)))
    one = (F.col("block") == 0) & (F.col("copy") == 0)
    return again.select("doc_id", "e.keep_id", F.col("e.group_size").cast("long").alias("group_size"), (stays & one).alias("kept"), "text_sha256", "bucket", "chain", "text_key")
