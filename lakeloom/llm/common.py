"""What the operators of this subpackage share: the shared work folder, staging and hot keys.

Intermediate tables go to the folder that spark.checkpoint.dir names, which driver and executors
share. A folder of our own is made only where that setting is missing, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes 09-0D and 20 that part words; a fixed value of the contracts.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a character class of Java's regular expressions.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = getattr(spark, "_lakeloom_root", None) or tempfile.mkdtemp(prefix="lakeloom-")
        spark._lakeloom_root = root
    return root.rstrip("/")


#: Rows and bytes of an Arrow batch at most, and rows of a batch of the Parquet reader.
ARROW_ROWS, ARROW_BYTES, SCAN_ROWS = 2000, 2 << 20, 256


def _made(spark: SparkSession) -> list[str]:
    """Catalog tables that this session's operators have made."""
    if not hasattr(spark, "_lakeloom_tables"):
        spark._lakeloom_tables = []
    return spark._lakeloom_tables


def clean_up(spark: SparkSession) -> None:
    """Drops all intermediate tables of this session's operators. Results that were not written before can't be computed after."""
    tables = _made(spark)
    while tables:
        spark.sql(f"DROP TABLE IF EXISTS `{tables.pop()}`")
    for root in getattr(spark, "_lakeloom_works", []):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._lakeloom_works = []


class Workspace:
    """A folder of intermediate tables of one call of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.name = f"{name}_{uuid.uuid4().hex[:12]}"
        self.root = f"{shared_root(spark)}/lakeloom/{self.name}"
        spark._lakeloom_works = [*getattr(spark, "_lakeloom_works", []), self.root]
        # Texts may be long: Arrow batches are bounded by bytes and not by rows alone, and the Parquet reader, whose
        # buffers hold whole batches of texts, by few rows. Results are lazy, so the session keeps these settings.
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def put(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Writes df as Parquet and reads it back: later steps start from files, not from lineage.

        The shuffle files of the job that made it are freed as soon as it is written.
        """
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            writer = df.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Writes df bucketed by key, so that later joins on key don't shuffle it."""
        table = f"{self.name}_{name}"
        _made(self.spark).append(table)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            (df.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}")
             .bucketBy(buckets, key).saveAsTable(table))
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        """Deletes an intermediate table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only (doc_id, text) and what is asked for besides; a null text counts as empty. Other columns can't clash with ours."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A key is hot if it has more than one in so many of the rows, so at most so many keys are hot; and the rows any hot key has.
HOT_SHARE, HOT_ROWS = 1 << 16, 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Left join of many rows to one row a key where some keys hold a large share of the left rows.

    right has one row for each key and, in column `count`, the key's number of left rows. Keys with
    more than max(HOT_ROWS, total / HOT_SHARE) left rows are at most HOT_SHARE many, so their rows of
    `right` are broadcast and the left rows stay where they are; all other keys are joined by shuffle.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = right.where(F.col(count) > limit)
    keys = hot.select(*on, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(keys), on, "left")
    cold_part = marked.where(F.col("_hot").isNull()).drop("_hot").join(right.where(F.col(count) <= limit), on, "left")
    hot_part = marked.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot), on, "inner")
    return cold_part.unionByName(hot_part)
