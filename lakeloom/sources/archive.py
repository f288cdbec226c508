"""File trees as a Spark source, a stream of their listings, and incremental classification.

spark.dataSource.register(ArchiveSource); spark.read.format("lakeloom_archive").option("roots", json).load()
With option("pushdown", "true") and spark.sql.python.filterPushdown.enabled, filters on path, size and time are tested
before a file is hashed, and directories that a path filter rules out are not entered.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.window import Window
from lakeloom.sources.store import numbered

CHUNK = 64 * 1024
SCHEMA = "root string, path string, size_bytes long, modified_time timestamp, fingerprint string, error string"


class ScanConfigError(ValueError):
    """A root that can't be scanned."""


def validate_root(root: str, dialect: str = "boolean") -> str:
    """The root, or an error. simple: not empty; boolean: absolute, existing and a directory."""
    if not root:
        raise ScanConfigError("a root must not be empty")
    if dialect == "boolean":
        if not os.path.isabs(root):
            raise ScanConfigError(f"not absolute: {root}")
        if not os.path.exists(root):
            raise ScanConfigError(f"missing: {root}")
        if not os.path.isdir(root):
            raise ScanConfigError(f"not a directory: {root}")
    return root


def file_fingerprint(path: str) -> str:
    """SHA-256 in chunks: constant memory."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(CHUNK):
            h.update(block)
    return h.hexdigest()


#: Directories that the driver lists at least, if there are as many, and files of one of these that a task reads.
LISTED, FILES_A_TASK = 64, 10_000


class _Directory(InputPartition):
    """The files of a directory, those of one share of its names, or, if deep, all below it."""

    def __init__(self, root: str, path: str, deep: bool, share: int = 0, shares: int = 1) -> None:
        self.root, self.path, self.deep, self.share, self.shares = root, path, deep, share, shares


class ArchiveReader(DataSourceReader):
    """The tree is parted from the top, level by level, until there are enough directories; errors are rows.

    A directory that was listed is dealt over tasks by a hash of its files' names, so a flat one of many files is not
    one task; the directories below those that were listed are walked by one task each.
    """

    def __init__(self, options: dict) -> None:
        self.roots = json.loads(options["roots"])
        self.hash = options.get("hash", "true") == "true"
        self.links = options.get("follow_file_links", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        waiting, at = [(root, root) for root in self.roots], 0
        while at < len(waiting) and (at < len(self.roots) or len(waiting) < LISTED):
            root, path = waiting[at]
            at += 1
            files = 0
            try:
                with os.scandir(path) as entries:
                    below = []
                    for e in entries:
                        if e.is_dir(follow_symlinks=False):
                            below.append((root, e.path))
                        else:
                            files += 1
                waiting += sorted(below)
            except OSError:
                pass  # the directory's own partition reports it
            shares = 1 + files // FILES_A_TASK
            parts += [_Directory(root, path, False, i, shares) for i in range(shares)]
        return parts + [_Directory(root, path, True) for root, path in waiting[at:]]

    # What filters that were pushed down say; here there are none.
    def enters(self, directory: str) -> bool:
        return True

    def wants_path(self, path: str) -> bool:
        return True

    def wants(self, size: int | None, when: datetime | None) -> bool:
        return True

    def _row(self, root: str, path: str) -> tuple | None:
        try:
            stat = os.stat(path)
            when = datetime.fromtimestamp(stat.st_mtime_ns // 1000 / 1e6, timezone.utc)
            if self.wants(stat.st_size, when):
                return root, path, stat.st_size, when, file_fingerprint(path) if self.hash else None, None
        except OSError as e:
            if self.wants(None, None):
                return root, path, None, None, None, f"{type(e).__name__}: {e.strerror}"
        return None

    def read(self, partition: _Directory) -> Iterator[tuple]:
        for path, error in self.walk(partition):
            if error is None:
                if self.wants_path(path) and (row := self._row(partition.root, path)):
                    yield row
            elif self.wants_path(path) and self.wants(None, None):
                yield partition.root, path, None, None, None, error

    def walk(self, partition: _Directory) -> Iterator[tuple[str, str | None]]:
        """Paths of files, and those of directories that can't be listed with the error."""
        stack = [partition.path]
        while stack:
            here = stack.pop()
            try:
                with os.scandir(here) as found:
                    entries = sorted(found, key=lambda e: e.name)
            except OSError as e:
                if not partition.share:
                    yield here, f"{type(e).__name__}: {e.strerror}"
                continue
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if partition.deep and self.enters(e.path):
                        stack.append(e.path)
                    continue
                if partition.shares > 1 and zlib.crc32(os.fsencode(e.name)) % partition.shares != partition.share:
                    continue
                if e.is_symlink() and (not self.links or not os.path.isfile(e.path)):
                    continue
                yield e.path, None


#: Filters on these columns are tested here: by the filter's class, what it says of a value.
_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x),
}


class PushingReader(ArchiveReader):
    """A reader that takes filters on path, size_bytes and modified_time."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.tests: dict[str, list[tuple[type, object]]] = {"path": [], "size_bytes": [], "modified_time": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if type(f) in _TESTS and name in self.tests:
                value = f.value
                if isinstance(value, datetime):
                    value = value.astimezone(timezone.utc) if value.tzinfo else value.replace(tzinfo=timezone.utc)
                self.tests[name].append((type(f), value))
            else:
                yield f

    def _passes(self, name: str, value) -> bool:
        return all(value is not None and _TESTS[kind](value, x) for kind, x in self.tests[name])

    def enters(self, directory: str) -> bool:
        """A directory may hold a wanted path if either begins with the other."""
        inside = directory + "/"
        for kind, x in self.tests["path"]:
            prefixes = x if kind is In else [x] if kind in (EqualTo, StringStartsWith) else None
            if prefixes is not None and not any(p.startswith(inside) or kind is StringStartsWith and inside.startswith(p) for p in prefixes):
                return False
        return True

    def wants_path(self, path: str) -> bool:
        return self._passes("path", path)

    def wants(self, size: int | None, when: datetime | None) -> bool:
        return self._passes("size_bytes", size) and self._passes("modified_time", when)

    def partitions(self) -> list[InputPartition]:
        return [p for p in super().partitions() if self.enters(p.path)]


class _Beat(InputPartition):
    """A row for each bucket, so that a bucket of which all files are gone is looked at too."""


class WatchReader(DataSourceStreamReader):
    """Each batch is a listing of the roots by the executors, dealt over tasks as a scan is; the offset is the time of the batch alone.

    Rows: bucket, identity (of the file, whatever it is called; of a path for hard links), path, size, time in ns, tick.
    """

    def __init__(self, options: dict) -> None:
        self.files = ArchiveReader(options)
        self.buckets = int(options.get("buckets", "64"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"tick": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts: list[InputPartition] = [_Beat(end["tick"])]
        for p in self.files.partitions():
            p.tick = end["tick"]
            parts.append(p)
        return parts

    def read(self, partition) -> Iterator[tuple]:
        if isinstance(partition, _Beat):
            for b in range(self.buckets):
                yield b, None, None, None, None, partition.value
            return
        for path, error in self.files.walk(partition):
            try:
                own, stat = os.lstat(path), os.stat(path)
            except OSError:
                continue
            if error is None:
                identity = f"{own.st_dev}:{own.st_ino}" if own.st_nlink == 1 else path
                yield zlib.crc32(identity.encode("utf-8", "surrogateescape")) % self.buckets, identity, path, stat.st_size, stat.st_mtime_ns, partition.tick


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lakeloom_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown", "false") == "true" else ArchiveReader)(self.options)


class WatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lakeloom_watch"

    def schema(self) -> str:
        return "bucket int, identity string, path string, size_bytes long, modified_ns long, tick long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return WatchReader(self.options)


def listing(spark: SparkSession, roots: list[str], dialect: str = "boolean", hash_files: bool = False) -> DataFrame:
    """(path, size_bytes, modified_time, fingerprint, error) of every file below the roots, once each, and of what can't be read."""
    for r in roots:
        validate_root(r, dialect)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("lakeloom_archive").option("roots", json.dumps(roots)).option("hash", str(hash_files).lower()).option("follow_file_links", str(dialect == "boolean").lower()).load().drop("root")


def hash_files(files: DataFrame) -> DataFrame:
    """(path, size_bytes, modified_time, fingerprint, error) of (path), as the files are when they are hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ArchiveReader({"roots": "[]"})
        for rb in batches:
            rows = [reader._row("", path)[1:] for path in rb.column(0).to_pylist()]
            kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["path", "size_bytes", "modified_time", "fingerprint", "error"])

    return files.select("path").mapInArrow(run, "path string, size_bytes long, modified_time timestamp, fingerprint string, error string")


def gone(error):
    """Whether an error says that there is no such file or directory: any other says that there is one that can't be read."""
    return error.startswith("FileNotFoundError") | error.startswith("NotADirectoryError")


def scan(spark: SparkSession, roots: list[str], dialect: str = "boolean", hash_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, issues) below the roots. In the boolean dialect any invalid root fails the scan; in the simple one it is an issue."""
    rows = listing(spark, roots, dialect, hash_files)
    files = rows.where("error is null").select("path", "size_bytes", "modified_time", "fingerprint")
    return files, rows.where("error is not null").select("path", "error")


def in_path_order(files: DataFrame) -> DataFrame:
    return files.orderBy(F.split("path", "/"))


def classify_scan(files: DataFrame, previous: DataFrame) -> DataFrame:
    """files with outcome new, unchanged (size and time equal) or changed, and the previous values of changed ones."""
    old = previous.select("path", F.col("size_bytes").alias("previous_size"), F.col("modified_time").alias("previous_time"), F.lit(True).alias("_known"))
    joined = files.join(old, "path", "left")
    same = (F.col("size_bytes") == F.col("previous_size")) & (F.date_trunc("microsecond", "modified_time") == F.date_trunc("microsecond", "previous_time"))
    outcome = F.when(F.col("_known").isNull(), "new").when(same, "unchanged").otherwise("changed")
    keep = lambda c: F.when(outcome == "changed", F.col(c)).alias(c)
    return joined.select(*files.columns, outcome.alias("outcome"), keep("previous_size"), keep("previous_time"))


def needing_processing(classified: DataFrame) -> DataFrame:
    return classified.where("outcome <> 'unchanged'")


def pending(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates whose fingerprint the resume log doesn't hold."""
    return candidates.join(log.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*candidates.columns)


def mark_indexed(log: DataFrame, done: DataFrame) -> DataFrame:
    return log.select("fingerprint").unionByName(done.select("fingerprint")).distinct()


def index_scanned(files: DataFrame, index: DataFrame) -> DataFrame:
    """The rows that files add to an index of (id, path, ...): numbers go on after the greatest, from 1, in order of path.

    A path that the index has already, or that stands twice in files, is an error; so is a file that could not be hashed.
    """
    last = index.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    known = index.select("path", F.lit(True).alias("_known"))
    marked = files.join(known, "path", "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("path")))
    fault = F.when(F.col("_known").isNotNull() | (F.col("_n") > 1), F.concat(F.lit("path already indexed: "), F.col("path"))).when(F.col("fingerprint").isNull(), F.concat(F.lit("unreadable file: "), F.col("path")))
    checked = marked.withColumn("path", F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("path"))).drop("_known", "_n")
    return numbered(checked, ["path"], "id", last + 1).select("id", *files.columns)
