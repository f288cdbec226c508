"""The store: versioned Parquet tables with upserts, cascades and a numbered pointer file a table.

A write makes new files beside the current ones and then creates the pointer of the next number, which names them.
The name is taken exclusively, so of two writers that began alike one fails and none is lost; readers see the old or
the new files and never a path that is being written. Tables of BUCKETED are parted by a hash of their key: a write
makes anew only the buckets that its rows fall into. Tables of LOGS are appended to, a row of a key standing for those
before it, and are compacted when the store is opened.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.sources.cut import checkpointed

#: Tables, their schemas and keys.
TABLES = {
    "archives": ("id string, name string, roots array<string>, ai map<string,string>", ["id"]),
    "preferences": ("key string, value string", ["key"]),
    "assets": ("id string, archive_id string, path string, fingerprint string, size_bytes long, modified_time timestamp, media_type string, supported boolean, technical string", ["id"]),
    "derivatives": ("asset_id string, kind string, path string", ["asset_id", "kind"]),
    "tags": ("id long, asset_id string, label string, source string, model string, version string, provider string, confidence float, rejected boolean", ["id"]),
    "duplicate_groups": ("id string, match_kind string, similarity float, reviewed boolean, keeper string, members array<string>", ["id"]),
    "scenes": ("asset_id string, idx int, start_s double, end_s double", ["asset_id", "idx"]),
    "health_snapshots": ("archive_id string, taken_at timestamp, total_assets long, missing_files long, corrupt_assets long, orphaned_derivatives long, duplicate_waste_bytes long", ["archive_id", "taken_at"]),
    "health_findings": ("archive_id string, taken_at timestamp, kind string, subject string", ["archive_id", "taken_at", "kind", "subject"]),
    "index_runs": ("job_id string, archive_id string, taken_at timestamp, found long, new long, changed long, unchanged long, hashed long, warnings long", ["job_id"]),
    "imports": ("job_id string, archive_id string, path string, status string, reason string, asset_id string", ["job_id", "path"]),
    "scan_issues": ("archive_id string, path string, error string, taken_at timestamp", ["archive_id", "path"]),
    "jobs": ("id string, archive_id string, kind string, status string, progress double, error string, note string, created_at timestamp, updated_at timestamp, stage string, after string", ["id"]),
}


#: Values that columns may have, in the order of their numbers; fixed values.
ENUMS = {
    "media_type": ("video", "audio", "unknown"),
    "tag_source": ("manual", "local-model", "cloud-model"),
    "derivative_kind": ("thumbnail", "proxy", "waveform"),
    "match_kind": ("exact-hash", "perceptual-near-duplicate", "audio-fingerprint"),
    "job_kind": ("index", "derivatives", "tagging"),
    "job_status": ("queued", "active", "paused", "cancelled", "done", "failed"),
}
#: Tables parted by a hash of the column, and tables that are appended to, the last row of a key standing.
BUCKETED = {"assets": "id", "tags": "id"}
LOGS = ("jobs",)
#: Buckets of a new store, and appended files of a log after which opening the store compacts it.
BUCKETS, LOG_FILES = 16, 64
_CHECKED = {("assets", "media_type"): "media_type", ("tags", "source"): "tag_source", ("derivatives", "kind"): "derivative_kind", ("duplicate_groups", "match_kind"): "match_kind", ("jobs", "kind"): "job_kind", ("jobs", "status"): "job_status"}


class StoreError(RuntimeError):
    """The store is of another version, can't be read, or was asked for what it can't do."""


def _invalid(kind: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"invalid {kind} "), value.cast("string")))


def encode_enum(kind: str, value: Column) -> Column:
    """A value's number; null stays null, an unknown value is an error when it is met."""
    numbers = F.create_map(*(x for i, v in enumerate(ENUMS[kind]) for x in (F.lit(v), F.lit(i))))
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(numbers, value), _invalid(kind, value).cast("int")))


def decode_enum(kind: str, number: Column) -> Column:
    """The value of a number; null stays null, an unknown number is an error when it is met."""
    return F.when(number.isNotNull(), F.coalesce(F.get(F.array(*map(F.lit, ENUMS[kind])), number.cast("int")), _invalid(kind, number)))


def checked_enum(kind: str, value: Column) -> Column:
    return F.when(value.isNull() | value.isin(*ENUMS[kind]), value).otherwise(_invalid(kind, value))


def numbered(rows: DataFrame, order: list[str], name: str = "id", first: int = 1) -> DataFrame:
    """rows numbered from `first` on without gaps, in order, by ranges: only the number of rows of each range meets in one place.

    The dealt rows are cut from their lineage, so rows that tie keep their numbers if an executor is lost.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = dealt.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    out = dealt.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts), "_range")  # a row for each range
    return out.withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + F.lit(first)).drop("_at", "_range", "_before")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old and new, the new one where the key is in both; of new rows with one key the greatest, column by column."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    # Maps have no order; as text they have.
    kinds = dict(old.dtypes)
    order = [F.to_json(c) if kinds[c].startswith("map") else F.col(c) for c in rest]
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *(c.desc() for c in order))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


class Store:
    """Tables below one folder, which any Hadoop file system may hold."""

    VERSION = 3

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        """Opens the store, or makes one with the present version and so many buckets; a store of another version is refused."""
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        found = self._read(f"{self.root}/VERSION")
        if found is None:
            if any(self._fs().exists(self._path(f"{self.root}/{t}")) for t in TABLES):
                raise StoreError("a store without a version")
            self._create(f"{self.root}/VERSION", f"{self.VERSION} {buckets}")
            found = self._read(f"{self.root}/VERSION")
        version, _, held = found.partition(" ")
        if version != str(self.VERSION):
            raise StoreError(f"a store of version {version}, not {self.VERSION}")
        self.buckets = int(held)
        for name in LOGS:
            if self._appended(name) > LOG_FILES:
                self.replace(name, self.table(name))

    def _read(self, name: str) -> str | None:
        fs, p = self._fs(), self._path(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def _create(self, name: str, value: str) -> None:
        """Makes a file of that name, whole or not at all; an error if there is one already."""
        jvm, fs = self.spark._jvm, self._fs()
        temporary, final = self._path(f"{name}.{uuid.uuid4().hex}"), self._path(name)
        out = fs.create(temporary, True)
        out.write(bytearray(value.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.isAbsolute() and final.toUri().getScheme() else fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(temporary, final, options)
        except Exception as e:
            fs.delete(temporary, False)
            raise StoreError(f"{name} was written by another") from e

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [e.getPath().getName() for e in fs.listStatus(path)] if fs.exists(path) else []

    def _number(self, table: str) -> int:
        """Of the current pointer; 0 if there is none."""
        return max((int(n[1:]) for n in self._names(f"{self.root}/{table}") if n[:1] == "P" and n[1:].isdigit()), default=0)

    def _parts(self, table: str, number: int) -> dict[str, str]:
        """The folder of each bucket, or of the whole table as bucket ""."""
        return json.loads(self._read(f"{self.root}/{table}/P{number:09d}")) if number else {}

    def _appended(self, name: str) -> int:
        return sum(n.startswith("part-") for folder in self._parts(name, self._number(name)).values() for n in self._names(f"{self.root}/{name}/{folder}"))

    def bucket(self, name: str, key: Column | None = None) -> Column:
        """The bucket of a row of a table of BUCKETED."""
        return F.pmod(F.xxhash64(F.col(BUCKETED[name]) if key is None else key), F.lit(self.buckets)).cast("int")

    def _stored(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """All rows as they were written, or those of some buckets."""
        schema = TABLES[name][0] + (", _seq long" if name in LOGS else "")
        parts = self._parts(name, self._number(name))
        folders = [f"{self.root}/{name}/{v}" for b, v in parts.items() if buckets is None or b == "" or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        rows = self._stored(name)
        return rows if name not in LOGS else latest(rows, TABLES[name][1][0], ["_seq"]).select(*rows.columns).drop("_seq")

    def _checked(self, name: str, rows: DataFrame) -> DataFrame:
        columns = [f.strip().split(" ")[0] for f in TABLES[name][0].replace("map<string,string>", "map").split(",")]
        for column in columns:
            if kind := _CHECKED.get((name, column)):
                rows = rows.withColumn(column, checked_enum(kind, F.col(column)))
        return rows.select(*columns, *[F.lit(time.time_ns()).alias("_seq")] * (name in LOGS))

    def replace(self, name: str, rows: DataFrame, buckets: list[int] | None = None) -> None:
        """rows become the table, or, with buckets, what these buckets hold; the others stay the files they are."""
        number, version = self._number(name), f"v_{uuid.uuid4().hex}"
        parts = {b: v for b, v in self._parts(name, number).items() if buckets is not None and int(b) not in buckets}
        folder, rows = f"{self.root}/{name}/{version}", self._checked(name, rows)
        if name in BUCKETED:
            rows.withColumn("_bucket", self.bucket(name)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
            made = {n.partition("=")[2]: f"{version}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}
            if buckets is not None and (strange := {*made} - {*map(str, buckets)}):
                raise StoreError(f"{name}: rows of the buckets {sorted(strange)} don't belong to this write")
            parts |= made
        else:
            rows.write.parquet(folder)
            parts = {"": version}
        self._create(f"{self.root}/{name}/P{number + 1:09d}", json.dumps(parts))  # a version that isn't pointed to goes with vacuum()

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows for the end of a table of LOGS; nothing else is written."""
        if name not in LOGS:
            raise StoreError(f"{name} is not appended to")
        parts = self._parts(name, self._number(name))
        if parts:
            self._checked(name, rows).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}/{parts['']}")
        else:
            self.replace(name, rows)

    def vacuum(self) -> int:
        """Deletes the versions that the last pointer doesn't name, but for those of readers that may still be at work: call it when none is."""
        fs, gone = self._fs(), 0
        for name in TABLES:
            number = self._number(name)
            keep = {*self._parts(name, number).values()}
            for entry in self._names(f"{self.root}/{name}"):
                below = [f"{entry}/{n}" for n in self._names(f"{self.root}/{name}/{entry}") if n.startswith("_bucket=")] if entry.startswith("v_") else []
                old = [n for n in below if n not in keep] if any(n in keep for n in below) else [entry] if entry.startswith("v_") and entry not in keep or entry[:1] == "P" and entry != f"P{number:09d}" else []
                gone += sum(bool(fs.delete(self._path(f"{self.root}/{name}/{n}"), True)) for n in old)
        return gone

    def upsert(self, name: str, rows: DataFrame) -> None:
        """New and changed rows by key; of a bucketed table only the buckets that they fall into are written."""
        _, keys = TABLES[name]
        if name in LOGS:
            return self.append(name, rows)
        buckets = None
        if name in BUCKETED:
            rows = checkpointed(rows)  # read three times, and it may be made of this table
            buckets = [r[0] for r in rows.select(self.bucket(name)).distinct().collect()]  # as many as there are buckets
            if not buckets:
                return None
        if name == "assets":
            others = self.table(name).select(F.col("id").alias("_id"), "path").unionByName(rows.select(F.col("id").alias("_id"), "path"))
            if twice := others.join(rows.select("path"), "path", "left_semi").groupBy("path").agg(F.count_distinct("_id").alias("n")).where("n > 1").first():
                raise StoreError(f"path already indexed: {twice['path']}")
        return self.replace(name, upsert(self._stored(name, buckets), rows, keys), buckets)

    def delete(self, name: str, condition) -> None:
        self.replace(name, self.table(name).where(~F.coalesce(condition, F.lit(False))))

    # Deletes reach what depends on the row.
    def delete_assets(self, ids: DataFrame) -> None:
        gone = checkpointed(ids.select(F.col("id").alias("asset_id")).distinct())  # what it is read from changes below
        for name in ("derivatives", "tags", "scenes"):
            self.replace(name, self.table(name).join(gone, "asset_id", "left_anti"))
        groups = self.table("duplicate_groups")
        members = groups.select("id", F.posexplode_outer("members").alias("pos", "asset_id")).join(gone, "asset_id", "left_anti")
        left = members.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "asset_id"))), lambda x: x["asset_id"]).alias("members"))
        self.replace("duplicate_groups", groups.drop("members").join(left, "id", "left").withColumn("members", F.coalesce("members", F.array().cast("array<string>"))))
        buckets = [r[0] for r in gone.select(self.bucket("assets", F.col("asset_id"))).distinct().collect()]
        if buckets:
            self.replace("assets", self._stored("assets", buckets).join(gone.withColumnRenamed("asset_id", "id"), "id", "left_anti"), buckets)

    def delete_archive(self, archive_id: str) -> None:
        self.delete_assets(self.table("assets").where(F.col("archive_id") == archive_id).select("id"))
        for name in ("health_snapshots", "health_findings", "scan_issues", "index_runs", "imports"):
            self.delete(name, F.col("archive_id") == archive_id)
        jobs = self.table("jobs")
        self.replace("jobs", jobs.withColumn("archive_id", F.when(F.col("archive_id") != archive_id, F.col("archive_id"))))
        self.delete("archives", F.col("id") == archive_id)

    def find_or_create_archive(self, name: str, roots: list[str]) -> str:
        """Existing roots and new ones, sorted and distinct; the archive's id."""
        found = self.table("archives").where(F.col("name") == name).first()
        row = (found["id"] if found else str(uuid.uuid4()), name, sorted({*(found["roots"] if found else []), *roots}), found["ai"] if found else {"local_tagging": "true"})
        self.upsert("archives", self.spark.createDataFrame([row], TABLES["archives"][0]))
        return row[0]

    def archives(self) -> DataFrame:
        return self.table("archives").orderBy("name")

    def archive(self, archive_id: str) -> dict | None:
        row = self.table("archives").where(F.col("id") == archive_id).first()
        return row.asDict() if row else None

    def roots_of(self, archive_id: str) -> DataFrame:
        """(pos, root) in order."""
        return self.table("archives").where(F.col("id") == archive_id).select(F.posexplode("roots").alias("pos", "root")).orderBy("pos")

    def asset(self, asset_id: str) -> dict | None:
        row = self.table("assets").where(F.col("id") == asset_id).first()
        return row.asDict() if row else None

    def set_preference(self, key: str, value: str) -> None:
        self.upsert("preferences", self.spark.createDataFrame([(key, value)], TABLES["preferences"][0]))

    def preference(self, key: str) -> str | None:
        row = self.table("preferences").where(F.col("key") == key).first()
        return row["value"] if row else None

    def assets_of(self, archive_id: str) -> DataFrame:
        return self.table("assets").where(F.col("archive_id") == archive_id).orderBy("path")

    def derivatives_of(self, asset_id: str) -> DataFrame:
        return self.table("derivatives").where(F.col("asset_id") == asset_id).orderBy("kind")

    def add_tags(self, tags: DataFrame) -> None:
        """New tags get the numbers after the greatest, in order of asset and label."""
        base = self.table("tags").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self.upsert("tags", numbered(tags.drop("id"), ["asset_id", "label"], "id", base + 1))

    def set_tag_rejected(self, tag_id: int, rejected: bool) -> None:
        """Writes the tag's bucket and nothing else."""
        mine = [self.spark.range(1).select(self.bucket("tags", F.lit(tag_id).cast("long"))).first()[0]]
        self.replace("tags", self._stored("tags", mine).withColumn("rejected", F.when(F.col("id") == tag_id, F.lit(rejected)).otherwise(F.col("rejected"))), mine)

    def tags_of(self, asset_id: str) -> DataFrame:
        return self.table("tags").where(F.col("asset_id") == asset_id).orderBy("id")

    def groups_of_archive(self, archive_id: str) -> DataFrame:
        members = self.table("duplicate_groups").select("id", F.explode("members").alias("asset"))
        mine = self.table("assets").where(F.col("archive_id") == archive_id).select(F.col("id").alias("asset"))
        return self.table("duplicate_groups").join(members.join(mine, "asset", "left_semi").select("id").distinct(), "id", "left_semi").orderBy("id")

    def groups_of_asset(self, asset_id: str) -> DataFrame:
        return self.table("duplicate_groups").where(F.array_contains("members", asset_id)).orderBy("id")

    def group(self, group_id: str) -> dict | None:
        """One group; its members keep their order."""
        row = self.table("duplicate_groups").where(F.col("id") == group_id).first()
        return row.asDict() if row else None

    def delete_group(self, group_id: str) -> None:
        self.delete("duplicate_groups", F.col("id") == group_id)

    def review_group(self, group_id: str, keeper: str | None) -> None:
        """Marks the group as reviewed; a keeper must be one of its members."""
        found = self.group(group_id)
        if found is None:
            raise StoreError(f"no group {group_id}")
        if keeper is not None and keeper not in found["members"]:
            raise StoreError(f"{keeper} is not in group {group_id}")
        mine = F.col("id") == group_id
        self.replace("duplicate_groups", self.table("duplicate_groups").withColumn("reviewed", F.when(mine, F.lit(True)).otherwise(F.col("reviewed"))).withColumn("keeper", F.when(mine, F.lit(keeper)).otherwise(F.col("keeper"))))

    def replace_scenes(self, asset_id: str, scenes: DataFrame) -> None:
        self.replace("scenes", self.table("scenes").where(F.col("asset_id") != asset_id).unionByName(scenes))

    def scenes_of(self, asset_id: str) -> DataFrame:
        return self.table("scenes").where(F.col("asset_id") == asset_id).orderBy("idx")

    def recent_snapshots(self, archive_id: str | None, limit: int) -> DataFrame:
        rows = self.table("health_snapshots")
        return (rows if archive_id is None else rows.where(F.col("archive_id") == archive_id)).orderBy(F.desc("taken_at")).limit(limit)


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key of an append-only log, by one aggregate."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in rest))


def union_roots(frames: list[DataFrame]) -> DataFrame:
    """Sorted distinct roots by archive of several (name, roots) tables."""
    both = reduce(DataFrame.unionByName, frames)
    return both.select("name", F.explode("roots").alias("root")).groupBy("name").agg(F.array_sort(F.collect_set("root")).alias("roots"))
