"""An index run: list, plan against the store, hash what is new or changed in chunks, then store.

Listing reads no file. The plan joins it with the archive's assets; only new and changed files are read, chunk by chunk.
A chunk's rows are a folder of the run, and which folders are whole is the run's cursor: a run that was paused, cancelled
or lost goes on after the last whole chunk, with the plan that it has, in whatever session. Between chunks the job's
flags are polled, so a pause ends the work within a chunk and frees the queue.
"""

from __future__ import annotations

import math
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import media, text
from lakeloom.operators import dedupe, health
from lakeloom.plans.jobs import JobQueue, Stage
from lakeloom.sources import archive, probe
from lakeloom.sources.cut import checkpointed
from lakeloom.sources.store import TABLES, Store

#: Files and bytes that a chunk has on average at most.
CHUNK_FILES, CHUNK_BYTES = 50_000, 1 << 40


def plan(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, size_bytes, modified_time, outcome) of a listing (path, size_bytes, modified_time, error), once each: new, changed, unchanged."""
    files = listing.where("error is null").select("path", "size_bytes", "modified_time").dropDuplicates(["path"])
    return archive.classify_scan(files, known).select("path", "size_bytes", "modified_time", "outcome")


def in_chunks(planned: DataFrame, chunks: int) -> DataFrame:
    """The plan's files that are to be hashed, with the chunk of each."""
    return archive.needing_processing(planned).withColumn("chunk", F.pmod(F.xxhash64("path"), F.lit(chunks)).cast("int"))


#: Why a file isn't imported; fixed values.
UNSUPPORTED, UNRECOGNISED, UNREADABLE = "unsupported codec (indexed as unsupported)", "unrecognised file", "unreadable file"


def imported(probed: DataFrame, archive_id: str) -> DataFrame:
    """(path, status imported or rejected, reason, asset_id) of probed files, and all that they came with: one that isn't supported is refused, which is no failure."""
    error = F.coalesce(F.col("error"), F.col("probe_error"))
    why = F.when(error.isNotNull(), F.concat(F.lit(f"{UNREADABLE}: "), error)).when(F.col("container").isNull(), UNRECOGNISED).when(~F.col("supported"), UNSUPPORTED)
    asset = F.when(why.isNull(), text.asset_uuid(F.lit(archive_id), text.normalize_path(F.col("path"))))
    return probed.select("*", F.when(why.isNull(), "imported").otherwise("rejected").alias("import_status"), why.alias("reason"), asset.alias("asset_id"))


class Import:
    """Files given by path: probed and hashed, refused or stored, and what they were decided to be kept by job.

    The stages after it (derivatives, scenes, tags) are jobs of their own that wait for it, each for the one before; their
    workers get the assets that this import has stored, as a table, by assets_of().
    """

    STAGES = ((Stage.DERIVATIVES, "derivatives"), (Stage.SCENE_DETECTION, "derivatives"), (Stage.TAGGING, "tagging"))

    def __init__(self, store: Store, home: str) -> None:
        self.store, self.home = store, home

    def enqueue(self, queue: JobQueue, archive_id: str, paths: DataFrame) -> list[str]:
        """Jobs of the import of (path) and of its stages, in their order."""
        folder = f"{self.store.root}/imports_asked/{uuid.uuid4().hex}"
        paths.select("path").where("path is not null").distinct().write.parquet(folder)
        first = queue.enqueue(archive_id, "index", lambda context, job: self.work(context, job, folder), Stage.SCAN)
        jobs = [first]
        for stage, kind in self.STAGES:
            jobs.append(queue.enqueue(archive_id, kind, None, stage, after=jobs[-1]))
        return jobs

    def work(self, context, job: dict, folder: str) -> str:
        spark = self.store.spark
        asked = spark.read.parquet(folder).repartition(2 * spark.sparkContext.defaultParallelism)
        probed = probe.probe_files(archive.hash_files(asked), once=True)
        rows = checkpointed(imported(probed, job["archive_id"]))
        context.check()
        fresh = rows.where("import_status = 'imported'").select(
            F.col("asset_id").alias("id"), F.lit(job["archive_id"]).alias("archive_id"), "path", "fingerprint", "size_bytes", "modified_time",
            "media_type", "supported", F.to_json(F.struct("container", "codec")).alias("technical"),
        )
        self.store.upsert("assets", fresh)
        self.store.upsert("imports", rows.select(F.lit(job["id"]).alias("job_id"), F.lit(job["archive_id"]).alias("archive_id"), "path", F.col("import_status").alias("status"), "reason", "asset_id"))
        self.store._fs().delete(self.store._path(folder), True)
        counts = {r["import_status"]: r["count"] for r in rows.groupBy("import_status").count().collect()}  # two statuses
        return f"imported {counts.get('imported', 0)} file(s), rejected {counts.get('rejected', 0)}"

    def assets_of(self, job_id: str) -> DataFrame:
        """Assets that the import job has stored, with the places of their derivatives below the engine's home."""
        mine = self.store.table("imports").where((F.col("job_id") == job_id) & (F.col("status") == "imported")).select(F.col("asset_id").alias("id"))
        assets = self.store.table("assets").join(mine, "id", "left_semi")
        return assets.withColumn("derivatives", media.derivative_paths(F.lit(f"{self.home}/derivatives"), F.col("id")))


class IndexRun:
    """A run of an archive's index job, kept below the store until it is through."""

    def __init__(self, store: Store, archive_row: dict, job_id: str, headers: bool = False, chunk_files: int = CHUNK_FILES) -> None:
        self.store, self.spark, self.row, self.job = store, store.spark, archive_row, job_id
        self.headers, self.chunk_files = headers, chunk_files
        self.root = f"{store.root}/runs/{job_id}"

    def _whole(self, name: str) -> bool:
        return self.store._fs().exists(self.store._path(f"{self.root}/{name}/_SUCCESS"))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def assets(self) -> DataFrame:
        return self.store.table("assets").where(F.col("archive_id") == self.row["id"])

    def planned(self) -> DataFrame:
        """The run's plan, made once."""
        if not self._whole("listing"):
            archive.listing(self.spark, self.row["roots"], "simple").select("path", "size_bytes", "modified_time", "error").write.mode("overwrite").parquet(f"{self.root}/listing")
        if not self._whole("plan"):
            plan(self._read("listing"), self.assets()).write.mode("overwrite").parquet(f"{self.root}/plan")
        return self._read("plan")

    def work(self, context) -> str:
        planned = self.planned()
        counts = {r["outcome"]: r for r in planned.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")).collect()}  # three outcomes
        n = {o: counts[o]["n"] if o in counts else 0 for o in ("new", "changed", "unchanged")}
        todo, size = n["new"] + n["changed"], sum(counts[o]["bytes"] or 0 for o in ("new", "changed") if o in counts)
        chunks = max(math.ceil(todo / self.chunk_files), math.ceil(size / CHUNK_BYTES)) if todo else 0
        for c in range(chunks):
            if not self._whole(f"hashed/chunk={c}"):
                context.check()
                self.hash_chunk(in_chunks(planned, chunks).where(F.col("chunk") == c), c)
            context.report_progress(0.9 * (c + 1) / chunks)
        context.check()
        return self.finish(context, n, chunks)

    def hash_chunk(self, files: DataFrame, c: int) -> None:
        # Dealt anew: a chunk's files come from few blocks of the plan, and one file may take as long as a thousand others.
        dealt = files.select("path").repartition(2 * self.spark.sparkContext.defaultParallelism)
        hashed = archive.hash_files(dealt)
        (probe.probe_files(hashed, once=True) if self.headers else hashed).write.mode("overwrite").parquet(f"{self.root}/hashed/chunk={c}")

    def finish(self, context, n: dict[str, int], chunks: int) -> str:
        """Assets, findings, issues and the run's figures go to the store; again if it is lost amid them."""
        aid, now, hashed = self.row["id"], datetime.now(timezone.utc), None
        listing = self._read("listing")
        issues = listing.where("error is not null").select("path", "error")
        if chunks:
            hashed = self._read("hashed").drop("chunk")
            issues = issues.unionByName(hashed.where("error is not null").select("path", "error"))
            self.store.upsert("assets", self._fresh(hashed.where("error is null"), aid))
        context.report_progress(0.95)
        assets = self.assets()
        finding = lambda kind, rows, subject: rows.select(F.lit(aid).alias("archive_id"), F.lit(now).alias("taken_at"), F.lit(kind).alias("kind"), F.col(subject).alias("subject"))
        seen = listing.select("path", "error")
        if hashed is not None:  # what the later look says of a file stands
            later = hashed.select("path", "error")
            seen = seen.join(later.select("path"), "path", "left_anti").unionByName(later)
        self.store.upsert("health_findings", finding("missing-file", health.missing_from(assets, seen), "path").unionByName(finding("corrupt-asset", health.corrupt(assets), "id")))
        mine = self.store.table("scan_issues").where(F.col("archive_id") != aid)
        self.store.replace("scan_issues", mine.unionByName(issues.groupBy("path").agg(F.max("error").alias("error")).select(F.lit(aid).alias("archive_id"), "path", "error", F.lit(now).alias("taken_at"))))
        warnings = self.store.table("scan_issues").where(F.col("archive_id") == aid).count()
        found = self.store.table("health_findings").where((F.col("archive_id") == aid) & (F.col("taken_at") == F.lit(now)))
        counts = {r["kind"]: r["n"] for r in health.counts_by_kind(found).collect()}  # a row for each kind
        waste = dedupe.waste_report(dedupe.exact_members(assets, "id"), assets.select(F.col("id").alias("asset_id"), "size_bytes")).first()
        snapshot = (aid, now, assets.count(), counts.get("missing-file", 0), counts.get("corrupt-asset", 0), 0, waste["reclaimable_bytes"])
        self.store.upsert("health_snapshots", self.spark.createDataFrame([snapshot], TABLES["health_snapshots"][0]))
        total, read = sum(n.values()), n["new"] + n["changed"]
        self.store.upsert("index_runs", self.spark.createDataFrame([(self.job, aid, now, total, n["new"], n["changed"], n["unchanged"], read, warnings)], TABLES["index_runs"][0]))
        self.discard()
        return f"indexed {total} asset(s)" + (f", {warnings} warning(s) (see scan errors)" if warnings else "")

    def _fresh(self, files: DataFrame, aid: str) -> DataFrame:
        found = media.extension_probe(text.extension(text.filename(F.col("path"))))
        value = {"media_type": found["media_type"], "supported": found["supported"], "container": found["container"], "codec": found["codec"]}
        if self.headers:  # the extension speaks where the header says nothing
            value = {k: F.coalesce(F.when(F.col("codec").isNotNull(), F.col(k)), v) for k, v in value.items()}
        return files.select(
            text.asset_uuid(F.lit(aid), text.normalize_path(F.col("path"))).alias("id"), F.lit(aid).alias("archive_id"), "path", "fingerprint", "size_bytes", "modified_time",
            value["media_type"].alias("media_type"), value["supported"].alias("supported"), F.to_json(F.struct(value["container"].alias("container"), value["codec"].alias("codec"))).alias("technical"),
        )

    def discard(self) -> None:
        self.store._fs().delete(self.store._path(self.root), True)
