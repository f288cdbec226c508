"""Archive health: missing, corrupt, orphaned and moved files, snapshots and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.sources import archive
from lakeloom.sources.store import numbered

#: Kinds of findings; fixed values.
KINDS = ("missing-file", "moved-file", "corrupt-asset", "orphaned-derivative")


def missing(assets: DataFrame, scan: DataFrame) -> DataFrame:
    return assets.join(scan.select("path"), "path", "left_anti")


def missing_from(assets: DataFrame, listing: DataFrame) -> DataFrame:
    """Assets that a listing with its errors (path, error) doesn't hold.

    What can't be read is there: it isn't missing, and neither is what stands below a directory that can't be listed.
    """
    there = listing.where(F.col("error").isNull() | ~archive.gone(F.col("error")))
    absent = missing(assets, there)
    steps = F.split("path", "/")
    above = absent.select(F.col("path").alias("_path"), F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("path"))
    hidden = above.join(there.where("error is not null").select("path"), "path", "left_semi").select(F.col("_path").alias("path")).distinct()
    return absent.join(hidden, "path", "left_anti")


def corrupt(assets: DataFrame) -> DataFrame:
    """Unsupported counts as corrupt."""
    return assets.where(~F.coalesce(F.col("supported"), F.lit(False)))


def orphaned_derivatives(derivatives: DataFrame, live: DataFrame) -> DataFrame:
    return derivatives.join(live.select("asset_id"), "asset_id", "left_anti")


def moved(assets: DataFrame, scan: DataFrame) -> DataFrame:
    """(asset_id, path, new_path): missing assets whose content a new file has, the least path of several (our own design)."""
    fresh = scan.join(assets.select("path"), "path", "left_anti").groupBy("fingerprint").agg(F.min("path").alias("new_path"))
    return missing(assets, scan).join(fresh, "fingerprint").select("asset_id", "path", "new_path")


def counts_by_kind(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def is_healthy(issues: DataFrame) -> bool:
    return issues.isEmpty()


def snapshot(assets: DataFrame, scan: DataFrame, derivatives: DataFrame, waste: DataFrame) -> DataFrame:
    """One row: total_assets, missing_files, corrupt_assets, orphaned_derivatives (counts), duplicate_waste_bytes, interventions."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [n(assets, "total_assets"), n(missing(assets, scan), "missing_files"), n(corrupt(assets), "corrupt_assets"), n(orphaned_derivatives(derivatives, assets), "orphaned_derivatives"), waste.select(F.col("reclaimable_bytes").alias("duplicate_waste_bytes"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("interventions", F.col("missing_files") + F.col("corrupt_assets") + F.col("orphaned_derivatives"))


def _deltas(snapshots: DataFrame, *key: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("taken_at", "interventions")
    return snapshots.withColumn("delta", F.coalesce(F.col("interventions") - F.lag("interventions").over(w), F.lit(0)))


def trend(snapshots: DataFrame, key: str | None = None) -> DataFrame:
    """Snapshots with delta: interventions less those of the one before; 0 for the first.

    With a key, the one before of that key. Without, snapshots are numbered in order of time by ranges and each meets
    its predecessor by number, so all of them never meet in one task; of one time the fewer interventions come first.
    """
    if key:
        return _deltas(snapshots, key)
    at = numbered(snapshots, ["taken_at", "interventions"], "_n")
    before = at.select((F.col("_n") + 1).alias("_n"), F.col("interventions").alias("_before"))
    return at.join(before, "_n", "left").select(*snapshots.columns, F.coalesce(F.col("interventions") - F.col("_before"), F.lit(0)).alias("delta"))


def recent_trend(snapshots: DataFrame, limit: int) -> DataFrame:
    """The newest are taken first, so the oldest of them has delta 0. They are `limit` many, so one task orders them."""
    return _deltas(snapshots.orderBy(F.desc("taken_at")).limit(limit))
