"""Scenes: segmentation of ordered score sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.operators.kernels import dhash_udf, frame_difference_udf
from lakeloom.sources.cut import checkpointed


def in_ranges(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """rows sorted by key and order and dealt by ranges of both, with _range and _at (place in it): one key may span many ranges.

    Cut from lineage, so rows that tie keep their places.
    """
    by = [key, *order]
    dealt = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    return dealt.withColumn("_range", F.shiftright("_at", 33))


def carried(parts: DataFrame, key: str, value: Column, forward: bool = True) -> DataFrame:
    """(key, _range, _carry): value of the ranges before (forward) or after, summed up by a window over a key's ranges.

    parts has a row for each key and range; so a key has as many as there are ranges at most.
    """
    w = Window.partitionBy(key).orderBy("_range")
    w = w.rowsBetween(Window.unboundedPreceding, -1) if forward else w.rowsBetween(1, Window.unboundedFollowing)
    return parts.select(key, "_range", value.over(w).alias("_carry"))


def numbered_in_ranges(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows of in_ranges() with their number within the key, from 0: the place in the range, and what the ranges before hold of the key."""
    parts = rows.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    base = carried(parts, key, F.sum("_n")).join(parts, [key, "_range"]).select(key, "_range", "_first", F.coalesce("_carry", F.lit(0)).alias("_before"))
    return rows.join(base, [key, "_range"]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_first", "_before")


def spans(cuts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, scene, value, next) of cuts (key, _range, _at, value): their number within the key from 0 on, and the value of the next cut."""
    w = Window.partitionBy(key, "_range").orderBy("_at")  # within a range
    parts = cuts.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_first"))
    before = carried(parts, key, F.sum("_n")).withColumnRenamed("_carry", "_before")
    after = carried(parts, key, F.min("_first"), forward=False).withColumnRenamed("_carry", "_after")
    local = cuts.withColumn("_k", F.row_number().over(w) - 1).withColumn("_next", F.lead(value).over(w))
    scene = (F.col("_k") + F.coalesce("_before", F.lit(0))).cast("int").alias("scene")
    return local.join(before, [key, "_range"]).join(after, [key, "_range"]).select(key, scene, value, F.coalesce("_next", "_after").alias("next"))


def split_scenes(scores: DataFrame, threshold: float, fps: float, assets: DataFrame | None = None, key: str = "asset_id", order: tuple[str, ...] = ("frame",), score: str = "score") -> DataFrame:
    """(key, scene, start_s, end_s): a scene begins at frame 0 and at each later frame whose score reaches the threshold.

    The last scene is open (null end). Assets without scores, if given, have one open scene at 0. Frames are dealt by ranges of
    asset and time and joined by what each range carries over, so an endless recording is as many tasks as its share of all.
    """
    framed = numbered_in_ranges(in_ranges(scores.select(key, *order, score).where(F.col(key).isNotNull()), key, order), key, "_i")
    cuts = checkpointed(framed.where((F.col("_i") == 0) | (F.col(score) >= threshold)).select(key, "_range", "_at", "_i"))
    out = spans(cuts, key, "_i").select(key, "scene", (F.col("_i") / fps).alias("start_s"), (F.col("next") / fps).alias("end_s"))
    if assets is None:
        return out
    return assets.select(key).distinct().join(out, key, "left").select(key, F.coalesce("scene", F.lit(0)).alias("scene"), F.coalesce("start_s", F.lit(0.0)).alias("start_s"), "end_s")


def before_in_ranges(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows of in_ranges() with the value of the row before within the key; the first row of a range gets the last of the range before."""
    w = Window.partitionBy(key, "_range").orderBy("_at")
    parts = rows.groupBy(key, "_range").agg(F.max_by(value, "_at").alias("_last"))
    last = parts.select(key, "_range", F.lag("_last").over(Window.partitionBy(key).orderBy("_range")).alias("_carry"))
    return rows.withColumn("_first", F.row_number().over(w) == 1).withColumn(name, F.lag(value).over(w)).join(last, [key, "_range"]).withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(name))).drop("_first", "_carry")


def frame_scores(frames: DataFrame, key: str = "asset_id") -> DataFrame:
    """frames (key, frame, data) to (key, frame, score); the first frame scores 0."""
    return before_in_ranges(in_ranges(frames.select(key, "frame", "data"), key, ("frame",)), key, "data", "before").select(key, "frame", F.coalesce(frame_difference_udf("before", "data"), F.lit(0.0).cast("float")).alias("score"))


def detect_scenes(frames: DataFrame, threshold: float, fps: float, max_frames: int, short_videos: bool = False, key: str = "asset_id") -> DataFrame:
    """Scenes of the first max_frames frames; assets with fewer frames have none unless short_videos is set."""
    kept = frames.where(F.col("frame") < max_frames)
    if not short_videos:
        kept = kept.join(frames.groupBy(key).count().where(F.col("count") >= max_frames).select(key), key, "left_semi")
    return split_scenes(frame_scores(kept, key), threshold, max(fps, 1.0), key=key)


def checked_scenes(scenes: DataFrame) -> DataFrame:
    ok = F.col("end_s").isNull() | (F.col("end_s") > F.col("start_s"))
    return scenes.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a scene must end after its start")).cast("boolean")))


def merge_short_scenes(scenes: DataFrame, min_seconds: float = 1.0, key: str = "asset_id") -> DataFrame:
    """Scenes shorter than min_seconds become part of the scene before, which then lasts on (our own design).

    A cut counts if the scene that is open began min_seconds earlier at least, so cuts that were dropped don't count. Which
    cuts of a range count depends on the last that counts before it. Each range is first decided as if none stood before;
    then those for which that was wrong are decided again, until none is. A range is right at the latest once those before
    it are, and mostly soon, as two different beginnings meet in one cut after a few.
    """
    kind = scenes.schema[key].dataType.simpleString()
    cuts = in_ranges(scenes.select(key, F.col("start_s").cast("double").alias("start_s")).where("start_s is not null"), key, ("start_s",))

    def decide(rows: pa.Table) -> Iterator[tuple[int, float]]:
        """Rows of one range that count, in order of place, given what counts last before it."""
        last = rows.column("_carry")[0].as_py()
        starts = rows.column("start_s").to_pylist()
        at = rows.column("_at").to_pylist()
        for i in sorted(range(len(at)), key=at.__getitem__):
            if last is None or starts[i] - last >= min_seconds:
                last = starts[i]
                yield i, last

    def end(rows: pa.Table) -> pa.Table:
        last = rows.column("_carry")[0].as_py()
        for _, last in decide(rows):
            pass
        return pa.table({key: rows.column(key).slice(0, 1), "_range": rows.column("_range").slice(0, 1), "_carry": rows.column("_carry").slice(0, 1), "_end": pa.array([last], pa.float64())})

    def kept(rows: pa.Table) -> pa.Table:
        return rows.take(pa.array([i for i, _ in decide(rows)], pa.int64()))

    of_range = [key, "_range"]
    carry = cuts.select(*of_range).distinct().withColumn("_carry", F.lit(None).cast("double"))
    ends = None  # of each range: what it was decided with, and what counts last in it
    while True:
        fresh = cuts.join(carry, of_range).groupBy(*of_range).applyInArrow(end, f"{key} {kind}, _range long, _carry double, _end double")
        ends = checkpointed(fresh if ends is None else ends.join(carry.select(*of_range), of_range, "left_anti").unionByName(fresh))
        before = ends.select(*of_range, F.col("_carry").alias("_had"), F.lag("_end").over(Window.partitionBy(key).orderBy("_range")).alias("_carry"))
        carry = checkpointed(before.where(~F.col("_had").eqNullSafe(F.col("_carry"))).select(*of_range, "_carry"))
        if carry.isEmpty():
            break
    counted = cuts.join(ends.select(*of_range, "_carry"), of_range).groupBy(*of_range).applyInArrow(kept, f"{key} {kind}, _range long, start_s double, _at long, _carry double")
    return spans(checkpointed(counted.select(key, "_range", "_at", "start_s")), key, "start_s").select(key, "scene", "start_s", F.col("next").alias("end_s"))


@dataclass(frozen=True)
class SceneDetector:
    """Cuts where the difference hashes of neighbouring sampled frames lie further apart than hash_distance."""

    hash_distance: int = 24
    min_scene_ms: int = 1000
    every_nth_frame: int = 1

    def detect(self, frames: DataFrame, fps: float, key: str = "asset_id") -> DataFrame:
        """frames (key, frame, data, width, height) to (key, scene, start_s, end_s)."""
        sampled = frames.where(F.col("frame") % self.every_nth_frame == 0).select(key, "frame", dhash_udf("data", "width", "height").alias("hash"))
        apart = F.bit_count(F.col("hash").bitwiseXOR(F.col("before")))
        scores = before_in_ranges(in_ranges(sampled, key, ("frame",)), key, "hash", "before").select(key, "frame", apart.alias("apart"))
        cuts = scores.where(F.col("apart").isNull() | (F.col("apart") > self.hash_distance)).select(key, (F.col("frame") / fps).alias("start_s"))
        return merge_short_scenes(cuts, self.min_scene_ms / 1000, key)
