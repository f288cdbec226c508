"""Structured Streaming: watch folders and counts by window."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeloom.sources.archive import WatchSource

HINTS = "path string, deleted boolean, renamed_from string, renamed_to string, tick long"
#: Of a file: path, size and time as seen last; since which tick; what was told of it (null: nothing); since when it is gone.
_SEEN, _SINCE, _TOLD, _GONE = range(4)


def advance(known: dict[str, list], seen: dict[str, tuple], tick: int, debounce_ms: int) -> Iterator[tuple]:
    """Takes what a listing saw of one bucket's files into their state; yields HINTS of what has been quiet for debounce_ms.

    A file that goes on changing is told of once it rests, one that comes and goes within the window never. A file that
    has another name is a rename: a deletion of the old path and the new path, each naming the other.
    """
    for identity, now in seen.items():
        file = known.setdefault(identity, [None, tick, None, None])
        if list(now) != file[_SEEN]:
            file[_SEEN], file[_SINCE] = list(now), tick
        file[_GONE] = None
        if tick - file[_SINCE] >= debounce_ms and file[_TOLD] != file[_SEEN]:
            path, before = file[_SEEN][0], file[_TOLD] and file[_TOLD][0]
            renamed = before if before not in (None, path) else None
            if renamed is not None:
                yield renamed, True, None, path, tick
            yield path, False, renamed, None, tick
            file[_TOLD] = file[_SEEN]
    for identity in [i for i in known if i not in seen]:
        file = known[identity]
        if file[_GONE] is None:
            file[_GONE] = tick
        if tick - file[_GONE] >= debounce_ms:
            if file[_TOLD]:
                yield file[_TOLD][0], True, None, None, tick
            del known[identity]


def watch(spark: SparkSession, roots: list[str], debounce_ms: int = 0, buckets: int = 64) -> DataFrame:
    """Stream of HINTS below the roots: paths to scan again, and paths that are gone.

    State is kept by bucket of files in the stream's checkpoint, as is the time of the last listing, and nothing more: a
    restart tells what changed meanwhile and repeats nothing. The clock is the time of the listings.
    """
    spark.dataSource.register(WatchSource)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple] = {}
        tick = 0
        for frame in frames:
            for identity, path, size, when, at in zip(frame["identity"], frame["path"], frame["size_bytes"], frame["modified_ns"], frame["tick"]):
                tick = max(tick, int(at))
                if identity is not None:
                    seen[identity] = (path, int(size), int(when))
        known = json.loads(state.get[0]) if state.exists else {}
        told = list(advance(known, seen, tick, debounce_ms))
        state.update((json.dumps(known),))
        yield pd.DataFrame(told, columns=["path", "deleted", "renamed_from", "renamed_to", "tick"])

    listed = spark.readStream.format("lakeloom_watch").option("roots", json.dumps(roots)).option("buckets", str(buckets)).load()
    return listed.groupBy("bucket").applyInPandasWithState(step, HINTS, "files string", "append", GroupStateTimeout.NoTimeout)


def settled(hints: DataFrame) -> DataFrame:
    """One hint a path: what was written anew under its old name isn't deleted."""
    return hints.groupBy("path").agg(F.min("deleted").alias("deleted"), F.max("renamed_from").alias("renamed_from"), F.max("renamed_to").alias("renamed_to"), F.max("tick").alias("tick"))


def on_hints(hints: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs handle(batch, id) for each micro-batch of hints, one a path."""
    writer = hints.writeStream.foreachBatch(lambda batch, i: handle(settled(batch), i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; works on streams (with a watermark) and on tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), "event_type", "n")
