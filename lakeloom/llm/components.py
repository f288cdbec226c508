"""Connected components by alternating large-star and small-star steps, as joins and aggregates.

Each step is written to the shared folder, so lineage stays short and no link reaches the driver but as
counts. A node with very many links is pre-aggregated (a minimum) and its rows are split by skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Workspace, partitions

#: Links that a file of a round holds at least: a small graph is not written as hundreds of files.
FILE_LINKS = 50_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), both directions for large, u > v for small; links the neighbours to the least of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, ws: Workspace, name: str, rounds: int = 60) -> DataFrame:
    """(a, b) to (node, label): the least node of each node's component, for nodes that have links."""
    now = ws.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}_0")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(now)
    for i in range(1, rounds + 1):
        if not before[0]:
            break
        large = _star(now, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        files = min(partitions(ws.spark), 1 + before[0] // FILE_LINKS)
        now = ws.put(_star(large, False).coalesce(files), f"{name}_{i}")
        ws.drop(f"{name}_{i - 1}")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
