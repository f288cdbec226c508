"""All pairs of rows in tiles: blocks of packed rows, any two of which meet in one place and are compared there as arrays."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions that tiles are dealt over at most, and pairs that a compare looks at together.
MOST_PARTS, ROWS_AT_ONCE, COLS_AT_ONCE, PAIRS_AT_ONCE, HASHES_AT_ONCE, LEADS_AT_ONCE = 4096, 256, 8192, 1 << 14, 4, 16
#: Leading dimensions by which vectors are filtered at most.
FILTER_DIMS = 64

#: (ids, values) of two blocks, and whether they are the same one, to what is found in their pairs.
Compare = Callable[[pa.Array, pa.Array, pa.Array, pa.Array, bool], Iterator[pa.RecordBatch]]


def blocks_of(rows: DataFrame, n: int, tile_rows: int) -> int:
    """Blocks of at most some tile_rows rows, and enough of them that each core has four tiles."""
    return max(1, -(-n // tile_rows), math.isqrt(8 * rows.sparkSession.sparkContext.defaultParallelism) if n > 200 else 1)


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, values) of rows (id, value) without nulls: a row for each block."""
    own = rows.select("id", "value", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    return own.repartition("block").groupBy("block").agg(F.collect_list("id").alias("ids"), F.collect_list("value").alias("values"))


def _compared(sides: DataFrame, tiles: int, compare: Compare, schema: str) -> DataFrame:
    """What compare finds in tiles whose sides are rows (tile, side, whole, ids, values); whole: that block meets itself."""

    def run(batches):
        held = None
        for batch in batches:
            for k in range(batch.num_rows):
                tile, side, whole = (batch.column(c)[k].as_py() for c in range(3))
                ids, values = (batch.column(c).slice(k, 1).flatten() for c in (3, 4))
                if whole:
                    yield from compare(ids, values, ids, values, True)
                elif side == 0:
                    held = (tile, ids, values)
                elif held is not None and held[0] == tile:
                    yield from compare(held[1], held[2], ids, values, False)

    parts = max(1, min(tiles, MOST_PARTS))
    dealt = sides.repartitionById(parts, F.pmod("tile", F.lit(parts)).cast("int")).sortWithinPartitions("tile", "side")
    return dealt.select("tile", "side", "whole", "ids", "values").mapInArrow(run, schema)


def among(rows: DataFrame, blocks: int, compare: Compare, schema: str) -> DataFrame:
    """What compare finds in every pair of rows (id, value), each met once."""
    meets = _packed(rows, blocks).select("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"), "ids", "values")
    last, first = F.greatest("block", "other").cast("long"), F.least("block", "other")
    sides = meets.select((F.floor(last * (last + 1) / 2) + first).alias("tile"), (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("whole"), "ids", "values")
    return _compared(sides, blocks * (blocks + 1) // 2, compare, schema)


def between(left: DataFrame, left_blocks: int, right: DataFrame, right_blocks: int, compare: Compare, schema: str) -> DataFrame:
    """What compare finds in every pair of a left and a right row (id, value)."""
    side = lambda rows, blocks, others, tile, n: _packed(rows, blocks).select("block", F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other"), "ids", "values").select((F.col(tile[0]).cast("long") * right_blocks + F.col(tile[1])).alias("tile"), F.lit(n).alias("side"), F.lit(False).alias("whole"), "ids", "values")
    sides = side(left, left_blocks, right_blocks, ("block", "other"), 0).unionByName(side(right, right_blocks, left_blocks, ("other", "block"), 1))
    return _compared(sides, left_blocks * right_blocks, compare, schema)


def _true(mask: np.ndarray) -> np.ndarray:
    """Places in a flat mask, few of them true: eight are looked at together."""
    even = len(mask) & ~7
    words = np.flatnonzero(mask[:even].view(np.uint64))
    word, bit = np.nonzero(mask[:even].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + bit, np.flatnonzero(mask[even:]) + even])


def _hashes(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def near_hashes(k: int) -> Compare:
    """(p, hp, q, hq) of 64-bit hashes that differ in k bits at most."""

    def compare(ids_a, values_a, ids_b, values_b, same):
        x, y = _hashes(values_a), _hashes(values_b)
        bits = np.empty(HASHES_AT_ONCE * COLS_AT_ONCE, np.uint64)
        count, near = np.empty(len(bits), np.uint8), np.empty(len(bits), bool)
        found, n = [], 0

        def batch():
            i, j = (pa.array(np.concatenate(f)) for f in zip(*found))
            return pa.RecordBatch.from_arrays([ids_a.take(i), values_a.take(i), ids_b.take(j), values_b.take(j)], ["p", "hp", "q", "hq"])

        for c in range(0, len(y), COLS_AT_ONCE):
            others = y[c : c + COLS_AT_ONCE]
            for r in range(0, min(len(x), c + COLS_AT_ONCE) if same else len(x), HASHES_AT_ONCE):
                few = x[r : r + HASHES_AT_ONCE, None]
                m = len(few) * len(others)
                np.bitwise_xor(few, others, out=bits[:m].reshape(len(few), -1))
                np.bitwise_count(bits[:m], out=count[:m])
                i, j = np.divmod(_true(np.less_equal(count[:m], k, out=near[:m])), len(others))
                i, j = i + r, j + c
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    found.append((i, j))
                    n += len(i)
                if n >= 1 << 16:
                    yield batch()
                    found, n = [], 0
        if n:
            yield batch()

    return compare


def first_near(k: int) -> Compare:
    """(id, lead): of each left hash the least right id whose hash differs in k bits at most, if there is one."""

    def compare(ids_a, values_a, ids_b, values_b, same):
        ids, x = ids_a.to_numpy(zero_copy_only=False), _hashes(values_a)
        leads, y = ids_b.to_numpy(zero_copy_only=False), _hashes(values_b)
        order = np.argsort(leads, kind="stable")
        leads, y = leads[order], y[order]
        for r in range(0, len(x), COLS_AT_ONCE):
            few, left = x[r : r + COLS_AT_ONCE], ids[r : r + COLS_AT_ONCE]
            for c in range(0, len(y), LEADS_AT_ONCE):  # in order of id; who has found one looks no further
                i, j = np.divmod(_true((np.bitwise_count(few ^ y[c : c + LEADS_AT_ONCE, None]) <= k).ravel()), len(few))
                if len(j):
                    near, at = np.unique(j, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(left[near]), pa.array(leads[c + i[at]])], ["id", "lead"])
                    few, left = np.delete(few, near), np.delete(left, near)
                    if not len(few):
                        break

    return compare


class _Vectors:
    """Vectors of one block in order of their length, and their leading dimensions as a matrix."""

    def __init__(self, ids: pa.Array, values: pa.Array):
        sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(sizes, kind="stable")
        self.ids, self.sizes = ids.take(pa.array(order)), sizes[order]
        self.flat, self.at = values.flatten().to_numpy(zero_copy_only=False), (np.cumsum(sizes) - sizes)[order]
        self.head = np.zeros((len(sizes), min(FILTER_DIMS, int(self.sizes[-1]))))
        for d in range(self.head.shape[1]):
            has = int(np.searchsorted(self.sizes, d, "right"))
            self.head[has:, d] = self.flat[self.at[has:] + d]


def _distances(x: _Vectors, i: np.ndarray, y: _Vectors, j: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the pairs within the radius: squares are added dimension by dimension, as Spark and SQL add them."""
    size, total = np.minimum(x.sizes[i], y.sizes[j]), np.zeros(len(i))
    least, most, width = int(size.min()), int(size.max()), min(x.head.shape[1], y.head.shape[1])
    apart = np.take(x.head, i, axis=0)[:, :width] - np.take(y.head, j, axis=0)[:, :width]
    apart *= apart
    for d in range(min(most, width)):
        total += apart[:, d] if d < least else np.where(size > d, apart[:, d], 0.0)
    for d in range(width, most):
        if d % 16 == 0:  # a sum never falls
            open_ = ~(np.sqrt(total) > radius)
            i, j, size, total = i[open_], j[open_], size[open_], total[open_]
        on = np.flatnonzero(size > d)
        rest = x.flat[x.at[i[on]] + d] - y.flat[y.at[j[on]] + d]
        total[on] += rest * rest
    distance = np.sqrt(total)
    near = distance <= radius
    return i[near], j[near], distance[near]


def near_vectors(radius: float) -> Compare:
    """(p, q, distance) of vectors within the radius over their common prefix.

    |x|² + |y|² - 2xy over a common prefix, lowered by more than its rounding error, is a bound by which matrix products
    filter; what passes is measured by itself.
    """

    def compare(ids_a, values_a, ids_b, values_b, same):
        with np.errstate(all="ignore"):
            x = _Vectors(ids_a, values_a)
            y = x if same else _Vectors(ids_b, values_b)
            square = radius * radius
            top = float((x.head**2).sum(1).max() + (y.head**2).sum(1).max())
            slack = 4 * max(x.head.shape[1], y.head.shape[1]) + 16
            # Single precision where its error is small beside the radius and nothing overflows.
            kind = np.float32 if 1e-20 < square < 1e20 and slack * 2.0**-23 * top < 0.02 * square else np.float64
            keep = 1 - slack * float(np.finfo(kind).eps)
            limit = kind(square * (1 + 1e-6) + 1e-300)
            for c in range(0, len(y.sizes), COLS_AT_ONCE):
                many, dims, others = y.head[c : c + COLS_AT_ONCE], -1, None
                for r in range(0, min(len(x.sizes), c + COLS_AT_ONCE) if same else len(x.sizes), ROWS_AT_ONCE):
                    few = x.head[r : r + ROWS_AT_ONCE]
                    if (d := int(min(x.sizes[r], y.sizes[c], few.shape[1], many.shape[1]))) != dims:
                        dims, others = d, np.vstack([many[:, :d].T, np.ones(len(many)), keep * (many[:, :d] ** 2).sum(1)]).astype(kind)
                    bound = np.column_stack([-2 * few[:, :d], keep * (few[:, :d] ** 2).sum(1), np.ones(len(few))]).astype(kind) @ others
                    i, j = np.divmod(_true(~(bound > limit).ravel()), len(many))  # what is no number is measured
                    i, j = i + r, j + c
                    if same:
                        i, j = i[i < j], j[i < j]
                    for k in range(0, len(i), PAIRS_AT_ONCE):
                        left, right, distance = _distances(x, i[k : k + PAIRS_AT_ONCE], y, j[k : k + PAIRS_AT_ONCE], radius)
                        yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(left)), y.ids.take(pa.array(right)), pa.array(distance)], ["p", "q", "distance"])

    return compare
