"""Product codes of vectors; segment-mean lower bounds spare most distances.

Components become integers, floor(scale * x), and a vector is cut into equal parts. Each part position has a codebook,
which starts with the parts of the first vectors and is replaced by the means of its parts in a fixed number of rounds.
A round is one pass over the integer vectors: each task codes its batches and adds up their parts by entry; Spark adds
up the tasks' sums, and only the codebooks (entries x dimensions numbers) come to the driver and go out again.

The nearest entry is found coarse to fine. With a part cut into segments, the squared distance to an entry is at least
the sum of the segments' lengths times the squared differences of their means, plus the squared difference of the norms
of what is left over (both residuals are orthogonal to the means). The entry that seems nearest by one segment is
measured first; entries whose bound is beyond that distance are out, then by 2, 4, ... segments. Bounds are floating
numbers and are lowered by more than their rounding error, so none is out wrongly. What is left gets its exact integer
distance; ties go to the lower index.

Defined results: a vector that is null or empty, holds null or non-finite components, isn't of `parts` equal parts, or
has another length than the kept vector of least id, is dropped. Null ids come last; vectors of one id come in the
order of their stored bytes. With fewer vectors than entries the codebooks have as many entries as there are
vectors; an empty table gives an empty result. Integers of any size are exact (beyond LIMIT by Python's integers, slowly);
an error beyond a long is the greatest long. Repeated rows count each. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Workspace, join_hot
from lakeloom.llm.wordblocks import trim

#: Fixed values of the contract.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers below this are kept in 32 bits and their distances in 64: (2 * LIMIT) ** 2 times 2 ** 13 components fits.
LIMIT = 1 << 24
GREATEST = (1 << 63) - 1
#: Sums of parts travel in limbs of so many bits, so that no number of tasks overflows a long.
LIMB = 32
#: Share of both norms, and amount, by which a bound is lowered: a residual norm is a root of a difference, so its error
#: is up to the root of a double's rounding error.
SLACK, LEAST_SLACK = 1e-6, 1.0


def levels(size: int) -> list[np.ndarray]:
    """Starts of 1, 2, 4, ... segments of a part, short of single components."""
    out, n = [], 1
    while n < max(2, size):
        out.append(np.linspace(0, size, n, endpoint=False).astype(np.int64))
        n *= 2
    return out


def _summaries(x: np.ndarray, norm: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of segments times the root of their length, and the norm of what is left over."""
    root = np.sqrt(np.diff(np.append(starts, x.shape[1])))
    mean = np.add.reduceat(x, starts, axis=1) / root
    return mean, np.sqrt(np.maximum(norm - (mean * mean).sum(1), 0))


def _measure(x: np.ndarray, book: np.ndarray, rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of the named rows to the named entries."""
    away = x[rows] - book[entry]
    return (away * away).sum(1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry, the lower index of ties; and how many distances were measured.

    Both are integers: int64, or objects where numbers are too large for that.
    """
    n, k = len(x), len(book)
    every = np.arange(n)
    if x.dtype == object:  # beyond what floating bounds can hold: all are measured
        dist = np.stack([_measure(x, book, every, np.full(n, e)) for e in range(k)], 1)
        code = np.array([min(range(k), key=d.__getitem__) for d in dist.tolist()])
        return code, dist[every, code], n * k
    xf, bf = x.astype(np.float64), book.astype(np.float64)
    xn, bn = (xf * xf).sum(1), (bf * bf).sum(1)
    noise = SLACK * (xn[:, None] + bn[None, :]) + LEAST_SLACK  # bounds are differences of numbers of this size
    rows = entry = guess = best = None
    for starts in levels(x.shape[1]):
        (xm, xr), (bm, br) = _summaries(xf, xn, starts), _summaries(bf, bn, starts)
        if rows is None:
            bound = ((xm[:, None, :] - bm[None, :, :]) ** 2).sum(2) + (xr[:, None] - br[None, :]) ** 2
            guess = bound.argmin(1)
            best = _measure(x, book, every, guess)
            limit = best.astype(np.float64)
            rows, entry = np.nonzero(bound - noise <= limit[:, None])
        else:
            bound = ((xm[rows] - bm[entry]) ** 2).sum(1) + (xr[rows] - br[entry]) ** 2
            stay = bound - noise[rows, entry] <= limit[rows]
            rows, entry = rows[stay], entry[stay]
    fresh = entry != guess[rows]
    rows, entry = rows[fresh], entry[fresh]
    away = _measure(x, book, rows, entry)
    code, dist = guess.copy(), best.copy()
    for e in range(k):  # ascending, so a tie is won by the lower index
        at = rows[entry == e]
        if len(at):
            d = away[entry == e]
            better = (d < dist[at]) | ((d == dist[at]) & (e < code[at]))
            code[at[better]], dist[at[better]] = e, d[better]
    return code, dist, n + len(rows)


def _exact(x: float, scale: int) -> int:
    """floor(scale * x) of any finite x."""
    top, bottom = x.as_integer_ratio()
    return scale * top // bottom


def _prepare(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, size, wide, body of vectors without null or non-finite components.

    body holds the integer components as int32, or, if wide, in decimal with commas.
    """
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rb = rb.filter(rb.column(2).is_valid())
            lists = rb.column(2)
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            among = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[edges]) > 0  # noqa: B023, E731
            bad = ~np.isfinite(values)  # a null is NaN here
            large = ~bad & (np.abs(np.where(bad, 0, values)) >= LIMIT / scale - 1)
            keep, wide = (sizes > 0) & ~among(bad), among(large)
            whole = np.floor(np.where(bad | large, 0, values) * scale).astype("<i4")
            body = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * edges).astype("<i4")), pa.py_buffer(whole)])
            if wide.any():
                exact = lambda i: ",".join(str(_exact(v, scale)) for v in values[edges[i] : edges[i + 1]].tolist()).encode()  # noqa: B023, E731
                body = pa.array([exact(i) if k and w else b.as_py() for i, (k, w, b) in enumerate(zip(keep, wide, body))], pa.binary())
            out = [rb.column(0), rb.column(1), pa.array(sizes.astype(np.int32)), pa.array(wide), body]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "label", "size", "wide", "body"]).filter(pa.array(keep))
        trim()

    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id long, label {label}, size int, wide boolean, body binary")


def _decode(body: bytes, wide: bool) -> list[int]:
    return list(map(int, body.split(b","))) if wide else np.frombuffer(body, "<i4").tolist()


def _matrix(rb: pa.RecordBatch, size: int, books: np.ndarray) -> np.ndarray:
    """Rows' components as int64, or as Python integers where the batch or the codebooks hold large ones."""
    wide, body = rb.column(rb.schema.get_field_index("wide")).to_pylist(), rb.column(rb.schema.get_field_index("body")).to_pylist()
    if books.dtype == object or any(wide):
        return np.array([_decode(b, w) for b, w in zip(body, wide)], object).reshape(len(body), size)
    return np.frombuffer(b"".join(body), "<i4").reshape(len(body), size).astype(np.int64)


def _books(rows: list[list[list[int]]]) -> np.ndarray:
    """Codebooks as (part, entry, component): int64 if all are small, else objects."""
    out = np.array(rows, object)
    return out if out.size and abs(out).max() >= LIMIT else out.astype(np.int64)


def _code(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Part by part: the rows' parts, their codes and their distances."""
    width = books.shape[2]
    for p, book in enumerate(books):
        part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
        code, dist, _ = nearest(part, book if part.dtype != object else book.astype(object))
        yield part, code, dist


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, k = -1 if value < 0 else 1, abs(value), 0
    while value:
        if low := value & ((1 << LIMB) - 1):
            yield k, sign * low
        value, k = value >> LIMB, k + 1


def _sums(ready: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Number and componentwise sums of the parts of each (part, entry) that is in use."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for rb in batches:
            if rb.num_rows:
                for p, (part, code, _) in enumerate(_code(_matrix(rb, parts * width, books), books)):
                    for e in np.unique(code).tolist():
                        mine = part[code == e]
                        total[p, e] += mine.sum(0).astype(object)
                        count[p, e] += len(mine)
        rows = [(p, e, -1, 0, int(count[p, e])) for p, e in zip(*np.nonzero(count))]
        rows += [(p, e, i, k, v) for p, e, *_ in list(rows) for i in range(width) for k, v in _limbs(int(total[p, e, i]))]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.int64())], names=["part", "entry", "component", "limb", "n"])
        trim()

    keys = ["part", "entry", "component", "limb"]
    found = ready.select("wide", "body").mapInArrow(run, "part int, entry int, component int, limb int, n long").groupBy(*keys).agg(F.sum("n").alias("n")).collect()
    out: dict = {}
    for r in sorted(map(tuple, found)):
        p, e, i, k, n = r
        if i < 0:
            out[p, e] = (n, [0] * width)
        else:
            out[p, e][1][i] += n << (LIMB * k)
    return out


def train(ready: DataFrame, size: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """The codebooks after all rounds; as many rows as entries come to the driver, and the sums of one codebook a round."""
    ordered = ready.orderBy(F.col("vec_id").asc_nulls_last(), "wide", "body").limit(entries).select("wide", "body")
    first = [_decode(r["body"], r["wide"]) for r in ordered.collect()]
    if not first:
        return np.zeros((parts, 0, size // parts), np.int64)
    width = size // parts
    books = _books([[v[p * width : (p + 1) * width] for v in first] for p in range(parts)])
    for _ in range(rounds):
        new = books.astype(object)
        for (p, e), (n, total) in _sums(ready, books).items():
            new[p, e] = [t // n for t in total]
        books = _books(new.tolist())
    return books


def encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code binary (a byte a part), error, label_error of the kept vectors; the codebooks)."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index must fit a byte")
    spark = vectors.sparkSession
    ws = Workspace(spark, "vector_codes")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    ready = ws.put(_prepare(rows, scale).where((F.col("size") % parts) == 0), "ready")
    least = ready.orderBy(F.col("vec_id").asc_nulls_last(), "size").select("size").first()
    size = least["size"] if least else parts
    ready = ready.where(F.col("size") == size)
    books = train(ready, size, parts, entries, rounds)
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                found = list(_code(_matrix(rb, size, books), books))
                codes = np.stack([c for _, c, _ in found], 1).astype(np.uint8)
                error = sum(d.astype(object) for _, _, d in found)
                out = [rb.column(0), rb.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([min(int(e), GREATEST) for e in error], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["vec_id", "label", "code", "error"])
        trim()

    coded = ws.put(ready.select("vec_id", "label", "wide", "body").mapInArrow(run, f"vec_id long, label {label}, code binary, error long"), "coded")
    ws.drop("ready")
    # Nulls are a label of their own.
    coded = coded.withColumn("no_label", F.col("label").isNull()).withColumn("label_text", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = coded.groupBy("no_label", "label_text").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n_label"))
    sums = sums.select("no_label", "label_text", F.least("total", F.lit(str(GREATEST)).cast("decimal(38,0)")).cast("long").alias("label_error"), "n_label")
    out = join_hot(coded, sums, ["no_label", "label_text"], "n_label", coded.count())
    return out.select("vec_id", "label", "code", "error", "label_error"), books


def books_sha256(books: np.ndarray) -> str:
    """Of all components in decimal, by part, entry and place, with commas between them."""
    return hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()
