"""Distinct words of a whole corpus, looked up by shuffle and brought back to where they stand.

Exploding every word with its position would shuffle far more than the text. Here a task codes the
texts it reads against a dictionary of its own batch (about `batch_bytes` characters of text) and emits

* one payload row a batch: the ids of its documents and their words as codes, in order of position;
* one block row for each part of the word space: the batch's distinct words that fall into the part.

Blocks are shuffled by part, so each task resolves all occurrences of its words (`resolve`), and the
answers return to their batch (`reassemble`). Payloads are written bucketed by batch, so they are
shuffled at no time. Nothing depends on the order in which rows are read again: batches are written
once. A word that a third of all documents hold costs one entry a batch, not one a document.
"""

from __future__ import annotations

import ctypes
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Workspace, partitions

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  other C libraries lack it
except (OSError, AttributeError):
    _LIBC = None

BATCH_BYTES = 8 << 20
SCHEMA = "batch long, part int, body binary, kind string"
ANSWER = "batch long, part int, body binary"


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays to one compressed body."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<I{len(raw)}Q", len(raw), *map(len, raw)) + b"".join(raw))


def unpack(body: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(body))
    (n,) = struct.unpack_from("<I", raw)
    sizes, at, out = struct.unpack_from(f"<{n}Q", raw, 4), 4 + 8 * n, []
    for size in sizes:
        out.append(raw[at : at + size])
        at += size
    return out


def pack_words(words: list[bytes], *more: np.ndarray) -> bytes:
    return pack(np.fromiter(map(len, words), np.uint32, len(words)), b"".join(words), *more)


def unpack_words(body: bytes) -> tuple[list[bytes], list[memoryview]]:
    sizes, text, *more = unpack(body)
    ends = np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64).tolist()
    text = bytes(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)], more


def numbering() -> defaultdict:
    """A dictionary that numbers its keys from 0 on, in the order in which they are first looked up."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


class _Batch:
    def __init__(self) -> None:
        self.codes: defaultdict = numbering()
        self.ids: list = []
        self.flags: list[int] = []
        self.sizes: list[int] = []
        self.words: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id, flag: int, tokens: list, size: int) -> None:
        self.words.append(np.fromiter(map(self.codes.__getitem__, tokens), np.uint32, len(tokens)))
        self.ids.append(doc_id)
        self.flags.append(flag)
        self.sizes.append(len(tokens))
        self.bytes += size

    def rows(self, batch: int, parts: int, counted: bool) -> Iterator[tuple]:
        words = list(self.codes)
        if words and isinstance(words[0], str):
            words = [w.encode() for w in words]
        part = (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        renumber = np.empty(len(words), np.uint32)
        renumber[order] = np.arange(len(words), dtype=np.uint32)
        codes = renumber[np.concatenate(self.words)] if words else np.zeros(0, np.uint32)
        flags = np.array(self.flags, np.uint8)
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        yield batch, -1, pack(ids, known, flags, np.array(self.sizes, np.uint32), codes), "payload"
        more = []
        if counted:  # occurrences in the documents that carry the flag
            more = [np.bincount(codes[np.repeat(flags, self.sizes) == 1], minlength=len(words)).astype(np.uint32)]
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(edges[p], edges[p + 1])
            yield batch, p, pack_words([words[i] for i in order[at]], *(m[at] for m in more)), "words"


def trim() -> None:
    """Gives freed memory back: workers live on from task to task beside others of their executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _table(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def code(docs: DataFrame, ws: Workspace, split: Callable, counted: bool = False, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """Codes (doc_id, text[, flag]) by `split(text) -> tokens`; the table of rows and the number of parts.

    With counted, blocks also hold how often each word stands in the batch's documents of flag 1.
    """
    parts = partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, now = TaskContext.get().partitionId() << 24, 0, _Batch()

        def out() -> pa.RecordBatch:
            return _table(list(now.rows(base + seq, parts, counted)), ["batch", "part", "body", "kind"], [pa.int64(), pa.int32(), pa.binary(), pa.string()])

        for rb in batches:
            ids, flags = rb.column(0).to_pylist(), rb.column(2).to_pylist() if counted else None
            for i, text in enumerate(rb.column(1)):
                text = text.as_py()
                now.add(ids[i], flags[i] if counted else 0, split(text), len(text))
                if now.bytes >= batch_bytes:
                    yield out()
                    seq, now = seq + 1, _Batch()
        if now.ids:
            yield out()
        del now
        trim()

    cols = ["doc_id", "text", *(["flag"] if counted else [])]
    return ws.bucketed(docs.select(*cols).mapInArrow(run, SCHEMA), "coded", "batch", parts), parts


def resolve(coded: DataFrame, parts: int, answer: Callable[[list[tuple[int, int, bytes]]], Iterator[tuple]], schema: str = ANSWER) -> DataFrame:
    """All blocks of a part meet in one task; answer() maps [(batch, part, body)] to rows of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(b, p, w) for rb in batches for b, p, w in zip(*(c.to_pylist() for c in rb.columns))]
        rows: list[tuple] = []
        held = 0
        for row in answer(blocks):
            rows.append(row)
            held += sum(len(x) for x in row if isinstance(x, bytes)) + 64
            if held > 8 << 20:
                yield _table(rows, names, kinds)
                rows, held = [], 0
        if rows:
            yield _table(rows, names, kinds)
        del blocks
        trim()

    fields = [f.strip().split(" ") for f in schema.split(",")]
    names, kinds = [n for n, _ in fields], [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t] for _, t in fields]
    blocks = coded.where(F.col("kind") == "words").select("batch", "part", "body")
    return blocks.repartitionById(parts, F.col("part")).mapInArrow(run, schema)


def reassemble(coded: DataFrame, answers: DataFrame, finish: Callable[[list, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """finish([ids, known, flags, sizes, codes], bodies in order of part) makes the rows of one batch."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("answer_part").to_numpy(), kind="stable")
        bodies = right.column("answer").to_pylist()
        ids, known, flags, sizes, codes = unpack(left.column("body")[0].as_py())
        doc = [np.frombuffer(ids, np.int64), np.frombuffer(known, np.uint8), np.frombuffer(flags, np.uint8), np.frombuffer(sizes, np.uint32), np.frombuffer(codes, np.uint32)]
        out = finish(doc, [bodies[i] for i in order.tolist()])
        trim()
        return out

    payload = coded.where(F.col("kind") == "payload").select("batch", "body")
    # New names: both sides may stem from one table, and a cogroup must not confuse their columns.
    renamed = answers.select(F.col("batch").alias("answer_batch"), F.col("part").alias("answer_part"), F.col("body").alias("answer"))
    return payload.groupby("batch").cogroup(renamed.groupby("answer_batch")).applyInArrow(run, schema)


def id_column(doc: list) -> pa.Array:
    return pa.array(doc[0], pa.int64(), mask=doc[1] == 0)
