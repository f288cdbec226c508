"""Packing of token sequences into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows and a rest. Best fit asks for an item's
length alone, so windows with equal room are interchangeable and a whole class of items of one length
is placed at once: a segment tree indexed by remaining capacity finds the tightest open windows. The
plan is made on the driver from the histogram of lengths (at most `window` rows) and its size depends
on the window, not on the number of documents; it equals what best fit would do piece by piece. Each
piece then finds its place from its rank among the pieces of its length.

Defined results: a null or empty text is one piece that holds only the end id; an empty table gives an
empty result; repeated rows are packed as often as they stand there; ids of documents may be null;
other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Workspace, documents, partitions
from lakeloom.llm.wordblocks import trim

WINDOW = 4096
END_ID = 2
#: Bytes of words and their ids that a worker keeps, in two generations: what was not met in one goes with it. Pieces of words
#: that are kept besides; texts encoded at once have so many bytes.
CACHED_BYTES, CACHED_PIECES, ENCODED_BYTES = 128 << 20, 1 << 17, 2 << 20


class CapacityTree:
    """Which remaining capacities have open windows; finds the least one that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, at: int, value: bool) -> None:
        i = at + self.size
        self.open[i] = int(value)
        while i := i >> 1:
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.open[2 * i])
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, items a window, first window, offset) in order of length and rank.

    Items of `length` from the first rank on, up to the next move's, fill windows one after another
    from the first window on, `items a window` into each, beginning at the offset.
    """
    tree, rooms, windows, moves = CapacityTree(window), [deque() for _ in range(window + 1)], 0, []

    def put(room: int, first: int, n: int) -> None:
        if n:
            rooms[room].append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = window, window // length
                first, n = windows, -(-left // each)
                windows += n
            else:
                each = room // length
                first, n = rooms[room].popleft()
                if (need := -(-left // each)) < n:
                    rooms[room].appendleft((first + need, n - need))
                    n = need
                if not rooms[room]:
                    tree.set(room, False)
            moves.append((length, rank, each, first, window - room))
            full = min(n, left // each)
            put(room - each * length, first, full)
            if full < n:
                put(room - (left - full * each) * length, first + full, 1)
            placed = min(left, n * each)
            left, rank = left - placed, rank + placed
    return sorted(moves)


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Words of these characters need no normalisation but lower case, and no table of character classes.
_PLAIN = re.compile("[!-~\xa1-\xac\xae-\xff]*")


@cache
def _fast_words(path: str):
    """Encodes one plain word as the tokenizer would, at the cost of a table look-up and a few merges.

    The file's merges are given to a byte-pair encoder in C as ranks: a byte stands for itself, and a
    marker byte for the end of a word, which joins the byte before it ahead of all other merges. None
    if the file is of another kind.
    """
    import json

    import regex
    import tiktoken

    with open(path) as f:
        spec = json.load(f)
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    suffix = model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in steps] != ["Split", "ByteLevel"]:
        return None
    # The usual map of bytes to visible characters: printable ones stay, the rest follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    byte = {c: b for b, c in char.items()}
    marker = 255  # no byte of UTF-8
    as_bytes = lambda t: bytes(byte[c] for c in t.removesuffix(suffix)) + (bytes([marker]) if t.endswith(suffix) else b"")
    ranks = {bytes([b]): b for b in range(256)}
    ids = [model["vocab"].get(char[b], -1) for b in range(256)]
    for b in range(255):
        ranks[bytes([b, marker])] = len(ids)
        ids.append(model["vocab"].get(char[b] + suffix, -1))
    for m in model["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        ranks[as_bytes(left + right)] = len(ids)
        ids.append(model["vocab"][left + right])
    piece = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    plain = _PLAIN.fullmatch
    split = regex.compile(steps[0]["pattern"]["Regex"]).findall
    special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)").search
    as_id = [i.to_bytes(4, "little") if i >= 0 else b"" for i in ids].__getitem__

    @lru_cache(CACHED_PIECES)
    def one(x: str) -> bytes:
        return b"".join([as_id(i) for i in piece(x.encode() + b"\xff")])

    def encode(word: str) -> bytes | None:
        if not plain(word):
            return None
        if word.isalpha():  # letters are one piece, and so is a mark behind them
            return one(word.lower())
        if word[:-1].isalpha() and not word[-1].isalnum():
            return one(word[:-1].lower()) + one(word[-1])
        if special(word):
            return None
        return b"".join(map(one, split(word.lower())))

    return encode


@cache
def _encoder(path: str, end_id: int):
    """Texts to ids. No token spans white space, so words are encoded apart, each new one once."""
    known: dict[bytes, bytes] = {}
    before: dict[bytes, bytes] = {}
    held = 0

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal known, before, held
        fast = _fast_words(path)
        if held > CACHED_BYTES // 2:
            known, before, held = {}, known, 0
        out, end, slow = [], np.array([end_id], "<u4").tobytes(), []
        split = [t.encode().split() for t in texts]  # parts at the bytes 09-0D and 20
        new = {w for words in split for w in words if w not in known}
        for w in new:
            if (ids := before.get(w)) is not None:
                known[w] = ids
            elif fast is None or (ids := fast(w.decode())) is None:
                slow.append(w)
            else:
                known[w] = ids
        for w, e in zip(slow, _tokenizer(path).encode_batch_fast([w.decode() for w in slow], add_special_tokens=False) if slow else ()):
            known[w] = np.array(e.ids, "<u4").tobytes()
        held += sum(len(w) + len(known[w]) + 200 for w in new)  # with what two objects and their entry take
        for words in split:
            out.append(b"".join(map(known.__getitem__, words)) + end)
        return out

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenizes docs and cuts them: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path, end_id)
        for rb in batches:
            ids, texts = rb.column(0).to_pylist(), rb.column(1)
            at = 0
            while at < len(ids):
                some, size = [], 0
                while at + len(some) < len(ids) and (not some or size < ENCODED_BYTES):
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1])
                rows, kept = [], []
                for doc_id, raw in zip(ids[at:], encode(some)):
                    n = len(raw) // 4
                    for start in range(0, n, window):
                        part = raw[4 * start : 4 * (start + window)]
                        rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
                        if with_ids:
                            kept.append(part)
                at += len(some)
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * with_ids, names=names)
        trim()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    cut = pieces(documents(docs, id_col, text_col), tokenizer_path, window, end_id, with_ids)
    order = [F.col("length"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    cut = ws.put(cut, "cut")  # dealing by ranges reads its input twice
    ranked = cut.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranked = ws.put(ranked, "pieces")
    ws.drop("cut")

    # Ranges hold few lengths each, so this has about as many rows as there are lengths and ranges.
    runs = ranked.groupBy(F.shiftright("at", 33).alias("task"), "length").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    runs = sorted((r["length"], r["task"], r["first"], r["n"]) for r in runs)
    histogram: dict[int, int] = {}
    base = []
    for length, task, first, n in runs:
        base.append(histogram.get(length, 0) - first)
        histogram[length] = histogram.get(length, 0) + n
    moves = np.array(plan(histogram, window), np.int64).reshape(-1, 5)
    run_key = np.array([(length << 33) + task for length, task, _, _ in runs], np.int64)
    run_base = np.array(base, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move_key = (moves[:, 0] << 40) + moves[:, 1]
        for rb in batches:
            at, length = (rb.column(rb.schema.get_field_index(c)).to_numpy() for c in ("at", "length"))
            rank = at + run_base[np.searchsorted(run_key, (length << 33) + (at >> 33))]
            m = moves[np.searchsorted(move_key, (length << 40) + rank, side="right") - 1]
            j = rank - m[:, 1]
            cols = [c for c, n in zip(rb.columns, rb.schema.names) if n != "at"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(m[:, 3] + j // m[:, 2]), pa.array(m[:, 4] + j % m[:, 2] * length)], names=[n for n in rb.schema.names if n != "at"] + ["sequence_id", "offset"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "at"]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))
