"""Byte-level BPE by a global distinct-word shuffle, and decoding by the token-byte table.

Pre-tokens are coded with their positions, each distinct pre-token of the corpus is encoded once, in
the task that owns its part of the word space, its ids return to every place where it stands, and the
places are put together in order (see wordblocks). Decoding looks ids up in the table of token bytes,
whose size is the vocabulary's.

Defined results: a null or empty text has no ids; ids of documents may repeat or be null; no special
tokens; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeloom.llm import wordblocks
from lakeloom.llm.common import Workspace, documents


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@cache
def _token_bytes(path: str) -> list[bytes]:
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for b, i in ranks.items():
        table[i] = b
    return table


@cache
def _splitter(pattern: str):
    """Pre-tokens of a text, as tiktoken's own regular expressions would find them.

    Their tables of characters are older than those of the module `regex`, which splits here. Code points that the two
    put into different classes of the pattern are found once by asking tiktoken for all code points. A text that holds
    one is split by a stand-in of equal length, in which they are replaced by code points of the right classes.
    """
    import regex
    import tiktoken

    find = regex.compile(pattern)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    ours, theirs = np.zeros((2, 0x110000), np.int64)
    for k, name in enumerate(sorted(set(regex.findall(r"\\[pP]\{[^}]*\}|\\[sdw]", pattern)))):
        asked = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs[[ord(c) for c in bytes(asked.encode_ordinary(every)).decode()]] |= 1 << k
        ours[[ord(c) for c in regex.findall(name, every)]] |= 1 << k
    odd = np.flatnonzero(ours != theirs)
    if not len(odd):
        return find.findall
    agreed = np.flatnonzero((ours == theirs) & (np.arange(0x110000) >= 128) & (np.arange(0x110000) // 0x800 != 0x1B))  # no surrogates
    stands = {int(v): chr(agreed[ours[agreed] == v][0]) for v in np.unique(theirs[odd])}
    table = {int(c): stands[int(theirs[c])] for c in odd}
    edges = np.flatnonzero(np.diff(odd) != 1)
    ranges = zip(odd[np.concatenate([[0], edges + 1])].tolist(), odd[np.concatenate([edges, [len(odd) - 1]])].tolist())
    holds_odd = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]").search

    def split(text: str) -> list[str]:
        if not holds_odd(text):
            return find.findall(text)
        return [text[slice(*m.span())] for m in find.finditer(text.translate(table))]

    return split


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """Per row of docs: doc_id, ids (little-endian unsigned 32-bit integers).

    with_decoded adds what decode() makes of the ids, in the same Python worker: two workers a task
    would hold twice the memory.
    """
    ws = Workspace(docs.sparkSession, "bpe")
    coded, parts = wordblocks.code(documents(docs, id_col, text_col), ws, lambda text: _splitter(pattern)(text))

    def answer(blocks: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        piece, known = _encoding(ranks_path, pattern)._encode_single_piece, {}
        for batch, part, body in blocks:
            ids, sizes = [], []
            for w in wordblocks.unpack_words(body)[0]:
                if (got := known.get(w)) is None:
                    got = known[w] = piece(w)  # each distinct word of the corpus once
                ids += got
                sizes.append(len(got))
            yield batch, part, wordblocks.pack(np.array(sizes, np.uint32), np.array(ids, np.uint32))

    def finish(doc: list, bodies: list[bytes]) -> pa.Table:
        _, _, _, sizes, codes = doc
        parts_ = [wordblocks.unpack(b) for b in bodies]
        counts = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(p[0], np.uint32) for p in parts_)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(p[1], np.uint32) for p in parts_)])
        starts = np.cumsum(counts) - counts
        doc_ends = np.cumsum(sizes, dtype=np.int64)
        lists, at = [], 0
        for end in doc_ends.tolist():
            c = codes[at:end]
            n = counts[c]
            total = int(n.sum())
            shift = np.repeat(starts[c] - (np.cumsum(n) - n), n)
            lists.append(flat[shift + np.arange(total)].tobytes())
            at = end
        cols = [wordblocks.id_column(doc), pa.array(lists, pa.binary())]
        if with_decoded:
            cols.append(pa.array(_decoded(lists, ranks_path), pa.binary()))
        return pa.table(cols, names=["doc_id", "ids", "decoded"][: len(cols)])

    schema = "doc_id long, ids binary" + ", decoded binary" * with_decoded
    return wordblocks.reassemble(coded, wordblocks.resolve(coded, parts, answer), finish, schema)


def _decoded(lists: list[bytes], ranks_path: str) -> list[bytes]:
    look = _token_bytes(ranks_path).__getitem__
    return [b"".join(map(look, np.frombuffer(x, np.uint32).tolist())) for x in lists]


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids) with the bytes of the ids in order, as `decoded`; an id outside the table is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids = rb.column(1)
            out = _decoded([x.as_py() or b"" for x in ids], ranks_path)
            yield pa.RecordBatch.from_arrays([rb.column(0), ids, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
