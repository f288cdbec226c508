"""Suffix-array deduplication of passages: bytes covered by a string of `length` that starts earlier go.

Suffixes are sampled where two equal strings agree on the sample: each window of `length` bytes has one
anchor, its least 24-byte gram by hash (the leftmost of equals), so equal windows have their anchors at
the same offset and it is enough to sort what stands around anchors. Sorting is deep-shallow:

* shallow: a multikey quicksort orders the suffixes at anchors by their first 24 bytes, three
  characters of 8 bytes each; a suffix alone in its group has no partner and is done;
* deep: the windows of a group that have their anchor at one offset share those bytes and mostly many
  more, and go into blind tries. Members stand in order of document, so a trie's first leaf is the
  earliest occurrence; each member is compared with that leaf only, is a repetition if nothing differs
  within the window, and else descends to the branch of its first differing byte. A branch is a trie of
  its own, until every member is placed.

Anchors whose gram stands once in the corpus are found by a shuffle of hashes alone. Texts are written
once, bucketed by batch, and never shuffled. What repeats inside a batch is settled there, so only a
batch's first occurrences travel: a passage that a third of all documents hold is one entry a batch.
A gram that stands very often, as in a common line with different text around it, would bring all its
places into one task. Its windows go out one by one, dealt by a fingerprint of their bytes, so that equal ones
meet; there they are sorted and compared as all others are.

Defined results: matches never cross documents; rows count as different documents, in order of doc_id
(null ids last), rows of one id in an order that is fixed once; a null or empty text has no bytes and is
returned; texts shorter than a window keep all bytes; an empty table gives an empty result; other
columns are read only where `carry` names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Workspace, documents, partitions
from lakeloom.llm.wordblocks import _table, pack, trim, unpack

LENGTH, GRAM = 100, 24
BATCH_BYTES = 8 << 20
#: Window starts that are hashed at once, and windows that are sorted at once.
BLOCK, SORTED_WINDOWS = 1 << 18, 1 << 18
#: An anchor that stands so often, and makes up one part in HOT_PART of what its task receives, is hot: its windows
#: are dealt by their fingerprints and not by the anchor.
HOT_LEAST, HOT_PART = 256, 4
_POSITION = np.uint64((1 << 30) - 1)
_ROWS = "batch long, part int, body binary, kind string"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return x ^ (x >> np.uint64(29))


def words8(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, first byte lowest; 7 positions fewer."""
    x = b.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    return x[:-4] | (x[4:] << np.uint64(32))


def anchor_runs(text: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one anchor: first window, number of windows, anchor, hash of its gram.

    text holds documents one after another, which end at `ends`, and 8 bytes more.
    """
    if len(text) > int(_POSITION):
        raise ValueError("a batch of documents must be shorter than 2 ** 30 bytes")
    width = length - GRAM + 1
    found: list[tuple] = []
    for x in range(0, max(0, len(text) - 8 - length + 1), BLOCK):
        part = text[x : x + BLOCK + length + 7]
        w = words8(part)
        with np.errstate(over="ignore"):
            h = _mix(w[: len(w) - 16] * _M2 + np.uint64(1))
            h = _mix((h + w[8 : len(w) - 8]) * _M1)
            h = _mix((h + w[16:]) * _M2)[: len(part) - 8 - GRAM + 1]
        low = (h & ~_POSITION) | np.arange(x, x + len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        starts = np.arange(x, x + len(low))
        doc = np.searchsorted(ends, starts, side="right")
        ok = starts + length <= ends[np.minimum(doc, len(ends) - 1)]
        starts, doc, anchor = starts[ok], doc[ok], (low[ok] & _POSITION).astype(np.int64)
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        found.append((starts[at], np.diff(np.concatenate([at, [len(starts)]])), anchor[at], h[anchor[at] - x]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def multikey_quicksort(characters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the characters, first to last, and group of each place; only what ties is sorted further."""
    order = np.argsort(characters[0], kind="quicksort")
    group = np.concatenate([[0], np.cumsum(np.diff(characters[0][order].view(np.int64)) != 0)]) if len(order) else np.zeros(0, np.int64)
    for c in characters[1:]:
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        sub = np.lexsort((c[order[tied]], group[tied]))
        order[tied] = order[tied][sub]
        value = c[order]
        new = np.zeros(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(new)
    return order, group


def _common(w: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the strings at a and b have in common from their start, up to length."""
    out = np.full(len(a), length, np.int64)
    live = np.arange(len(a))
    for d in range(0, length, 8):
        x = w[a[live] + d] ^ w[b[live] + d]
        differs = x != 0
        if differs.any():
            v = x[differs]
            low = v & (~v + np.uint64(1))
            byte = np.log2(low.astype(np.float64)).astype(np.int64) >> 3
            out[live[differs]] = np.minimum(length, d + byte)
            live = live[~differs]
            if not len(live):
                break
    return out


def blind_tries(w: np.ndarray, starts: np.ndarray, trie: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings at `starts` repeat an earlier one of their trie; members of a trie stand together, in order."""
    repeats = np.zeros(len(starts), bool)
    live = np.arange(len(starts))
    while len(live):
        first = np.flatnonzero(np.concatenate([[True], trie[1:] != trie[:-1]]))
        size = np.diff(np.concatenate([first, [len(live)]]))
        leaf = np.repeat(live[first], size)
        member = np.ones(len(live), bool)
        member[first] = False
        live, leaf, trie = live[member], leaf[member], trie[member]
        lcp = _common(w, starts[live], starts[leaf], length)
        same = lcp >= length
        repeats[live[same]] = True
        live, trie, lcp = live[~same], trie[~same], lcp[~same]
        if not len(live):
            break
        branch = (lcp << 8) | (w[starts[live] + lcp] & np.uint64(255)).astype(np.int64)
        order = np.lexsort((live, branch, trie))
        live, trie, branch = live[order], trie[order], branch[order]
        trie = np.cumsum(np.concatenate([[0], (trie[1:] != trie[:-1]) | (branch[1:] != branch[:-1])]))
        alone = np.bincount(trie)[trie] == 1
        live, trie = live[~alone], trie[~alone]
    return repeats


def repeated_windows(text: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(run, window of the run) of windows that also stand in a run of lower rank, or earlier in their own run.

    Run i has `count[i]` windows from text position `first[i]` on and its anchor at `anchor[i]`.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if len(first) < 2:
        return out
    w = words8(text)
    order, group = multikey_quicksort([w[anchor + d].byteswap() for d in (0, 8, 16)])  # first byte highest: the order of suffixes
    several = np.bincount(group)[group] > 1
    order, group = order[several], group[several]
    if not len(order):
        return out
    windows = np.cumsum(count[order])
    last = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]]))
    at = 0
    while at < len(order):  # whole groups, about SORTED_WINDOWS windows at once
        base = windows[at - 1] if at else 0
        k = int(np.searchsorted(windows[last], base + SORTED_WINDOWS, side="right"))
        k = max(k, int(np.searchsorted(last, at)) + 1)
        end = int(last[min(k, len(last)) - 1]) + 1
        runs, g = order[at:end], group[at:end]
        n = count[runs]
        run = np.repeat(runs, n)
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = first[run] + which
        trie = (np.repeat(g, n) << 7) | (anchor[run] - start)
        by = np.lexsort((which, rank[run], trie))
        hit = by[blind_tries(w, start[by], trie[by], length)]
        out.append((run[hit], which[hit]))
        at = end
    return out


def fingerprints(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A 64-bit mix of each of the strings that begin at `starts`, to deal them by. text has 8 bytes more."""
    out = np.full(len(starts), _M1)
    w = words8(text)
    with np.errstate(over="ignore"):
        for d in [*range(0, length - 8, 8), length - 8]:  # whole words; the last may overlap the one before
            out = _mix((out ^ w[starts + d]) * _M2 + np.uint64(d + 1))
    return out


def _by_part(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by part, in which of their places each hash's is, how often they stand, and the parts' edges."""
    unique, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    part = (unique % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return unique[order], place[inverse], n[order], np.searchsorted(part[order], np.arange(parts + 1))


def _intervals(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted window starts to first starts and lengths of runs of consecutive ones."""
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    starts = np.unique(starts)
    at = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    return starts[at].astype(np.uint32), np.diff(np.concatenate([at, [len(starts)]])).astype(np.uint32)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return _table(rows, ["batch", "part", "body", "kind"], [pa.int64(), pa.int32(), pa.binary(), pa.string()])


def _read(body: bytes) -> tuple:
    ids, known, sizes, text = unpack(body)[:4]
    raw = np.concatenate([np.frombuffer(text, np.uint8), np.zeros(8, np.uint8)])
    sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
    return np.frombuffer(ids, np.int64), np.frombuffer(known, np.uint8), sizes, raw, np.cumsum(sizes)


def deduplicate(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay), starts and ends of removed runs.

    The columns that carry names travel with their row, so that rows of one id need no join; they stand in the struct `carried`.
    With as_text, `kept` is a string: of a character that a cut has split, the bytes that stay go too, and nothing else.
    """
    if not GRAM <= length <= GRAM + 127:
        raise ValueError(f"length must be from {GRAM} to {GRAM + 127}")
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix_dedup")
    parts = partitions(spark)

    # 1. Batches of whole documents, and the hashes of their anchors by part of the hash space.
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 24, 0
        ids, texts, extra, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, texts), np.uint32, len(texts))
            body = pack(np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], np.uint8), sizes, b"".join(texts), np.fromiter(map(len, extra), np.uint32, len(extra)), b"".join(extra))
            raw = np.concatenate([np.frombuffer(b"".join(texts), np.uint8), np.zeros(8, np.uint8)])
            _, _, _, h = anchor_runs(raw, np.cumsum(sizes, dtype=np.int64), length)
            unique, _, n, edges = _by_part(h, parts)
            rows = [(base + seq, -1, body, "payload")]
            for p in np.flatnonzero(np.diff(edges)).tolist():
                at = slice(edges[p], edges[p + 1])
                rows.append((base + seq, p, unique[at].tobytes() + n[at].astype(np.uint32).tobytes(), "anchors"))
            return _emit(rows)

        for rb in batches:
            for doc_id, text, more in zip(rb.column(0).to_pylist(), rb.column(1), rb.column(2)):
                b = text.as_py().encode()
                ids.append(doc_id)
                texts.append(b)
                extra.append(more.as_py().encode())
                size += len(b) + len(extra[-1])
                if size >= BATCH_BYTES:
                    yield out()
                    ids, texts, extra, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield out()
        del texts
        trim()

    carried = F.to_json(F.struct(*carry)) if carry else F.lit("")
    coded = ws.bucketed(documents(docs, id_col, text_col, carried.alias("carried")).mapInArrow(code, _ROWS), "coded", "batch", parts)
    payload = coded.where("kind = 'payload'").select("batch", "body")

    # 2. Anchors whose gram stands twice or more go back to their batch: 1, or 2 for hot ones.
    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for rb in batches for r in zip(*(c.to_pylist() for c in rb.columns))]
        if not rows:
            return
        sizes = [len(x) // 12 for _, _, x in rows]
        h = np.concatenate([np.frombuffer(x, np.uint64, n) for (_, _, x), n in zip(rows, sizes)])
        often = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for (_, _, x), n in zip(rows, sizes)]).astype(np.int64)
        order = np.argsort(h)
        heads = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        size = np.diff(np.concatenate([heads, [len(h)]]))  # batches that have the gram
        total = np.add.reduceat(often[order], heads)
        mark = np.where((total >= HOT_LEAST) & (total * HOT_PART >= total.sum()), 2, total > 1).astype(np.uint8)
        flags = np.empty(len(h), np.uint8)
        flags[order] = np.repeat(mark, size)
        for (batch, part, _), own in zip(rows, np.split(flags, np.cumsum(sizes)[:-1])):
            if own.any():
                yield _emit([(batch, part, own.tobytes(), "hits")])
        trim()

    anchors = coded.where("kind = 'anchors'").select("batch", "part", "body")
    hits = anchors.repartitionById(parts, F.col("part")).mapInArrow(several, _ROWS).select(F.col("batch").alias("hit_batch"), F.col("part").alias("hit_part"), F.col("body").alias("hit"))

    def set_of(run: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.sort((run << 7) | which)

    def alone(batch: int, runs: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, gone: np.ndarray, ids: np.ndarray, known: np.ndarray, doc: np.ndarray, begin: np.ndarray, raw: np.ndarray) -> list[tuple]:
        """Rows of the windows of hot runs that repeat nothing in their batch, each a context of one window, by part of their fingerprints."""
        n = count[runs]
        run = np.repeat(runs, n)
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        stays = ~np.isin((run << 7) | which, gone)
        run, which = run[stays], which[stays]
        where = first[run] + which
        part = (fingerprints(raw, where, length) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        rows = []
        for p in np.flatnonzero(np.diff(edges)).tolist():
            g = order[edges[p] : edges[p + 1]]
            d = doc[run[g]]
            text = raw[where[g][:, None] + np.arange(length)].reshape(-1)
            rows.append((batch, p, pack(ids[d], known[d], d.astype(np.uint32), (where[g] - begin[run[g]]).astype(np.uint32), where[g].astype(np.uint32), np.ones(len(g), np.uint8), (anchor[run[g]] - where[g]).astype(np.uint8), text), "context"))
        return rows

    # 3. Within a batch: sort what stands around these anchors; first occurrences go on.
    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"batch": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "body": pa.array([], pa.binary()), "kind": pa.array([], pa.string())})
        batch = left.column("batch")[0].as_py()
        ids, known, sizes, raw, ends = _read(left.column("body")[0].as_py())
        first, count, anchor, h = anchor_runs(raw, ends, length)
        unique, place, _, edges = _by_part(h, parts)
        flags = np.zeros(len(unique), np.uint8)
        for p, x in zip(right.column("hit_part").to_pylist(), right.column("hit").to_pylist()):
            flags[edges[p] : edges[p + 1]] = np.frombuffer(x, np.uint8)
        at = np.flatnonzero(flags[place])
        first, count, anchor, h, hot = first[at], count[at], anchor[at], h[at], flags[place][at] == 2
        doc = np.searchsorted(ends, first, side="right")
        begin = ends[doc] - sizes[doc]
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((first, doc, ids[doc], known[doc] == 0))] = np.arange(len(at))
        hit = repeated_windows(raw, first, count, anchor, rank, length)
        run = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in hit)])
        which = np.concatenate([np.zeros(0, np.int64), *(x for _, x in hit)])
        rows = [(batch, -1, pack(*_intervals(first[run] + which)), "cover")]
        left_over = np.bincount(run, minlength=len(at)) < count
        rows += alone(batch, np.flatnonzero(left_over & hot), first, count, anchor, set_of(run, which), ids, known, doc, begin, raw)
        goes = np.flatnonzero(left_over & ~hot)
        part = (h[goes] % np.uint64(parts)).astype(np.int64)
        goes = goes[np.argsort(part, kind="stable")]
        edges = np.searchsorted(np.sort(part), np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            g = goes[edges[p] : edges[p + 1]]
            size = count[g] + length - 1
            pick = np.repeat(first[g] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            rows.append((batch, p, pack(ids[doc[g]], known[doc[g]], doc[g].astype(np.uint32), (first[g] - begin[g]).astype(np.uint32), first[g].astype(np.uint32), count[g].astype(np.uint8), (anchor[g] - first[g]).astype(np.uint8), raw[pick]), "context"))
        out = pa.Table.from_batches([_emit(rows)])
        trim()
        return out

    found = ws.put(payload.groupby("batch").cogroup(hits.groupby("hit_batch")).applyInArrow(local, _ROWS), "found", "kind")

    # 4. Across batches, in the task that owns the part of the hash space.
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b, unpack(x)) for rb in batches for b, x in zip(rb.column(0).to_pylist(), rb.column(2).to_pylist())]
        if not rows:
            return
        kinds = (np.int64, np.uint8, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8, np.uint8)
        ids, known, doc, start, where, count, offset, text = (np.concatenate([np.frombuffer(x[k], t) for _, x in rows]) for k, t in enumerate(kinds))
        n = [len(x[0]) // 8 for _, x in rows]
        names = np.array([b for b, _ in rows], np.int64)
        batch = np.repeat(np.arange(len(rows)), n)
        del rows
        count, offset = count.astype(np.int64), offset.astype(np.int64)
        size = count + length - 1
        first = np.cumsum(size) - size
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((start, doc, names[batch], ids, known == 0))] = np.arange(len(ids))
        hit = repeated_windows(np.concatenate([text, np.zeros(8, np.uint8)]), first, count, first + offset, rank, length)
        run = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in hit)])
        which = np.concatenate([np.zeros(0, np.int64), *(x for _, x in hit)])
        order = np.argsort(batch[run], kind="stable")
        run, which = run[order], which[order]
        edges = np.searchsorted(batch[run], np.arange(len(names) + 1))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            r = slice(edges[i], edges[i + 1])
            yield _emit([(int(names[i]), 0, pack(*_intervals(where[run[r]].astype(np.int64) + which[r])), "cover")])
        trim()

    contexts = found.where("kind = 'context'").select("batch", "part", "body")
    covers = contexts.repartitionById(parts, F.col("part")).mapInArrow(across, _ROWS).select("batch", "body")
    covers = covers.unionByName(found.where("kind = 'cover'").select("batch", "body")).select(F.col("batch").alias("cover_batch"), F.col("body").alias("cover"))

    # 5. Cover and cut.
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        body = left.column("body")[0].as_py()
        ids, known, sizes, raw, ends = _read(body)
        widths, more = unpack(body)[4:]
        more, stop = bytes(more), np.cumsum(np.frombuffer(widths, np.uint32), dtype=np.int64).tolist()
        edge = np.zeros(len(raw) + 1, np.int32)
        for body in right.column("cover").to_pylist():
            first, n = (np.frombuffer(x, np.uint32).astype(np.int64) for x in unpack(body))
            np.add.at(edge, first, 1)
            np.add.at(edge, first + n - 1 + length, -1)
        gone = np.cumsum(edge)[: len(raw)] > 0
        extra = [more[a:b].decode() for a, b in zip([0, *stop], stop)]
        kept, removed, spans, begins, stops = [], [], [], [], []
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            g = gone[a:b]
            turn = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            begins.append(turn[::2])
            stops.append(turn[1::2])
            spans.append(len(turn) // 2)
            removed.append(int(g.sum()))
            stays = raw[a:b][~g].tobytes()
            kept.append(stays.decode(errors="ignore") if as_text else stays)
        out = pa.table(
            [pa.array(ids, pa.int64(), mask=known == 0), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(begins, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64())), pa.array(extra, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "starts", "ends", "carried"],
        )
        trim()
        return out

    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, starts array<long>, ends array<long>, carried string"
    out = payload.groupby("batch").cogroup(covers.groupby("cover_batch")).applyInArrow(cut, schema)
    return out.withColumn("carried", F.from_json("carried", docs.select(*carry).schema)) if carry else out.drop("carried")
