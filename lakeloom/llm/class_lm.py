"""Language-model scoring by Brown class-based n-grams.

Counts come from all training documents, and each of their words gets a class by exchange:

1. A start: the most frequent words, and the most frequent endings of all others, are types that the
   driver clusters, moving one at a time to the class that raises the likelihood of the class bigrams most.
2. Rounds over the whole vocabulary: how often each word stands before and after each class is counted
   over all training documents and summed by part of the word space; there each word goes to the class
   that raises the likelihood most, against the table of class bigrams, which alone reaches all tasks.
   The words that the start moved one at a time, each a type of its own, stay where they are. The others
   move at once, so a round that lowers the likelihood is undone and ends the rounds.

Words that only held-out texts hold keep the class of their ending, as context of what follows. Then

    p(w | v) = (1 - u) * p(class of w | class of v) * p(w | class of w)    for words seen in training
    p(w | v) = u                                                           for the one unseen type

with u the Good-Turing mass n1 / N, emissions count(w) / count(class), and class transitions smoothed
towards the class distribution by Witten-Bell weights. Word counts are a shuffle over all words of the
corpus (see wordblocks), and so are the counts of words and classes; only the bigrams of the starting
types and of the classes reach the driver.

Defined results: a null or empty text is the end token alone; without training words everything is
unseen and both scores are 0 per token; ids may repeat or be null (a null id is not held out); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import wordblocks
from lakeloom.llm.common import Workspace, documents

#: The end token; no word is empty.
END = b""
#: Types that the start clusters: the most frequent words and the most frequent endings of the others.
FREQUENT_WORDS, ENDINGS, ENDING_BYTES = 768, 255, 3
CLASSES, ROUNDS = 64, 8
#: Rounds over the whole vocabulary at most; entries whose gains are computed at once.
ASSIGN_ROUNDS, ENTRIES = 3, 1 << 18
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text: str) -> list[bytes]:
    """Words after lower-casing A-Z, then one end."""
    return [*text.encode().translate(_LOWER).split(), END]


def exchange(bigrams: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each type: starts by frequency, then moves types while the likelihood grows."""
    n = len(bigrams)
    classes = min(classes, n)
    weight = bigrams.sum(0) + bigrams.sum(1)
    cls = np.empty(n, np.int64)
    cls[np.argsort(-weight, kind="stable")] = np.minimum(np.arange(n), classes - 1)
    log = lambda x: x * np.log(np.maximum(x, 1e-300))  # noqa: E731  x log x, 0 at 0
    one = np.zeros((n, classes))
    one[np.arange(n), cls] = 1
    table = one.T @ bigrams @ one
    for _ in range(rounds):
        moved = 0
        for t in np.argsort(-weight, kind="stable"):
            if not weight[t]:
                continue
            a, own = cls[t], bigrams[t, t]
            out = np.bincount(cls, weights=bigrams[t], minlength=classes)
            into = np.bincount(cls, weights=bigrams[:, t], minlength=classes)
            out[a] -= own
            into[a] -= own
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= own
            rows, cols = table.sum(1), table.sum(0)
            r, c = out.sum() + own, into.sum() + own
            # Change of sum n(x,y) log n(x,y) - sum n(x) log n(x) - sum n(y) log n(y), for every target at once.
            both = log(table + out[None, :]).sum(1) - log(table).sum(1) + log(table + into[:, None]).sum(0) - log(table).sum(0)
            d = np.diagonal(table)
            both -= log(d + out) - log(d) + log(d + into) - log(d)
            both += log(d + out + into + own) - log(d)
            gain = both - (log(rows + r) - log(rows)) - (log(cols + c) - log(cols))
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += own
            moved += b != a
            cls[t] = b
        if not moved:
            break
    return cls


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """What exchange raises: the log-likelihood of class bigrams, but for the part that no class changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def _sums(rows: np.ndarray, pick: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of rows[pick] between one head and the next: the first of each at once, then the second, and so on."""
    size = np.diff(heads, append=len(pick))
    order = np.argsort(-size)
    at, size = heads[order], size[order]
    sums = np.zeros((len(heads), rows.shape[1]))
    for j in range(int(size[0])):
        n = int(np.searchsorted(-size, -j, side="left"))  # those with more than j rows
        sums[:n] += rows[pick[at[:n] + j]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def assign(word: np.ndarray, cell: np.ndarray, n: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class of each word against the table of class bigrams, which holds the word in its own class.

    Entries are sorted by word and cell: cell c counts the word before class c, cell k + c after class c.
    A word without entries stays. The gain leaves out what a word's leaving changes in the rows of others.
    """
    k = len(table)
    best = own.copy()
    if not len(word):
        return best
    cells = np.concatenate([table, table.T], 1)  # [class of the word, cell]
    flat = _xlogx(cells)
    sums = (table.sum(1), table.sum(0))
    edges = np.searchsorted(word, np.arange(len(own) + 1))
    lo = 0
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + ENTRIES, "right")) - 1)
        at = slice(edges[lo], edges[hi])
        w, c, x = word[at], cell[at], n[at].astype(np.float64)
        if len(w):
            pairs, back = np.unique(x * (2 * k) + c, return_inverse=True)
            pc, px = (pairs % (2 * k)).astype(np.int64), pairs // (2 * k)
            gains = (_xlogx(cells[:, pc] + px) - flat[:, pc]).T  # [pair, class]
            heads = np.flatnonzero(np.diff(w, prepend=-1))
            who = w[heads]
            total = _sums(gains, back, heads)
            o = own[w]
            here = np.add.reduceat(flat[o, c] - _xlogx(np.maximum(cells[o, c] - x, 0)), heads)
            a = own[who]
            for side, size in enumerate(sums):
                r = np.add.reduceat(np.where((c >= k) == side, x, 0), heads)
                total -= _xlogx(size[None, :] + r[:, None]) - _xlogx(size)[None, :]
                here -= _xlogx(size[a]) - _xlogx(np.maximum(size[a] - r, 0))
            rows = np.arange(len(who))
            total[rows, a] = here
            b = total.argmax(1)
            best[who] = np.where(total[rows, b] > here + 1e-9, b, a)
        lo = hi
    return best


def ending(word: bytes) -> bytes:
    """The last ENDING_BYTES bytes, and as many more as the first character needs to be whole."""
    at = max(0, len(word) - ENDING_BYTES)
    while at and 0x80 <= word[at] < 0xC0:
        at -= 1
    return word[at:]


def transitions(moves: np.ndarray) -> np.ndarray:
    """Probabilities of the next class after each, from the bigrams of classes: Witten-Bell towards the classes' shares."""
    size = moves.sum(0)
    prior = (size + 1e-9) / (size.sum() + 1e-9 * len(size))
    spread = (moves > 0).sum(1) + 1.0
    return (moves + spread[:, None] * prior[None, :]) / (moves.sum(1) + spread)[:, None]


def _typer(frequent: list[bytes], endings: list[bytes]):
    """Type of a word: itself, its ending, or the one type for all others (the last)."""
    by_word = {w: i for i, w in enumerate(frequent)}
    by_ending = {w: len(frequent) + i for i, w in enumerate(endings)}
    rest = len(frequent) + len(endings)
    return lambda w: by_word[w] if w in by_word else by_ending.get(ending(w), rest)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    held_out is a boolean column over doc_id; rows where it is true are scored and not learnt from.
    """
    ws = Workspace(docs.sparkSession, "class_lm")
    rows = documents(docs, id_col, text_col).withColumn("flag", F.when(F.coalesce(held_out, F.lit(False)), 0).otherwise(1))
    coded, parts = wordblocks.code(rows, ws, tokens, counted=True)

    # 1. Counts of all words. Batch -1: totals of a part; -2 and -3: its most frequent words and endings.
    def answer(blocks: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        number, total, lists = wordblocks.numbering(), np.zeros(0, np.int64), []
        for batch, part, body in blocks:
            words, (counts,) = wordblocks.unpack_words(body)
            own = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            if len(number) > len(total):
                total = np.concatenate([total, np.zeros(2 * len(number) - len(total), np.int64)])
            total[own] += np.frombuffer(counts, np.uint32)  # a block holds a word once
            lists.append((batch, part, own.astype(np.uint32)))
        total = total[: len(number)]
        for batch, part, own in lists:  # the numbers of the part's words serve the rounds
            yield batch, part, wordblocks.pack(total[own].astype(np.uint64), own, np.array([batch, part], np.int64)), b"", 0, 0, 0
        yield -1, 0, b"", b"", int(total.sum()), int((total > 0).sum()), int((total == 1).sum())
        words = list(number)
        least = np.partition(total, len(total) - FREQUENT_WORDS)[len(total) - FREQUENT_WORDS] if len(total) > FREQUENT_WORDS else 0
        most = [(words[i], int(total[i])) for i in np.flatnonzero(total >= least).tolist()]
        for w, n in sorted(most, key=lambda x: (-x[1], x[0]))[:FREQUENT_WORDS]:
            yield -2, 0, b"", w, n, 0, 0
        ends: dict[bytes, int] = {}
        for w, n in zip(words, total.tolist()):
            e = ending(w)
            ends[e] = ends.get(e, 0) + n
        for e, n in ends.items():
            yield -3, 0, b"", e, n, 0, 0

    counted = ws.put(wordblocks.resolve(coded, parts, answer, "batch long, part int, body binary, word binary, n long, distinct long, once long"), "counts")
    totals = counted.where("batch = -1").agg(F.sum("n"), F.sum("distinct"), F.sum("once")).first()
    n_all, n_distinct, n_once = (int(x or 0) for x in totals)
    top = lambda batch, k: [(bytes(r["word"]), r["n"]) for r in counted.where((F.col("batch") == batch) & (F.col("n") > 0)).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(k).collect()]
    frequent = top(-2, FREQUENT_WORDS)
    own_types = {w for w, _ in frequent}
    ends = dict(top(-3, ENDINGS + len(frequent)))  # endings rank by the words that go by them: the frequent ones do not
    for w, n in frequent:
        if (e := ending(w)) in ends:
            ends[e] -= n
    endings = sorted((e for e, n in ends.items() if n > 0), key=lambda e: (-ends[e], e))[:ENDINGS]
    least = frequent[-1][1] if frequent else 0  # words with more occurrences are all types of their own
    frequent = [w for w, _ in frequent]
    if END not in own_types:
        frequent.append(END)
    types = len(frequent) + len(endings) + 1
    answers = counted.where("batch >= 0").select("batch", "part", "body")
    words = coded.where(F.col("kind") == "words").select("batch", "part", "body")
    end_type = frequent.index(END)

    # 2. Types of all words, and bigrams of types over all training documents.
    def by_type(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typed = _typer(frequent, endings)
        for rb in batches:
            lists = [wordblocks.unpack_words(b.as_py())[0] for b in rb.column(2)]
            bodies = [wordblocks.pack(np.fromiter(map(typed, words), np.uint16, len(words))) for words in lists]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(bodies, pa.binary())], names=["batch", "part", "body"])

    typed = ws.put(words.mapInArrow(by_type, wordblocks.ANSWER), "types")

    def bigrams(doc: list, bodies: list[bytes]) -> pa.Table:
        _, _, flags, sizes, codes = doc
        kinds = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(wordblocks.unpack(b)[0], np.uint16) for b in bodies)]).astype(np.int64)[codes]
        previous = np.concatenate([[end_type], kinds[:-1]])  # every document ends with the end, the next starts after it
        train = np.repeat(flags, sizes) == 1
        n = np.bincount(previous[train] * types + kinds[train], minlength=1)
        at = np.flatnonzero(n)
        return pa.table([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["pair", "n"])

    pairs = wordblocks.reassemble(coded, typed, bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(types * types)
    table[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    table = table.reshape(types, types)

    # 3. Classes: those of the types at first, then rounds over all words.
    cls = exchange(table, classes, ROUNDS)
    k = int(cls.max()) + 1
    one = np.zeros((types, k))
    one[np.arange(types), cls] = 1
    moves = one.T @ table @ one

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            bodies = [wordblocks.pack(cls[np.frombuffer(wordblocks.unpack(b.as_py())[0], np.uint16)].astype(np.uint16)) for b in rb.column(2)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(bodies, pa.binary())], names=["batch", "part", "body"])

    grouped = ws.put(typed.mapInArrow(start, wordblocks.ANSWER), "classes0")

    def look_up(grouped: DataFrame) -> DataFrame:
        """Counts and classes of each batch's words: two answers for each part, in that order."""
        return answers.unionByName(grouped.select("batch", (F.col("part") + parts).alias("part"), "body"))

    def neighbours(doc: list, bodies: list[bytes], detail: bool) -> pa.Table:
        """Class bigrams of a batch (batch -1) and, by part, what classes stand beside each word."""
        half = len(bodies) // 2
        _, _, flags, sizes, codes = doc
        group = np.concatenate([np.frombuffer(wordblocks.unpack(b)[0], np.uint16) for b in bodies[half:]]).astype(np.int64)
        codes = codes.astype(np.int64)
        previous = np.concatenate([codes[-1:], codes[:-1]])
        train = np.repeat(flags, sizes) == 1
        previous, codes = previous[train], codes[train]
        n = np.bincount(group[previous] * k + group[codes], minlength=1)
        at = np.flatnonzero(n)
        rows = [(-1, -1, b"", int(p), int(n[p])) for p in at]
        if detail:
            keys, count = np.unique(np.concatenate([previous * (2 * k) + group[codes], codes * (2 * k) + k + group[previous]]), return_counts=True)
            word, cell = np.divmod(keys, 2 * k)
            low = 0
            for answer, own in zip(bodies[:half], bodies[half:]):
                _, index, head = wordblocks.unpack(answer)
                high = low + len(index) // 4
                a, b = np.searchsorted(word, [low, high])
                each = np.bincount(word[a:b] - low, minlength=high - low).astype(np.uint16)  # 2 k at most
                batch, part = np.frombuffer(head, np.int64).tolist()
                rows.append((batch, part, wordblocks.pack(index, each, cell[a:b].astype(np.uint16), count[a:b].astype(np.uint32), wordblocks.unpack(own)[0]), 0, 0))
                low = high
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["batch", "part", "body", "pair", "n"])

    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def count_classes(grouped: DataFrame, r: int, detail: bool) -> tuple[DataFrame, np.ndarray]:
        """Counts of words and classes by block, and the class bigrams, both under the classes of `grouped`."""
        run = lambda doc, bodies: neighbours(doc, bodies, detail)
        found = ws.put(wordblocks.reassemble(coded, look_up(grouped), run, "batch long, part int, body binary, pair long, n long"), f"beside{r}")
        pairs = found.where("batch = -1").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros(k * k)
        table[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
        return found.where("batch >= 0").select("batch", "part", "body", F.lit("words").alias("kind")), table.reshape(k, k)

    def regroup(table: np.ndarray):
        def answer(blocks: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
            keys, counts, own, lists = [], [], {}, []
            for batch, part, body in blocks:
                index, each, cell, count, group = (np.frombuffer(x, t) for x, t in zip(wordblocks.unpack(body), (np.uint32, np.uint16, np.uint16, np.uint32, np.uint16)))
                keys.append(np.repeat(index, each).astype(np.int64) * (2 * k) + cell)
                counts.append(count)
                lists.append((batch, part, index, group))
            if not lists:
                return
            key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
            del keys, counts
            own = np.zeros(max((int(i.max()) + 1 for _, _, i, _ in lists if len(i)), default=0), np.int64)
            for _, _, index, group in lists:
                own[index] = group
            order = np.argsort(key)
            key, count = key[order], count[order]
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            if len(heads):
                key, count = key[heads], np.add.reduceat(count, heads)
            word, cell = key // (2 * k), key % (2 * k)
            rare = (np.bincount(word, np.where(cell < k, count, 0), len(own)) <= least)[word]
            best = assign(word[rare], cell[rare], count[rare], own, table).astype(np.uint16)
            for batch, part, index, _ in lists:
                yield batch, part, wordblocks.pack(best[index])

        return answer

    before = None
    for r in range(ASSIGN_ROUNDS + 1 if n_all else 0):
        beside, now = count_classes(grouped, r, r < ASSIGN_ROUNDS)
        if before is not None and likelihood(now) < likelihood(before[1]):
            grouped, moves = before
            break
        moves = now
        if before is not None and r < ASSIGN_ROUNDS and (moves == before[1]).all():
            break
        if r < ASSIGN_ROUNDS:
            before = grouped, moves
            grouped = ws.put(wordblocks.resolve(beside, parts, regroup(moves)), f"classes{r + 1}")
            ws.drop(f"beside{r}")

    # 4. Transitions and emissions.
    size = moves.sum(0)
    unseen = (n_once + 0.5) / (n_all + 1.0) if n_all else 1.0
    log_transition = np.log10(transitions(moves))
    log_size = np.log10(np.maximum(size, 1.0))
    log_unseen, log_seen = np.log10(unseen), np.log10(max(1 - unseen, 1e-12))
    base_total = n_all + 0.1 * (n_distinct + 1)

    # 5. Scores.
    def finish(doc: list, bodies: list[bytes]) -> pa.Table:
        half = len(bodies) // 2
        ids, known, flags, sizes, codes = doc
        counts = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(wordblocks.unpack(b)[0], np.uint64) for b in bodies[:half])]).astype(np.float64)
        group = np.concatenate([np.frombuffer(wordblocks.unpack(b)[0], np.uint16) for b in bodies[half:]]).astype(np.int64)
        emit = np.log10(np.maximum(counts, 1)) - log_size[group]
        c, g, e = counts[codes], group[codes], emit[codes]
        before = np.concatenate([g[-1:], g[:-1]])
        each = np.where(c > 0, log_seen + log_transition[before, g] + e, log_unseen)
        base = np.log10((c + 0.1) / base_total)
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)[:-1]])
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has its end at least
        n = sizes.astype(np.int64)
        total = add(each)
        return pa.table(
            [wordblocks.id_column(doc), pa.array(flags == 0), pa.array(n), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(n), n_all, np.int64)),
             pa.array(add(base)), pa.array(total), pa.array(10 ** np.minimum(300, -total / n))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
        )

    return wordblocks.reassemble(coded, look_up(grouped), finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
