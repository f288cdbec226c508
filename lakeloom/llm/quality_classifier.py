"""Quality classifier by a sparse rule ensemble.

Statistics of the whole text (one Arrow pass) are the features. Boosted shallow trees are grown on a
bounded sample of labelled rows; each path from a root to a node is a conjunctive rule over statistics.
A logistic model with lasso penalty weighs the rules, most weights become zero, and what is left is
compiled into one Spark column expression, which scores all documents without Python.

Defined results: a null or empty text has statistics of zero and gets a score like any other; without
labels of both kinds every score is the share of label 1 (smoothed); labels of repeated ids are
combined by their maximum; repeated rows score alike; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Workspace, documents

#: Labelled rows that the model is fitted on at most, drawn by a hash of the id.
FIT_ROWS = 20_000
TREES, DEPTH, SHRINK, MIN_LEAF, BINS = 24, 3, 0.3, 10, 64
LASSO, STEPS = 0.002, 600
STATISTICS = (
    "n_words", "chars_per_word", "symbols_per_word", "marks_per_word", "bars_per_word", "upper_share", "digit_share",
    "high_byte_share", "distinct_share", "stutter_share", "lines_per_word", "dup_line_share", "punctuation_per_word", "longest_word",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars)] = 1
    return t


_CLASSES = {
    "symbols": _table(b"#*$%&<>@^~=+\\_{}[]"), "marks": _table(b"!?"), "bars": _table(b"|"), "upper": _table(bytes(range(65, 91))),
    "digits": _table(bytes(range(48, 58))), "high": _table(bytes(range(128, 256))), "punctuation": _table(b".,;:'\"()-"),
}


def _measure(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n, lines = max(1, len(words)), [x for x in text.split(b"\n") if x.strip()]
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    c = {k: int(seen @ t) for k, t in _CLASSES.items()}
    chars = sum(map(len, words))
    size = max(1, chars)
    return (
        len(words), chars / n, c["symbols"] / n, c["marks"] / n, c["bars"] / n, c["upper"] / size, c["digits"] / size, c["high"] / size,
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(lines) / n, (len(lines) - len(set(lines))) / max(1, len(lines)), c["punctuation"] / n, max(map(len, words), default=0),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id and STATISTICS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = np.array([_measure(t.as_py().encode()) for t in rb.column(1)], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(found[:, k]) for k in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold), all of which hold


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Rules of the paths of boosted regression trees on the logistic gradient."""
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)], 1)  # bin > b means value > edge b
    margin = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        stack: list[tuple[np.ndarray, Rule, int]] = [(np.arange(len(y)), (), 0)]
        while stack:
            at, path, d = stack.pop()
            best = (1e-6, None)
            g, h = grad[at], hess[at]
            whole = g.sum() ** 2 / (h.sum() + 1)
            if d < depth and len(at) >= 2 * MIN_LEAF:
                for k, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[at, k]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h, np.ones(len(at))))
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                    gain[(ns < MIN_LEAF) | (len(at) - ns < MIN_LEAF)] = -1
                    j = int(np.argmax(gain))
                    if gain[j] > best[0]:
                        best = (gain[j], (k, j))
            if best[1] is None:
                margin[at] += SHRINK * g.sum() / (h.sum() + 1)
                continue
            k, j = best[1]
            above = binned[at, k] > j
            for side in (False, True):
                rule = (*path, (k, side, float(edges[k][j])))
                rules[tuple(sorted(rule))] = None
                stack.append((at[above == side], rule, d + 1))
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.all([(x[:, k] > t) == above for k, above, t in rule], axis=0)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic model with an absolute penalty, by accelerated proximal steps."""
    n, m = r.shape
    w, b = np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    step = 4.0 / (np.linalg.norm(np.column_stack([r, np.ones(n)]), 2) ** 2 / n + 1e-9) if m else 1.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        err = (1 / (1 + np.exp(-(r @ v + c))) - y) / n
        nw = v - step * (r.T @ err)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb, nt = c - step * err.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def compile_rules(intercept: float, weights: list[float], rules: list[Rule]) -> Column:
    """The ensemble as a column: the logistic of the intercept and the weights of the rules that hold."""
    z = F.lit(float(intercept))
    for w, rule in zip(weights, rules):
        cond = F.lit(True)
        for k, above, t in rule:
            cond = cond & ((F.col(STATISTICS[k]) > t) if above else (F.col(STATISTICS[k]) <= t))
        z = z + F.when(cond, float(w)).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-z))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, n_rules. held_out is a boolean column over doc_id."""
    ws = Workspace(docs.sparkSession, "quality_classifier")
    stats = ws.put(statistics(documents(docs, id_col, text_col)), "statistics")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out)
    n = marks.count()
    drawn = marks if n <= fit_rows else marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    fit = stats.join(drawn, "doc_id").select("label", *STATISTICS).toArrow()
    x = np.column_stack([fit.column(s).to_numpy() for s in STATISTICS]) if len(fit) else np.zeros((0, len(STATISTICS)))
    y = fit.column("label").to_numpy()
    order = np.lexsort(np.column_stack([x, y]).T)  # the same model whatever the order of the rows
    x, y = x[order], y[order]
    rules = grow_rules(x, y) if 0 < y.sum() < len(y) else []
    r = np.column_stack([holds(rule, x) for rule in rules]).astype(np.float64) if rules else np.zeros((len(y), 0))
    b, w = lasso(r, y)
    kept = [(float(v), rule) for v, rule in zip(w, rules) if abs(v) > 1e-6]
    score = compile_rules(b, [v for v, _ in kept], [rule for _, rule in kept])
    out = stats.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.lit(len(kept)).alias("n_rules"))
