"""Quality rules with risk-controlled thresholds (DataFrame operations only).

Fixed rules come first (too few words, too much repetition). Further rules reject a document whose
statistic exceeds a cutoff, and the cutoffs come from labelled rows: for each stratum and rule the
strictest cutoff of a grid is taken whose share of falsely rejected good documents is, by an exact
binomial (Clopper-Pearson) bound, at most the rule's part of the risk. The chance of error is divided
by strata x rules (Bonferroni); within a rule, cutoffs are tested from lax to strict and testing ends at
the first that fails (a fixed sequence, which needs no further division). So with probability 1 - DELTA
no stratum loses more than RISK of its good documents to the further rules. Where labels don't suffice,
a rule stays idle.

Defined results: a null or empty text has no words and fails; a null or unlabelled stratum has its own
(idle) cutoffs; labels of repeated ids are combined by their minimum; repeated rows are judged alike;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import SPACE_CLASS, SPACES, Workspace

#: Good documents that the further rules may reject in a stratum, and the chance that they reject more.
RISK, DELTA = 0.02, 0.05
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
GRID = 32
#: Statistic of each further rule and the grid's largest cutoff; cutoffs fall from there by halves of an octave.
RULES = {
    "symbols_per_word": 4.0,
    "marks_per_word": 4.0,
    "upper_per_char": 1.0,
    "dup_lines_per_line": 1.0,
    "chars_per_word": 64.0,
    "repeats_per_word": 1.0,
}


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def statistics(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """Per row: doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' statistics."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(stratum_col).cast("string").alias("stratum"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, SPACES)) > 0)
    cut = base.select(
        "doc_id", "stratum",
        F.length("text").alias("chars"),
        F.length(_without(F.col("text"), SPACES)).alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).alias("n_symbols"),
        (F.length("text") - F.length(_without(F.col("text"), "!?"))).alias("n_marks"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).alias("n_upper"),
        lines.alias("lines"),
        F.filter(F.split("text", f"{SPACE_CLASS}+"), lambda w: w != "").alias("words"),
    )
    hashed = cut.select(
        "doc_id", "stratum", "chars", "word_chars", "n_symbols", "n_marks", "n_upper",
        F.size("words").alias("n_words"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    at = lambda i: F.get(F.col("h"), i)
    grams = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - WINDOW, F.lit(0))), lambda i: F.xxhash64(*(at(i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    windows = hashed.select("*", grams.alias("g")).drop("h")
    # Windows in order of content; a window whose neighbour is equal stands twice or more.
    order = F.sort_array(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    sorted_ = windows.select("*", F.when(F.size(F.array_distinct("g")) < F.size("g"), order).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")).alias("s")).drop("g")
    key = lambda j: F.get(F.col("s"), j).getField("g")
    found = F.sort_array(F.transform(F.filter(F.transform("s", lambda x, j: F.struct(x["i"].alias("i"), (x["g"].eqNullSafe(key(j - 1)) | x["g"].eqNullSafe(key(j + 1))).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))
    covered = F.aggregate(
        found, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"],
    )
    counted = sorted_.select("*", covered.alias("n_repeat_words")).drop("s")
    per = lambda n, d: F.col(n) / F.greatest(F.col(d), F.lit(1))
    return counted.select(
        "doc_id", "stratum", *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        per("n_symbols", "n_words").alias("symbols_per_word"), per("n_marks", "n_words").alias("marks_per_word"), per("n_upper", "word_chars").alias("upper_per_char"),
        per("n_dup_lines", "n_lines").alias("dup_lines_per_line"), per("word_chars", "n_words").alias("chars_per_word"), per("n_repeat_words", "n_words").alias("repeats_per_word"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def cutoffs(rule: str) -> list[float]:
    """The rule's grid, from lax to strict."""
    return [RULES[rule] * 2 ** (-k / 4) for k in range(GRID)]


def upper_bound(failed: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate under which `failed` or fewer of n have probability delta."""
    if failed >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(failed + 1)]

    def at_most(p: float) -> float:
        terms = [c + k * math.log(p) + (n - k) * math.log1p(-p) for k, c in enumerate(logs)]
        top = max(terms)
        return top + math.log(sum(math.exp(t - top) for t in terms))

    low, high = failed / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(max(mid, 1e-300)) > math.log(delta) else (low, mid)
    return high


def select_cutoffs(counts: dict[tuple[str, str], tuple[int, list[int]]], risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> (good documents, of these above each cutoff of the grid) to the chosen cutoffs."""
    chosen, share = {}, risk / len(RULES)
    each = delta / max(1, len(counts))
    for (stratum, rule), (n, above) in counts.items():
        for cutoff, failed in zip(cutoffs(rule), above):
            if n == 0 or failed > share * n or upper_bound(failed, n, each) > share:
                break
            chosen[stratum, rule] = cutoff
    return chosen


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules."""
    ws = Workspace(docs.sparkSession, "quality_rules")
    stats = ws.put(statistics(docs, id_col, text_col, stratum_col), "statistics")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).groupBy("doc_id").agg(F.min("label").alias("label"))
    good = stats.join(marks.where("label = 1").select("doc_id"), "doc_id").where(~base_failed() & F.col("stratum").isNotNull())
    above = [F.sum((F.col(r) > c).cast("long")).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(cutoffs(r))]
    counted = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *above).collect()  # a row for each stratum
    counts = {(row["stratum"], r): (row["n"], [row[f"{r}_{i}"] for i in range(GRID)]) for row in counted for r in RULES}
    chosen = select_cutoffs(counts, risk, delta)
    failed = [F.when((F.col("stratum") == s) & (F.col(r) > c), F.lit(r)) for (s, r), c in sorted(chosen.items())]
    names = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    out = stats.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_join(names, ","))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")
