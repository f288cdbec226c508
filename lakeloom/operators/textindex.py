"""Search by an index of trigrams: lists of the rarest grams of each term are intersected, and what is left is verified.

The index has a row for each (field, gram, asset): of fields that match by substring the trigrams of the folded value, of
the others the folded value itself. It is sorted by field and gram in ranges, so a query reads the few row groups that
hold its grams, and the list of a frequent gram is spread over many files. A query's tree says which lists bound it; where
nothing does (a short needle, everything, a negation) or where the lists hold more than SCAN_SHARE of all assets, the
documents are scanned as ever. The predicate decides in either case, so the rows are the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import ascii_fold, fold
from lakeloom.operators.search import FIELDS, SUBSTRING_FIELDS, And, MatchAll, Not, Or, Term, explain, parse, predicate

GRAM = 3
#: Lists of a term that are intersected, rarest first, and the share of all assets beyond which a scan is cheaper.
LISTS, SCAN_SHARE = 3, 0.3


def grams_of(value: str) -> list[str]:
    """The distinct grams of a folded needle; none if it is too short."""
    return sorted({value[i : i + GRAM] for i in range(len(value) - GRAM + 1)})


def grams(docs: DataFrame) -> DataFrame:
    """(field, gram, asset_id), each once, of search documents."""
    def of(field: str) -> DataFrame:
        values = docs.select("asset_id", F.explode(field).alias("v")).select("asset_id", ascii_fold(F.col("v")).alias("v"))
        if field in SUBSTRING_FIELDS:
            cut = F.transform(F.sequence(F.lit(1), F.length("v") - (GRAM - 1)), lambda i: F.substring(F.col("v"), i, F.lit(GRAM)))
            values = values.where(F.length("v") >= GRAM).select("asset_id", F.explode(F.array_distinct(cut)).alias("v"))
        return values.select(F.lit(field).alias("field"), F.col("v").alias("gram"), "asset_id")

    return reduce(DataFrame.unionByName, map(of, FIELDS)).distinct()


def write(docs: DataFrame, path: str) -> None:
    """Writes the index; a gram that many assets hold spans several ranges."""
    grams(docs).repartitionByRange("field", "gram", "asset_id").sortWithinPartitions("field", "gram", "asset_id").write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class Plan:
    """How a query is answered: candidates (None: by scan), of how many assets, and how many there are at most."""

    candidates: DataFrame | None
    assets: int
    bound: int


def _terms(q) -> list[Term]:
    return [q] if isinstance(q, Term) else [] if isinstance(q, MatchAll) else _terms(q.left) + _terms(q.right)


def _lists(t: Term) -> dict[str, list[str]] | None:
    """The grams that a match must hold, by field, any of which may match; None if nothing bounds the term."""
    out = {}
    for field in [t.field] if t.field else FIELDS:
        if field in FIELDS:
            needle = fold(t.value)
            found = grams_of(needle) if field in SUBSTRING_FIELDS else [needle]
            if not found:
                return None
            out[field] = found
    return out


def plan(index: DataFrame, query: str, assets: int) -> Plan:
    """Candidates of a query over so many assets; the sizes of the lists that its grams name are looked up first."""
    q = parse(query)
    wanted = sorted({(f, g) for t in _terms(q) for f, gs in (_lists(t) or {}).items() for g in gs})
    sizes: dict[tuple[str, str], int] = {}
    if wanted:  # as many rows as the query has grams
        near = index.where(F.col("field").isin(sorted({f for f, _ in wanted})) & F.col("gram").isin(sorted({g for _, g in wanted})))
        sizes = {(r["field"], r["gram"]): r["n"] for r in near.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n")).collect()}

    def of_term(t: Term) -> tuple[DataFrame | None, int]:
        lists, found, bound = _lists(t), [], 0
        if lists is None:
            return None, assets
        for field, gs in lists.items():
            by_size = sorted(gs, key=lambda g: (sizes.get((field, g), 0), g))[:LISTS]
            if least := sizes.get((field, by_size[0]), 0):  # a gram that no asset holds: no match in this field
                bound += least
                rows = index.where((F.col("field") == field) & F.col("gram").isin(by_size))
                found.append(rows.select("asset_id") if len(by_size) == 1 else rows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(by_size)).select("asset_id"))
        if bound > SCAN_SHARE * assets:
            return None, assets
        return (reduce(DataFrame.unionByName, found).distinct() if found else index.select("asset_id").limit(0)), bound

    def of(node) -> tuple[DataFrame | None, int]:
        if isinstance(node, MatchAll):
            return None, assets
        if isinstance(node, Term):
            return of_term(node)
        left = of(node.left)
        if isinstance(node, Not):
            return left
        right = of(node.right)
        if isinstance(node, Or):
            if left[0] is None or right[0] is None:
                return None, assets
            return left[0].unionByName(right[0]).distinct(), left[1] + right[1]
        if left[0] is None or right[0] is None:
            return right if left[0] is None else left
        few, many = sorted((left, right), key=lambda c: c[1])
        return few[0].join(many[0], "asset_id", "left_semi"), few[1]

    found, bound = of(q)
    return Plan(found, assets, min(bound, assets)) if found is not None and bound <= SCAN_SHARE * assets else Plan(None, assets, assets)


def search_indexed(docs: DataFrame, index: DataFrame, query: str, assets: int | None = None) -> tuple[DataFrame, Plan]:
    """(rows as search.search gives them, unordered; how they were found). assets: how many documents there are, if that is known."""
    q = parse(query)
    how = plan(index, query, docs.count() if assets is None else assets)
    read = docs if how.candidates is None else docs.join(how.candidates, "asset_id", "left_semi")
    return read.where(predicate(q)).select("asset_id", explain(q).alias("explanations")), how
