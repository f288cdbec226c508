"""Search: two query dialects, compiled to Spark columns.

The boolean dialect has AND (also by adjacency), OR, prefix NOT, parentheses, phrases and field:value;
the simple dialect is a list of clauses joined by `and`. A query becomes a nullable array of
explanations (null: no match) and, for `where`, a boolean column without the explanations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.media import media_type
from lakeloom.functions.text import ascii_fold, extension, filename, fold

#: Fields in the order in which a bare term tries them; the first two match by substring.
FIELDS = ("filename", "path", "ext", "media", "codec", "container", "resolution", "tag")
SUBSTRING_FIELDS = ("filename", "path")


class QueryError(ValueError):
    """A query that can't be read; position is a byte offset."""

    def __init__(self, position: int, message: str) -> None:
        super().__init__(f"{message} at {position}")
        self.position, self.message = position, message


@dataclass(frozen=True)
class MatchAll:
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Term:
    value: str
    field: str | None = None
    phrase: bool = False

    def __str__(self) -> str:
        text = f'"{self.value}"' if self.phrase else self.value
        return f"{self.field}:{text}" if self.field else text


@dataclass(frozen=True)
class And:
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} AND {self.right})"


@dataclass(frozen=True)
class Or:
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} OR {self.right})"


@dataclass(frozen=True)
class Not:
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} NOT {self.right})"


def term_count(q) -> int:
    return {MatchAll: lambda: 0, Term: lambda: 1}.get(type(q), lambda: term_count(q.left) + term_count(q.right))()


_LEXEME = re.compile(rb'(?P<space>[ \t\n\r\x0c]+)|(?P<open>\()|(?P<close>\))|"(?P<phrase>[^"]*)"|(?P<broken>")|(?P<word>[^ \t\n\r\x0c()"]+)')
_KEYWORDS = ("AND", "OR", "NOT")


def tokenize(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, byte offset); kinds: word, phrase, AND, OR, NOT, open, close."""
    out = []
    for m in _LEXEME.finditer(text.encode()):
        kind = m.lastgroup
        if kind == "broken":
            raise QueryError(m.start(), "unterminated quoted phrase")
        value = m[kind].decode()
        if kind != "space":
            out.append((value if kind == "word" and value in _KEYWORDS else kind, value, m.start()))
    return out


def parse(text: str):
    """The syntax tree of a boolean query; OR binds least, then AND, then NOT, which takes one primary."""
    tokens = tokenize(text)
    if not tokens or [t[:2] for t in tokens] == [("word", "*")]:
        return MatchAll()
    shown = {"open": "`(`", "close": "`)`", "AND": "`AND`", "OR": "`OR`", "NOT": "`NOT`"}
    at = 0

    def kind() -> str | None:
        return tokens[at][0] if at < len(tokens) else None

    def climb(level: int):
        nonlocal at
        if level == 2:
            return unary()
        node = climb(level + 1)
        while (k := kind()) and (k == "OR" if level == 0 else k not in ("OR", "close")):
            if k in ("OR", "AND"):
                at += 1
            right = climb(level + 1)
            node = (Or if level == 0 else And)(node, right)
        return node

    def unary():
        nonlocal at
        if kind() == "NOT":
            at += 1
            return Not(MatchAll(), primary())
        return primary()

    def primary():
        nonlocal at
        if at >= len(tokens):
            raise QueryError(tokens[-1][2] + 1, "unexpected end of query")
        k, value, position = tokens[at]
        if k == "open":
            at += 1
            inside = climb(0)
            if kind() != "close":
                raise QueryError(position, "missing closing parenthesis")
            at += 1
            return inside
        if k not in ("word", "phrase"):
            raise QueryError(position, f"unexpected {shown[k]}")
        at += 1
        name, colon, rest = value.partition(":")
        if k == "word" and colon and name and rest:
            return Term(rest, fold(name))
        return Term(value, None, k == "phrase")

    tree = climb(0)
    if at < len(tokens):
        k, value, position = tokens[at]
        raise QueryError(position, f"unexpected {shown.get(k) or f'term `{value}`'}")
    return tree


def search_docs(assets: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """assets (asset_id, path, technical fields) to asset_id and one array column for each field."""
    name = filename(F.col("path"))
    ext = extension(name)
    has = lambda c: F.col(c) if c in assets.columns else F.lit(None).cast("string")
    res = F.when(has("width").isNotNull() & has("height").isNotNull(), F.concat(has("width").cast("string"), F.lit("x"), has("height").cast("string")))
    one = lambda c: F.array_compact(F.array(c))
    docs = assets.select(
        "asset_id", one(name).alias("filename"), one(F.col("path")).alias("path"), one(F.when(ext != "", ext)).alias("ext"),
        one(F.coalesce(has("media_type"), media_type(ext))).alias("media"), F.array_compact(F.array(has("video_codec"), has("audio_codec"))).alias("codec"),
        one(has("container")).alias("container"), one(res).alias("resolution"),
    )
    empty = F.array().cast("array<string>")
    if tags is None:
        return docs.withColumn("tag", empty)
    labels = tags.groupBy("asset_id").agg(F.array_sort(F.collect_list("label")).alias("tag"))
    return docs.join(labels, "asset_id", "left").withColumn("tag", F.coalesce("tag", empty))


def _field_hits(field: str, needle: str) -> Column:
    test = (lambda v: F.contains(ascii_fold(v), F.lit(needle))) if field in SUBSTRING_FIELDS else (lambda v: ascii_fold(v) == needle)
    return F.filter(F.col(field), test)


def _explain_term(t: Term) -> Column:
    def one(field: str) -> Column:
        if field not in FIELDS:
            return F.lit(None).cast("array<string>")
        first = F.get(_field_hits(field, fold(t.value)), F.lit(0))
        return F.when(first.isNotNull(), F.array(F.concat(F.lit(f'{field} matches "{t.value}" ('), first, F.lit(")"))))

    return one(t.field) if t.field else F.coalesce(*(one(f) for f in FIELDS))


def explain(q) -> Column:
    """Explanations of a match, or null."""
    if isinstance(q, MatchAll):
        return F.array(F.lit("matches all assets"))
    if isinstance(q, Term):
        return _explain_term(q)
    left, right = explain(q.left), explain(q.right)
    if isinstance(q, And):
        return F.when(left.isNotNull() & right.isNotNull(), F.concat(left, right))
    if isinstance(q, Not):
        return F.when(right.isNull(), left)
    empty = F.array().cast("array<string>")
    return F.when(left.isNotNull() | right.isNotNull(), F.concat(F.coalesce(left, empty), F.coalesce(right, empty)))


def predicate(q) -> Column:
    """Whether the query matches; cheap, for filters."""
    if isinstance(q, MatchAll):
        return F.lit(True)
    if isinstance(q, Term):
        fields = [q.field] if q.field else FIELDS
        hit = F.lit(False)
        for f in fields:
            if f in FIELDS:
                hit = hit | (F.size(_field_hits(f, fold(q.value))) > 0)
        return hit
    left, right = predicate(q.left), predicate(q.right)
    return left & right if isinstance(q, And) else left & ~right if isinstance(q, Not) else left | right


def search(docs: DataFrame, query: str, ordered: bool = True) -> DataFrame:
    """Boolean search: (asset_id, explanations) of matching documents, by id."""
    q = parse(query)
    out = docs.where(predicate(q)).select("asset_id", explain(q).alias("explanations"))
    return out.orderBy("asset_id") if ordered else out


def parse_simple(text: str) -> list[tuple[str, str]]:
    """(field, value) clauses of the simple dialect."""
    words = text.split()
    if not words:
        raise QueryError(0, "empty query")
    clauses, now = [], []
    for w in [*words, "and"]:
        if fold(w) != "and":
            now.append(w)
            continue
        clause, now = " ".join(now), []
        if not clause:
            raise QueryError(0, "empty clause")
        name, colon, value = (x.strip() for x in clause.partition(":"))
        if colon and not (name and value):
            raise QueryError(0, clause)
        clauses.append((fold(name), value) if colon else ("text", clause))
    return clauses


def search_simple(entries: DataFrame, query: str) -> DataFrame:
    """entries (asset_id, filename, codec, tags, notes): matches with the reasons of every clause."""
    keep, reasons = F.lit(True), []
    for field, value in parse_simple(query):
        needle = F.lit(fold(value))
        inside = lambda c: F.contains(ascii_fold(F.coalesce(c, F.lit(""))), needle)  # noqa: B023, E731
        tagged = F.exists("tags", inside)
        keep = keep & {"codec": inside(F.col("codec")), "tag": tagged, "note": inside(F.col("notes")), "notes": inside(F.col("notes"))}.get(field, inside(F.col("filename")) | tagged | inside(F.col("notes")))
        reasons += [
            F.array_compact(F.array(F.when(inside(F.col("filename")), F.lit(f"filename contains '{value}'")), F.when(inside(F.col("codec")), F.concat(F.lit("codec '"), F.col("codec"), F.lit("' matches"))))),
            F.transform(F.filter("tags", inside), lambda t: F.concat(F.lit("tag '"), t, F.lit("' matches"))),
            F.array_compact(F.array(F.when(inside(F.col("notes")), F.lit("notes match")))),
        ]
    return entries.where(keep).select("asset_id", F.concat(*reasons).alias("explanations")).orderBy("asset_id")


def simple_entries(assets: DataFrame, tags: DataFrame) -> DataFrame:
    """Entries of the simple dialect: labels that are not rejected; notes are always empty."""
    labels = tags.where(~F.coalesce(F.col("rejected"), F.lit(False))).groupBy("asset_id").agg(F.array_sort(F.collect_list("label")).alias("tags"))
    return assets.join(labels, "asset_id", "left").select("asset_id", filename(F.col("path")).alias("filename"), "codec", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.lit("").alias("notes"))


class SearchLayer(Enum):
    """Where a match comes from: deterministic fields, words of text, or similarity with a score from 0 to 1."""

    METADATA = "metadata"
    FULL_TEXT = "full-text"
    SEMANTIC = "semantic"


def semantic_entries(entries: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """entries (asset_id, ...) with embedding, embedding_source and has_embedding from vectors (asset_id, embedding, source); without vectors all are text only."""
    if vectors is None:
        out = entries.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("embedding_source", F.lit(None).cast("string"))
    else:
        out = entries.join(vectors.select("asset_id", F.col("embedding").cast("array<float>").alias("embedding"), F.col("source").alias("embedding_source")), "asset_id", "left")
    return out.withColumn("has_embedding", F.col("embedding").isNotNull())


def cosine_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k vectors most similar to the query by cosine; a scan with a bounded heap in each task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    v = F.col(vec_col)
    score = F.when(F.size(v) == len(query), dot(v, q) / (F.sqrt(dot(v, F.transform(v, lambda x: x.cast("double")))) * norm))
    return vectors.select(id_col, score.alias("similarity")).where("similarity is not null").orderBy(F.desc("similarity"), id_col).limit(k)
