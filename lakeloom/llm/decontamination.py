"""Benchmark decontamination by a distributed positional inverted index (DataFrame operations only).

The index is a table of postings (term, key, position) of the training tokens whose words the benchmark holds, with one
posting more a document, of term HEADER, that says which document a key is. A task indexes the documents it reads and
sorts its postings by term, so each file is a shard that holds the lists of its documents: texts are never shuffled.

A query is a set of terms, each with the offsets at which it may stand from the start of a match: a phrase has one
offset a term, a proximity query all offsets of its span. Starts come from the list of a query's rarest term, adjusted
by its offsets; the lists of the second and third rarest are intersected with them by an equi-join on key and position,
each reading only those terms' lists; what is left, by then few, meets all other lists at once. What is compared are
whole lists, so matches are exact and nothing is compared in pairs of texts.

Defined results: null texts have no words, and no hit; an item without words has no window; items that repeat are one
by id, and an item without id makes hits but isn't listed or counted. Repeated documents and documents without id each
have their own row. Empty tables give no hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.llm.common import Workspace, ascii_lower, documents

#: What parts words, with A-Z left in them: they are lower-cased word by word.
PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A word that no text has, and its number; it heads the postings of each document.
HEAD_WORD, HEADER = "\x00", -1
#: Rows and bytes of a table at most that is sent to all executors; larger ones are joined by a shuffle.
SENT_ROWS, SENT_BYTES = 1 << 18, 16 << 20
#: Lists that are intersected one by one, rarest first, before all others at once.
SINGLY = 3


def lowered(word: Column) -> Column:
    """A-Z to a-z and nothing else; a word of ASCII alone the short way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word))


def words_of(text: Column) -> Column:
    """The words with an empty string before and after them where the text begins and ends with what parts words."""
    return F.split(text, PARTING, -1)


def _number(words: Column) -> Column:
    """Number of words in what words_of() gives."""
    return (F.size(words) - (F.get(words, F.lit(0)) == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def _small(df: DataFrame, bytes_of: Column | None = None) -> DataFrame:
    """df to be broadcast if its rows and bytes are below the bounds, else as it is."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(bytes_of if bytes_of is not None else F.lit(0))).first()
    return F.broadcast(df) if n <= SENT_ROWS and (size or 0) <= SENT_BYTES else df


def vocabulary(items: DataFrame) -> DataFrame:
    """(word, term): the distinct words of (text), numbered from 0 on with gaps."""
    words = items.select(F.explode(words_of(F.col("text"))).alias("word")).where("word <> ''").select(lowered(F.col("word")).alias("word")).distinct()
    return words.withColumn("term", F.monotonically_increasing_id())


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, key, pos, doc_id, n_words) of (doc_id, text); the last two are set for HEADER alone.

    key numbers the rows of docs, so write the table before it is used twice. Positions of a document are consecutive.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", words_of(F.col("text")).alias("words"))
    tokens = keyed.select("key", "doc_id", _number(F.col("words")).alias("n_words"), F.posexplode(F.concat(F.array(F.lit(HEAD_WORD)), "words")).alias("pos", "word"))
    tokens = tokens.select("key", "doc_id", "n_words", "pos", lowered(F.col("word")).alias("word"))
    head = terms.sparkSession.range(1).select(F.lit(HEAD_WORD).alias("word"), F.lit(HEADER).cast("long").alias("term"))
    listed = tokens.join(_small(terms.select("word", "term").unionByName(head), F.octet_length("word")), "word")
    of_head = lambda c: F.when(F.col("term") == HEADER, F.col(c)).alias(c)
    return listed.select("term", "key", "pos", of_head("doc_id"), of_head("n_words")).sortWithinPartitions("term", "key", "pos")


def ranked_terms(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, term, offsets) with rank 1, 2, ... from the rarest term on, and n, the number of them.

    Queries with a term that the index doesn't hold are left out: they can't match.
    """
    listed = postings.where(F.col("term") > HEADER).groupBy("term").agg(F.count(F.lit(1)).alias("listed"))
    by_query = Window.partitionBy("query")
    known = queries.join(_small(listed), "term", "left").withColumn("missing", F.max(F.col("listed").isNull()).over(by_query)).where("not missing")
    return known.select("query", "term", "offsets", F.row_number().over(by_query.orderBy("listed", "term", "offsets")).alias("rank"), F.count(F.lit(1)).over(by_query).alias("n"))


def match(postings: DataFrame, queries: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(query, n, key, start) of all matches of (query, term, offsets): each of its n terms stands at one of its offsets from start."""
    lists = postings.where(F.col("term") > HEADER).select("term", "key", "pos")
    ranked = ws.put(ranked_terms(queries, lists), f"{name}_terms")
    single = ranked.where(F.size("offsets") > 1).isEmpty()
    place = [F.max(F.when(F.col("rank") == r, F.struct("term", "offsets"))).alias(f"at{r}") for r in range(1, SINGLY + 1)]
    plans = ws.put(ranked.where(F.col("rank") <= SINGLY).groupBy("query", "n").agg(*place), f"{name}_plans")
    once = lambda df: df if single else df.distinct()  # noqa: E731  another posting may give the same start

    # The rarest lists, adjusted by their offsets.
    later = [f"at{r}" for r in range(2, SINGLY + 1)]
    rare = lists.join(_small(plans.withColumn("term", F.col("at1.term"))), "term")
    found = rare.select("query", "n", "key", F.explode(F.transform("at1.offsets", lambda o: F.col("pos") - o)).alias("start"), *later)
    found = ws.put(once(found), f"{name}_1")

    # The next rarest, one by one: of all lists only those of these terms are read on.
    for r in range(2, SINGLY + 1):
        at, later = f"at{r}", later[1:]
        terms = _small(plans.where(F.col(at).isNotNull()).select(F.col(f"{at}.term").alias("term")).distinct())
        seen = lists.join(terms, "term", "left_semi")
        if r > 2:
            seen = seen.join(_small(found.select("key").distinct()), "key", "left_semi")
        wanted = found.where(F.col("n") >= r).select("query", "n", "key", "start", *later, F.col(f"{at}.term").alias("term"), F.explode(F.transform(f"{at}.offsets", lambda o: F.col("start") + o)).alias("pos"))
        stay = wanted.join(seen, ["key", "pos", "term"], "left_semi").select("query", "n", "key", "start", *later)
        found = ws.put(once(stay).unionByName(found.where(F.col("n") < r).select("query", "n", "key", "start", *later)), f"{name}_{r}")
        ws.drop(f"{name}_{r - 1}")

    # All others at once: a start stays if each of them has it.
    seen = lists.join(_small(found.where(F.col("n") > SINGLY).select("key").distinct()), "key", "left_semi")
    rest = _small(ranked.where(F.col("rank") > SINGLY).select("query", "rank", "term", "offsets"))
    wanted = found.where(F.col("n") > SINGLY).join(rest, "query").select("query", "n", "key", "start", "rank", "term", F.explode(F.transform("offsets", lambda o: F.col("start") + o)).alias("pos"))
    met = once(wanted.join(seen, ["key", "pos", "term"], "left_semi").select("query", "n", "key", "start", "rank"))
    whole = met.groupBy("query", "n", "key", "start").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") == F.col("n") - SINGLY).drop("met")
    out = ws.put(whole.unionByName(found.where(F.col("n") <= SINGLY)), name)
    for step in (f"{name}_{SINGLY}", f"{name}_terms", f"{name}_plans"):
        ws.drop(step)
    return out


def _item_words(text: Column) -> Column:
    return F.transform(F.filter(words_of(text), lambda w: w != ""), lowered)


def windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words): all runs of `window` words of each (item_id, text); a shorter text that has words is one."""
    words = items.select("item_id", _item_words(F.col("text")).alias("all")).where(F.size("all") > 0)
    return words.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0))), lambda i: F.slice("all", i + 1, window))).alias("words"))


def _terms_of(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, term, offset) of (query, words)."""
    return queries.select("query", F.posexplode("words").alias("offset", "word")).join(_small(terms, F.octet_length("word")), "word").select("query", "term", "offset")


def near(postings: DataFrame, terms: DataFrame, queries: DataFrame, span: int, ws: Workspace) -> DataFrame:
    """Proximity: (query, key, start) where a word of (query, text) stands and from where on all its words stand within `span` words, in any order."""
    asked = queries.select("query", F.array_distinct(_item_words(F.col("text"))).alias("words")).where(F.size("words") > 0)
    held = ws.put(asked.join(_terms_of(asked, terms).groupBy("query").agg(F.collect_set("term").alias("terms")), "query").where(F.size("words") == F.size("terms")), "near_queries")
    each = held.select("query", F.explode("terms").alias("term"))
    found = match(postings, each.select("query", "term", F.sequence(F.lit(0), F.lit(span - 1)).alias("offsets")), ws, "near")
    begins = found.join(_small(each), "query").select("query", "key", "start", "term", F.col("start").alias("pos"))
    return begins.join(postings.select("term", "key", "pos"), ["term", "key", "pos"], "left_semi").select("query", "key", "start").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurring window), n_items, items (their ids, sorted as strings, with commas), contaminated."""
    ws = Workspace(docs.sparkSession, "decontamination")
    bench = items.select(F.col(item_col).cast("string").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    terms = ws.put(vocabulary(bench), "vocabulary")
    postings = ws.put(index(documents(docs, id_col, text_col), terms), "postings")

    runs = ws.put(windows(bench, window), "windows")
    phrases = ws.put(runs.select("words").distinct().withColumn("query", F.monotonically_increasing_id()), "phrases")
    of_item = ws.put(runs.where("item_id is not null").join(phrases, "words").select("query", "item_id").distinct(), "items")
    found = match(postings, _terms_of(phrases, terms).select("query", "term", F.array("offset").alias("offsets")), ws, "matches")
    for step in ("windows", "phrases"):
        ws.drop(step)

    # A word in several windows counts once: each adds what lies beyond the furthest end before it.
    end = F.col("start") + F.col("n")
    before = F.max(end).over(Window.partitionBy("key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.select("key", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.col("start")))).alias("fresh"))
    hits = fresh.groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    listed = found.select("key", "query").distinct().join(_small(of_item, F.octet_length("item_id")), "query").select("key", "item_id").distinct()
    listed = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("items"))
    heads = postings.where(F.col("term") == HEADER).select("key", "doc_id", "n_words")
    joined = heads.join(hits, "key", "left").join(listed, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items", F.lit("")).alias("items"), (zero("n_hit") > 0).alias("contaminated"))
