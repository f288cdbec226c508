"""URL filters by a temporal list join (DataFrame operations only).

List entries are dated events (add or remove a pattern). Per list and pattern they become validity intervals
[from, until), which don't overlap. A capture's keys are its host and the host's parent domains, and its host with each directory of its path and
with the whole path, with and without a slash at the end; of these only those as long as some pattern are made, so what
a capture sends is bounded by the lists and not by its url. Captures meet the lists that ever had one of their keys; an
as-of join takes each list's last interval that began by the fetch time, which holds if it has not ended: intervals and
captures of a pattern stand in one order of time, so a long history costs no more than its intervals.

Keys that many captures have are salted on both sides by their number of captures, so one host can't fill a task.

Defined results: urls without a host and null urls or times match nothing; of events of one pattern at
one time the removal wins, and an event counts at its own time; a prefix without a slash at the end covers that path and
what is below it, and no longer name; repeated captures keep their number of rows; empty lists and empty captures
give no matches and no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.llm.common import HOT_SHARE, Workspace, ascii_lower

#: Captures that a key may have without being salted.
HOT_ROWS = 256
#: Copies of a capture that are written out at once.
COPIES = 1 << 16


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, action, at) to (list, kind, pattern, valid_from, valid_until); open ends are null."""
    events = entries.select("list", "kind", ascii_lower(F.col("pattern")).alias("pattern"), "action", F.col("at").cast("timestamp").alias("at")).where("pattern is not null and at is not null")
    w = Window.partitionBy("list", "kind", "pattern").orderBy("at", F.when(F.col("action") == "add", 0).otherwise(1))
    spans = events.withColumn("valid_until", F.lead("at").over(w)).where(F.col("action") == "add")
    return spans.where("valid_until is null or valid_until > at").select("list", "kind", "pattern", F.col("at").alias("valid_from"), "valid_until")


def _parts(url):
    """Host, and host with path, of a url, lower-cased; an empty host if it has none."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    authority = F.regexp_extract(rest, "^([^/]*)", 1)
    host = ascii_lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r"\.?(:[0-9]*)?$", ""))
    return host, F.concat(host, ascii_lower(F.substr(rest, F.length(authority) + 1)))


def _keys(host, whole, domains: list[int], prefixes: list[int]):
    """Keys of a capture: structs (kind, pattern), of the lengths that patterns of each kind have."""
    kind = "array<struct<kind:string,pattern:string>>"
    at = lambda text, i: F.substring(text, i, F.lit(1))
    n, size = F.length(host), F.length(whole)
    of = lambda name, lengths, ok, cut: F.transform(F.filter(F.lit(lengths), ok), lambda k: F.struct(F.lit(name).alias("kind"), cut(k).alias("pattern"))) if lengths else F.array().cast(kind)
    # A domain begins the host or stands behind a dot; a prefix ends with a slash, or before one, or with the path.
    above = of("domain", domains, lambda k: (k == n) | ((k < n) & (at(host, n - k) == ".")), lambda k: F.substring(host, n - k + 1, k))
    ends = lambda k: (at(whole, k) == "/") | (k == size) | (at(whole, k + 1) == "/")
    below = of("prefix", prefixes, lambda k: (k > n) & (k <= size) & ends(k), lambda k: F.substring(whole, F.lit(1), k))
    return F.when(n > 0, F.concat(above, below)).otherwise(F.array().cast(kind))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "capture_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Per row of captures: id, fetched_at, blocked, n_active, lists (names, sorted) and the most specific pattern."""
    ws = Workspace(captures.sparkSession, "url_filter")
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).cast("timestamp").alias("at")).groupBy("id", "url", "at").agg(F.count(F.lit(1)).alias("copies"))
    rows = ws.put(rows.withColumn("row", F.monotonically_increasing_id()), "captures")
    spans = ws.put(intervals(entries), "intervals")
    named = spans.select("kind", "pattern", "list").distinct()
    # As many lengths as the longest pattern has characters at most.
    lengths = {r["kind"]: sorted(r["n"]) for r in named.groupBy("kind").agg(F.collect_set(F.length("pattern")).alias("n")).collect()}
    host, whole = _parts(F.col("url"))
    split = rows.where("at is not null").select("row", "at", host.alias("host"), whole.alias("whole"))
    keys = _keys(F.col("host"), F.col("whole"), lengths.get("domain", []), lengths.get("prefix", []))
    keyed = split.select("row", "at", F.explode(keys).alias("k")).select("row", "at", "k.kind", "k.pattern")
    # Only keys that some list ever had go on.
    keyed = ws.put(keyed.join(named.select("kind", "pattern").distinct(), ["kind", "pattern"], "left_semi"), "keys")
    sizes = keyed.groupBy("kind", "pattern").count()
    limit = max(HOT_ROWS, (sizes.agg(F.sum("count")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(sizes.where(F.col("count") > limit).select("kind", "pattern", (F.col("count") / limit).cast("int").alias("more")))  # HOT_SHARE keys at most
    salted = lambda df: df.join(hot, ["kind", "pattern"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
    left = salted(keyed).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("more") + 1).cast("int"))
    every = lambda df: salted(df).withColumn("salt", F.explode(F.sequence(F.lit(0), "more")))
    met = left.join(every(named), ["kind", "pattern", "salt"]).select("list", "kind", "pattern", "salt", "at", "row", F.lit(None).cast("struct<until:timestamp>").alias("span"))
    begun = every(spans).select("list", "kind", "pattern", "salt", F.col("valid_from").alias("at"), F.lit(None).cast("long").alias("row"), F.struct(F.col("valid_until").alias("until")).alias("span"))
    w = Window.partitionBy("list", "kind", "pattern", "salt").orderBy("at", F.col("row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = met.unionByName(begun).withColumn("span", F.last("span", ignorenulls=True).over(w))
    active = last.where("row is not null and span is not null and (span.until is null or at < span.until)")
    best = F.min(F.struct(-F.length("pattern"), F.col("pattern"))).getField("pattern")
    found = active.groupBy("row").agg(F.count(F.lit(1)).alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), best.alias("pattern"))
    out = rows.join(found, "row", "left").withColumn("block", F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / COPIES).cast("int"))))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("copies") - F.col("block") * COPIES).cast("int"))))
    n = F.coalesce("n_active", F.lit(0))
    return out.select(F.col("id").alias(id_col), F.col("at").alias("fetched_at"), (n > 0).alias("blocked"), n.alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), "pattern")
