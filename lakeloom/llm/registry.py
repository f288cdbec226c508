"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lakeloom.llm import bpe, class_lm, decontamination, exact_dedup, importance, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, toxicity, url_filter, vector_codes
from lakeloom.llm.common import crc_mod, read_documents


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.deduplicate(read_documents(spark, sf_dir)).drop("bucket", "chain", "text_key")


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""

def op3_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode(read_documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_decoded=True)
    return out.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_class_lm(spark, sf_dir):
    return class_lm.score(read_documents(spark, sf_dir), crc_mod(F.col("doc_id"), 10) == 0)


def op10_packing(spark, sf_dir):
    return packing.pack(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op7_quality_rules(spark, sf_dir):
    return quality_rules.judge(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"))


def _captures(spark, sf_dir):
    """Pages with a fetch time each, made from the id: the tables have none."""
    day = F.expr("cast(page_id % 365 as int)")
    return read_documents(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01"), day).cast("timestamp").alias("fetched_at"))


def _list_entries(captures):
    """Dated list entries on the hosts that occur, made from a hash of the host: the tables have none."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    hosts = captures.select(host.alias("host")).distinct().where("host <> ''").withColumn("v", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int") % 365)
    day = lambda n: F.date_add(F.lit("2024-01-01"), n).cast("timestamp")
    entry = lambda df, name, kind, pattern, action, at: df.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), at.alias("at"))
    even, third, fifth = hosts.where("v % 2 = 0"), hosts.where("v % 6 = 0"), hosts.where("v % 5 = 0")
    parents = hosts.select(F.substring_index("host", ".", -2).alias("host")).distinct().where("host like '%.org'")
    parts = [
        entry(even, "hosts", "domain", F.col("host"), "add", day(F.col("v"))),
        entry(third, "hosts", "domain", F.col("host"), "remove", day(F.col("v") + 60)),
        entry(third, "hosts", "domain", F.col("host"), "add", day(F.col("v") + 120)),
        entry(fifth, "paths", "prefix", F.concat("host", F.lit("/de/")), "add", day(F.col("v"))),
        entry(parents, "parents", "domain", F.col("host"), "add", day(F.lit(200))),
        entry(parents, "parents", "domain", F.col("host"), "remove", day(F.lit(260))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op8_url_filter(spark, sf_dir):
    captures = _captures(spark, sf_dir)
    return url_filter.evaluate(captures, _list_entries(captures), "page_id").withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd"))


OP8_SQL = r"""
WITH caps AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS d,
         regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages
), hosts AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) % 365 AS v FROM (SELECT DISTINCT host FROM caps WHERE host <> '')
), spans AS (
  SELECT 'hosts' AS list, host AS pattern, 'h' AS kind, v AS a, CASE WHEN v % 6 = 0 THEN v + 60 ELSE 999999 END AS b FROM hosts WHERE v % 2 = 0
  UNION ALL SELECT 'hosts', host, 'h', v + 120, 999999 FROM hosts WHERE v % 6 = 0
  UNION ALL SELECT 'paths', host || '/de/', 'p', v, 999999 FROM hosts WHERE v % 5 = 0
  UNION ALL SELECT DISTINCT 'parents', regexp_extract(host, '([^.]*[.][^.]*)$', 1), 'h', 200, 260 FROM hosts WHERE host LIKE '%.org'
), m AS (
  SELECT c.page_id, s.list, s.pattern FROM caps c JOIN spans s
    ON ((s.kind = 'h' AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern))) OR (s.kind = 'p' AND starts_with(c.host || c.path, s.pattern)))
   AND date_diff('day', DATE '2024-01-01', c.d) >= s.a AND date_diff('day', DATE '2024-01-01', c.d) < s.b
), g AS (
  SELECT page_id, count(*) AS n_active, (SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT DISTINCT m2.list AS l FROM m m2 WHERE m2.page_id = m.page_id)) AS lists,
         first(pattern ORDER BY length(pattern) DESC, pattern) AS pattern FROM m GROUP BY page_id
)
SELECT c.page_id, strftime(c.d, '%Y-%m-%d') AS fetched_at, g.page_id IS NOT NULL AS blocked, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, pattern
FROM caps c LEFT JOIN g USING (page_id)
"""

def op1_toxicity(spark, sf_dir):
    return toxicity.classify(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) == 2)


def op5_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) == 1)


def op4_ngram_join(spark, sf_dir):
    return ngram_join.join(read_documents(spark, sf_dir), words=4, percent=85)


def op9_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.deduplicate(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_vector_codes(spark, sf_dir):
    coded, books = vector_codes.encode(read_documents(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """A round is a statement of its own: parts are coded against the codebook of the round before, which means replace."""
    coded = lambda r: f"""
c{r} AS MATERIALIZED (
  SELECT vec_id, p, e, d FROM (
    SELECT v.vec_id, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN b{r} b USING (p, i) GROUP BY ALL
  ) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1
)"""  # noqa: E731
    book = lambda r: f"""
b{r} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, coalesce(m.x, b.x) AS x FROM b{r - 1} b LEFT JOIN (
    SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM v JOIN c{r - 1} USING (vec_id, p) GROUP BY ALL
  ) m USING (p, e, i)
)"""  # noqa: E731
    steps = ",".join(coded(r) + "," + book(r + 1) for r in range(rounds)) + "," + coded(rounds)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT vec_id, (k - 1) // (n // {parts}) AS p, (k - 1) % (n // {parts}) AS i, x FROM (
    SELECT vec_id, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS k, CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)
), b0 AS MATERIALIZED (
  SELECT p, e, i, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}) USING (vec_id)
),{steps}, r AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM c{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
FROM r JOIN kept USING (vec_id)
"""


def op12_importance(spark, sf_dir):
    return importance.resample(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))


#: A word's crc32 in SQL: its bytes, one by one, through a table that follows from the polynomial.
OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS b, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), u AS MATERIALIZED (SELECT doc_id, unnest(w) AS w FROM d),
words AS MATERIALIZED (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM u UNION ALL SELECT w FROM b)),
bucket AS MATERIALIZED (
  SELECT w, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 10000 AS k FROM words, crc
), s AS (SELECT k, count(*) AS s FROM u JOIN bucket USING (w) GROUP BY k), t AS (SELECT k, count(*) AS t FROM b JOIN bucket USING (w) GROUP BY k),
n AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM u) AS s_all, (SELECT CAST(count(*) AS DOUBLE) FROM b) AS t_all),
gain AS MATERIALIZED (
  SELECT k, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (k), n
), weight AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM u JOIN bucket USING (w) JOIN gain USING (k) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weight USING (doc_id)
), placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""


def op13_decontamination(spark, sf_dir):
    out = decontamination.decontaminate(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS MATERIALIZED (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
), found AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM places JOIN win USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op1_toxicity": op1_toxicity,
    "op5_quality_classifier": op5_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op3_bpe": op3_bpe,
    "op6_class_lm": op6_class_lm,
    "op10_packing": op10_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance": op12_importance,
    "op13_decontamination": op13_decontamination,
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op8_url_filter": OP8_SQL, "op11_vector_codes": _op11_sql(), "op12_importance": OP12_SQL, "op13_decontamination": OP13_SQL}
