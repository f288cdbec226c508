"""The named queries over the driver's tables, and their SQL.

Documents stand for assets: doc_id is the asset, source the archive, lang the codec, sha256(text) the
fingerprint, and the path ends in an extension that follows from the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import media, text
from lakeloom.operators import dedupe, health, scenes, search, tagging, textindex
from lakeloom.plans import indexing
from lakeloom.sources import archive, store
from lakeloom.sources.cut import checkpointed
from lakeloom.streaming import event_counts

EXTENSIONS = ("mkv", "mp4", "wav", "flac", "jpg", "txt", "ogg", "opus", "mov", "aiff", "webm", "dpx")
_EXT_SQL = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + f"][1 + doc_id % {len(EXTENSIONS)}]"
_PATH_SQL = f"source || '/' || lang || '/Doc_' || doc_id || '.' || {_EXT_SQL}"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*(F.lit(e) for e in EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("asset_id"), F.col("source").alias("archive"),
        F.concat("source", F.lit("/"), "lang", F.lit("/Doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        text.fingerprint(F.col("text")).alias("fingerprint"), F.col("n_chars").alias("size_bytes"), F.col("lang").alias("video_codec"), F.col("lang").alias("codec"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"), "quality", "toxic")
    both = labels.where("quality = 1").select("asset_id", F.lit(" High-Quality ").alias("label")).unionByName(labels.where("toxic = 1").select("asset_id", F.lit("toxic").alias("label")))
    return both.select("*", F.lit("local").alias("source"), F.lit("m").alias("model"), F.when(F.col("asset_id") % 2 == 0, "1").otherwise("2").alias("version"), F.lit(None).cast("string").alias("provider"), (F.col("asset_id") % 5 == 0).alias("rejected"))


_TAGS_SQL = """tags AS (
  SELECT doc_id AS asset_id, ' High-Quality ' AS label, CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '2' END AS version, doc_id % 5 = 0 AS rejected FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'toxic', CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '2' END, doc_id % 5 = 0 FROM labels WHERE toxic = 1)"""
_ASSETS_SQL = f"assets AS (SELECT doc_id AS asset_id, source AS archive, {_PATH_SQL} AS path, sha256(text) AS fingerprint, n_chars AS size_bytes, lang AS codec, {_EXT_SQL} AS ext FROM documents)"
_TYPES = "CASE WHEN ext IN ('mkv','mp4','mov','webm') THEN 'video' WHEN ext IN ('wav','flac','ogg','opus','aiff') THEN 'audio' WHEN ext IN ('jpg','dpx') THEN 'image' ELSE 'other' END"


def _joined(df: DataFrame) -> DataFrame:
    return df.select("asset_id", F.array_join("explanations", "; ").alias("explanations"))


def _docs(spark, sf_dir):
    return search.search_docs(assets(spark, sf_dir), tags(spark, sf_dir).where("not rejected"))


BOOLEAN_QUERY = "codec:EN AND (doc_1 OR tag:toxic) OR media:image"


def search_boolean(spark, sf_dir):
    return _joined(search.search(_docs(spark, sf_dir), BOOLEAN_QUERY))


def search_not_prefix(spark, sf_dir):
    return _joined(search.search(_docs(spark, sf_dir), "doc_2 NOT media:audio"))


def search_simple(spark, sf_dir):
    return _joined(search.search_simple(search.simple_entries(assets(spark, sf_dir), tags(spark, sf_dir)), "tag:quality and codec:E and doc_"))


def search_indexed(spark, sf_dir):
    """The boolean query by the trigram index, which is made anew here."""
    docs = _docs(spark, sf_dir)
    rows, _ = textindex.search_indexed(docs, checkpointed(textindex.grams(docs)), BOOLEAN_QUERY)
    return _joined(rows)


SUBSTRING_QUERY = "oc_12 NOT ext:wav OR path:/doc_77"


def search_substring(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows, _ = textindex.search_indexed(docs, checkpointed(textindex.grams(docs)), SUBSTRING_QUERY)
    return _joined(rows)


def exact_duplicates(spark, sf_dir):
    return dedupe.exact_duplicates(assets(spark, sf_dir)).select("group_id", "fingerprint", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def waste_report(spark, sf_dir):
    a = assets(spark, sf_dir)
    return dedupe.waste_report(dedupe.exact_members(a), a)


def groups_for_archive(spark, sf_dir):
    a = assets(spark, sf_dir)
    return dedupe.groups_for_archive(dedupe.exact_members(a), a)


def _hashes(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), dedupe.sign_bits(F.col("embedding")).alias("hash"))


def hamming_pairs(spark, sf_dir):
    return dedupe.hamming_pairs(_hashes(spark, sf_dir), 18)


def hamming_leaders(spark, sf_dir):
    return dedupe.leader_groups(_hashes(spark, sf_dir), 18)


AUDIO_RADIUS = 0.3


def audio_pairs(spark, sf_dir):
    """Vectors' first 16 components stand for fingerprints of eight windows, those of every fifth vector for five."""
    prints = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", F.lit(1), F.when(F.col("vec_id") % 5 == 0, 10).otherwise(16)).alias("fingerprint"))
    return dedupe.audio_duplicates(prints, AUDIO_RADIUS)[0].select("a", "b", F.round("distance", 6).alias("distance"))


def cosine_topk(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    first = vectors.orderBy("vec_id").select("embedding").first()
    return search.cosine_topk(vectors, list(first[0]) if first else [], 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


def euclid_topk(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    first = vectors.orderBy("vec_id").select(F.col("embedding").alias("q")).limit(1)
    near = vectors.crossJoin(F.broadcast(first)).select("vec_id", dedupe.euclid(F.col("embedding"), F.col("q")).alias("d"))  # one row
    return near.orderBy("d", "vec_id").limit(20).select("vec_id", F.round("d", 6).alias("distance"))


def scene_cuts(spark, sf_dir):
    scored = _table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), "ts", "event_id", F.col("value").alias("score"))
    out = scenes.split_scenes(scored, 90.0, 25.0, order=("ts", "event_id"))
    return out.select("asset_id", "scene", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def scenes_merged(spark, sf_dir):
    scored = _table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), "ts", "event_id", F.col("value").alias("score"))
    out = scenes.merge_short_scenes(scenes.split_scenes(scored, 90.0, 25.0, order=("ts", "event_id")), 0.2)
    return out.select("asset_id", "scene", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def _scan(spark, sf_dir):
    """A later scan: a seventh of the files gone, a fifth grown, and new copies of a ninth under another path."""
    a = assets(spark, sf_dir).where("asset_id % 7 <> 3")
    kept = a.select("path", (F.col("size_bytes") + F.when(F.col("asset_id") % 5 == 0, 1).otherwise(0)).alias("size_bytes"), "fingerprint")
    moved = assets(spark, sf_dir).where("asset_id % 9 = 3").select(F.concat(F.lit("moved/"), "path").alias("path"), "size_bytes", "fingerprint")
    return kept.unionByName(moved).withColumn("modified_time", F.lit("2024-01-01").cast("timestamp"))


_SCAN_SQL = """scan AS (
  SELECT path, size_bytes + CASE WHEN asset_id % 5 = 0 THEN 1 ELSE 0 END AS size_bytes, fingerprint FROM assets WHERE asset_id % 7 <> 3
  UNION ALL SELECT 'moved/' || path, size_bytes, fingerprint FROM assets WHERE asset_id % 9 = 3)"""


def rescan_outcomes(spark, sf_dir):
    before = assets(spark, sf_dir).withColumn("modified_time", F.lit("2024-01-01").cast("timestamp"))
    out = archive.classify_scan(_scan(spark, sf_dir), before)
    return out.select("path", "outcome", "previous_size")


def _listing(spark, sf_dir):
    """The same scan as a listing without hashes: every 11th file can't be read, nor can one of the directories."""
    rows = _scan(spark, sf_dir).select("path", "size_bytes", "modified_time", F.when(F.substring_index(F.substring_index("path", "_", -1), ".", 1).cast("long") % 11 == 5, "PermissionError: denied").alias("error"))
    directory = _closed(spark, sf_dir).select("path", F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified_time"), F.lit("PermissionError: denied").alias("error"))
    return rows.unionByName(directory)


def _closed(spark, sf_dir):
    """The directory of the first file that is gone."""
    return _table(spark, sf_dir, "documents").where("doc_id % 7 = 3").agg(F.min_by(F.concat(F.col("source"), F.lit("/"), F.col("lang")), "doc_id").alias("path")).where("path is not null")


def index_plan(spark, sf_dir):
    before = assets(spark, sf_dir).withColumn("modified_time", F.lit("2024-01-01").cast("timestamp"))
    return indexing.plan(_listing(spark, sf_dir), before).select("path", "outcome", (F.col("outcome") != "unchanged").alias("to_hash"))


def index_missing(spark, sf_dir):
    return health.missing_from(assets(spark, sf_dir), _listing(spark, sf_dir).select("path", "error")).select("asset_id", "path")


def rescan_pending(spark, sf_dir):
    return archive.needing_processing(rescan_outcomes(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def resume_pending(spark, sf_dir):
    a = assets(spark, sf_dir)
    return archive.pending(a.select("asset_id", "fingerprint"), a.where("asset_id % 3 = 0"))


def health_missing(spark, sf_dir):
    return health.missing(assets(spark, sf_dir), _scan(spark, sf_dir)).select("asset_id", "path")


def health_moved(spark, sf_dir):
    return health.moved(assets(spark, sf_dir), _scan(spark, sf_dir))


def health_orphans(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset_id"), F.concat(F.lit("thumb/"), F.col("o_orderkey").cast("string")).alias("path"))
    live = _table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("asset_id"))
    return health.orphaned_derivatives(orders, live)


def health_counts_by_kind(spark, sf_dir):
    a = assets(spark, sf_dir).withColumn("supported", media.extension_probe(text.extension(text.filename(F.col("path"))))["supported"])
    kind = lambda df, k: df.select(F.lit(k).alias("kind"))
    issues = kind(health.missing(a, _scan(spark, sf_dir)), "missing-file").unionByName(kind(health.corrupt(a), "corrupt-asset")).unionByName(kind(health_orphans(spark, sf_dir), "orphaned-derivative")).unionByName(kind(health_moved(spark, sf_dir), "moved-file"))
    return health.counts_by_kind(issues)


def health_snapshot(spark, sf_dir):
    a = assets(spark, sf_dir).withColumn("supported", media.extension_probe(text.extension(text.filename(F.col("path"))))["supported"])
    return health.snapshot(a, _scan(spark, sf_dir), a.where("asset_id % 4 = 0").select((F.col("asset_id") * 2).alias("asset_id"), "path"), waste_report(spark, sf_dir))


def _snapshots(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("taken_at")).agg(F.sum((F.col("event_type") == "error").cast("long")).alias("interventions"))


def health_trend(spark, sf_dir):
    return health.trend(_snapshots(spark, sf_dir))


def health_trend_recent(spark, sf_dir):
    return health.recent_trend(_snapshots(spark, sf_dir), 5)


def tag_decisions(spark, sf_dir):
    t = tags(spark, sf_dir)
    memory = tagging.remember(t.where("rejected").withColumn("label", F.upper("label")))
    return tagging.decisions(t.drop("rejected"), memory).select("asset_id", "label", "decision")


def tags_kept(spark, sf_dir):
    t = tags(spark, sf_dir)
    kept, _ = tagging.filter_rejected(t, t.where("label = 'toxic'").select("label"))
    return kept.select("asset_id", "label")


def tags_strict(spark, sf_dir):
    t = tags(spark, sf_dir)
    return tagging.strict_matches(t, t.where("asset_id % 3 = 0").withColumn("version", F.lit("1"))).select("asset_id", "label", "version")


def media_fields(spark, sf_dir):
    ext = text.extension(text.filename(F.col("path")))
    p = media.extension_probe(ext)
    return assets(spark, sf_dir).select("asset_id", text.filename(F.col("path")).alias("filename"), ext.alias("ext"), media.media_type(ext).alias("media"), media.container(ext).alias("container"), p["media_type"].alias("probe_type"), p["supported"].alias("supported"), text.ascii_fold(F.col("path")).alias("folded"))


def technical_metadata(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    t = media.technical(F.lit("mkv"), F.concat(F.lit("V"), F.col("event_type")), F.when(k % 2 == 0, "OPUS"), k, k, F.col("value") / 10, F.col("value") / 7)
    return _table(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", F.col("t.video_codec").alias("video_codec"), F.col("t.frame_rate.num").alias("fps_num"), F.col("t.duration_ms").alias("duration_ms"), F.size("t.streams").alias("n_streams"), F.col("t.width").alias("width"))


def asset_uuid5(spark, sf_dir):
    return assets(spark, sf_dir).select("asset_id", text.asset_uuid(F.col("archive"), F.col("path")).alias("uuid"))


def jobs_latest(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("status"))
    return store.latest(log, "job_id", ["ts", "event_id"]).select("job_id", "status", "event_id")


def upsert_assets(spark, sf_dir):
    a = assets(spark, sf_dir).select("asset_id", "path", "size_bytes")
    return store.upsert(a, a.where("asset_id % 4 = 0").select((F.col("asset_id") + 2).alias("asset_id"), "path", F.lit(0).cast("long").alias("size_bytes")), ["asset_id"])


def archive_roots(spark, sf_dir):
    a = _table(spark, sf_dir, "documents")
    one = a.groupBy(F.col("source").alias("name")).agg(F.collect_set("lang").alias("roots"))
    two = a.select(F.col("source").alias("name"), F.array(F.concat(F.lit("extra/"), "lang")).alias("roots")).distinct()
    return store.union_roots([one, two]).select("name", F.array_join("roots", ",").alias("roots"))


def event_windows(spark, sf_dir):
    return event_counts(_table(spark, sf_dir, "events")).select(F.date_format("starts", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        search_boolean, search_not_prefix, search_simple, search_indexed, search_substring, cosine_topk, euclid_topk, exact_duplicates, waste_report, groups_for_archive, hamming_pairs, hamming_leaders, audio_pairs, scene_cuts, scenes_merged,
        index_plan, index_missing, rescan_outcomes, rescan_pending, resume_pending, health_missing, health_moved, health_orphans, health_counts_by_kind, health_snapshot, health_trend, health_trend_recent,
        tag_decisions, tags_kept, tags_strict, media_fields, technical_metadata, asset_uuid5, jobs_latest, upsert_assets, archive_roots, event_windows,
    )
}

_BARE_DOC = """CASE WHEN contains({f}, '{n}') THEN 'filename matches "{n}" (' || regexp_extract(path, '[^/]*$') || ')' WHEN contains({p}, '{n}') THEN 'path matches "{n}" (' || path || ')' END"""
_DOC1 = _BARE_DOC.format(f=_FOLD.format("regexp_extract(path, '[^/]*$')"), p=_FOLD.format("path"), n="doc_1")
_DOC2 = _DOC1.replace("doc_1", "doc_2")
_OC12 = _BARE_DOC.format(f=_FOLD.format("regexp_extract(path, '[^/]*$')"), p=_FOLD.format("path"), n="oc_12")
_GROUPS_SQL = "grp AS (SELECT fingerprint, min(asset_id) AS group_id, count(*) AS n, string_agg(CAST(asset_id AS VARCHAR), ',' ORDER BY asset_id) AS members, sum(size_bytes) - max(size_bytes) AS free FROM assets GROUP BY fingerprint HAVING count(*) > 1)"
_BITS_SQL = "h AS (SELECT vec_id AS id, [x > 0 FOR x IN embedding] AS b FROM embeddings)"
_SCENES_SQL = """f AS (SELECT user_id AS asset_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events),
cuts AS (SELECT asset_id, i, row_number() OVER w - 1 AS scene, lead(i) OVER w AS j FROM f WHERE i = 0 OR value >= 90 WINDOW w AS (PARTITION BY asset_id ORDER BY i))"""
_MISSING_SQL = "missing AS (SELECT * FROM assets a WHERE NOT EXISTS (SELECT 1 FROM scan s WHERE s.path = a.path))"
_MOVED_SQL = "moved AS (SELECT m.asset_id, m.path, n.new_path FROM missing m JOIN (SELECT fingerprint, min(path) AS new_path FROM scan s WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.path = s.path) GROUP BY fingerprint) n USING (fingerprint))"
_ORPHANS_SQL = "orphans AS (SELECT o_custkey AS asset_id, 'thumb/' || o_orderkey AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'))"
_SUPPORTED = "ext IN ('mkv','webm','ogg','wav','flac','opus')"
_SNAP_SQL = "snap AS (SELECT strftime(ts, '%Y-%m-%d') AS taken_at, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS interventions FROM events GROUP BY 1)"

ORACLES = {
    "search_boolean": f"""WITH {_ASSETS_SQL}, {_TAGS_SQL}, d AS (SELECT a.*, {_TYPES} AS media, {_DOC1} AS e1,
        (SELECT count(*) FROM tags t WHERE t.asset_id = a.asset_id AND NOT rejected AND label = 'toxic') AS tox FROM assets a),
      e AS (SELECT asset_id, CASE WHEN codec = 'en' AND (e1 IS NOT NULL OR tox > 0) THEN concat_ws('; ', 'codec matches "EN" (en)', e1, CASE WHEN tox > 0 THEN 'tag matches "toxic" (toxic)' END) END AS l,
        CASE WHEN media = 'image' THEN 'media matches "image" (image)' END AS r FROM d)
      SELECT asset_id, concat_ws('; ', l, r) AS explanations FROM e WHERE l IS NOT NULL OR r IS NOT NULL""",
    "search_not_prefix": f"""WITH {_ASSETS_SQL}, d AS (SELECT asset_id, {_TYPES} AS media, {_DOC2} AS e FROM assets)
      SELECT asset_id, e || '; matches all assets' AS explanations FROM d WHERE e IS NOT NULL AND media <> 'audio'""",
    "search_simple": f"""WITH {_ASSETS_SQL}, {_TAGS_SQL}, d AS (SELECT a.asset_id, a.codec, {_FOLD.format("regexp_extract(path, '[^/]*$')")} AS fn,
        coalesce((SELECT bool_or(label = ' High-Quality ') FROM tags t WHERE t.asset_id = a.asset_id AND NOT rejected), false) AS hq,
        coalesce((SELECT bool_or(label = 'toxic') FROM tags t WHERE t.asset_id = a.asset_id AND NOT rejected), false) AS tox FROM assets a)
      SELECT asset_id, concat_ws('; ', 'tag '' High-Quality '' matches', CASE WHEN contains(fn, 'e') THEN 'filename contains ''E''' END, 'codec ''' || codec || ''' matches',
        CASE WHEN contains('high-quality', 'e') THEN NULL END, 'filename contains ''doc_''') AS explanations FROM d WHERE hq AND contains(codec, 'e')""",
    "search_substring": f"""WITH {_ASSETS_SQL}, e AS (SELECT asset_id, CASE WHEN ext <> 'wav' THEN {_OC12} || '; matches all assets' END AS l, CASE WHEN contains({_FOLD.format("path")}, '/doc_77') THEN 'path matches "/doc_77" (' || path || ')' END AS r FROM assets)
      SELECT asset_id, concat_ws('; ', l, r) AS explanations FROM e WHERE l IS NOT NULL OR r IS NOT NULL""",
    "audio_pairs": """WITH f AS MATERIALIZED (SELECT vec_id AS id, CAST(list_slice(embedding, 1, CASE WHEN vec_id % 5 = 0 THEN 10 ELSE 16 END) AS DOUBLE[]) AS v FROM embeddings),
      k AS MATERIALIZED (SELECT min(id) AS id, v FROM f WHERE len(v) > 0 GROUP BY v),
      p AS (SELECT x.id AS a, y.id AS b, list_distance(list_slice(x.v, 1, least(len(x.v), len(y.v))), list_slice(y.v, 1, least(len(x.v), len(y.v)))) AS d FROM k x JOIN k y ON x.id < y.id)
      SELECT a, b, round(d, 6) AS distance FROM p WHERE d <= 0.3""",
    "cosine_topk": """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20""",
    "euclid_topk": """SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20""",
    "exact_duplicates": f"WITH {_ASSETS_SQL}, {_GROUPS_SQL} SELECT group_id, fingerprint, members FROM grp",
    "waste_report": f"WITH {_ASSETS_SQL}, {_GROUPS_SQL} SELECT count(*) AS \"groups\", CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_assets, CAST(coalesce(sum(free), 0) AS BIGINT) AS reclaimable_bytes FROM grp",
    "groups_for_archive": f"WITH {_ASSETS_SQL}, {_GROUPS_SQL} SELECT DISTINCT archive, group_id FROM grp JOIN assets USING (fingerprint)",
    "hamming_pairs": f"WITH {_BITS_SQL} SELECT x.id AS a, y.id AS b, CAST(list_sum([CASE WHEN x.b[i] <> y.b[i] THEN 1 ELSE 0 END FOR i IN range(1, 65)]) AS INTEGER) AS distance FROM h x JOIN h y ON x.id < y.id WHERE list_sum([CASE WHEN x.b[i] <> y.b[i] THEN 1 ELSE 0 END FOR i IN range(1, 65)]) <= 18",
    "scene_cuts": f"WITH {_SCENES_SQL} SELECT asset_id, scene, round(i / 25.0, 6) AS start_s, round(j / 25.0, 6) AS end_s FROM cuts",
    "hamming_leaders": f"""WITH RECURSIVE {_BITS_SQL.replace("h AS (", "h AS MATERIALIZED (")}, p AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM h x JOIN h y ON x.id < y.id WHERE list_sum([CASE WHEN x.b[i] <> y.b[i] THEN 1 ELSE 0 END FOR i IN range(1, 65)]) <= 18),
      near AS MATERIALIZED (SELECT b, list(a ORDER BY a) AS l FROM p GROUP BY b), o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM h),
      r AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS leaders, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS leader
        UNION ALL SELECT o.rn, CASE WHEN list_has_any(coalesce(n.l, CAST([] AS BIGINT[])), r.leaders) THEN r.leaders ELSE list_append(r.leaders, o.id) END, o.id,
          coalesce(list_min(list_intersect(coalesce(n.l, CAST([] AS BIGINT[])), r.leaders)), o.id) FROM r JOIN o ON o.rn = r.rn + 1 LEFT JOIN near n ON n.b = o.id)
      SELECT leader, id AS member FROM r WHERE leader IN (SELECT leader FROM r WHERE id IS NOT NULL GROUP BY leader HAVING count(*) > 1)""",
    "asset_uuid5": f"""WITH {_ASSETS_SQL}, x AS (SELECT asset_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('asset:' || archive || ':' || path)) AS h FROM assets)
      SELECT asset_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM x""",
    "scenes_merged": f"""WITH RECURSIVE {_SCENES_SQL}, k AS (SELECT asset_id, i FROM cuts WHERE scene = 0
        UNION ALL SELECT k.asset_id, min(c.i) FROM k JOIN cuts c ON c.asset_id = k.asset_id AND c.i > k.i AND c.i / 25.0 - k.i / 25.0 >= 0.2 GROUP BY k.asset_id, k.i)
      SELECT asset_id, row_number() OVER w - 1 AS scene, round(i / 25.0, 6) AS start_s, round(lead(i) OVER w / 25.0, 6) AS end_s FROM k WINDOW w AS (PARTITION BY asset_id ORDER BY i)""",
    "rescan_outcomes": f"""WITH {_ASSETS_SQL}, {_SCAN_SQL}, o AS (SELECT s.path, a.size_bytes AS old, CASE WHEN a.path IS NULL THEN 'new' WHEN a.size_bytes = s.size_bytes THEN 'unchanged' ELSE 'changed' END AS outcome FROM scan s LEFT JOIN assets a ON a.path = s.path)
      SELECT path, outcome, CASE WHEN outcome = 'changed' THEN old END AS previous_size FROM o""",
    "index_plan": f"""WITH {_ASSETS_SQL}, {_SCAN_SQL}, o AS (SELECT s.path, CASE WHEN a.path IS NULL THEN 'new' WHEN a.size_bytes = s.size_bytes THEN 'unchanged' ELSE 'changed' END AS outcome
        FROM scan s LEFT JOIN assets a ON a.path = s.path WHERE CAST(regexp_extract(s.path, '_([0-9]+)[.][a-z0-9]*$', 1) AS BIGINT) % 11 <> 5)
      SELECT path, outcome, outcome <> 'unchanged' AS to_hash FROM o""",
    "index_missing": f"""WITH {_ASSETS_SQL}, {_SCAN_SQL}, {_MISSING_SQL}
      SELECT asset_id, path FROM missing WHERE NOT starts_with(path, (SELECT arg_min(source || '/' || lang, doc_id) FROM documents WHERE doc_id % 7 = 3) || '/')""",
    "rescan_pending": f"""WITH {_ASSETS_SQL}, {_SCAN_SQL}, o AS (SELECT CASE WHEN a.path IS NULL THEN 'new' WHEN a.size_bytes = s.size_bytes THEN 'unchanged' ELSE 'changed' END AS outcome FROM scan s LEFT JOIN assets a ON a.path = s.path)
      SELECT outcome, count(*) AS n FROM o WHERE outcome <> 'unchanged' GROUP BY outcome""",
    "resume_pending": f"WITH {_ASSETS_SQL} SELECT asset_id, fingerprint FROM assets WHERE fingerprint NOT IN (SELECT fingerprint FROM assets WHERE asset_id % 3 = 0)",
    "health_missing": f"WITH {_ASSETS_SQL}, {_SCAN_SQL}, {_MISSING_SQL} SELECT asset_id, path FROM missing",
    "health_moved": f"WITH {_ASSETS_SQL}, {_SCAN_SQL}, {_MISSING_SQL}, {_MOVED_SQL} SELECT * FROM moved",
    "health_orphans": f"WITH {_ORPHANS_SQL} SELECT * FROM orphans",
    "health_counts_by_kind": f"""WITH {_ASSETS_SQL}, {_SCAN_SQL}, {_MISSING_SQL}, {_MOVED_SQL}, {_ORPHANS_SQL}
      SELECT 'missing-file' AS kind, count(*) AS n FROM missing HAVING count(*) > 0 UNION ALL SELECT 'moved-file', count(*) FROM moved HAVING count(*) > 0
      UNION ALL SELECT 'corrupt-asset', count(*) FROM assets WHERE NOT {_SUPPORTED} HAVING count(*) > 0 UNION ALL SELECT 'orphaned-derivative', count(*) FROM orphans HAVING count(*) > 0""",
    "health_snapshot": f"""WITH {_ASSETS_SQL}, {_SCAN_SQL}, {_MISSING_SQL}, {_GROUPS_SQL}, n AS (SELECT (SELECT count(*) FROM assets) AS total_assets, (SELECT count(*) FROM missing) AS missing_files,
        (SELECT count(*) FROM assets WHERE NOT {_SUPPORTED}) AS corrupt_assets, (SELECT count(*) FROM assets WHERE asset_id % 4 = 0 AND asset_id * 2 NOT IN (SELECT asset_id FROM assets)) AS orphaned_derivatives,
        (SELECT CAST(coalesce(sum(free), 0) AS BIGINT) FROM grp) AS duplicate_waste_bytes)
      SELECT *, missing_files + corrupt_assets + orphaned_derivatives AS interventions FROM n""",
    "health_trend": f"WITH {_SNAP_SQL} SELECT *, coalesce(interventions - lag(interventions) OVER (ORDER BY taken_at), 0) AS delta FROM snap",
    "health_trend_recent": f"WITH {_SNAP_SQL}, r AS (SELECT * FROM snap ORDER BY taken_at DESC LIMIT 5) SELECT *, coalesce(interventions - lag(interventions) OVER (ORDER BY taken_at), 0) AS delta FROM r",
    "tag_decisions": f"WITH {_TAGS_SQL} SELECT asset_id, label, CASE WHEN rejected THEN 'propose-flagged-rejected' ELSE 'propose' END AS decision FROM tags",
    "tags_kept": f"WITH {_TAGS_SQL} SELECT asset_id, label FROM tags WHERE label <> 'toxic'",
    "tags_strict": f"WITH {_TAGS_SQL} SELECT asset_id, label, version FROM tags WHERE asset_id % 3 = 0 AND version = '1'",
    "media_fields": f"""WITH {_ASSETS_SQL} SELECT asset_id, regexp_extract(path, '[^/]*$') AS filename, ext, {_TYPES} AS media,
        CASE WHEN ext IN ('mkv','mp4','wav','flac','mov','aiff','webm','ogg') THEN ext WHEN ext = 'opus' THEN 'ogg' END AS container,
        CASE WHEN ext IN ('mkv','webm','mp4') THEN 'video' WHEN ext IN ('ogg','opus','flac','wav') THEN 'audio' ELSE 'unknown' END AS probe_type, {_SUPPORTED} AS supported, {_FOLD.format("path")} AS folded FROM assets""",
    "technical_metadata": """WITH e AS (SELECT event_id, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k FROM events)
      SELECT event_id, 'v' || event_type AS video_codec, CASE WHEN value > 0 THEN CAST(round(value / 10 * 1000) AS BIGINT) END AS fps_num, CAST(round(value / 7 * 1000) AS BIGINT) AS duration_ms, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS n_streams, k AS width FROM e""",
    "jobs_latest": "SELECT user_id AS job_id, event_type AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "upsert_assets": f"""WITH {_ASSETS_SQL}, n AS (SELECT asset_id + 2 AS asset_id, path, CAST(0 AS BIGINT) AS size_bytes FROM assets WHERE asset_id % 4 = 0)
      SELECT asset_id, path, size_bytes FROM n UNION ALL SELECT asset_id, path, size_bytes FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM n)""",
    "archive_roots": "WITH r AS (SELECT DISTINCT source AS name, lang AS root FROM documents UNION SELECT DISTINCT source, 'extra/' || lang FROM documents) SELECT name, string_agg(root, ',' ORDER BY root) AS roots FROM r GROUP BY name",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
ORACLES["search_indexed"] = ORACLES["search_boolean"]
