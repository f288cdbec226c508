"""Index runs that hash what changed, pause and go on; the store's writes; pushed filters; the watch stream; blocks of leaders and scenes."""

from __future__ import annotations

import math
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lakeloom import streaming
from lakeloom.operators import dedupe, health, scenes
from lakeloom.plans import api, indexing
from lakeloom.sources import archive
from lakeloom.sources.store import Store, StoreError


@pytest.fixture
def files(tmp_path):
    root = tmp_path / "files"
    for i in range(12):
        p = root / f"d{i % 3}" / f"f{i:02d}.mkv"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"content {i:02d}")
    return root


def _last_run(engine):
    return engine.store.table("index_runs").orderBy(F.desc("taken_at")).first().asDict()


def test_unchanged_files_are_not_hashed(spark, files, tmp_path):
    engine = api.Engine(spark, str(tmp_path / "data"))
    engine.index("a", [str(files)])
    assert {k: _last_run(engine)[k] for k in ("found", "new", "changed", "unchanged", "hashed")} == {"found": 12, "new": 12, "changed": 0, "unchanged": 0, "hashed": 12}
    prints = lambda: {r["path"].rsplit("/", 1)[1]: r["fingerprint"] for r in engine.store.table("assets").collect()}
    before = prints()
    # Another content of the same size under the same time is not looked at: nothing is read that the listing calls unchanged.
    quiet, loud = files / "d0" / "f00.mkv", files / "d1" / "f01.mkv"
    stat = quiet.stat()
    quiet.write_text("CONTENT 00")
    os.utime(quiet, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    engine.index("a", [])
    assert prints() == before and _last_run(engine)["hashed"] == 0 and _last_run(engine)["unchanged"] == 12
    loud.write_text("longer content")
    (files / "d2" / "new.mkv").write_text("new")
    (files / "d2" / "f02.mkv").unlink()
    engine.index("a", [])
    run = _last_run(engine)
    assert (run["new"], run["changed"], run["unchanged"], run["hashed"]) == (1, 1, 10, 2)
    after = prints()
    assert after["f01.mkv"] != before["f01.mkv"] and after["f00.mkv"] == before["f00.mkv"] and "new.mkv" in after
    missing = engine.store.table("health_findings").where("kind = 'missing-file'").collect()
    assert [r["subject"].rsplit("/", 1)[1] for r in missing] == ["f02.mkv"]
    assert not (tmp_path / "data" / "runs").exists() or not any((tmp_path / "data" / "runs").iterdir())


def test_unreadable_is_not_missing(spark, files, tmp_path, monkeypatch):
    engine = api.Engine(spark, str(tmp_path / "data"))
    engine.index("a", [str(files)])
    true = archive.listing

    def listing(*a, **k):
        """f00 can't be read, d1 can't be listed, f02 goes, and a file goes between listing and hashing."""
        rows = true(*a, **k).where("path not like '%/d1/%' and path not like '%/f02.mkv'")
        rows = rows.withColumn("error", F.when(F.col("path").endswith("f00.mkv"), "PermissionError: denied"))
        more = [(f"{files}/d1", None, None, None, "PermissionError: denied"), (f"{files}/d0/late.mkv", 3, None, None, None)]
        return rows.unionByName(spark.createDataFrame(more, "path string, size_bytes long, modified_time timestamp, fingerprint string, error string"))

    monkeypatch.setattr(indexing.archive, "listing", listing)
    job = engine.queue.enqueue(engine.archive_id("a"), "index")
    engine.queue.run_until_idle()
    state = engine.queue.get(job)
    assert state["status"] == "done" and state["note"] == "indexed 7 asset(s), 3 warning(s) (see scan errors)"
    assert {r["path"].rsplit("/", 1)[1] for r in engine.store.table("scan_issues").collect()} == {"f00.mkv", "d1", "late.mkv"}
    assert [r["subject"].rsplit("/", 1)[1] for r in engine.store.table("health_findings").where("kind = 'missing-file'").collect()] == ["f02.mkv"]
    assets = spark.createDataFrame([("/r/a/x",), ("/r/b/c/y",), ("/r/z",), ("/q",)], "path string")
    seen = spark.createDataFrame([("/r/b", "PermissionError: denied"), ("/r/a", "FileNotFoundError: none"), ("/q", "OSError: broken")], "path string, error string")
    assert {r["path"] for r in health.missing_from(assets, seen).collect()} == {"/r/a/x", "/r/z"}


def test_a_paused_run_goes_on_where_it_was(spark, files, tmp_path, monkeypatch):
    data, done = str(tmp_path / "data"), []
    engine = api.Engine(spark, data, chunk_files=2)
    aid = engine.store.find_or_create_archive("a", [str(files)])
    job = engine.queue.enqueue(aid, "index")
    true = indexing.IndexRun.hash_chunk

    def hash_chunk(self, rows, c):
        true(self, rows, c)
        done.append(c)
        if len(done) == 2:
            engine.queue.pause(job)

    monkeypatch.setattr(indexing.IndexRun, "hash_chunk", hash_chunk)
    engine.queue.run_until_idle()
    assert engine.queue.get(job)["status"] == "paused" and done == [0, 1] and engine.store.table("assets").count() == 0
    engine.queue.run_until_idle()  # a paused job isn't begun
    assert len(done) == 2
    again = api.Engine(spark, data, chunk_files=2)
    assert again.queue.get(job)["status"] == "paused"
    again.queue.resume(job)
    assert again.queue.get(job)["status"] == "queued"
    again.queue.run_until_idle()
    assert again.queue.get(job)["status"] == "done" and sorted(done) == list(range(6)) and again.store.table("assets").count() == 12
    # A cancelled run leaves nothing.
    gone = again.queue.enqueue(aid, "index")
    for p in files.rglob("*.mkv"):
        p.write_text("all anew")
    monkeypatch.setattr(indexing.IndexRun, "hash_chunk", lambda self, rows, c: (true(self, rows, c), again.queue.cancel(gone)))
    again.queue.run_until_idle()
    assert again.queue.get(gone)["status"] == "cancelled" and not any((tmp_path / "data" / "runs").iterdir())
    assert again.store.table("assets").select("fingerprint").distinct().count() == 12


def test_a_late_word_does_not_undo_a_pause_or_cancel(spark, tmp_path):
    from lakeloom.plans.jobs import JobQueue

    queue = JobQueue(Store(spark, str(tmp_path / "s")))
    seen = []

    def work(context, job):
        if not seen:
            seen.append(1)
            queue.pause(job["id"])
            context.check()
        return "through"

    job = queue.enqueue(None, "index", work)
    queue.run_until_idle()
    assert queue.get(job)["status"] == "paused"
    queue.resume(job)
    queue.run_until_idle()
    assert queue.get(job)["status"] == "done" and queue.get(job)["note"] == "through"

    def cancelled(context, job):
        queue.cancel(job["id"])
        return "never mind"

    job = queue.enqueue(None, "index", cancelled)
    queue.run_until_idle()
    assert queue.get(job)["status"] == "cancelled" and queue.get(job)["note"] is None
    waiting = queue.enqueue(None, "index", lambda c, j: (queue.pause(j["id"]), queue.resume(j["id"]), queue.get(j["id"])["status"])[2])
    queue.run_until_idle()
    assert queue.get(waiting)["note"] == "active"  # its worker was at it all the time


def test_writes_of_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    tags = spark.createDataFrame([("k", f"l{i:02d}") for i in range(60)], "asset_id string, label string")
    more = {c: F.lit(None) for c in ("model", "version", "provider", "confidence")}
    store.add_tags(tags.withColumns(more | {"source": F.lit("manual"), "rejected": F.lit(False)}))
    parts = lambda: store._parts("tags", store._number("tags"))
    size = lambda folder: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
    before, whole = parts(), size(tmp_path / "s" / "tags")
    store.set_tag_rejected(7, True)
    now = parts()
    assert sum(before[b] != now[b] for b in before) == 1 and len(before) > 8
    assert size(tmp_path / "s" / "tags") - whole < whole / 4
    assert [r["id"] for r in store.table("tags").where("rejected").collect()] == [7] and store.table("tags").count() == 60
    # A job's progress appends a row and writes no table.
    from lakeloom.plans.jobs import JobContext, JobQueue

    queue = JobQueue(store)
    job = queue.enqueue(None, "index")
    number, rows = store._number("jobs"), store._stored("jobs").count()
    for p in (0.1, 0.101, 0.2, 0.3):
        JobContext(queue, job).report_progress(p)
    assert store._number("jobs") == number and store._stored("jobs").count() == rows + 4 and queue.get(job)["progress"] == 0.3
    for p in range(70):
        queue._update(job, progress=p / 100)
    again = JobQueue(Store(spark, str(tmp_path / "s")))
    assert again.store._number("jobs") == number + 1 and again.store._stored("jobs").count() == 1 and again.get(job)["progress"] == 0.69
    # Of two writers that began alike one fails, and nothing of the other's is lost.
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    take = one._create

    def late(name, value):
        two.set_preference("k", "two")
        take(name, value)

    one._create = late
    with pytest.raises(StoreError, match="by another"):
        one.set_preference("k", "one")
    assert two.preference("k") == "two"
    with pytest.raises(StoreError, match="path already indexed"):
        row = lambda i: (i, "a", "/same", "f", 1, None, "video", True, None)
        store.upsert("assets", spark.createDataFrame([row("x"), row("y")], "id string, archive_id string, path string, fingerprint string, size_bytes long, modified_time timestamp, media_type string, supported boolean, technical string"))


def test_pushed_filters(spark, files):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = archive.PushingReader({"roots": json.dumps([str(files)]), "hash": "false"})
    left = GreaterThan(("fingerprint",), "a")
    assert list(reader.pushFilters([StringStartsWith(("path",), f"{files}/d1/"), GreaterThan(("size_bytes",), 3), left])) == [left]
    assert {p.path for p in reader.partitions()} == {str(files), f"{files}/d1"}
    assert sorted(r[1] for p in reader.partitions() for r in reader.read(p)) == sorted(str(p) for p in files.glob("d1/*"))
    one = archive.PushingReader({"roots": json.dumps([str(files)])})
    assert list(one.pushFilters([EqualTo(("path",), f"{files}/d2/f02.mkv")])) == [] and not one.enters(f"{files}/d0") and one.enters(str(files))
    spark.dataSource.register(archive.ArchiveSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        (files / "d1" / "big.mkv").write_text("x" * 1000)
        rows = spark.read.format("lakeloom_archive").option("roots", json.dumps([str(files)])).option("pushdown", "true").load()
        base = spark.read.format("lakeloom_archive").option("roots", json.dumps([str(files)]))
        got = rows.where((F.col("size_bytes") > 100) & (F.col("modified_time") > F.lit("2020-01-01").cast("timestamp")) & F.col("path").startswith(str(files)))
        assert [r["path"] for r in got.collect()] == [f"{files}/d1/big.mkv"] and rows.where("size_bytes > 100 and modified_time < timestamp'2020-01-01'").count() == 0
        assert rows.where("size_bytes <= 100").count() == 12
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert base.load().count() == 13


def test_watch_state():
    known: dict = {}
    tell = lambda seen, tick, quiet=10: [h[:4] for h in streaming.advance(known, seen, tick, quiet)]
    assert tell({"i": ("a", 1, 1)}, 0) == [] and tell({"i": ("a", 2, 2)}, 6) == [] and tell({"i": ("a", 2, 2)}, 12) == []
    assert tell({"i": ("a", 2, 2)}, 16) == [("a", False, None, None)] and tell({"i": ("a", 2, 2)}, 99) == []
    assert tell({"i": ("b", 2, 2), "j": ("t", 1, 1)}, 100) == []
    assert tell({"i": ("b", 2, 2)}, 110) == [("a", True, None, "b"), ("b", False, "a", None)]  # j was there for a moment only
    assert tell({"i": ("b", 2, 2)}, 121) == [] and "j" not in known
    assert tell({}, 130) == [] and tell({"i": ("b", 2, 2)}, 135) == [] and tell({}, 140) == [] and tell({}, 150) == [("b", True, None, None)] and known == {}


def test_watch_stream_of_many_files(spark, tmp_path):
    root, n = tmp_path / "tree", 100_000
    for d in range(100):
        (root / f"d{d:02d}").mkdir(parents=True)
        for i in range(n // 100):
            os.close(os.open(f"{root}/d{d:02d}/f{i:04d}", os.O_CREAT | os.O_WRONLY))
    told = []
    ck = str(tmp_path / "ck")

    def run():
        told.clear()
        streaming.on_hints(streaming.watch(spark, [str(root)]), lambda df, i: told.extend(df.collect() if df.count() < 100 else [df.count()]), ck).awaitTermination()
        return told

    assert run() == [n]
    assert run() == []  # a restart repeats nothing
    os.rename(root / "d00" / "f0000", root / "d99" / "moved")
    (root / "d01" / "f0001").write_text("now with content")
    (root / "d02" / "f0002").unlink()
    (root / "d03" / "f0003").unlink()
    (root / "d03" / "new").write_text("")  # another file, so f0003 is not written anew
    (root / "d04" / "other").write_text("x")
    os.replace(root / "d04" / "other", root / "d04" / "f0004")  # written anew under its old name
    hints = run()
    got = {(os.path.relpath(r["path"], root), r["deleted"]) for r in hints}
    assert {("d00/f0000", True), ("d99/moved", False), ("d01/f0001", False), ("d02/f0002", True), ("d03/f0003", True), ("d03/new", False), ("d04/f0004", False)} <= got
    assert {p for p, _ in got} <= {"d00/f0000", "d99/moved", "d01/f0001", "d02/f0002", "d03/f0003", "d03/new", "d04/f0004"} and len(hints) == 7
    assert any(r["renamed_to"] == f"{root}/d99/moved" for r in hints) and any(r["renamed_from"] == f"{root}/d00/f0000" for r in hints)
    assert run() == []
    assert all(os.path.getsize(os.path.join(ck, "offsets", f)) < 1024 for f in os.listdir(os.path.join(ck, "offsets")))


def _leaders(n, pairs):
    lead = {}
    near = {i: [] for i in range(n)}
    for a, b in pairs:
        near[b].append(a)
    for i in range(n):
        found = [a for a in near[i] if lead.get(a) == a]
        lead[i] = min(found) if found else i
    return lead


@pytest.mark.parametrize(("block_ids", "last_rows"), [(2000, 200_000), (7, 0), (1000, 0)])
def test_leaders_in_blocks(spark, block_ids, last_rows):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(59)]
    mesh = list({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    for pairs in (chain, mesh, []):
        got = {r["id"]: r["lead"] for r in dedupe.leaders_of(spark.createDataFrame(pairs, "a long, b long"), block_ids, last_rows).collect()}
        want = _leaders(60, pairs)
        assert got == {i: want[i] for i in {x for p in pairs for x in p}}


def test_a_chain_of_thousands_settles(spark):
    n = 5000
    pairs = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for last in (200_000, 1000):
        got = {r["id"]: r["lead"] for r in dedupe.leaders_of(pairs, last_rows=last).collect()}
        assert got == {i: i - i % 2 for i in range(n)}


def test_scenes_across_ranges(spark):
    """One asset has most frames and spans many ranges; times tie; another has none."""
    rng = random.Random(9)
    rows = [("long", t // 2, t, rng.random()) for t in range(3000)] + [(f"s{i}", t, t, rng.random()) for i in range(5) for t in range(rng.randint(1, 9))] + [(None, 1, 1, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "asset_id string, ts long, n long, score double").repartition(5)
    settings = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        framed = scenes.in_ranges(df.where("asset_id = 'long'"), "asset_id", ("ts", "n"))
        shares = [r["count"] for r in framed.groupBy("_range").count().collect()]
        assert len(shares) > 5 and max(shares) < 1000
        got = sorted((r["asset_id"], r["scene"], r["start_s"], r["end_s"]) for r in scenes.split_scenes(df, 0.9, 25.0, order=("ts", "n")).collect())
        before_rows = scenes.before_in_ranges(framed, "asset_id", "n", "b").orderBy("n").select("b").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["b"] for r in before_rows] == [None, *range(2999)]
    want = []
    for key in sorted({r[0] for r in rows if r[0]}):
        frames = sorted((r[1], r[2], r[3]) for r in rows if r[0] == key)
        cuts = [i for i, f in enumerate(frames) if i == 0 or f[2] >= 0.9]
        want += [(key, k, c / 25.0, cuts[k + 1] / 25.0 if k + 1 < len(cuts) else None) for k, c in enumerate(cuts)]
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    none = spark.createDataFrame([("x",)], "asset_id string")
    assert [tuple(r) for r in scenes.split_scenes(df.limit(0), 0.9, 25.0, none, order=("ts", "n")).collect()] == [("x", 0, 0.0, None)]


def test_short_scenes_across_ranges(spark):
    """One asset's cuts span many ranges, near and far from each other; no range may forget what counts before it."""
    rng = random.Random(11)
    starts = {"long": sorted(rng.choice([rng.uniform(0, 900), float(rng.randint(0, 300)) * 3]) for _ in range(2000)), "dense": [i * 0.4 for i in range(500)], "one": [0.0]}
    rows = [(k, x) for k, v in starts.items() for x in v]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "asset_id string, start_s double").repartition(5)
    settings = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = sorted(map(tuple, scenes.merge_short_scenes(df, 1.0).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = []
    for key, xs in starts.items():
        kept: list = []
        for x in xs:
            if not kept or x - kept[-1] >= 1.0:
                kept.append(x)
        want += [(key, i, x, kept[i + 1] if i + 1 < len(kept) else None) for i, x in enumerate(kept)]
    assert got == sorted(want)


def test_import_with_stages(spark, tmp_path):
    """A supported file is stored and its stages wait for each other; others are refused with a reason; a failed import takes its stages along."""
    good, odd, video = tmp_path / "take.flac", tmp_path / "words.txt", tmp_path / "clip.mp4"
    good.write_bytes(b"fLaC\0\0\0\x22" + b"\0" * 10 + ((48000 << 44) | (1 << 41) | (15 << 36) | 48000).to_bytes(8, "big") + b"\0" * 16)
    odd.write_text("no media")
    video.write_bytes(b"\0\0\0\x18ftypmp42" + b"\0" * 32)
    engine = api.Engine(spark, str(tmp_path / "home"))
    paths = spark.createDataFrame([(str(p),) for p in (good, odd, video, tmp_path / "none.wav", good)] + [(None,)], "path string")
    order = []
    for kind in ("derivatives", "tagging"):
        engine.queue.workers[kind] = lambda c, j: order.append(j["stage"])
    jobs = engine.import_files("a", paths)
    assert [engine.queue.get(j)["stage"] for j in jobs] == ["scan", "derivatives", "scene_detection", "tagging"]
    assert [j["id"] for j in engine.queue.ready()] == jobs[:1]
    engine.queue.run_until_idle()
    assert [engine.queue.get(j)["status"] for j in jobs] == ["done"] * 4 and order == ["derivatives", "scene_detection", "tagging"]
    assert engine.queue.get(jobs[0])["note"] == "imported 1 file(s), rejected 3"
    said = {r["path"].rsplit("/", 1)[1]: (r["status"], r["reason"]) for r in engine.store.table("imports").collect()}
    assert said["take.flac"] == ("imported", None) and said["words.txt"] == ("rejected", indexing.UNRECOGNISED) and said["clip.mp4"] == ("rejected", indexing.UNSUPPORTED) and said["none.wav"][1].startswith(indexing.UNREADABLE)
    (asset,) = engine.imports.assets_of(jobs[0]).collect()
    assert asset["archive_id"] == engine.archive_id("a") and asset["supported"] and asset["derivatives"]["waveform"].startswith(str(tmp_path / "home"))
    bad = engine.queue.enqueue(None, "index", lambda c, j: 1 / 0)
    next_, last = (second := engine.queue.enqueue(None, "tagging", after=bad)), engine.queue.enqueue(None, "tagging", after=second)
    engine.queue.run_until_idle()
    assert [engine.queue.get(j)["status"] for j in (bad, next_, last)] == ["failed", "cancelled", "cancelled"]
    with pytest.raises(KeyError):
        engine.queue.enqueue(None, "tagging", after="none")


def test_report_sink(spark, tmp_path):
    from lakeloom.sources.report import write_report

    path = tmp_path / "r.json"
    rows = spark.range(1000).repartition(5).select("id", F.array(F.lit("a\n\"é"), F.col("id").cast("string")).alias("m"), F.struct(F.lit(None).cast("int").alias("n")).alias("s"))
    write_report(rows, str(path), {"archive": "x", "groups": 2}, "members")
    report = json.loads(path.read_text())
    assert report["archive"] == "x" and sorted(r["id"] for r in report["members"]) == list(range(1000)) and report["members"][0]["s"] == {"n": None}
    with pytest.raises(Exception, match="no more"):
        write_report(rows.withColumn("id", F.when(F.col("id") == 700, F.raise_error(F.lit("no more")).cast("long")).otherwise(F.col("id"))), str(path), {}, "members")
    assert json.loads(path.read_text()) == report and [p.name for p in tmp_path.iterdir()] == ["r.json"]  # neither a half report nor parts
    write_report(rows.limit(0), str(tmp_path / "none.json"), {}, "members")
    assert json.loads((tmp_path / "none.json").read_text()) == {"members": []}


def test_search_by_index_equals_the_scan(spark, tmp_path):
    from lakeloom.operators import search, textindex

    rng = random.Random(3)
    rows = [(i, f"{rng.choice(['Alpha', 'beta', 'GAMMA'])}/{rng.choice(['take', 'Clip', 'ab'])}_{i}.{rng.choice(['mkv', 'wav', 'x'])}", rng.choice(["av1", "flac", None])) for i in range(300)] + [(900, "", None), (901, None, None), (902, "é/ÄÖ.wav", "av1")]
    assets = spark.createDataFrame(rows, "asset_id long, path string, video_codec string")
    docs = search.search_docs(assets, spark.createDataFrame([(5, "red"), (6, "Red Hot")], "asset_id long, label string"))
    textindex.write(docs, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for query in ("clip_12", "take_1 NOT ext:wav", "codec:AV1 AND mma/t", "ab", "*", "NOT beta", "path:zzz OR tag:red", "(lip_1 OR lip_2) take", "ake_7 OR ab_8", "unknown:x", '"ÄÖ"', "resolution:1x1", "path:" + "ta"):
        got, how = textindex.search_indexed(docs, index, query)
        want = search.search(docs, query)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), query
        assert want.count() <= how.bound <= how.assets == 303
    share = lambda q: textindex.plan(index, q, 303)
    assert share("clip_12").candidates is not None and share("clip_12").bound < 30 and share("path:zzz").bound == 0
    assert share("*").candidates is None and share("ab").candidates is None and share("NOT beta").candidates is None and share("path:alpha").candidates is None


def test_audio_pairs(spark):
    """Against a loop: short prefixes, ties with the radius, copies, odd numbers, far values."""
    rng = random.Random(8)
    rows = [(i, [rng.uniform(0, 2) for _ in range(rng.choice([2, 6, 16]))]) for i in range(120)] + [(200 + i, [0.5, 0.5]) for i in range(40)] + [(300, [1e300, 0.0]), (301, [-1e300, 0.0]), (302, [1e300, 0.25])]
    odd = [(400, None), (401, []), (402, [None, 1.0]), (403, [float("nan"), 1.0]), (404, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows + odd, "id long, fingerprint array<double>").repartition(3)
    first: dict = {}
    for i, v in rows:
        first.setdefault(tuple(v), i)
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y)) ** 0.5 if max(map(abs, x + y)) < 1e150 else abs(x[0] - y[0]) or far(x[1:], y[1:])
    for radius in (0.0, 0.25, 0.7):
        pairs, members = dedupe.audio_duplicates(df, radius)
        kinds = sorted((i, v) for v, i in first.items())
        want = {(a, b) for k, (a, x) in enumerate(kinds) for b, y in kinds[k + 1 :] if far(x, y) <= radius}
        assert {(r["a"], r["b"]) for r in pairs.collect()} == want and (radius or not want)
        assert {(r["id"], r["kind"]) for r in members.collect()} == {(i, first[tuple(v)]) for i, v in rows}
    assert dedupe.audio_duplicates(df.limit(0), 1.0)[0].count() == 0
    with pytest.raises(ValueError, match="negative"):
        dedupe.audio_duplicates(df, -1.0)


@pytest.mark.parametrize("path", ["tiles", "small tiles", "grid"])
def test_audio_pairs_by_each_path(spark, monkeypatch, path):
    """Prefixes of many lengths, far from and near to zero, ties of a sum, in one tile, in many, and by the grid."""
    monkeypatch.setattr(dedupe, "JOIN_COST", 0 if path == "grid" else 1e9)
    if path == "small tiles":
        monkeypatch.setattr(dedupe, "VECTOR_ROWS", 17)
    rng = random.Random(3)
    for shift, scale in ((0.0, 1.0), (1e6, 1.0), (0.0, 1e-12)):
        rows = [(i, [shift + scale * rng.uniform(0, 1) for _ in range(rng.choice([1, 3, 8, 40]))]) for i in range(150)]
        rows += [(1000 + i, [x + scale * 0.01 for x in v]) for i, v in rows[:20]]
        df = spark.createDataFrame(rows, "id long, fingerprint array<double>").repartition(3)
        got = {(r["a"], r["b"]): r["distance"] for r in dedupe.audio_duplicates(df, 0.4 * scale)[0].collect()}
        want = {}
        for k, (a, x) in enumerate(rows):
            for b, y in rows[k + 1 :]:
                total = 0.0
                for p, q in zip(x, y):
                    total += (p - q) * (p - q)
                if math.sqrt(total) <= 0.4 * scale:
                    want[a, b] = math.sqrt(total)
        assert got == want and len(want) > 100


def test_dense_fingerprints_meet_in_tiles(spark):
    """Cells that part fingerprints little aren't joined: each would be sent 81 times, and nearly all pairs met as rows."""
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(600)], "id long, v array<double>")
    pairs = dedupe.audio_pairs(rows, 0.3)
    pairs.collect()
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert dedupe.grid_is_cheaper(10**6, 4, 1e6, 2.0, 12) and not dedupe.grid_is_cheaper(10**6, 4, 1e6 + 1e10, 1e5, 12)


def test_probing_in_place_equals_the_join(spark, files):
    from lakeloom.sources import probe

    (files / "d0" / "real.flac").write_bytes(b"fLaC\0\0\0\x22" + b"\0" * 10 + ((48000 << 44) | (1 << 41) | (15 << 36) | 48000).to_bytes(8, "big") + b"\0" * 16)
    rows = archive.hash_files(archive.listing(spark, [str(files)])).unionByName(spark.createDataFrame([(None, None, None, None, None), (f"{files}/none.wav", 1, None, None, None)], "path string, size_bytes long, modified_time timestamp, fingerprint string, error string"))
    apart, here = probe.probe_files(rows), probe.probe_files(rows, once=True)
    assert apart.columns == here.columns and sorted(map(str, apart.collect())) == sorted(map(str, here.collect()))
    assert here.where("status = 'ok'").count() == 1 and here.where("status = 'failed'").count() == 1
