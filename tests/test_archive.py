"""Behaviour of the archive operators on small hand-made inputs."""

from __future__ import annotations

import hashlib
import json
import os
import random
import threading
import urllib.request
import uuid

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import media, text
from lakeloom.operators import dedupe, health, kernels, scenes, search, tagging
from lakeloom.plans import api
from lakeloom.plans.jobs import JobQueue, Stage
from lakeloom.sources import archive
from lakeloom.sources.store import Store


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "2024/interview_prores.mov", "prores", 1920, 1080), (2, "2024/b_roll.mov", "prores", 1920, 1080), (3, "audio/room_tone.wav", None, None, None)]
    assets = spark.createDataFrame(rows, "asset_id long, path string, video_codec string, width int, height int")
    return search.search_docs(assets, spark.createDataFrame([(1, "interview")], "asset_id long, label string"))


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("codec:prores AND tag:interview", [1]), ("interview", [1]), ("2024", [1, 2]), ("CODEC:ProRes", [1, 2]), ("codec:pro", []), ("resolution:1920x1080", [1, 2]),
        ("b_roll OR room_tone", [2, 3]), ("prores NOT tag:interview", [2]), ("NOT media:video", [3]), ("", [1, 2, 3]), ("*", [1, 2, 3]), ("nofield:x", []), ("(b_roll OR room_tone) NOT ext:wav", [2]),
    ],
)
def test_boolean_search(docs, query, ids):
    assert [r["asset_id"] for r in search.search(docs, query).collect()] == ids


def test_explanations(docs):
    found = {r["asset_id"]: r["explanations"] for r in search.search(docs, "b_roll NOT tag:interview OR 2024").collect()}
    assert found[2] == ['filename matches "b_roll" (b_roll.mov)', "matches all assets", 'path matches "2024" (2024/b_roll.mov)']
    assert found[1] == ['path matches "2024" (2024/interview_prores.mov)']


@pytest.mark.parametrize(("query", "position"), [('a "b', 2), ("NOT NOT a", 4), ("(a", 0), ("a )", 2), ("a AND", 3), ("OR", 0), ("é )", 3)])
def test_query_errors(query, position):
    with pytest.raises(search.QueryError) as e:
        search.parse(query)
    assert e.value.position == position


def test_parser_never_fails_otherwise():
    rng = random.Random(7)
    for _ in range(3000):
        q = "".join(rng.choice(['a', 'AND', 'OR', 'NOT', '(', ')', '"', ':', ' ', 'é', '*', 'x:y']) for _ in range(rng.randint(0, 12)))
        for parse in (search.parse, search.parse_simple):
            try:
                parse(q)
            except search.QueryError:
                pass
    assert search.term_count(search.parse("a b OR c:d NOT e")) == 4
    assert str(search.parse("a AND (b OR c:d)")) == "(a AND (b OR c:d))"
    assert search.parse('field:"two words"') == search.And(search.Term("field:"), search.Term("two words", None, True))


def test_simple_search(spark):
    entries = spark.createDataFrame([("a", "interview_av1.mkv", "av1", ["interview"], "press event")], "asset_id string, filename string, codec string, tags array<string>, notes string")
    ids = lambda q: [r["asset_id"] for r in search.search_simple(entries, q).collect()]
    assert ids("codec:AV1 and tag:inter") == ["a"] and ids("av1") == ["a"] and ids("codec:vp9") == [] and ids("notes:press and other:EVENT") == ["a"]
    assert search.search_simple(entries, "codec:av1").first()["explanations"] == ["filename contains 'av1'", "codec 'av1' matches"]
    for bad in ("", "a and", "a:", ":b and c"):
        with pytest.raises(search.QueryError):
            search.parse_simple(bad)


def test_text_functions(spark):
    rows = spark.createDataFrame([("a.tar.gz",), (".bashrc",), ("foo.",), ("É.MKV",)], "n string")
    assert [r[0] for r in rows.select(text.extension(F.col("n"))).collect()] == ["gz", "", "", "mkv"]
    assert [r[0] for r in rows.select(text.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in rows.collect()]
    one = spark.range(1)
    assert one.select(text.unicode_trim(F.lit("  a  "))).first()[0] == "a"
    assert one.select(media.duration_ms(F.lit(0.0005)), media.duration_ms(F.lit(float("nan"))), media.frame_rate(F.lit(29.97)), media.frame_rate(F.lit(0.0)), media.mkv_codec(F.lit("A_PCM/INT/LIT"))).first()[:] == (1, None, (29970, 1000), None, "pcm")


def test_waste(spark):
    groups = lambda keeper: spark.createDataFrame([(1, [1, 2, 3], keeper)], "group_id long, members array<long>, keeper long")
    sizes = spark.createDataFrame([(1, 4100), (2, 4100), (3, 3900)], "asset_id long, size_bytes long")
    assert dedupe.waste_report(groups(None), sizes).first()[:] == (1, 3, 8000)
    assert dedupe.waste_report(groups(3), sizes).first()[:] == (1, 3, 8200)
    assert dedupe.waste_report(groups(None), sizes.limit(0)).first()[:] == (1, 0, 0)
    with pytest.raises(Exception, match="member"):
        dedupe.choose_keeper(groups(None), 1, 9).collect()


def test_leader_groups_and_pairs_against_loops(spark):
    rng = random.Random(2)
    for k in (3, 12):
        base = [rng.getrandbits(64) for _ in range(6)]
        hashes = [rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for _ in range(60)]
        hashes = [h & (2**64 - 1) for h in hashes]
        signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
        rows = spark.createDataFrame(list(enumerate(signed)), "id long, hash long")
        near = lambda a, b: bin(hashes[a] ^ hashes[b]).count("1") <= k  # noqa: B023, E731
        assert {(r["a"], r["b"]) for r in dedupe.hamming_pairs(rows, k).collect()} == {(a, b) for a in range(60) for b in range(a + 1, 60) if near(a, b)}
        used, want = set(), set()
        for i in range(60):
            if i not in used:
                group = [j for j in range(i, 60) if j not in used and near(i, j)]
                used.update(group)
                if len(group) > 1:
                    want |= {(i, j) for j in group}
        assert {(r["leader"], r["member"]) for r in dedupe.leader_groups(rows, k).collect()} == want


def test_leaders_are_met_in_rounds(spark, monkeypatch):
    """Against a loop, with few ids a round; pairs are made among the ids of a round alone, not among all."""
    rng = random.Random(5)
    k, base = 18, [rng.getrandbits(64) for _ in range(40)]
    hashes = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 12))) for _ in range(400)] + [rng.getrandbits(64) for _ in range(100)]
    rng.shuffle(hashes)
    signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
    want, leaders = set(), []
    for i, h in enumerate(hashes):
        lead = next((j for j in leaders if (hashes[j] ^ h).bit_count() <= k), i)
        leaders += [i] if lead == i else []
        want.add((lead, i))
    several = {lead for lead, i in want if lead != i}
    met, pairs = [], dedupe.hamming_pairs
    monkeypatch.setattr(dedupe, "hamming_pairs", lambda rows, *a: met.append(rows.count()) or pairs(rows, *a))
    monkeypatch.setattr(dedupe, "TILE_ROWS", 60)
    monkeypatch.setattr(dedupe.leaders_by_rounds, "__defaults__", (30, 80))
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(signed)], "id long, hash long").repartition(3)
    assert {(r["leader"], r["member"]) for r in dedupe.leader_groups(rows, k).collect()} == {(lead, i) for lead, i in want if lead in several}
    assert len(met) > 2 and max(met) <= 90


def test_kernels(spark):
    solid, black, white = bytes([9, 9, 9, 255]) * (32 * 24), bytes([0, 0, 0, 255]) * 64, bytes([255] * 4) * 64
    assert kernels.dhash(solid, 32, 24) == 0
    ramp = b"".join(bytes([200 - 5 * x] * 3 + [255]) for _ in range(24) for x in range(32))
    assert kernels.dhash(ramp, 32, 24) == -1
    assert kernels.frame_difference(black, black) == 0 and abs(kernels.frame_difference(black, white) - 1) < 0.01
    pcm = [0.5, -0.5] * 2048
    assert kernels.audio_fingerprint(pcm, 1, 8) == kernels.audio_fingerprint(pcm, 1, 8) and len(kernels.audio_fingerprint(pcm, 1, 8)) == 8
    row = spark.createDataFrame([(solid, 32, 24)], "d binary, w int, h int").select(kernels.dhash_udf("d", "w", "h")).first()
    assert row[0] == 0


def test_scenes(spark):
    scores = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9), ("a", 2, 0.1)], "asset_id string, frame int, score double")
    out = scenes.split_scenes(scores, 0.5, 10.0, spark.createDataFrame([("a",), ("b",)], "asset_id string")).orderBy("asset_id", "scene").collect()
    assert [tuple(r) for r in out] == [("a", 0, 0.0, 0.1), ("a", 1, 0.1, None), ("b", 0, 0.0, None)]


def test_tags_and_health(spark):
    t = spark.createDataFrame([(1, " Cat ", "local"), (1, "cat", "manual"), (2, "cat", "local")], "asset_id long, label string, source string")
    memory = tagging.remember(t.limit(1))
    assert [r["decision"] for r in tagging.decisions(t, memory).orderBy("asset_id", "label").collect()] == ["propose-flagged-rejected", "propose", "propose"]
    snaps = spark.createDataFrame([(3, 4), (1, 1), (2, 2)], "taken_at int, interventions long")
    assert [r["delta"] for r in health.trend(snaps).orderBy("taken_at").collect()] == [0, 1, 2]
    assert [r["delta"] for r in health.recent_trend(snaps, 2).orderBy("taken_at").collect()] == [0, 2]


@pytest.fixture
def tree(tmp_path):
    for name, body in {"a.mkv": b"\0" * 16, "b.mkv": b"\0" * 16, "sub/deep/c.txt": b"c", "sub/.hidden": b"h", "_x": b"", "é.wav": b"w"}.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    os.symlink(tmp_path / "tree" / "a.mkv", tmp_path / "tree" / "link.mkv")
    os.symlink(tmp_path / "tree" / "sub", tmp_path / "tree" / "loop")
    return str(tmp_path / "tree")


def test_scan(spark, tree):
    files, issues = archive.scan(spark, [tree])
    got = {os.path.relpath(r["path"], tree): r["fingerprint"] for r in files.collect()}
    assert set(got) == {"a.mkv", "b.mkv", "sub/deep/c.txt", "sub/.hidden", "_x", "é.wav", "link.mkv"}
    assert got["_x"] == hashlib.sha256(b"").hexdigest() and issues.count() == 0
    assert archive.scan(spark, [tree, tree + "/nowhere"], "simple")[1].count() == 1
    with pytest.raises(archive.ScanConfigError):
        archive.scan(spark, [tree + "/nowhere"])
    before = files.persist()
    before.count()
    with open(tree + "/a.mkv", "ab") as f:
        f.write(b"!")
    out = {r["outcome"] for r in archive.classify_scan(archive.scan(spark, [tree])[0], before).where("path like '%/a.mkv'").collect()}
    assert out == {"changed"}


def test_scan_parts(tmp_path, monkeypatch):
    """Every file is read by one task, however the tree is parted; a flat directory is dealt over several."""
    names = {f"{d}/{i}.bin" for d in ("", "/flat", "/deep/er/est") for i in range(20)} | {"/deep/er/x.bin"}
    for name in names:
        path = str(tmp_path) + "/" + name.lstrip("/")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        open(path, "w").close()
    for listed, size in ((1, 10_000), (1, 7), (3, 7), (64, 7)):
        monkeypatch.setattr(archive, "LISTED", listed)
        monkeypatch.setattr(archive, "FILES_A_TASK", size)
        reader = archive.ArchiveReader({"roots": json.dumps([str(tmp_path)])})
        parts = reader.partitions()
        read = [row[1] for p in parts for row in reader.read(p)]
        assert sorted(read) == sorted(str(tmp_path) + "/" + n.lstrip("/") for n in names)
        assert sum(p.path == str(tmp_path) for p in parts) == (1 if size > 20 else 3)
    assert sum(p.path.endswith("/flat") for p in parts) == 3 and not any(p.deep for p in parts)


def test_watch(spark, tree, tmp_path):
    from lakeloom import streaming

    seen = []
    run = lambda: streaming.on_hints(streaming.watch(spark, [tree]), lambda df, i: seen.append({(os.path.basename(r["path"]), r["deleted"]) for r in df.collect()}), str(tmp_path / "ck")).awaitTermination()
    run()
    os.rename(tree + "/a.mkv", tree + "/z.mkv")
    run()
    assert set().union(*seen) >= {("a.mkv", False), ("a.mkv", True), ("z.mkv", False)}


def test_application(spark, tree, tmp_path):
    data = str(tmp_path / "data")
    code, out = api.run(spark, ["--data-dir", data, "index", "--archive", "home", "--roots", tree])
    assert code == 0 and json.loads(out) == {"archive": "home", "assets": 6, "duplicate_groups": 1}
    assert api.run(spark, ["--data-dir", data, "index", "--archive", "home", "--roots", tree])[0] == 0  # again: same ids
    code, out = api.run(spark, ["--data-dir", data, "search", "--archive", "home", "--query", "a.mkv"])
    assert code == 0 and out.endswith("1 match(es)")
    assert api.run(spark, ["--data-dir", data, "search", "--archive", "home", "--query", "a:"])[0] == 3
    assert api.run(spark, ["--data-dir", data, "search", "--archive", "none", "--query", "a"])[0] == 4
    assert api.run(spark, ["--data-dir", data, "dedupe", "--archive", "none"])[0] == 2
    assert api.run(spark, ["--data-dir", data, "index", "--archive", "home"])[0] == 5
    engine = api.Engine(spark, data)
    aid = engine.archive_id("home")
    server = api.serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda p: json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}"))
    assert get("/health")["archives"] == 1 and len(get(f"/search?archive={aid}&q=b.mkv")) == 1 and len(get("/health-trend")) == 2
    server.shutdown()
    with pytest.raises(ValueError):
        api.check_bind("0.0.0.0")
    engine.store.delete_archive(aid)
    assert engine.store.table("assets").count() == 0 and engine.store.table("health_snapshots").count() == 0 and engine.store.table("jobs").where("archive_id is not null").count() == 0


def test_job_recovery(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    queue = JobQueue(store)
    job = queue.enqueue(None, "tagging", lambda c, j: c.report_progress(0.4))
    queue._update(job, status="active", progress=0.4)
    again = JobQueue(store, {"tagging": lambda c, j: "fine"})
    assert again.get(job)["status"] == "queued"
    bad = again.enqueue(None, "tagging", lambda c, j: 1 / 0)
    gone = again.enqueue(None, "tagging")
    again.cancel(gone)
    again.run_until_idle()
    assert [again.get(j)["status"] for j in (job, bad, gone)] == ["done", "failed", "cancelled"]
    assert Stage.SEARCH_INDEX_METADATA.in_first_pass and not Stage.DERIVATIVES.in_first_pass
    store.set_preference("a", "1")
    store.set_preference("a", "2")
    assert store.preference("a") == "2" and store.preference("b") is None


def test_store_versions_and_reads(spark, tmp_path):
    from lakeloom.sources.store import ENUMS, StoreError, decode_enum, encode_enum, numbered

    root = str(tmp_path / "s")
    store = Store(spark, root)
    aid = store.find_or_create_archive("b", ["/y", "/x"])
    store.find_or_create_archive("a", ["/z"])
    assert [r["name"] for r in store.archives().collect()] == ["a", "b"]
    assert [tuple(r) for r in store.roots_of(aid).collect()] == [(0, "/x"), (1, "/y")]
    assert store.archive(aid)["name"] == "b" and store.archive("none") is None and store.asset("none") is None
    groups = spark.createDataFrame([("g", "exact-hash", 1.0, False, None, ["k", "j"])], "id string, match_kind string, similarity float, reviewed boolean, keeper string, members array<string>")
    store.upsert("duplicate_groups", groups)
    assert store.group("g")["members"] == ["k", "j"] and store.group("h") is None
    for bad in (("h", None), ("g", "q")):
        with pytest.raises(StoreError):
            store.review_group(*bad)
    store.review_group("g", "j")
    assert (store.group("g")["keeper"], store.group("g")["reviewed"]) == ("j", True)
    store.delete_group("g")
    assert store.group("g") is None
    with pytest.raises(Exception, match="invalid job_kind other"):
        JobQueue(store).enqueue(None, "other")
    tags = spark.createDataFrame([("k", f"l{i:02d}") for i in range(40)], "asset_id string, label string")
    more = {c: F.lit(None) for c in ("model", "version", "provider", "confidence")}
    for _ in range(2):
        store.add_tags(tags.withColumns(more | {"source": F.lit("manual"), "rejected": F.lit(False)}))
    assert [(r["id"], r["label"]) for r in store.table("tags").orderBy("id").collect()] == [(i + 1, f"l{i % 40:02d}") for i in range(80)]
    assert store.vacuum() > 0 and store.vacuum() == 0 and store.table("tags").count() == 80
    assert Store(spark, root).archive(aid)["roots"] == ["/x", "/y"]
    (tmp_path / "s" / "VERSION").write_text("99")
    (tmp_path / "s" / ".VERSION.crc").unlink(missing_ok=True)
    with pytest.raises(StoreError, match="version 99"):
        Store(spark, root)
    values = spark.createDataFrame([(v, i) for i, v in enumerate(ENUMS["job_status"])] + [(None, None)], "v string, i int")
    assert all(r[0] == r[1] and r[2] == r[3] for r in values.select("i", encode_enum("job_status", F.col("v")), "v", decode_enum("job_status", F.col("i"))).collect())
    for column in (encode_enum("match_kind", F.lit("odd")), decode_enum("match_kind", F.lit(7))):
        with pytest.raises(Exception, match="invalid match_kind"):
            spark.range(1).select(column).collect()
    assert numbered(spark.createDataFrame([], "path string"), ["path"]).count() == 0


def test_upsert_ties_are_settled(spark):
    from lakeloom.sources.store import upsert

    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, x string, n int")
    new = spark.createDataFrame([(1, "c", 1), (1, "d", 0), (1, "d", 5), (3, None, None)], "id long, x string, n int")
    assert sorted(map(tuple, upsert(old, new, ["id"]).collect())) == [(1, "d", 5), (2, "b", 2), (3, None, None)]


def test_index_scanned(spark):
    from lakeloom.sources.archive import index_scanned

    files = spark.createDataFrame([(p, "f") for p in ("b", "a", "c")], "path string, fingerprint string")
    none = spark.createDataFrame([], "id long, path string, fingerprint string")
    assert sorted(map(tuple, index_scanned(files, none).collect())) == [(1, "a", "f"), (2, "b", "f"), (3, "c", "f")]
    some = spark.createDataFrame([(7, "z")], "id long, path string")
    assert min(r["id"] for r in index_scanned(files, some).collect()) == 8
    for bad, message in ((files.unionByName(files.limit(1)), "path already indexed"), (files.withColumn("fingerprint", F.lit(None).cast("string")), "unreadable file")):
        with pytest.raises(Exception, match=message):
            index_scanned(bad, none).collect()
    with pytest.raises(Exception, match="path already indexed"):
        index_scanned(files, spark.createDataFrame([(1, "b")], "id long, path string")).collect()


def test_headers_findings_and_second_command_line(spark, tmp_path):
    import json

    from lakeloom.plans import api

    root = tmp_path / "files"
    root.mkdir()
    (root / "odd.dat").write_bytes(b"fLaC\0\0\0\x22" + b"\0" * 10 + ((48000 << 44) | (1 << 41) | (15 << 36) | 48000).to_bytes(8, "big") + b"\0" * 16)
    (root / "text.xyz").write_text("words")
    data = str(tmp_path / "data")
    engine = api.Engine(spark, data, headers=True)
    assert engine.index("arch", [str(root)])["assets"] == 2
    rows = {r["path"].rsplit("/", 1)[1]: r for r in engine.store.table("assets").collect()}
    assert rows["odd.dat"]["media_type"] == "audio" and rows["odd.dat"]["supported"] and json.loads(rows["odd.dat"]["technical"])["codec"] == "flac"
    assert not rows["text.xyz"]["supported"]
    (root / "odd.dat").unlink()
    engine.index("arch", [])
    kinds = {(r["kind"], r["subject"].rsplit("/", 1)[-1]) for r in engine.store.table("health_findings").collect()}
    assert ("missing-file", "odd.dat") in kinds and ("corrupt-asset", rows["text.xyz"]["id"]) in kinds
    assert not any((tmp_path / "data" / "runs").iterdir())
    # The second command line.
    config = tmp_path / "arch.yaml"
    config.write_text(f"# an archive\nname: 'arch'\nroots:\n  - {root}\n")
    say = lambda *a: api.run_strict(spark, ["--data-dir", data, *a])
    assert say("index", "--archive", str(config))[0] == api.ExitCode.SUCCESS
    assert say("index", "--archive", str(tmp_path / "none.yaml"))[0] == api.ExitCode.CONFIGURATION
    code, out = say("search", "--archive", "arch", "--query", "text NOT media:audio")
    assert code == api.ExitCode.SUCCESS and "text.xyz" in out
    assert say("tag", "--archive", "arch", "--cloud")[0] == api.ExitCode.INPUT
    assert say("tag", "--archive", "arch", "--cloud", "--cloud-confirmed")[0] == api.ExitCode.SUCCESS
    assert say("dedupe", "--archive", "arch")[0] == api.ExitCode.INPUT
    assert say("dedupe", "--archive", "arch", "--report", str(tmp_path / "r.json"))[0] == api.ExitCode.SUCCESS and (tmp_path / "r.json").exists()


def test_service_configuration_and_statuses(spark, tmp_path):
    import shutil
    import threading
    import urllib.error
    import urllib.request

    from lakeloom.plans import api

    for bind, host in (("127.0.0.1", "127.0.0.1"), ("localhost:99", "localhost"), ("[::1]:8420", "[::1]"), ("::1", "::1"), ("[::1", "[::1"), ("10.0.0.1:1", "10.0.0.1")):
        assert api.host_of(bind) == host
    for bad in ("0.0.0.0", "10.0.0.1:1", "[::1", "example.com", ""):
        with pytest.raises(ValueError):
            api.ApiConfig(bind=bad).validate()
    engine = api.Engine(spark, str(tmp_path / "data"))
    assert api.ApiConfig().start(engine) is None
    server = api.ApiConfig(enabled=True, bind="127.0.0.1:0").start(engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def status(path, method="GET"):
        try:
            return urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", method=method), timeout=60).status
        except urllib.error.HTTPError as e:
            return e.code

    try:
        assert [status("/health"), status("/nothing"), status("/assets/x"), status("/search?archive=x"), status("/reindex?archive=x", "POST")] == [200, 404, 404, 400, 404]
        engine.store.set_preference("a", "b")
        aid = engine.store.find_or_create_archive("n", [])
        assert status(f"/search?archive={aid}&q=colour:") in (200, 400)
        shutil.rmtree(next((tmp_path / "data" / "archives").glob("v_*")))
        for v in (tmp_path / "data" / "archives").glob("v_*"):
            shutil.rmtree(v)
        assert status("/health") == 503
    finally:
        server.shutdown()
        server.server_close()


def test_semantic_entries_and_layers(spark):
    from lakeloom.operators.search import SearchLayer, semantic_entries

    entries = spark.createDataFrame([("a",), ("b",)], "asset_id string")
    vectors = spark.createDataFrame([("a", [0.5], "local-model")], "asset_id string, embedding array<double>, source string")
    assert sorted(map(tuple, semantic_entries(entries, vectors).collect())) == [("a", [0.5], "local-model", True), ("b", None, None, False)]
    assert not any(r["has_embedding"] for r in semantic_entries(entries).collect())
    assert [x.value for x in SearchLayer] == ["metadata", "full-text", "semantic"]
