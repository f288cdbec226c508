"""The application: index, search, dedupe, health; a command line with exit codes and a loopback HTTP service."""

from __future__ import annotations

import argparse
import ipaddress
import json
import os
import socket
from dataclasses import dataclass
from enum import IntEnum
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from urllib.parse import unquote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import dedupe, health, search
from lakeloom.plans.indexing import CHUNK_FILES, Import, IndexRun
from lakeloom.plans.jobs import JobQueue
from lakeloom.sources.report import write_report
from lakeloom.sources.store import Store, StoreError


class ExitCode(IntEnum):
    SUCCESS = 0
    PARTIAL = 1
    INDEXING_FAILED = 2
    SEARCH_FAILED = 3
    CONFIGURATION = 4
    INPUT = 5
    INTERNAL = 6


def default_data_dir() -> str:
    return os.environ.get("LAKELOOM_DATA_DIR") or os.path.join(os.environ.get("LOCALAPPDATA") or str(Path.home()), ".lakeloom")


class Engine:
    """Everything the command line and the service do. With headers, an index run also reads what file headers say."""

    def __init__(self, spark: SparkSession, data_dir: str, headers: bool = False, chunk_files: int = CHUNK_FILES) -> None:
        self.spark, self.headers, self.chunk_files = spark, headers, chunk_files
        self.store = Store(spark, data_dir)
        self.queue = JobQueue(self.store, {"index": self._index_job})
        self.imports = Import(self.store, self.store.root)

    def archive_id(self, name: str) -> str | None:
        row = self.store.table("archives").where(F.col("name") == name).first()
        return row["id"] if row else None

    def _index_job(self, context, job: dict) -> str:
        run = IndexRun(self.store, self.store.archive(job["archive_id"]), job["id"], self.headers, self.chunk_files)
        try:
            return run.work(context)
        except Exception:
            if context.is_cancelled():  # nothing of it will be asked for again
                run.discard()
            raise

    def index(self, name: str, roots: list[str]) -> dict:
        aid = self.store.find_or_create_archive(name, roots)
        job = self.queue.enqueue(aid, "index")
        self.queue.run_until_idle()
        if (state := self.queue.get(job))["status"] != "done":
            raise RuntimeError(state["error"])
        return {"archive": name, "assets": self.store.assets_of(aid).count(), "duplicate_groups": self.dedupe(name)["duplicate_groups"]}

    def import_files(self, name: str, paths: DataFrame) -> list[str]:
        """Enqueues the import of (path) into an archive, and the stages that wait for it; their jobs, in order."""
        return self.imports.enqueue(self.queue, self.store.find_or_create_archive(name, []), paths)

    def report(self, name: str, path: str, head: dict) -> None:
        """head and the archive's duplicate groups, a row for each member, as one JSON document at path; written by the executors."""
        assets = self.store.assets_of(self.archive_id(name))
        groups = dedupe.exact_members(assets.withColumn("asset_id", F.col("id"))).join(assets.select(F.col("id").alias("asset_id"), "path", "size_bytes"), "asset_id")
        write_report(groups.select("group_id", "asset_id", "path", "size_bytes").orderBy("group_id", "path"), path, head, "members")

    def dedupe(self, name: str) -> dict:
        aid = self.archive_id(name)
        assets = self.store.assets_of(aid).withColumn("asset_id", F.col("id"))
        groups = dedupe.exact_duplicates(assets)
        rows = groups.select(F.col("group_id").alias("id"), "match_kind", "similarity", F.lit(False).alias("reviewed"), F.lit(None).cast("string").alias("keeper"), "members")
        mine = assets.select("id")
        others = self.store.table("duplicate_groups").withColumn("first", F.get("members", F.lit(0)))
        keep = others.join(mine.withColumnRenamed("id", "first"), "first", "left_anti").drop("first")
        self.store.replace("duplicate_groups", keep.unionByName(rows.select(*keep.columns)))
        waste = dedupe.waste_report(groups, assets.select("asset_id", "size_bytes")).first()
        return {"archive": name, "duplicate_groups": waste["groups"], "reclaimable_bytes": waste["reclaimable_bytes"]}

    def search(self, archive_id: str, query: str, dialect: str = "boolean"):
        assets = self.store.assets_of(archive_id).withColumn("asset_id", F.col("id"))
        tags = self.store.table("tags")
        codec = F.get_json_object("technical", "$.codec")
        if dialect == "simple":
            return search.search_simple(search.simple_entries(assets.withColumn("codec", codec), tags), query)
        docs = search.search_docs(assets.withColumn("video_codec", codec).withColumn("container", F.get_json_object("technical", "$.container")), tags.where("not rejected"))
        return search.search(docs, query)

    def trend(self, archive_id: str | None, limit: int):
        rows = self.store.recent_snapshots(archive_id, limit)
        return health.recent_trend(rows.withColumn("interventions", F.col("missing_files") + F.col("corrupt_assets") + F.col("orphaned_derivatives")), limit)


#: Hits that a command line or a request gives at once; all are counted.
PAGE = 10_000


def page(rows: DataFrame, order: str, limit: int, offset: int) -> list:
    """Rows offset to offset + limit in order: a bounded heap in each task, and no more than the page on the driver."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return rows.orderBy(order).offset(offset).limit(limit).collect()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakeloom")
    p.add_argument("--data-dir", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "dedupe", "tag"):
        c = sub.add_parser(name)
        c.add_argument("--archive", required=True)
        if name == "index":
            c.add_argument("--roots", nargs="*", default=[])
        if name == "search":
            c.add_argument("--query", required=True)
            c.add_argument("--dialect", choices=("boolean", "simple"), default="simple")
            c.add_argument("--limit", type=int, default=PAGE)
            c.add_argument("--offset", type=int, default=0)
        if name == "dedupe":
            c.add_argument("--report", default=None)
        if name == "tag":
            c.add_argument("--local-only", action="store_true")
            c.add_argument("--allow-cloud", action="store_true")
    return p


def run(spark: SparkSession, argv: list[str]) -> tuple[ExitCode, str]:
    """One command: exit code and what to print."""
    try:
        args = parser().parse_args(argv)
    except SystemExit:
        return ExitCode.INPUT, "bad arguments"
    engine = Engine(spark, args.data_dir or default_data_dir())
    if args.command == "index":
        if not args.roots:
            return ExitCode.INPUT, "no roots"
        try:
            return ExitCode.SUCCESS, json.dumps(engine.index(args.archive, args.roots))
        except Exception as e:
            return ExitCode.INDEXING_FAILED, str(e)
    if args.command == "search":
        try:
            (search.parse if args.dialect == "boolean" else search.parse_simple)(args.query)
        except search.QueryError as e:
            return ExitCode.SEARCH_FAILED, str(e)
        if (aid := engine.archive_id(args.archive)) is None:
            return ExitCode.CONFIGURATION, f"no archive {args.archive}"
        hits = engine.search(aid, args.query, args.dialect).join(engine.store.table("assets").select(F.col("id").alias("asset_id"), "path"), "asset_id")
        rows, n = page(hits, "path", args.limit, args.offset), hits.count()
        return ExitCode.SUCCESS, "\n".join([*(f"{r['path']}: {'; '.join(r['explanations'])}" for r in rows), f"{n} match(es)"])
    if engine.archive_id(args.archive) is None:
        return (ExitCode.INDEXING_FAILED if args.command == "dedupe" else ExitCode.CONFIGURATION), f"no archive {args.archive}"
    if args.command == "dedupe":
        found = engine.dedupe(args.archive)
        if args.report:
            engine.report(args.archive, args.report, found)
        return ExitCode.SUCCESS, json.dumps(found)
    return ExitCode.SUCCESS, "tagging needs a model: nothing was tagged"


def host_of(bind: str) -> str:
    """The host of `host` or `host:port`; IPv6 addresses stand bare or in brackets."""
    if bind.startswith("["):
        end = bind.find("]")
        return bind if end < 0 else bind[: end + 1]
    return bind.rpartition(":")[0] if bind.count(":") == 1 else bind


def check_bind(bind: str) -> str:
    """The host if it is a loopback address; anything else is an error."""
    host = host_of(bind)
    bare = host[1:-1] if host.startswith("[") and host.endswith("]") else host
    try:
        ok = bare == "localhost" or ipaddress.ip_address(bare).is_loopback
    except ValueError:
        ok = False
    if not ok:
        raise ValueError(f"not a loopback address: {bind}")
    return bare


@dataclass(frozen=True)
class ApiConfig:
    """The service is off unless it is enabled, and never binds anything but the loopback."""

    enabled: bool = False
    bind: str = "127.0.0.1"
    port: int = 8420

    def validate(self) -> str:
        return check_bind(self.bind)

    def start(self, engine: Engine) -> HTTPServer | None:
        """The server, or None if it is not enabled. A port in `bind` goes before `port`."""
        host = self.validate()
        if not self.enabled:
            return None
        after = self.bind[len(host_of(self.bind)) :].lstrip(":")
        return serve(engine, int(after) if after else self.port, host)


class NotFoundError(LookupError):
    """There is no such row."""


class Commands:
    """What a desktop program or the service asks for, by name: plain values in and out."""

    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def health(self) -> dict:
        return {"status": "ok", "archives": self.engine.store.table("archives").count()}

    def list_archives(self) -> list[dict]:
        return [r.asDict() for r in self.engine.store.archives().collect()]

    def search(self, archive: str, q: str, dialect: str = "simple", limit: int = PAGE, offset: int = 0) -> list[dict]:
        return [r.asDict() for r in page(self.engine.search(archive, q, dialect), "asset_id", limit, offset)]

    def row(self, table: str, key: str) -> dict:
        found = self.engine.store.table(table).where(F.col("id") == key).first()
        if found is None:
            raise NotFoundError(f"{table}: {key}")
        return found.asDict()

    def health_trend(self, archive: str | None = None, limit: int = 30) -> list[dict]:
        return [r.asDict() for r in self.engine.trend(archive, limit).collect()]

    def reindex(self, archive: str) -> dict:
        if self.engine.store.archive(archive) is None:
            raise NotFoundError(f"archives: {archive}")
        return {"job": self.engine.queue.enqueue(archive, "index")}


def _status(error: Exception) -> int:
    if isinstance(error, (search.QueryError, KeyError, ValueError)):
        return 400
    if isinstance(error, NotFoundError):
        return 404
    unavailable = isinstance(error, StoreError) or any(n in str(error) for n in ("java.io.", "PATH_NOT_FOUND", "UNABLE_TO_INFER", "FAILED_READ_FILE"))
    return 503 if unavailable else 500


def serve(engine: Engine, port: int = 8420, host: str = "127.0.0.1", decode: bool = True) -> HTTPServer:
    """GET /health, /search?archive=&q=, /assets/<id>, /jobs/<id>, /health-trend; POST /reindex?archive=. Call serve_forever().

    Errors: 400 for a bad query or a missing argument, 404 for what isn't there, 503 if the store can't be read, else 500.
    """
    commands = Commands(engine)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _answer(self, method: str):
            path, _, query = self.path.partition("?")
            args = dict(x.partition("=")[::2] for x in query.split("&") if x)
            args = {k: unquote_plus(v) if decode else v for k, v in args.items()}
            if method == "GET" and path == "/health":
                return commands.health()
            if method == "GET" and path == "/search":
                return commands.search(args["archive"], args["q"], args.get("dialect", "simple"), int(args.get("limit", PAGE)), int(args.get("offset", 0)))
            if method == "GET" and path.startswith(("/assets/", "/jobs/")):
                _, kind, key = path.split("/", 2)
                return commands.row(kind, key)
            if method == "GET" and path == "/health-trend":
                return commands.health_trend(args.get("archive"), int(args.get("limit", 30)))
            if method == "POST" and path == "/reindex":
                return commands.reindex(args["archive"])
            raise NotFoundError("no such route")

        def _handle(self, method: str) -> None:
            try:
                self._send(200, self._answer(method))
            except Exception as e:
                self._send(_status(e), {"error": str(e)})

        def do_GET(self) -> None:  # noqa: N802
            self._handle("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._handle("POST")

        def log_message(self, *args) -> None:
            pass

    family = socket.AF_INET6 if ":" in check_bind(host) else socket.AF_INET
    return type("Server", (HTTPServer,), {"address_family": family})((check_bind(host), port), Handler)


def strict_parser() -> argparse.ArgumentParser:
    """The second command line: an archive is a configuration file, roots repeat, and a cloud model needs a second flag."""
    p = argparse.ArgumentParser(prog="lakeloom")
    p.add_argument("--data-dir", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "dedupe", "tag"):
        c = sub.add_parser(name)
        c.add_argument("--archive", required=True)
        if name == "index":
            c.add_argument("--root", dest="roots", action="append", default=[])
        if name == "search":
            c.add_argument("--query", required=True)
        if name == "dedupe":
            c.add_argument("--report", required=True)
        if name == "tag":
            c.add_argument("--local-only", action="store_true", default=True)
            c.add_argument("--cloud", action="store_true")
            c.add_argument("--cloud-confirmed", action="store_true")
    return p


def read_archive_file(path: str) -> tuple[str, list[str]]:
    """Name and roots of an archive's configuration: the lines `name: x` and `roots:` with `- path` below it."""
    name, roots, below = "", [], False
    for line in Path(path).read_text().splitlines():
        bare = line.split(" #")[0].strip()
        if bare.startswith("- ") and below:
            roots.append(bare[2:].strip().strip("'\""))
        elif ":" in bare and not bare.startswith("#"):
            key, _, value = bare.partition(":")
            below = key == "roots"
            if key == "name":
                name = value.strip().strip("'\"")
    if not name:
        raise ValueError(f"no name in {path}")
    return name, roots


def run_strict(spark: SparkSession, argv: list[str]) -> tuple[ExitCode, str]:
    """A command of the second command line, in the boolean dialect."""
    try:
        args = strict_parser().parse_args(argv)
    except SystemExit:
        return ExitCode.INPUT, "bad arguments"
    if args.command == "tag" and args.cloud and not args.cloud_confirmed:
        return ExitCode.INPUT, "--cloud needs --cloud-confirmed"
    own = ["--data-dir", args.data_dir] if args.data_dir else []
    if args.command == "index":
        try:
            name, roots = read_archive_file(args.archive)
        except (OSError, ValueError) as e:
            return ExitCode.CONFIGURATION, str(e)
        return run(spark, [*own, "index", "--archive", name, "--roots", *(args.roots or roots)])
    more = {"search": lambda: ["--query", args.query, "--dialect", "boolean"], "dedupe": lambda: ["--report", args.report], "tag": lambda: ["--allow-cloud"] if args.cloud else ["--local-only"]}
    return run(spark, [*own, args.command, "--archive", args.archive, *more[args.command]()])
