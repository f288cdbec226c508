"""A report as one JSON document, written by the executors.

df.write.format("lakeloom_report").option("path", file).option("head", json).option("rows", "groups").save(): each task
writes its rows as a part beside the file; once all have, the parts are strung together under the report's head, stream
by stream, and the file appears by one rename. If a task fails for good, the parts go and there is no report, nor is one
that was there before touched. The folder of the file must be one that all executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_CHUNK = 1 << 20


@dataclass
class _Part(WriterCommitMessage):
    order: int
    name: str
    rows: int


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.head, self.rows = options["path"], json.loads(options.get("head", "{}")), options.get("rows", "rows")
        self.parts = f"{self.path}.{uuid.uuid4().hex}"
        os.makedirs(self.parts)  # here and not by tasks: one that outlives the others finds it gone and leaves nothing

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        context = TaskContext.get()
        name, n = f"{self.parts}/{context.partitionId():09d}-{context.taskAttemptId()}", 0
        with open(name, "w", encoding="utf-8", errors="surrogatepass") as out:
            for row in iterator:
                out.write(("," if n else "") + json.dumps(row.asDict(recursive=True), default=str))
                n += 1
        return _Part(context.partitionId(), name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        whole, first = f"{self.parts}.whole", True
        with open(whole, "wb") as out:
            out.write((json.dumps(self.head)[:-1] + (", " if self.head else "") + json.dumps(self.rows) + ": [").encode())
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.order):
                out.write(b"" if first else b",")
                first = False
                with open(part.name, "rb") as made:
                    shutil.copyfileobj(made, out, _CHUNK)
            out.write(b"]}\n")
        os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lakeloom_report"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(self.options)


def write_report(rows: DataFrame, path: str, head: dict, name: str) -> None:
    """{**head, name: [rows]} at path."""
    rows.sparkSession.dataSource.register(ReportSink)
    rows.write.format("lakeloom_report").mode("append").option("path", path).option("head", json.dumps(head)).option("rows", name).save()
