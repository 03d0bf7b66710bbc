"""A data source that writes a new version of a folder: tasks copy, rename and rewrite its files."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .staging import staged
from .tree import CHUNK, FILES, local_path

#: Bytes of files that a task copies, about.
TASK_BYTES = 1 << 28
COLUMNS = "path string, target string, renamed boolean, link string, spans array<struct<start:bigint,end:bigint,value:binary>>"


def splice(source: str, target: str, spans: list) -> None:
    """Copy source to target with byte spans (start, end, value) replaced, CHUNK bytes at a time."""
    with open(source, "rb") as f, open(target, "wb") as out:
        for start, end, value in sorted((s["start"], s["end"], bytes(s["value"])) for s in spans):
            left = start - f.tell()
            while left > 0 and (block := f.read(min(CHUNK, left))):
                out.write(block)
                left -= len(block)
            out.write(value)
            f.seek(end)
        shutil.copyfileobj(f, out, CHUNK)
    shutil.copystat(source, target)


@dataclass
class Written(WriterCommitMessage):
    """The file of a task's operations."""

    part: str


class VersionWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.stage, self.parts = (os.path.abspath(local_path(options[k])) for k in ("root", "stage", "parts"))
        self.fail_after = options.get("fail_after", "")

    def write(self, iterator: Iterator) -> Written:
        mine = os.path.join(self.parts, uuid4().hex)
        os.makedirs(mine)
        try:
            operations = []
            for row in iterator:
                if kind := self._file(row, os.path.join(mine, "file")):
                    operations.append({"kind": kind, "source": row["path"], "target": row["target"]})
                if kind == "rename" and self.fail_after == "first-rename":
                    raise RuntimeError("stopped after first-rename")
            Path(f"{mine}.json").write_text(json.dumps(operations), encoding="utf-8")
        finally:
            shutil.rmtree(mine, ignore_errors=True)
        return Written(f"{mine}.json")

    def _file(self, row, new: str) -> str | None:
        """Make one file of the version, whole or not at all; the kind of operation, if it is not a copy."""
        source, target = os.path.join(self.root, row["path"]), os.path.join(self.stage, row["target"])
        if row["path"].endswith("/"):
            os.makedirs(target, exist_ok=True)
            return None
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if row["link"] is not None:
            os.symlink(row["link"], new)
        elif row["spans"] is not None:
            splice(source, new, row["spans"])
        else:
            shutil.copy2(source, new)
        os.replace(new, target)
        return "replace" if row["spans"] is not None else "rename" if row["renamed"] else None

    def commit(self, messages: list[Written | None]) -> None:
        """List the operations of the tasks that counted: renames, then documents, by path."""
        rows = [r for m in messages if m for r in json.loads(Path(m.part).read_text(encoding="utf-8"))]
        rows.sort(key=lambda r: (r["kind"] != "rename", r["source"]))
        Path(self.parts, "manifest.json").write_text(json.dumps(rows), encoding="utf-8")

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class VersionSource(DataSource):
    """Sink of rows COLUMNS, one for each file, link or empty folder (a path that ends with /) of root.

    Options: root, stage (the new folder), parts (a folder on the same device for files in the making),
    fail_after ("first-rename", for fault injection). All must be open to all executors. A file appears
    under its name when it is whole, so tasks may run again or twice; a manifest of operations appears
    when all tasks are done; a job that fails drops the stage."""

    @classmethod
    def name(cls) -> str:
        return "marlstone_version"

    def writer(self, schema, overwrite: bool) -> VersionWriter:
        return VersionWriter(self.options)


def write_version(files: DataFrame, renames: DataFrame, spans: DataFrame, root: str, stage: str, parts: str, fail_after: str = "") -> list[dict]:
    """Write files (path, length, link) of root into stage; the operations (kind, source, target).

    renames (path, target) gives assets other names, spans (path, start, end, value) documents other
    bytes. Only names and spans are joined; tasks read the files themselves and write them by chunks.
    The number of tasks follows the bytes and files to write."""
    spark = files.sparkSession
    spark.dataSource.register(VersionSource)
    files = staged(files.select("path", "length", "link"))
    size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-size[0] // FILES), -(-size[1] // TASK_BYTES))
    spans = spans.groupBy("path").agg(F.collect_list(F.struct("start", "end", "value")).alias("spans"))
    rows = files.join(renames, "path", "left").join(spans, "path", "left")
    rows = rows.select("path", F.coalesce("target", "path").alias("target"), F.col("target").isNotNull().alias("renamed"), "link", F.when(F.col("link").isNull(), F.col("spans")).alias("spans"))
    os.makedirs(parts, exist_ok=True)
    os.makedirs(stage, exist_ok=True)
    options = {"root": root, "stage": stage, "parts": parts, "fail_after": fail_after}
    rows.repartition(tasks, "path").write.format(VersionSource.name()).mode("append").options(**options).save()
    return json.loads(Path(parts, "manifest.json").read_text(encoding="utf-8"))
