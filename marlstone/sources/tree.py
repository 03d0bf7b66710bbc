"""A data source of the files under a folder that all executors can open, hidden names and links included."""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are hashed at once, files of a partition, and the most bytes that a cell of Spark holds.
CHUNK, FILES, MOST = 1 << 20, 512, (1 << 31) - 1 - (1 << 16)
SCHEMA = "path string, length long, sha256 string, content binary, link string, problem string"
# Codes of links: out of the root, to nothing (cycles among them), or inside the root.
OUTSIDE, NOWHERE, INSIDE = "linked-outside", "linked-nowhere", "linked"


def is_local(root: str) -> bool:
    return urlparse(root).scheme in ("", "file") if "://" in root or root.startswith("file:") else True


def local_path(root: str) -> str:
    return unquote(urlparse(root).path) if root.startswith("file:") else root


def sha256_file(path: str) -> str:
    """Lowercase hex SHA-256 of a file, CHUNK bytes at a time."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(CHUNK):
            digest.update(block)
    return digest.hexdigest()


def link_problem(path: str, root: str) -> str:
    """Where a symbolic link leads, chains followed to their end."""
    real, top = os.path.realpath(path), os.path.realpath(root)
    if real != top and not real.startswith(top.rstrip("/") + "/"):
        return OUTSIDE
    return INSIDE if os.path.exists(path) else NOWHERE


@dataclass
class Folders(InputPartition):
    """A run of folders, relative to the root."""

    folders: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(local_path(options["root"]))
        self.pattern, self.suffixes = options.get("pattern", "*"), tuple(s for s in options.get("suffixes", "").split(",") if s)
        self.content, self.hashed, self.folders = (options.get(k) == "true" for k in ("content", "hashed", "folders"))

    def partitions(self) -> list[Folders]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        out, run, n = [], [], 0
        for folder, inner, names in os.walk(self.root):
            inner.sort()
            run, n = [*run, os.path.relpath(folder, self.root)], n + len(names) + 1
            if n >= FILES:
                out, run, n = [*out, Folders(run)], [], 0
        return [*out, Folders(run)] if run else out

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in partition.folders:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                found = sorted(entries, key=lambda e: e.name)
            if self.folders and not found and folder != ".":
                yield f"{folder}/", None, None, None, None, None
            for e in found:
                path = os.path.normpath(os.path.join(folder, e.name))
                if e.is_symlink():
                    yield path, None, None, None, os.readlink(e.path), link_problem(e.path, self.root)
                elif e.is_file() and fnmatch.fnmatchcase(e.name, self.pattern) and (not self.suffixes or e.name.lower().endswith(self.suffixes)):
                    length = e.stat().st_size
                    yield path, length, sha256_file(e.path) if self.hashed else None, self._bytes(e.path, length) if self.content else None, None, None

    @staticmethod
    def _bytes(path: str, length: int) -> bytes:
        if length > MOST:
            raise ValueError(f"{path} is too large for one row")
        with open(path, "rb") as f:
            return f.read()


class TreeSource(DataSource):
    """Files below root: path (relative), length, and sha256 and content where asked for; a symbolic
    link is a row of its own with link (its target) and problem, and is never followed.

    Options: root, pattern (of the name, case-sensitive), suffixes (lower case, by commas), content,
    hashed and folders (true or false; empty folders are then rows too, with / at the end of their path).
    A partition reads a run of folders, of about FILES files."""

    @classmethod
    def name(cls) -> str:
        return "marlstone_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, pattern: str = "*", content: bool = False, hashed: bool = False, suffixes: tuple[str, ...] = (), folders: bool = False) -> DataFrame:
    spark.dataSource.register(TreeSource)
    options = {"root": root, "pattern": pattern, "content": str(content).lower(), "hashed": str(hashed).lower(), "suffixes": ",".join(suffixes), "folders": str(folders).lower()}
    return spark.read.format(TreeSource.name()).options(**options).load()
