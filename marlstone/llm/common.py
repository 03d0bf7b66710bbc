"""Shared pieces of the corpus operators: staged tables, skew-safe joins, distributed running sums, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of characters other than space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Whether Spark removes a query's shuffle files at its end; else they lie on disk until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key is hot if it holds more than one of so many rows; so there are fewer hot keys than this in any table.
SHARES = 1000
#: Edges that one task turns into stars at once: about a megabyte.
FOLD = 1 << 16

_lock = threading.Lock()
_writing = {"n": 0, "before": "false"}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own
    on a local master, whose executors are the driver; an error on any other."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = f"file://{path}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def cleaning(spark: SparkSession):
    """Spark's own removal of shuffle files is on while any thread is inside; as it was once all are out."""
    with _lock:
        if not _writing["n"]:
            _writing["before"] = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _writing["n"] += 1
    try:
        yield
    finally:
        with _lock:
            _writing["n"] -= 1
            if not _writing["n"]:
                spark.conf.set(CLEANUP, _writing["before"])


class Tables:
    """An operator's intermediate tables, Parquet in a folder of its own in the shared folder.

    save() writes one and reads it back: lineage ends there, and a lost executor costs no
    recomputation of what came before. drop() removes tables that nothing reads any more; keep()
    saves a result and drops all others. What is left goes when the application ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.live, self.n = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}", {}, 0
        where = self._path(self.folder)
        self.files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(where)
        self.files.deleteOnExit(where)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        with cleaning(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.live[id(out)] = (out, path)
        return out

    def write(self, writer, form: str, path: str) -> None:
        """Write files of our own form."""
        with cleaning(self.spark):
            writer.format(form).save(path)

    def drop_all(self) -> None:
        self.live.clear()
        self.files.delete(self._path(self.folder), True)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.files.delete(self._path(self.live.pop(id(df))[1]), True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        old = [t for t, _ in self.live.values()]
        out = self.save(df, name)
        self.drop(*old)
        return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hot_keys(rows: DataFrame, key: str | list[str]) -> list:
    """Keys that hold more than 1 / SHARES of the rows: fewer than SHARES, as rows of their columns."""
    keys = [key] if isinstance(key, str) else key
    known = rows.dropna(subset=keys)
    with cleaning(rows.sparkSession):
        total = rows.count()
        return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * SHARES > total).select(*keys).collect() if total else []


def skew_join(rows: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", hot: list | None = None, grows: bool = False) -> DataFrame:
    """rows joined with small, which has each key at most once.

    Hot keys of rows, fewer than SHARES whatever the data, meet their rows of small by broadcast,
    so that no task gets all rows of one; the others by shuffle. grows: small grows with the
    input, so Spark must not broadcast it either while it is small."""
    keys = [key] if isinstance(key, str) else key
    hot = hot_keys(rows, keys) if hot is None else hot
    other = small.hint("merge") if grows else small
    if not hot:
        return rows.join(other, keys, how)
    # by a hash of the key, the same on both sides, so that a filter parts them
    named = rows.sparkSession.createDataFrame([tuple(r) for r in hot], rows.select(*keys).schema)
    marks = [r[0] for r in named.select(F.xxhash64(*keys)).collect()]
    is_hot = F.xxhash64(*keys).isin(marks)
    rest = small.where(~is_hot)
    return rows.where(is_hot).join(F.broadcast(small.where(is_hot)), keys, how).unionByName(rows.where(~is_hot).join(rest.hint("merge") if grows else rest, keys, how))


def running_sum(df: DataFrame, key: str, part: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of value within key, in the order (part, *order).

    Two levels, so that no task holds a whole key: a window inside each (key, part), and a window
    over the parts' sums. key and part must not be null; part should take a few thousand values."""
    inner = Window.partitionBy(key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_value", value.cast("long"))
    start = (
        rows.groupBy(key, part)
        .agg(F.sum("_value").alias("_sum"))
        .select(key, part, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_start"))
    )
    rows = rows.withColumn("_inner", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    return rows.join(start, [key, part]).withColumn(out, F.col("_start") + F.col("_inner")).drop("_value", "_inner", "_start")


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """(u, v) of each node of these edges and the smallest one that they link it with, be it itself."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    top = list(range(len(nodes)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        while top[a] != a:
            top[a] = a = top[top[a]]
        while top[b] != b:
            top[b] = b = top[top[b]]
        top[max(a, b)] = min(a, b)
    for k, t in enumerate(top):  # a node's top is never above it, so tops come first
        top[k] = top[t]
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[np.array(top, dtype=np.int64)])], ["u", "v"])


def _folded(batches):
    """_stars of every FOLD edges."""
    held, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, FOLD):
            part = batch.slice(i, FOLD)
            if n + part.num_rows > FOLD:
                yield _stars(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
            held.append((part.column("u").to_numpy(), part.column("v").to_numpy()))
            n += part.num_rows
    if held:
        yield _stars(*map(np.concatenate, zip(*held, strict=True)))


def components(edges: DataFrame, tables: Tables, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every node of edges (a, b), as a table (node, component).

    Tasks of FOLD edges first replace theirs by stars; where all edges fit one task, that is the
    result. Else alternating large-star and small-star steps (Kiveris et al., 2014) follow, each a
    grouped minimum with partial aggregation, met by its rows in a skew-safe join, so that a node
    with very many links costs no more than its rows. Each round is a table of its own; the edges
    shrink to stars. edges are counted first, so they should be saved ones; the result is saved."""
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    with cleaning(tables.spark):
        n = e.count()
    e = tables.save(e.coalesce(1 + n // FOLD).mapInArrow(_folded, "u long, v long"), "edges")
    if n <= FOLD:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    old, e, same = [e], e.where("u <> v"), False
    while not same:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = skew_join(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tables.save(large, "large")
        small = skew_join(large, large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(small.select("u", "m"))
        new = tables.save(small.where("u <> v").distinct(), "small")
        with cleaning(tables.spark):
            same = new.count() == e.count() and new.exceptAll(e).isEmpty()
        tables.drop(large, *old)
        e, old = new, [new]
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return tables.save(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
