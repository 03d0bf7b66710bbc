"""Trees of files: counts at every folder of their paths, and comparison by hashes of folders.

A folder's hash is a sum over what it holds, so Spark adds up parts of a folder where they lie and
no task ever gathers a folder's children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parent

#: Of a SHA-256, the lanes of 32 bits that are summed; sums of 2^31 entries fit a long.
LANES = 6


def _ancestors(folder: Column) -> Column:
    """The folders above a folder and itself, from the root ("") down."""
    parts = F.split(folder, "/")
    depth = F.when(folder == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def path_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """folder, depth and n, the files at or below it, for every folder of any depth; the root is "".

    Files are counted by their own folder first, and only these counts go up. A null path is in no
    folder; equal paths count each; an empty table has no folders."""
    own = files.where(F.col(path).isNotNull()).groupBy(parent(F.col(path)).alias("own")).agg(F.count(F.lit(1)).alias("n"))
    out = own.select(F.posexplode(_ancestors(F.col("own"))).alias("depth", "folder"), "n")
    return out.groupBy("folder", F.col("depth").cast("long").alias("depth")).agg(F.sum("n").alias("n"))


def folders_above(files: DataFrame) -> DataFrame:
    """path of each folder above files (path), once, the root as ""."""
    own = files.where("path is not null").select(parent(F.col("path")).alias("own")).distinct()
    return own.select(F.explode(_ancestors(F.col("own"))).alias("path")).distinct()


def _lanes(*of: Column) -> list[Column]:
    sha = F.sha2(F.concat_ws("\0", *of).cast("binary"), 256)
    return [F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(LANES)]


def _summed() -> list[Column]:
    return [F.sum(f"h{i}").alias(f"h{i}") for i in range(LANES)]


def _hash() -> Column:
    return F.concat_ws("-", *[F.col(f"h{i}").cast("string") for i in range(LANES)])


def file_folders(files: DataFrame) -> DataFrame:
    """folder, hash and n of what lies in each folder itself; files has path and sha256."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    entries = files.where("path is not null").select(parent(F.col("path")).alias("folder"), *_lanes(name, F.coalesce("sha256", F.lit(""))))
    return entries.groupBy("folder").agg(*_summed(), F.count(F.lit(1)).alias("n")).select("folder", _hash().alias("hash"), "n")


def tree_hashes(own: DataFrame) -> DataFrame:
    """folder, tree and n: hash and number of files of everything below each folder.

    own is file_folders(); names count from the folder down, so equal trees have equal hashes
    wherever they stand."""
    above = own.select(F.explode(_ancestors(F.col("folder"))).alias("top"), "folder", "hash", "n")
    below = F.expr("substr(folder, length(top) + 1)")
    entries = above.select(F.col("top").alias("folder"), "n", *_lanes(F.regexp_replace(below, "^/", ""), F.col("hash"), F.col("n").cast("string")))
    return entries.groupBy("folder").agg(*_summed(), F.sum("n").alias("n")).select("folder", _hash().alias("tree"), "n")


def folder_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """folder, n_before, n_after and status of the folders whose trees differ: added, removed, changed;
    or moved, for an added one whose tree stood elsewhere before and stands there no more.

    before and after have path and sha256. Folders with equal trees are left out by their hashes
    alone. Null paths are in no folder; equal rows count each."""
    old, new = tree_hashes(file_folders(before)), tree_hashes(file_folders(after))
    a, b = old.select("folder", F.col("tree").alias("was"), F.col("n").alias("n_before")), new.select("folder", F.col("tree").alias("is"), F.col("n").alias("n_after"))
    met = a.join(b, "folder", "full_outer").where(~F.col("was").eqNullSafe(F.col("is")))
    gone = met.where(F.col("is").isNull()).select(F.col("was").alias("is")).distinct().withColumn("_gone", F.lit(True))
    status = F.when(F.col("was").isNull(), F.when(F.col("_gone"), "moved").otherwise("added")).when(F.col("is").isNull(), "removed").otherwise("changed")
    none = F.lit(0).cast("long")
    return met.join(gone, "is", "left").select("folder", F.coalesce("n_before", none).alias("n_before"), F.coalesce("n_after", none).alias("n_after"), status.alias("status"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, sha256 and side of the rows of either tree that the other lacks, as graph.tree_difference
    gives them for paths that are not null; files are compared in folders of unequal hashes only."""
    old, new = file_folders(before), file_folders(after)
    differ = old.join(new.select("folder", F.col("hash").alias("is")), "folder", "full_outer").where(~F.col("hash").eqNullSafe(F.col("is"))).select("folder")
    sides = []
    for files in (before, after):
        inside = files.where("path is not null").withColumn("folder", parent(F.col("path")))
        sides.append(inside.join(differ, "folder", "left_semi").select("path", "sha256"))
    left, right = sides
    return left.exceptAll(right).withColumn("side", F.lit("before")).unionByName(right.exceptAll(left).withColumn("side", F.lit("after")))
