"""Tables of Markdown documents, and the counts that they declare against those that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans
from .blocks import structure
from .graph import parity

_RULE = r"^\s*\|?(\s*:?-+:?\s*\|)+(\s*:?-+:?)?\s*$"


def _cells(text: Column) -> Column:
    """The cells of a line: between bars that no backslash escapes, outer bars left out."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, r"[\r\t]", " ")), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def table_rows(lines: DataFrame) -> DataFrame:
    """doc_path, line, header and cells of each row of a table; lines has doc_path, line and text.

    A table is a line with a bar above a delimiter row of as many cells, and the lines with a bar that
    follow without a break; the first such pair of a run of lines counts. Nothing in fences or
    comments does. A row may have more or fewer cells than the header."""
    shown = structure(lines)
    bar = F.coalesce(F.col("text").rlike(r"(?<!\\)\|") & ~F.col("protected"), F.lit(False))
    rows = shown.select("doc_path", "line", "text", bar.alias("bar"))
    rows = scans.segmented(rows, ["doc_path"], ["line"], run=scans.last_before(F.when(~F.col("bar"), F.col("line")))).where("bar")
    rows = rows.select("doc_path", F.coalesce("run", F.lit(-1)).alias("run"), "line", _cells(F.col("text")).alias("cells"), F.col("text").rlike(_RULE).alias("rule"))
    run = ["doc_path", "run"]
    above = scans.segmented(rows, run, ["line"], above=scans.lag(F.when(~F.col("rule"), F.col("cells"))))
    head = F.coalesce(F.col("rule") & (F.size("above") == F.size("cells")), F.lit(False))
    above = above.withColumn("head", F.when(head, F.struct("above")))
    # only the first delimiter row of a run begins a table; later ones are rows of it
    first = scans.segmented(above, run, ["line"], seen=scans.sum_before(F.when(head, 1).otherwise(0)))
    first = first.withColumn("begins", F.when(F.coalesce("seen", F.lit(0)) == 0, F.col("head")))
    out = scans.segmented(first, run, ["line"], header=scans.last_before(F.col("begins")))
    return out.where("header is not null").select("doc_path", "line", F.col("header.above").alias("header"), "cells")


def column(name: str) -> Column:
    """The cell of table_rows() under the header of this name, case aside; null where there is none."""
    at = F.array_position(F.transform("header", lambda h: F.lower(h)), name.lower())
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def declared_counts(lines: DataFrame, name: str, count: str) -> DataFrame:
    """doc_path, name and n that the rows of tables with both headers declare.

    A count is a number with or without separators of thousands and emphasis; other cells declare nothing."""
    number = F.regexp_replace(column(count), "[*_,  ]", "")
    rows = table_rows(lines).select("doc_path", F.regexp_replace(column(name), r"^[*_]+|[*_]+$", "").alias("name"), F.when(number.rlike("^[0-9]{1,18}$"), number).cast("long").alias("n"))
    return rows.where("name is not null and n is not null")


def count_mismatches(declared: DataFrame, counts: DataFrame, names: DataFrame) -> DataFrame:
    """name, folder, declared and actual where a declared count differs from the files of its folder.

    counts is trees.path_counts(), names (name, folder) says which folder a name stands for; a name
    without one, or a folder without files, counts 0 files, and one that is not declared has null."""
    there = names.join(counts.select("folder", "n"), "folder", "left").select("name", "folder", F.coalesce("n", F.lit(0)).alias("n"))
    wrong = parity(declared.select("name", "n"), there.select("name", "n"), ["name"], "n")
    wrong = wrong.withColumn("right_value", F.coalesce("right_value", F.lit(0))).where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    return wrong.join(names, "name", "left").select("name", "folder", F.col("left_value").alias("declared"), F.col("right_value").alias("actual"))
