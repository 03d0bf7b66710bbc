"""The document and asset graph, its warnings and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import label_number, parent, semantic_slug
from . import scans
from .blocks import document_lines, structure

# Captions that say nothing.
GENERIC = ("", "image", "figure", "fig", "picture", "img", "photo", "screenshot", "table", "chart", "untitled", "asset")


def build_graph(references: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, records, warnings): references of existing assets, assets with their references, and
    missing-asset and unreferenced-asset warnings, the latter only beside a referenced asset."""
    on = F.col("asset_path") == F.col("path")
    edges = references.join(assets, on, "inner").drop("path")
    missing = references.join(assets, on, "left_anti").select(F.lit("missing-asset").alias("code"), F.col("asset_path").alias("path"), F.col("doc_path").alias("detail"))
    folders = edges.select(parent(F.col("asset_path")).alias("folder")).distinct()
    loose = assets.join(references, on, "left_anti").withColumn("folder", parent(F.col("path"))).join(folders, "folder", "left_semi")
    loose = loose.select(F.lit("unreferenced-asset").alias("code"), "path", F.lit("").alias("detail"))
    records = edges.groupBy("asset_path", "sha256").agg(F.array_sort(F.collect_list(F.struct("doc_path", "start", "end", "syntax", "raw_destination", "encoding_style"))).alias("references"))
    return edges, records, missing.unionByName(loose).distinct()


def shared_assets(edges: DataFrame) -> DataFrame:
    return edges.groupBy("asset_path").agg(F.count_distinct("doc_path").alias("n_docs")).where("n_docs > 1")


def equal_content(assets: DataFrame) -> DataFrame:
    return assets.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).where("n > 1")


def target_collisions(plan: DataFrame, fold_case: bool = True) -> DataFrame:
    key = F.lower("new_path") if fold_case else F.col("new_path")
    return plan.groupBy(key.alias("target")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def markdown_context(documents: DataFrame, references: DataFrame) -> DataFrame:
    """For each reference: the nearest heading before it, and the nearest line just before and after its
    own that is not blank and stands in no block of code or comment.

    References meet their lines by a sweep over both in the order of their bytes, not by pairs."""
    lines = structure(document_lines(documents))
    shown = F.when(~F.col("protected") & ~F.col("underline") & (F.trim(F.regexp_replace("text", "\r", "")) != ""), F.col("text"))
    near = scans.segmented(lines, ["doc_path"], ["line"], previous=scans.last_before(shown), next=scans.first_after(shown), title=scans.last_before(F.col("heading")))
    none = references.schema["start"].dataType
    held = references.withColumn("_reference", F.struct(*references.columns))
    empty = F.lit(None).cast(held.schema["_reference"].dataType)
    events = near.select("doc_path", F.col("first").cast(none).alias("_at"), F.lit(0).alias("_kind"), F.struct("previous", "next", F.col("title").alias("heading")).alias("_line"), empty.alias("_reference"))
    asked = held.select("doc_path", F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(events.schema["_line"].dataType).alias("_line"), "_reference")
    met = scans.segmented(events.unionByName(asked), ["doc_path"], ["_at", "_kind"], _own=scans.last_before(F.col("_line")))
    return met.where("_kind = 1").select("_reference.*", "_own.previous", "_own.next", "_own.heading")


def choose_evidence(contexts: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row for each asset: visual_type, caption, tier and reason, the first meaningful tier.

    Tiers: extracted metadata; alt text, caption line before, caption line after; heading; file name.
    Within a tier the longest caption is the strongest, ties by document and place."""
    caption_line = F.lit(r"(?i)^\s*(figure|fig\.?|图|table|表|chart)\s*\.?\s*[0-9]+")
    base = ["asset_path", "doc_path", "start"]
    kind = F.lit("image")
    tiers = [
        contexts.join(metadata.withColumnRenamed("path", "asset_path"), "asset_path").select(*base, "visual_type", "caption", F.lit(1).alias("tier"), F.lit("mineru-caption").alias("reason")),
        contexts.select(*base, kind.alias("visual_type"), F.col("alt").alias("caption"), F.lit(2).alias("tier"), F.lit("alt-text").alias("reason")),
        contexts.where(F.regexp_like("previous", caption_line)).select(*base, kind.alias("visual_type"), F.col("previous").alias("caption"), F.lit(3).alias("tier"), F.lit("caption-line").alias("reason")),
        contexts.where(F.regexp_like("next", caption_line)).select(*base, kind.alias("visual_type"), F.col("next").alias("caption"), F.lit(4).alias("tier"), F.lit("caption-line").alias("reason")),
        contexts.select(*base, kind.alias("visual_type"), F.col("heading").alias("caption"), F.lit(5).alias("tier"), F.lit("heading").alias("reason")),
        contexts.select(*base, kind.alias("visual_type"), F.lit("").alias("caption"), F.lit(9).alias("tier"), F.lit("fallback").alias("reason")),
    ]
    rows = tiers[0]
    for t in tiers[1:]:
        rows = rows.unionByName(t)
    rows = rows.withColumn("semantic", semantic_slug(F.col("caption"))).where((F.col("tier") == 9) | ~F.coalesce("semantic", F.lit("")).isin(*GENERIC))
    w = Window.partitionBy("asset_path").orderBy("tier", F.desc(F.char_length("semantic")), "doc_path", "start")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").withColumns({"explicit": label_number(F.col("caption")), "semantic": F.coalesce("semantic", F.lit(""))})


def run_summary(documents: DataFrame, references: DataFrame, records: DataFrame, warnings: DataFrame, asked: DataFrame, calls: bool) -> DataFrame:
    """One row of counts. asked holds the assets whose evidence is generic, with any cached response;
    calls says whether an analyzer is there to be asked about the rest."""
    zero = F.lit(0).cast("long")
    kinds = ("documents", "unique_references", "eligible", "missing", "unreferenced", "vision_needed", "vision_calls", "warnings")

    def counted(df: DataFrame, **named) -> DataFrame:
        return df.agg(*[named.get(k, zero).alias(k) for k in kinds])

    one = F.count(F.lit(1))
    parts = [
        counted(documents, documents=one),
        counted(references, unique_references=F.count_distinct("asset_path")),
        counted(records, eligible=one),
        counted(warnings, missing=F.count_if(F.col("code") == "missing-asset"), unreferenced=F.count_if(F.col("code") == "unreferenced-asset"), warnings=one),
        counted(asked, vision_needed=one, vision_calls=F.count_if(F.col("response").isNull() & F.lit(calls))),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(*[F.sum(k).alias(k) for k in kinds])


def parity(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks."""
    a, b = left.select(*keys, F.col(value).alias("left_value")), right.select(*keys, F.col(value).alias("right_value"))
    return a.join(b, keys, "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def tree_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either tree (path, sha256) that the other lacks."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def without_copy(upstream: DataFrame, copies: DataFrame, names: DataFrame) -> DataFrame:
    """Projects of upstream (project) without a copy (name); names (project, name) maps the projects whose
    copy has another name than their own."""
    named = upstream.join(names, "project", "left").select("project", F.coalesce("name", "project").alias("name"))
    return named.join(copies, "name", "left_anti").select("project")


def broken_links(references: DataFrame, files: DataFrame) -> DataFrame:
    return references.join(files, references["asset_path"] == files["path"], "left_anti")


def same_everywhere(copies: DataFrame) -> DataFrame:
    return copies.groupBy("path").agg(F.count_distinct("sha256").alias("n")).where("n > 1")
