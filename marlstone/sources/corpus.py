"""Files of a corpus as DataFrames, and the small artifacts that the driver reads and writes."""

from __future__ import annotations

import csv
import json
import os
import time
from pathlib import Path
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import CREDENTIAL, IMAGE_EXTENSIONS, extension, is_text, normalize_path
from .tree import is_local, read_tree

PLAN_SCHEMA = 1
LARGE = 90 * 1024 * 1024
# Cache directories that should not be in a corpus.
CACHE_DIRECTORIES = ("__pycache__", ".pytest_cache", "node_modules", ".ruff_cache")


def read_files(spark: SparkSession, root: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """Files under root: path (relative), length, and content unless it is not wanted.

    The pattern is of the name, case-sensitive. In a folder that executors can open, names that start
    with . or _ are files like others and symbolic links are left out (see links). Elsewhere Spark's
    own reader lists the store, which leaves out such names."""
    if is_local(root):
        return read_tree(spark, root, pattern, content=content).where("link is null").select("path", "length", *(["content"] if content else []))
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    # a path is what follows the root's first place in it, whatever the root's characters
    at = F.lit("/" + urlparse(root).path.strip("/") + "/")
    path = F.substr("path", F.instr("path", at) + F.length(at))
    return base.select(path.alias("path"), "length", *(["content"] if content else []))


def links(spark: SparkSession, root: str) -> DataFrame:
    """Symbolic links under root as warnings: code, path, detail (the target); none is ever followed."""
    if not is_local(root):
        return spark.createDataFrame([], "code string, path string, detail string")
    return read_tree(spark, root).where("link is not null").select(F.col("problem").alias("code"), "path", F.col("link").alias("detail"))


def version_files(spark: SparkSession, root: str) -> DataFrame:
    """What a new version of root holds: path, length and link of files, symbolic links and empty folders,
    cache directories left out."""
    rows = read_tree(spark, root, folders=True).select("path", "length", "link")
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(c) for c in CACHE_DIRECTORIES])))


def _hashes(spark: SparkSession, root: str, pattern: str = "*", suffixes: tuple[str, ...] = ()) -> DataFrame:
    if is_local(root):
        return read_tree(spark, root, pattern, hashed=True, suffixes=suffixes).where("link is null").select("path", "sha256")
    return read_files(spark, root, pattern).select("path", F.sha2("content", 256).alias("sha256"))


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    return read_files(spark, root, "*.md").orderBy("path")


def assets(spark: SparkSession, root: str) -> DataFrame:
    """Images: path, sha256 (each hashed once, a megabyte at a time)."""
    return _hashes(spark, root, suffixes=tuple(f".{e}" for e in IMAGE_EXTENSIONS)).where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS))


def skill_count(spark: SparkSession, root: str) -> DataFrame:
    return read_files(spark, root, "SKILL.md", content=False).agg(F.count(F.lit(1)).alias("n"))


def text_lines(files: DataFrame) -> DataFrame:
    """path, line (from 1) and text of every line of valid files."""
    good = files.where(is_text(F.col("content")))
    return good.select("path", F.posexplode(F.split(F.col("content").cast("string"), "\r?\n"))).select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def credential_lines(files: DataFrame) -> DataFrame:
    return text_lines(files).where(F.col("text").rlike(CREDENTIAL))


def invalid_text(files: DataFrame) -> DataFrame:
    return files.where(~F.coalesce(is_text(F.col("content")), F.lit(True))).select("path")


def large_files(files: DataFrame, above: int = LARGE) -> DataFrame:
    return files.where(F.col("length") > above).select("path", "length")


def cache_files(files: DataFrame) -> DataFrame:
    return files.where(F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(c) for c in CACHE_DIRECTORIES]))).select("path")


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """Extracted metadata: path, caption, visual_type, page_idx, bbox, source, of two file layouts.

    content_list.json is a flat array of records; content_list_v2.json nests the same fields in
    `content`. Field names are assumptions of our own: img_path, image_caption or table_caption,
    type or sub_type, page_idx, bbox."""
    files = read_files(spark, root, "content_list*.json").where(F.regexp_like("path", F.lit(r"(^|/)content_list(_v2)?\.json$")))
    items = F.from_json(F.col("content").cast("string"), "array<string>")
    rows = files.select("path", F.explode(items).alias("item")).withColumn("v", F.try_parse_json("item"))
    nested = F.col("path").endswith("content_list_v2.json")

    def field(name: str, kind: str):
        return F.when(nested, F.coalesce(F.try_variant_get("v", f"$.content.{name}", kind), F.try_variant_get("v", f"$.{name}", kind))).otherwise(F.try_variant_get("v", f"$.{name}", kind))

    def caption(name: str):
        return F.coalesce(F.array_join(field(name, "array<string>"), " "), field(name, "string"))

    folder = F.regexp_replace("path", "[^/]*$", "")
    rows = rows.select(
        normalize_path(F.concat(folder, F.replace(field("img_path", "string"), F.lit("\\"), F.lit("/")))).alias("path"),
        F.coalesce(F.nullif(caption("image_caption"), F.lit("")), F.nullif(caption("table_caption"), F.lit(""))).alias("caption"),
        F.coalesce(field("sub_type", "string"), field("type", "string"), F.lit("image")).alias("visual_type"),
        field("page_idx", "int").alias("page_idx"),
        field("bbox", "array<double>").alias("bbox"),
        F.when(nested, "metadata-v2").otherwise("metadata-v1").alias("source"),
    )
    return rows.where("path is not null")


def document_hashes(spark: SparkSession, root: str) -> DataFrame:
    return _hashes(spark, root, "*.md")


def holding(files: DataFrame, secret: str) -> DataFrame:
    """Files that hold the secret's bytes anywhere; none should."""
    return files.where(F.contains("content", F.lit(secret.encode()))).select("path")


def write_json(path: str, value: dict) -> None:
    """Replace the file in one step, so that a reader finds the old or the new state, never a part."""
    Path(f"{path}.tmp").write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    os.replace(f"{path}.tmp", path)


def write_plan(plan: list[dict], summary: dict, folder: str, documents: list[dict] | None = None) -> tuple[str, str]:
    """The plan as canonical JSON and as CSV with a byte order mark; nothing in them varies by run.

    With documents (path, sha256) given, their hashes are recorded for the preflight."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    known = {} if documents is None else {"documents": documents}
    body = json.dumps({"schema": PLAN_SCHEMA, "summary": summary, "assets": plan, **known}, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    (target / "plan.json").write_bytes(body.encode())
    flat = ("old_path", "new_path", "sha256", "reason", "vision_status")
    with open(target / "plan.csv", "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow([*flat, "references"])
        out.writerows([*(a[c] for c in flat), len(a["references"])] for a in plan)
    return str(target / "plan.json"), str(target / "plan.csv")


def read_plan(path: str) -> dict:
    plan = json.loads(Path(path).read_text(encoding="utf-8"))
    if plan.get("schema") != PLAN_SCHEMA:
        raise ValueError("plan schema version is not supported")
    return plan


CACHE = "cache_key string, version long, response struct<description:string,keywords:array<string>,confidence:double>"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The log of responses: every version of every key. A log that was not begun yet is empty."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def write_cache(responses: DataFrame, path: str, version: int | None = None) -> None:
    """Append responses (cache_key, response) to the log, as a version later than those before."""
    version = time.time_ns() // 1000 if version is None else version
    responses.select("cache_key", F.lit(version).cast("long").alias("version"), "response").write.mode("append").parquet(path)


def latest(cache: DataFrame) -> DataFrame:
    """One response (cache_key, response) of each key: that of the latest version; of several of one
    version, or where there are no versions, the greatest as JSON, so that reruns agree."""
    order = F.struct(*(["version"] if "version" in cache.columns else []), F.to_json("response").alias("json"))
    return cache.groupBy("cache_key").agg(F.max_by("response", order).alias("response"))


def compact_cache(spark: SparkSession, path: str, target: str) -> None:
    """Write the latest version of each key to target, a log of its own."""
    cache = read_cache(spark, path)
    order = F.struct("version", F.to_json("response").alias("json"))
    cache.groupBy("cache_key").agg(F.max("version").alias("version"), F.max_by("response", order).alias("response")).select("cache_key", "version", "response").write.parquet(target)


def vision_config(env: dict[str, str] | None = None) -> dict[str, str]:
    """Endpoint settings from three variables; the key never goes into a table or a log."""
    env = dict(os.environ) if env is None else env
    return {k: env.get(v, "") for k, v in (("api_key", "VISION_API_KEY"), ("base_url", "VISION_BASE_URL"), ("model", "VISION_MODEL"))}
