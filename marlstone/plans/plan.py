"""Plans of new asset names: create, preflight, apply into a new corpus version, validate, roll back."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators.graph import GENERIC, build_graph, choose_evidence, markdown_context, run_summary, target_collisions
from ..operators.scan import resolve, scan_markdown
from ..sources import corpus
from ..sources.staging import staged
from ..sources.tree import local_path
from ..sources.versions import write_version

CONFIDENCE = 0.5
STAGES = ("staged", "first-rename", "documents", "verify")


def _asked(evidence: DataFrame, config: dict, cache: DataFrame | None) -> DataFrame:
    """Assets whose evidence is generic, with the cached response of each, if any."""
    key = S.cache_key(F.col("sha256"), F.lit(config.get("model", "")), F.lit("1"))
    asked = evidence.where(F.col("semantic").isin(*GENERIC)).select("asset_path", "caption", key.alias("cache_key"))
    if cache is None:
        return asked.withColumn("response", F.lit(None).cast("struct<description:string,keywords:array<string>,confidence:double>"))
    return asked.join(corpus.latest(cache), "cache_key", "left")


def response_fields(got: dict) -> tuple[str, list[str], float]:
    """(description, keywords, confidence) of an analyzer's response; ValueError if its shape is not the agreed one."""
    description, keywords, confidence = got.get("description"), got.get("keywords"), got.get("confidence")
    if not isinstance(description, str) or not isinstance(keywords, list) or not all(isinstance(k, str) for k in keywords):
        raise ValueError("description must be a string, keywords a list of strings")
    if isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
        raise ValueError("confidence must be a number from 0 to 1")
    return description, keywords, float(confidence)


def with_vision(evidence: DataFrame, analyzer: Callable[..., dict] | None, config: dict | None = None, cache: DataFrame | None = None, cache_path: str | None = None) -> DataFrame:
    """vision_status of each asset, and the analyzer's description where the evidence is generic.

    The analyzer takes (path, context, config) and gives description, keywords and confidence. Cached
    responses are joined first; only the rest reach the analyzer, and its failures become rows. With
    cache_path, what it answers is appended to that log, so that later runs do not ask again."""
    needed = F.col("semantic").isin(*GENERIC)
    if analyzer is None:
        return evidence.withColumn("vision_status", F.when(needed, "needed").otherwise("not-needed"))
    config = config or {}
    asked = _asked(evidence, config, cache)
    known = asked.where("response is not null").select("asset_path", "response")

    def ask(batches):
        for pdf in batches:
            rows = []
            for path, key, caption in zip(pdf["asset_path"], pdf["cache_key"], pdf["caption"], strict=True):
                try:
                    rows.append((path, key, *response_fields(analyzer(path, {"caption": caption}, config))))
                except Exception:  # a failing analyzer must not stop the plan
                    rows.append((path, key, None, None, None))
            yield pd.DataFrame(rows, columns=["asset_path", "cache_key", "description", "keywords", "confidence"])

    new = asked.where("response is null").select("asset_path", "cache_key", "caption").mapInPandas(ask, "asset_path string, cache_key string, description string, keywords array<string>, confidence double")
    response = F.when(F.col("confidence").isNotNull(), F.struct("description", "keywords", "confidence"))
    new = staged(new.select("asset_path", "cache_key", response.alias("response")))
    if cache_path is not None:
        corpus.write_cache(new.where("response is not null").dropDuplicates(["cache_key"]), cache_path)
    answers = known.unionByName(new.drop("cache_key")).select("asset_path", "response.description", "response.confidence")
    out = evidence.join(answers, "asset_path", "left")
    status = F.when(~needed, "not-needed").when(F.col("confidence").isNull(), "failed").when((F.col("confidence") < CONFIDENCE) | S.semantic_slug(F.col("description")).isin(*GENERIC), "rejected").otherwise("used")
    used = F.col("vision_status") == "used"
    out = out.withColumn("vision_status", status)
    return out.withColumns({"semantic": F.when(used, S.semantic_slug(F.col("description"))).otherwise(F.col("semantic")), "reason": F.when(used, "vision").otherwise(F.col("reason"))}).drop("description", "confidence")


def propose_names(evidence: DataFrame) -> DataFrame:
    """new_path of each asset: document slug, type and number, meaning, content hash."""
    w = Window.partitionBy("doc_path", "visual_type").orderBy("start", "asset_path")
    number = F.coalesce("explicit", F.row_number().over(w))
    doc_slug = S.slugify(F.regexp_replace(F.regexp_extract("doc_path", "([^/]*)$", 1), r"\.md$", ""))
    named = evidence.withColumn("number", number)
    name = S.asset_name(doc_slug, F.col("visual_type"), F.col("number"), F.col("semantic"), F.left("sha256", F.lit(8)), S.extension(F.col("asset_path")))
    folder = S.parent(F.col("asset_path"))
    return named.withColumn("new_path", F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name)))


def create_plan(spark: SparkSession, root: str, analyzer: Callable[..., dict] | None = None, config: dict | None = None, cache: DataFrame | None = None, cache_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, warnings, summary) of the corpus under root, which is only read.

    cache (cache_key, response) holds earlier responses of the analyzer, which is asked for the rest
    only; cache_path names a log of them, which is read and added to. Documents are scanned and assets
    hashed once: references, hashes and evidence are staged, and everything else reads those tables.
    Symbolic links are warnings, never assets."""
    documents = corpus.markdown_files(spark, root)
    assets, references = staged(corpus.assets(spark, root)), staged(resolve(scan_markdown(documents)))
    edges, records, warnings = build_graph(references, assets)
    records, warnings = staged(records), staged(warnings.unionByName(corpus.links(spark, root)))
    contexts = markdown_context(documents, edges)
    extracted = corpus.metadata(spark, root)
    evidence = staged(choose_evidence(contexts, extracted).join(records, "asset_path"))
    if cache_path is not None:
        logged = corpus.latest(corpus.read_cache(spark, cache_path))
        cache = staged(logged if cache is None else corpus.latest(logged.unionByName(corpus.latest(cache))))
    asked = staged(_asked(evidence, config or {}, cache))
    named = propose_names(with_vision(evidence, analyzer, config, cache, cache_path))
    plan = named.select(F.col("asset_path").alias("old_path"), "new_path", "sha256", "reason", "references", "vision_status").orderBy("old_path")
    files = corpus.read_files(spark, root, "*.md", content=False)
    return plan, warnings, run_summary(files, references, records, warnings, asked, analyzer is not None)


def save_plan(plan: DataFrame, summary: DataFrame, folder: str, documents: DataFrame | None = None) -> tuple[str, str]:
    """Write the plan; documents (path, sha256) are recorded, so that applying finds any that changed."""
    known = None if documents is None else [r.asDict() for r in documents.orderBy("path").collect()]
    return corpus.write_plan([r.asDict(recursive=True) for r in plan.collect()], summary.first().asDict(), folder, known)


def preflight(spark: SparkSession, root: str, plan: dict) -> list[str]:
    """What stands against applying the plan: changed sources, collisions, occupied targets, overlaps.

    Where the plan records documents, one changed, gone or added since is an error too."""
    rows, errors = plan["assets"], []
    if plan.get("documents") is not None:
        was = spark.createDataFrame([(d["path"], d["sha256"]) for d in plan["documents"]], "path string, was string")
        for r in was.join(corpus.document_hashes(spark, root), "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("sha256"))).collect():
            errors.append(f"document added: {r['path']}" if r["was"] is None else f"source hash changed: {r['path']}")
    if not rows:
        return sorted(errors)
    df = spark.createDataFrame([(a["old_path"], a["new_path"], a["sha256"]) for a in rows], "old_path string, new_path string, sha256 string")
    now = corpus.assets(spark, root)
    changed = df.alias("p").join(now.alias("n"), F.col("p.old_path") == F.col("n.path"), "left").where(~F.col("n.sha256").eqNullSafe(F.col("p.sha256")))
    errors += [f"source hash changed: {r['old_path']}" for r in changed.select("old_path").collect()]
    errors += [f"target collision: {r['target']}" for r in target_collisions(df).collect()]
    taken = df.where("old_path <> new_path").alias("p").join(now.alias("n"), (F.col("p.new_path") == F.col("n.path")) & (F.col("p.sha256") != F.col("n.sha256")))
    errors += [f"target occupied: {r['new_path']}" for r in taken.select("new_path").collect()]
    spans: dict[str, list[tuple[int, int]]] = {}
    for a in rows:
        if any(p in ("..", "") for p in a["new_path"].split("/")):
            errors.append(f"target leaves the root: {a['new_path']}")
        for r in a["references"]:
            spans.setdefault(r["doc_path"], []).append((r["start"], r["end"]))
    for doc, found in spans.items():
        found.sort()
        errors += [f"spans overlap: {doc}" for x, y in zip(found, found[1:], strict=False) if y[0] < x[1]]
    return sorted(errors)


def _new_destination(doc: str, new_path: str, style: str) -> bytes:
    return S.restyle(os.path.relpath(new_path, os.path.dirname(doc) or "."), style).replace(os.sep, "/").encode()


def apply_plan(spark: SparkSession, root: str, plan_path: str, target: str, fail_after: str = "") -> str:
    """Write the renamed corpus as a new version in target; root stays as it was.

    Executors copy, rename and rewrite the files, so root and target must be folders open to all of them;
    no document passes the driver. A journal of operations with its state is kept beside the new version;
    on any failure the version is dropped, so root is always whole. fail_after names one of STAGES, for
    fault injection."""
    plan = corpus.read_plan(plan_path)
    errors = preflight(spark, root, plan)
    if errors:
        raise ValueError("; ".join(errors))
    target_dir = Path(local_path(target)).absolute()
    stage, parts = _stage(target_dir)
    journal_path = f"{target_dir}.journal.json"
    journal = {"schema": 1, "state": "staging", "operations": []}

    def reached(name: str) -> None:
        if fail_after == name:
            raise RuntimeError(f"stopped after {name}")

    for left in (stage, parts):
        shutil.rmtree(left, ignore_errors=True)
    corpus.write_json(journal_path, journal)
    try:
        files = corpus.version_files(spark, root)
        renames = spark.createDataFrame([(a["old_path"], a["new_path"]) for a in plan["assets"]], "path string, target string")
        values = [(r["doc_path"], r["start"], r["end"], _new_destination(r["doc_path"], a["new_path"], r["encoding_style"])) for a in plan["assets"] for r in a["references"]]
        spans = spark.createDataFrame(values, "path string, start long, end long, value binary")
        reached("staged")
        try:
            done = write_version(files, renames, spans, root, str(stage), str(parts), fail_after)
        except PySparkException as e:
            raise RuntimeError("the new version could not be written") from e
        journal["operations"] = [{"seq": i, **o, "status": "done"} for i, o in enumerate(done)]
        corpus.write_json(journal_path, journal)
        reached("documents")
        wrong = _rescan(spark, str(stage), plan)
        reached("verify")
        if wrong:
            raise ValueError("; ".join(wrong))
        os.replace(stage, target_dir)
        journal["state"] = "committed"
    finally:
        shutil.rmtree(parts, ignore_errors=True)
        if journal["state"] != "committed":
            shutil.rmtree(stage, ignore_errors=True)
            journal["state"] = "rolled-back"
            if stage.exists():
                journal.update(state="rollback-incomplete", left=str(stage))
        corpus.write_json(journal_path, journal)
    return journal_path


def _stage(target: Path) -> tuple[Path, Path]:
    """The folder of a version in the making, and that of its files in the making."""
    return tuple(target.with_name(S.staging_name(target.name, t)) for t in ("1", "1-parts"))


def _rescan(spark: SparkSession, root: str, plan: dict) -> list[str]:
    want = spark.createDataFrame([(a["new_path"], a["sha256"]) for a in plan["assets"]], "path string, sha256 string")
    have = corpus.assets(spark, root)
    refs = resolve(scan_markdown(corpus.markdown_files(spark, root))).select("asset_path").distinct()
    errors = [f"asset missing or changed: {r['path']}" for r in want.join(have, ["path", "sha256"], "left_anti").collect()]
    errors += [f"asset not referenced: {r['path']}" for r in want.join(refs, want["path"] == refs["asset_path"], "left_anti").collect()]
    old = spark.createDataFrame([(a["old_path"],) for a in plan["assets"] if a["old_path"] != a["new_path"]], "path string")
    planned = want.select("path")
    errors += [f"reference not in plan: {r['path']}" for r in refs.withColumnRenamed("asset_path", "path").join(have, "path", "left_semi").join(planned, "path", "left_anti").collect()]
    errors += [f"old name still referenced: {r['path']}" for r in old.join(refs, old["path"] == refs["asset_path"], "left_semi").collect()]
    return sorted(errors)


def validate_plan(spark: SparkSession, root: str, plan_path: str) -> list[str]:
    return _rescan(spark, root, corpus.read_plan(plan_path))


def rollback(journal_path: str) -> list[str]:
    """Drop the version that the journal committed, or what a stopped run staged; what could not be
    undone is returned."""
    journal = json.loads(Path(journal_path).read_text(encoding="utf-8"))
    target = Path(journal_path.removesuffix(".journal.json"))
    if journal["state"] == "rolled-back":
        return []
    stage, parts = _stage(target)
    shutil.rmtree(parts, ignore_errors=True)
    if journal["state"] in ("staging", "committed"):
        # noted before anything is dropped, so that a second try drops the same
        journal["left"] = str(stage if journal["state"] == "staging" else target)
        journal["state"] = "rolling-back"
        journal["operations"].reverse()
        corpus.write_json(journal_path, journal)
    shutil.rmtree(journal["left"], ignore_errors=True)
    if Path(journal["left"]).exists():
        journal["state"] = "rollback-incomplete"
    else:
        journal["state"] = "rolled-back"
        del journal["left"]
    corpus.write_json(journal_path, journal)
    return [journal["left"]] if "left" in journal else []
