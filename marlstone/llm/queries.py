"""The registered queries of the corpus operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, jaccard, media, mixing, negatives, neighbours, oracle, pieces, pii, quality, repeats, sharding, toolcalls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(_read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op5_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"))


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_read(spark, sf_dir, "pages"))


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample_segmentations(_read(spark, sf_dir, "documents"))


def op8_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.conversation_calls(_read(spark, sf_dir, "conversations"))
    linked = toolcalls.link_tool_calls(calls, results, toolcalls.REPLY_SCHEMA)
    return linked.select("conv_id", "call_id", "level", "position", "status", F.array_join("errors", "; ").alias("errors"), F.md5("json").alias("json_md5"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op10_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(_read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.fingerprint_documents(_read(spark, sf_dir, "documents"))
    listed = F.concat_ws(";", *[F.array_join(c, ",") for c in ("times", "codes")])
    feature = F.concat_ws(":", "frames", "peaks", F.size("times"), F.md5(listed))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(_read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, label=label)


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_quality_rules, op3_cross_polytope, op4_minimax_shards, op5_repeat_removal, op6_warc_dictionary, op7_sampled_pieces, op8_tool_links, op9_jaccard_join, op10_private_spans, op11_filter_audit, op12_wav_fingerprints, op13_hard_negatives)}

ORACLE_SQL = oracle.ORACLE_SQL
