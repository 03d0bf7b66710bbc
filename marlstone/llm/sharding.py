"""Sharding of documents by minimax contiguous partition of atomic groups (native)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, running_sum

FIRST_DIGITS, MORE_DIGITS, ALL_DIGITS = 3, 2, 64


def _whole_cuts(ends: list[int], cap: int, shards: int) -> list[int]:
    """Greedy cuts at known ends, each shard as full as cap allows; fewer cuts if one can't advance."""
    cuts, at = [], 0
    for _ in range(shards - 1):
        at = ends[bisect_right(ends, at + cap) - 1]
        cuts.append(at)
    return cuts


def _loose_cuts(ends: list[int], atomic: list[bool], cap: int, shards: int) -> list[int]:
    """As _whole_cuts, but a chunk of several groups may be cut at any byte: no real cut lies later."""
    cuts, at = [], 0
    for _ in range(shards - 1):
        at = min(at + cap, ends[-1])
        k = bisect_left(ends, at)
        if ends[k] != at and atomic[k]:
            at = ends[k - 1]
        cuts.append(at)
    return cuts


def _least(low: int, high: int, fits) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def minimax_cuts(chunk_rows, shards: int) -> tuple[list[str], int]:
    """The first digest prefix of each shard after the first, and the least possible capacity.

    chunk_rows(None) gives [(prefix, bytes, is one group)] at FIRST_DIGITS digits; chunk_rows(list)
    the same for the parts of those prefixes, MORE_DIGITS longer. Chunks are held on the driver:
    at most 16**FIRST_DIGITS at first, then only those that a cut can fall into."""
    chunks = sorted(chunk_rows(None))
    while True:
        ends = [0, *accumulate(c[1] for c in chunks)]
        atomic = [True, *(c[2] for c in chunks)]
        total = ends[-1]
        least = -(-total // shards)
        tight = _least(least, total, lambda c: total - _whole_cuts(ends, c, shards)[-1] <= c) if shards > 1 else total
        loose = _least(least, tight, lambda c: total - _loose_cuts(ends, atomic, c, shards)[-1] <= c) if shards > 1 else total
        early, late = _whole_cuts(ends, loose, shards), _loose_cuts(ends, atomic, tight, shards)
        open_ = {k for a, b in zip(early, late, strict=True) for k in range(bisect_right(ends, a), bisect_left(ends, b) + 1) if k < len(ends) and not atomic[k]}
        if not open_:
            break
        parts = chunk_rows([chunks[k - 1][0] for k in sorted(open_)])
        chunks = sorted([c for k, c in enumerate(chunks, 1) if k not in open_] + parts)
    # every cut must leave what the shards after it can hold; within that, as even as can be
    after, at = [], total
    for _ in range(shards - 1):
        at = ends[bisect_left(ends, at - tight)] if at > tight else 0
        after.append(at)
    cuts, at = [], 0
    for k, floor in enumerate(reversed(after)):
        ideal = at + (total - at) / (shards - k)
        high = bisect_right(ends, at + tight) - 1
        low = max(bisect_left(ends, floor), bisect_left(ends, at))
        k = min(max(bisect_right(ends, ideal) - 1, low), high)
        if k < high and abs(ends[k + 1] - ideal) < abs(ends[k] - ideal):
            k += 1
        at = ends[k]
        cuts.append(k)
    return [chunks[k][0] if k < len(chunks) else "g" for k in cuts], tight


def shard_documents(
    docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id", slot_parts: int = 1024
) -> DataFrame:
    """Documents dealt to shards of near equal bytes, equal texts together.

    The groups of equal texts are ordered by the SHA-256 of the text, a uniform order, and cut into
    contiguous runs: binary search finds the smallest capacity for which greedy filling needs no
    more than the given shards. Only sums over digest prefixes reach the driver: 4096 at first, then
    256 for each prefix into which a cut may fall. A document's shard then is the number of cut
    prefixes not above its digest, without a join.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law "bytes", shard, slot, grown_shard
    (null). slot counts each shard's documents from 0. A null text has no bytes: size 1, CRC 0, and
    is a group of its own. An empty table gives no rows. Rows that are equal in all take different
    slots; documents of equal text and id are in no fixed order among them. Texts of any length are hashed
    whole and never leave their row. Other columns are ignored, whatever their names."""
    raw = F.col(text).cast("binary")
    tables = Tables(docs.sparkSession, "shards")
    rows = tables.save(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.sha2(raw, 256), F.lit("")).alias("sha"),
        ),
        "sizes",
    )

    def chunk_rows(prefixes):
        digits, of = FIRST_DIGITS, rows
        if prefixes is not None:
            # chunks of the same length together; a refined chunk's parts are MORE_DIGITS longer
            out = []
            for n in sorted({len(p) for p in prefixes}):
                mine = [p for p in prefixes if len(p) == n]
                digits = min(n + MORE_DIGITS, ALL_DIGITS)
                of = rows.where(F.substring("sha", 1, n).isin(mine)).withColumn("chunk", F.substring("sha", 1, digits))
                out += _sums(of)
            return out
        return _sums(of.withColumn("chunk", F.substring("sha", 1, digits)))

    cuts = minimax_cuts(chunk_rows, shards)[0] if shards > 1 and not rows.isEmpty() else []
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(F.col("sha") >= cut, 1).otherwise(0)
    dealt = rows.withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(slot_parts)))
    order = [F.col("sha"), F.col("doc_id")]
    out = running_sum(dealt, "shard", "part", order, F.lit(1), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )
    return tables.keep(out, "shards")


def _sums(df: DataFrame) -> list[tuple[str, int, bool]]:
    got = df.groupBy("chunk").agg(F.sum("size").alias("n"), F.min("sha").alias("a"), F.max("sha").alias("b"))
    return [(r["chunk"], r["n"], r["a"] == r["b"]) for r in got.collect()]
