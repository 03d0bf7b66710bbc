"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, n_words, running_sum, skew_join

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (3, 1, 2)
SHARE, LIMIT = Fraction(3, 2), Fraction(2)
BLOCK, CHUNK, PARTS = 128, 1 << 16, 1024
WIDE = "decimal(38,0)"


def _ordered(df: DataFrame, order: list[str], tables: Tables, name: str) -> DataFrame:
    """df as a table whose column part orders it: rows of a lower part come before those of a higher
    one in the given order, so that running sums over all rows need no task that holds them all."""
    dealt = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumn("all", F.lit(0))
    return tables.save(dealt, name)


def source_plan(sources: DataFrame, tables: Tables, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """sources (skey, source_size) with src (place in the order of skey), target and words.

    A source's target is its share of the words by weight, at most limit times its size, the
    excess reshared. With sources in the order of limit * size / weight those that reach their limit
    come first: one pass over running sums finds the first that does not, and what that one gets for
    a unit of weight is what all later ones get. Whole numbers throughout, any number of sources."""
    share, limit = Fraction(share), Fraction(limit)
    numbered = running_sum(_ordered(sources, ["skey"], tables, "sources"), "all", "part", [F.col("skey")], F.lit(1), "src")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    numbered = numbered.select("skey", "source_size", "src", weight.cast("long").alias("weight"))
    common = math.lcm(*weights)
    ranked = _ordered(numbered.withColumn("reach", F.col("source_size").cast(WIDE) * (F.lit(common) / F.col("weight")).cast("long")), ["reach", "src"], tables, "ranked")
    order = [F.col("reach"), F.col("src")]
    before = running_sum(running_sum(ranked, "all", "part", order, F.col("source_size"), "size_before"), "all", "part", order, F.col("weight"), "weight_before")
    totals = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not totals["weight"]:
        return ranked.select("skey", "source_size", "src", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("words"))
    # in parts of one word over the denominators of share and limit
    left = F.lit(share.numerator * limit.denominator * totals["size"]).cast(WIDE) - F.lit(limit.numerator * share.denominator).cast(WIDE) * F.col("size_before")
    rest = F.lit(totals["weight"]) - F.col("weight_before")
    size = F.col("source_size").cast(WIDE) * limit.numerator
    capped = size * rest * share.denominator < left * F.col("weight")
    first = before.where(~capped).agg(F.min(F.struct("reach", "src", left.alias("left"), rest.cast("long").alias("rest"))).alias("x")).first()["x"]
    if first is None:
        target = size.cast("double") / limit.denominator
        words = F.expr(f"(2 * cast(source_size as {WIDE}) * {limit.numerator} + {limit.denominator}) div {2 * limit.denominator}")
    else:
        over, under = int(first["left"]), int(first["rest"]) * share.denominator * limit.denominator
        capped = size * F.lit(under).cast(WIDE) < F.lit(over).cast(WIDE) * F.col("weight") * limit.denominator
        target = F.when(capped, size.cast("double") / limit.denominator).otherwise((F.lit(over).cast(WIDE) * F.col("weight")).cast("double") / float(under))
        even = F.expr(f"(2 * cast({over} as {WIDE}) * weight + {under}) div {2 * under}")
        words = F.when(capped, F.expr(f"(2 * cast(source_size as {WIDE}) * {limit.numerator} + {limit.denominator}) div {2 * limit.denominator}")).otherwise(even)
    return tables.save(ranked.select("skey", "source_size", "src", target.alias("target"), words.cast("long").alias("words")), "plan")


def schedule(plan: DataFrame, tables: Tables, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Slots (slot, src, pass, block, from_word, to_word) that deal words to each source of plan
    (src, source_size, words).

    Slot k's point is k * g mod N with g next to N over the golden ratio and coprime to N: the
    golden-ratio sequence on N points, each met once. Sources hold intervals of the N points, side
    by side by their running sums, in proportion to their numbers of slots, so any run of slots is
    near the target weights and the whole is exact. Each interval is cut into chunks of points; the
    slot of a point is the point times the inverse of g. A slot's rank among its source's slots,
    from running sums over ranges of slots, names the block it takes."""
    size, words = F.col("source_size"), F.col("words")
    turns = F.when(size > 0, F.expr("words div source_size")).otherwise(0)
    known = plan.where("source_size > 0").select("src", "source_size", turns.alias("turns"), F.expr(f"(source_size + {block - 1}) div {block}").alias("blocks"), (words - turns * size).alias("rest"))
    known = known.withColumn("slots", F.col("turns") * F.col("blocks") + F.expr(f"(rest + {block - 1}) div {block}"))
    known = running_sum(_ordered(known, ["src"], tables, "shares"), "all", "part", [F.col("src")], F.col("slots"), "start")
    known = tables.save(known, "intervals")
    total = known.agg(F.sum("slots")).first()[0] or 0
    if total * chunk >= 1 << 62:
        raise ValueError("too many slots for 64-bit points; use larger blocks")
    step = max(1, round(total * (math.sqrt(5) - 1) / 2))
    while total and math.gcd(step, total) > 1:
        step += 1
    back = pow(step, -1, total) if total > 1 else 0

    def slots_of(batches):
        for b in batches:
            for src, first, end in zip(*(b.column(c).to_pylist() for c in ("src", "first", "end")), strict=True):
                k = (first * back % total + np.arange(end - first, dtype=np.int64) * back % total) % total
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), src, dtype=np.int64))], ["slot", "src"])

    end = F.col("start") + F.col("slots")
    cut = known.where("slots > 0").select("src", "start", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {chunk}"))).alias("c"))
    cut = cut.select("src", (F.col("start") + F.col("c") * chunk).alias("first"), F.least(F.col("start") + (F.col("c") + 1) * chunk, end).alias("end"))
    slots = cut.repartition("src", "first").mapInArrow(slots_of, "slot long, src long")
    run = max(1, -(-total // PARTS))
    slots = tables.save(running_sum(tables.save(slots.withColumn("part", F.expr(f"slot div {run}")), "slots"), "src", "part", [F.col("slot")], F.lit(1), "rank"), "ranks")
    slots = skew_join(slots.select("slot", "src", "rank"), known.select("src", "source_size", "turns", "blocks", "rest"), "src")
    turn, at = F.expr("rank div blocks"), F.col("rank") % F.col("blocks")
    top = F.when(turn < F.col("turns"), F.col("source_size")).otherwise(F.col("rest"))
    return slots.select("slot", "src", turn.cast("int").alias("pass"), at.alias("block"), (at * block).alias("from_word"), F.least((at + 1) * block, top).alias("to_word"))


def mix_sources(
    docs: DataFrame,
    tables: Tables,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights=WEIGHTS,
    share=SHARE,
    limit=LIMIT,
    block: int = BLOCK,
    seed: int = 17,
    row: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(sizes, mix) of docs, read from tables of `tables`.

    sizes has a row for each document: row (a key to find it by; give `row`, a column, to choose it), doc_id, size (words),
    source_size and target (of its source). mix has a row for each piece of a document that a slot
    takes: slot, pass, row, start (the document's place among the words of its source, which tells
    documents of equal row apart), size, from_word, to_word (words of the document, end exclusive).

    Each source's documents are laid end to end in the order of a hash of doc_id and cut into
    blocks of equal words; schedule() deals the blocks. Pass p takes a source's blocks for the
    p-th time, so no document exceeds limit passes. There may be any number of sources. A null source
    is a source, last in order; a null or empty text has size 0 and takes no part; a very long
    one is cut into blocks like any other; an empty table gives no rows; equal rows are separate
    documents, ties in the order of the hash are broken by doc_id, size and row. Other columns are
    ignored, whatever their names."""
    skey = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    sizes = tables.save(docs.select(F.col(doc_id).alias("doc_id"), skey.alias("skey"), n_words(F.col(text)).alias("size"), (F.monotonically_increasing_id() if row is None else row).alias("row")), "words")
    plan = source_plan(sizes.groupBy("skey").agg(F.sum("size").alias("source_size")), tables, weights, share, limit)
    sizes = tables.save(skew_join(sizes, plan.select("skey", "src", "source_size", "target"), "skey").select("row", "doc_id", "src", "size", "source_size", "target"), "sizes")
    spread = F.xxhash64("doc_id", F.lit(seed))
    placed = running_sum(sizes.where("size > 0").withColumn("spread", spread).withColumn("part", F.pmod(F.shiftrightunsigned("spread", 32), F.lit(PARTS))), "src", "part", [F.col("spread"), F.col("doc_id"), F.col("size"), F.col("row")], F.col("size"), "start")
    pieces = placed.select("src", "row", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    slots = schedule(plan, tables, block)
    # both sides grow with the words, so they are never broadcast
    both = slots.hint("merge").join(pieces, ["src", "block"]).select("slot", "pass", "row", "start", "size", (F.greatest("from_word", "start") - F.col("start")).alias("from_word"), (F.least("to_word", F.col("start") + F.col("size")) - F.col("start")).alias("to_word"))
    return sizes.drop("src"), both.where("from_word < to_word")


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken (words, repeats counted).

    Nulls, empty and long texts, ties, equal rows, empty tables and other columns are as in mix_sources."""
    tables = Tables(docs.sparkSession, "mix")
    sizes, mix = mix_sources(docs, tables, **options)
    taken = mix.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    out = sizes.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return tables.keep(out, "counts")
