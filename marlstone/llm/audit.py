"""Filter interaction audit on a packed bitmap index of filters, labels and parts."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, skew_join
from .hashing import byte_column

#: The filters in the order of their bits; E (a copy of a smaller doc_id's text) needs the whole table.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10
_UPPER, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
GOOD, TOXIC = len(FILTERS), len(FILTERS) + 1
#: Rows of one bitmap; a partition has as many as it needs, so memory does not grow with it.
BLOCK_ROWS = 1 << 18
#: Bytes of one text that are split at once; longer texts are cut at white space.
SLICE = 2 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: (filters before, filter): 80 pairs, from which all 120 orders are read.
STEPS = [(sum(1 << i for i in before), f) for f in range(len(FILTERS)) for n in range(len(FILTERS)) for before in combinations([i for i in range(len(FILTERS)) if i != f], n)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _words(raw: bytes) -> tuple[int, int]:
    """Words and distinct words; bytes.split() parts at space and \\x09-\\x0D."""
    if len(raw) <= SLICE:
        words = raw.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        space = _SPACE.search(raw, at + SLICE)
        end = space.end() if space else len(raw)
        words = raw[at:end].split()
        n, at = n + len(words), end
        seen.update(words)
    return n, len(seen)


def own_failures(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = _words(raw)
    points = len(raw) - len(raw.translate(None, bytes(range(0x80, 0xC0)))) if not raw.isascii() else 0
    upper = len(raw) - len(raw.translate(None, _UPPER))
    symbol = len(raw.translate(None, _SYMBOLS)) < len(raw)
    return (n < MIN_WORDS) | (100 * distinct < MIN_DISTINCT * n) << 1 | (100 * upper > MAX_UPPER * (len(raw) - points)) << 2 | symbol << 3


def _judge(batches):
    for batch in batches:
        data, at = byte_column(batch.column("text"))
        fails, digests = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            raw = data[a:b].tobytes()
            fails.append(own_failures(raw))
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(fails, pa.int32())], ["doc_id", "part", "digest", "bits"])


def failures(docs: DataFrame, tables: Tables, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """doc_id, part and bits (the filters that fail) of each row, a table of its own."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    judged = tables.save(rows.mapInArrow(_judge, "doc_id long, part string, digest binary, bits int"), "judged")
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).cast("int")
    joined = skew_join(judged, first, "digest", "left", grows=True)
    return tables.save(joined.select("doc_id", "part", (F.col("bits") + F.lit(1 << FILTERS.index("E")) * copy).alias("bits")), "failures")


def with_labels(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """rows with the bits GOOD and TOXIC set where any label row of the doc_id says so."""
    of = labels.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")
    )
    of = of.where("doc_id is not null").select("doc_id", (F.col("good") * (1 << GOOD) + F.col("toxic") * (1 << TOXIC)).alias("marks"))
    known = skew_join(rows.where("doc_id is not null"), of, "doc_id", "left", grows=True)
    known = known.select("doc_id", "part", (F.col("bits") + F.coalesce("marks", F.lit(0))).alias("bits"))
    return known.unionByName(rows.where("doc_id is null").select("doc_id", "part", "bits"))


class BitmapIndex:
    """Packed bitsets over rows: one for each bit of `bits`, and the parts' rows.

    Rows are laid out part by part, each part filling whole 64-bit words, so that a part's bitset is
    the valid bits of its own words, and a popcount by word, summed between the parts' first words,
    counts every part at once, however many there are."""

    def __init__(self, bits: np.ndarray, part: np.ndarray, n_parts: int):
        sizes = np.bincount(part, minlength=n_parts)
        words = -(-sizes // 64)
        self.first = np.concatenate(([0], np.cumsum(words)))[:-1]
        order = np.argsort(part, kind="stable")
        place = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first * 64, sizes)
        room = int(words.sum()) * 64
        self.rows = self._packed(room, place)
        self.sets = [self._packed(room, place[(bits[order] >> b & 1).astype(bool)]) for b in range(TOXIC + 1)]

    @staticmethod
    def _packed(room: int, places: np.ndarray) -> np.ndarray:
        flat = np.zeros(room, dtype=bool)
        flat[places] = True
        return np.packbits(flat, bitorder="little").view(np.uint64)

    def count(self, bitset: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bitset).astype(np.int64), self.first)

    def interactions(self) -> np.ndarray:
        """Counts (parts, STEPS, COUNTS): each step takes from what the filters before it left."""
        n = len(FILTERS)
        left = {0: self.rows}
        for mask in range(1, 1 << n):
            low = (mask & -mask).bit_length() - 1
            left[mask] = left[mask & (mask - 1)] & ~self.sets[low]  # AND-NOT
        kept = {mask: self.count(bitset) for mask, bitset in left.items()}
        fails = [self.count(self.sets[f]) for f in range(n)]
        alone = [self.count(self.sets[f] & left[(1 << n) - 1 ^ 1 << f]) for f in range(n)]
        out = np.empty((len(self.first), len(STEPS), len(COUNTS)), dtype=np.int64)
        for i, (before, f) in enumerate(STEPS):
            after, gone = before | 1 << f, left[before] & self.sets[f]
            removed = kept[before] - kept[after]
            for j, c in enumerate((kept[after], removed, fails[f] - removed, alone[f], self.count(gone & self.sets[GOOD]), self.count(gone & self.sets[TOXIC]))):
                out[:, i, j] = c
        return out


def _count_block(rows: pa.Table):
    part = rows.column("part").combine_chunks().dictionary_encode()
    names = part.dictionary
    counts = BitmapIndex(rows.column("bits").to_numpy(), part.indices.to_numpy(), len(names)).interactions()
    at = np.repeat(np.arange(len(names)), len(STEPS))
    flat = counts.reshape(-1, len(COUNTS))
    for a in range(0, len(at), 1 << 14):
        some = slice(a, a + (1 << 14))
        step = pa.array(np.tile(np.arange(len(STEPS), dtype=np.int32), len(names))[some])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(at[some])), step, *[pa.array(flat[some, j]) for j in range(len(COUNTS))]], ["part", "at", *COUNTS])


def _count(block_rows: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= block_rows:
                yield from _count_block(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from _count_block(pa.Table.from_batches(held))

    return run


def audit_filters(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What each filter removes at each step of each order of the five, by part: part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Texts are judged once, where they lie; E compares them by SHA-256 with the smallest doc_id of each
    (hot texts by broadcast). Partitions then turn their narrow rows into bitmaps and count the 80 pairs
    of a filter and those before it; only these counts are summed, and the 120 orders read them.
    shapley is a filter's removed summed over all orders: each pair counts as often as orders have it.

    A null text is empty (it fails A, and equals other empty texts); a null part is ''. A row of null
    doc_id has no labels, is never a copy and is no smaller id. Rows of one doc_id are rows of their
    own, and not copies of one another. Several label rows of a doc_id mark it if any does. Long texts
    are split slice by slice, so that memory grows with their distinct words. A part has all its 600
    rows, zeros included; an empty table gives none. Other columns are ignored, whatever their names."""
    tables = Tables(docs.sparkSession, "audit")
    rows = with_labels(failures(docs, tables, text, doc_id, part), labels, doc_id).select("part", "bits")
    counted = rows.mapInArrow(_count(block_rows), f"part string, at int, {', '.join(f'{c} long' for c in COUNTS)}")
    counts = tables.save(counted.groupBy("part", "at").agg(*[F.sum(c).alias(c) for c in COUNTS]), "counts")
    n = len(FILTERS)
    place = {step: i for i, step in enumerate(STEPS)}
    orders = [("".join(FILTERS[f] for f in order), k + 1, place[sum(1 << i for i in order[:k]), f]) for order in permutations(range(n)) for k, f in enumerate(order)]
    often = [(i, f, factorial(before.bit_count()) * factorial(n - 1 - before.bit_count())) for i, (before, f) in enumerate(STEPS)]
    spark = docs.sparkSession
    # fixed tables of 80 and 600 rows
    often = spark.createDataFrame(often, "at int, filter int, orders long")
    by_filter = counts.join(F.broadcast(often), "at")
    shapley = by_filter.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    full = by_filter.join(shapley, ["part", "filter"]).drop("filter", "orders")
    table = spark.createDataFrame(orders, "filter_order string, step int, at int")
    out = full.join(F.broadcast(table), "at").select("part", "filter_order", "step", *COUNTS, "shapley")
    return tables.keep(out, "audit")
