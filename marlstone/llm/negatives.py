"""Hard-negative mining by norm-bucketed search: exact, pruned by the Cauchy-Schwarz bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables

#: Rows of a bucket of candidates, and anchors of a block.
BUCKET, BLOCK = 2048, 128
#: Tasks that share the blocks which meet one part of the buckets, and so many times more for the first bucket.
PART_TASKS, SEED_TASKS = 4, 4
#: Inner products of whole numbers are exact in single and double precision below these.
EXACT_SINGLE, EXACT = float(1 << 24), float(1 << 53)
#: Bounds are computed in floating point: a bucket is left out only if it misses by more than this.
SLACK = 1e-9
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

_ROWS = "dim int, top double, ids binary, marks binary, labels binary, width int, vectors binary"
_BUCKETS = f"part int, {_ROWS}"
_FOUND = "anchor_id long, anchor_mark long, window int, score long, vec_id long, mark long"


def whole_vectors(rows: DataFrame, vec_id: str, embedding: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label, vec (floor of scale times each component, whole doubles), dim, norm and mark (a
    hash that tells rows of one vec_id apart) of the rows that take part, repeated rows once."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    src = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"), finite.alias("_finite"))
    src = src.where("vec_id is not null and label is not null and x is not null and _finite")
    # floor of a double is a long in Spark; beyond 2 ** 52 doubles are whole already
    whole = lambda c: F.when(F.abs(c * scale) < float(1 << 52), F.floor(c * scale).cast("double")).otherwise(c * scale)
    src = src.select("vec_id", "label", F.transform("x", whole).alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c))
    return src.withColumns({"dim": F.size("vec"), "norm": norm, "mark": F.xxhash64("label", "vec")}).dropDuplicates(["vec_id", "mark"])


def pack(x: np.ndarray) -> tuple[int, bytes]:
    """Bytes a component takes, and the matrix in the narrowest of int16, int32 and double that holds it."""
    most = np.abs(x).max(initial=0)
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64
    return np.dtype(kind).itemsize, x.astype(kind).tobytes()


def unpack(width: int, raw: bytes, dim: int, rows: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[width]
    return np.frombuffer(raw, dtype=kind).reshape(rows, dim).astype(np.float64)


def _cut(batches, size: int):
    """Rows sorted by dim and norm, cut into runs of one dim and at most size rows."""
    held, n, dim = [], 0, None
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        at = 0
        while at < len(dims):
            if dim != dims[at] or n == size:
                if n:
                    yield dim, pa.Table.from_batches(held)
                held, n, dim = [], 0, dims[at]
            other = np.flatnonzero(dims[at:] != dim)
            end = min(at + size - n, at + int(other[0]) if len(other) else len(dims))
            held, n, at = [*held, batch.slice(at, end - at)], n + end - at, end
    if n:
        yield dim, pa.Table.from_batches(held)


def _matrix(lists: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [np.asarray(c.flatten()) for c in lists.chunks]
    return np.concatenate(flat).reshape(-1, dim) if dim else np.zeros((len(lists), 0))


def _columns(run: pa.Table, dim: int) -> list[pa.Array]:
    raw = lambda a: pa.array([a.tobytes()], pa.binary())
    ids, marks, labels = (run.column(c).to_numpy() for c in ("vec_id", "mark", "label"))
    width, vectors = pack(_matrix(run.column("vec"), dim))
    return [pa.array([dim], pa.int32()), pa.array([float(run.column("norm").to_numpy().max())]), raw(ids), raw(marks), raw(labels), pa.array([width], pa.int32()), pa.array([vectors], pa.binary())]


def _bucketed(size: int):
    def run(batches):
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        for dim, rows in _cut(batches, size):
            yield pa.RecordBatch.from_arrays([part, *_columns(rows, dim)], [c.split()[0] for c in _BUCKETS.split(", ")])

    return run


_WINDOWS = "of array<int>, name array<int>, low array<long>, high array<long>, kth array<long>, kth_id array<long>, same boolean, reach double"


def reach_of(norm: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The least norm of a row that can score limit with one of the given norm: limit / norm, by Cauchy-Schwarz."""
    need = limit.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = need * (1 - np.sign(need) * SLACK) / norm - SLACK
    return np.where(need <= 0, -np.inf, np.where(norm > 0, out, np.inf))


def _blocks(same: bool, size: int):
    """Anchors sorted by dim and norm, each with its windows -> blocks of them."""

    def run(batches):
        names = [c.split()[0] for c in _ROWS.split(", ")] + [c.split()[0] for c in _WINDOWS.split(", ")]
        for dim, rows in _cut(batches, size):
            windows = rows.column("windows").combine_chunks()
            of = np.repeat(np.arange(len(rows)), np.diff(np.asarray(windows.offsets)))
            w = windows.flatten()
            name, low, high, kth, kth_id = (np.asarray(w.field(f)) for f in ("name", "low", "high", "kth", "kth_id"))
            reach = reach_of(rows.column("norm").to_numpy()[of], np.maximum(low, kth)).min(initial=np.inf)
            lists = [pa.array([x.tolist()], pa.list_(t)) for x, t in ((of, pa.int32()), (name, pa.int32()), (low, pa.int64()), (high, pa.int64()), (kth, pa.int64()), (kth_id, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*_columns(rows, dim), *lists, pa.array([same]), pa.array([float(reach)])], names)

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exactly: in the precision in which they are exact, else as
    whole numbers of any size, of which those beyond 64 bits are an error."""
    most = max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if most < EXACT_SINGLE:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    out = whole[0] @ whole[1].T if a.shape[1] else np.zeros((len(a), len(b)), dtype=object)
    if any(not _LOW <= x <= _HIGH for x in out.flat):
        raise OverflowError("an inner product exceeds 64 bits")
    return out.astype(np.int64)


class Block:
    """A block of anchors and the best rows found so far in each of its windows."""

    def __init__(self, row: dict, k: int):
        self.k, self.dim, self.same = k, row["dim"], row["same"]
        self.ids, self.marks, self.labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "marks", "labels"))
        self.vectors = unpack(row["width"], row["vectors"], self.dim, len(self.ids))
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.vectors**2).sum(axis=1))
        self.of, self.name, low, self.high, kth, kth_id = (np.array(row[c], dtype=np.int64) for c in ("of", "name", "low", "high", "kth", "kth_id"))
        # a row must score more than the floor, or as much with an id up to floor_id; another round may have raised it
        self.floor, self.floor_id = np.maximum(low, kth), np.where(kth >= low, kth_id, _HIGH)
        self.best = [(np.zeros(0, np.int64),) * 3 for _ in self.of]

    def meet(self, row: dict) -> None:
        """Search a bucket: only anchors with a window that its largest norm can reach are multiplied."""
        open_ = np.flatnonzero(row["top"] >= reach_of(self.norm[self.of], self.floor))
        if not len(open_):
            return
        ids, marks, labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "marks", "labels"))
        vectors = unpack(row["width"], row["vectors"], self.dim, len(ids))
        anchors, line = np.unique(self.of[open_], return_inverse=True)
        scores = products(self.vectors[anchors], vectors)
        for w, i in zip(open_.tolist(), line.tolist(), strict=True):
            a, score = self.of[w], scores[i]
            fit = (score > self.floor[w]) | ((score == self.floor[w]) & (ids <= self.floor_id[w]))
            fit &= score <= self.high[w]
            fit &= (labels == self.labels[a]) & (ids != self.ids[a]) if self.same else labels != self.labels[a]
            at = np.flatnonzero(fit)
            if not len(at):
                continue
            s, v, m = (np.concatenate(x) for x in zip(self.best[w], (score[at], ids[at], marks[at]), strict=True))
            if len(s) > self.k:
                kth = np.partition(s, len(s) - self.k)[len(s) - self.k]
                near = np.flatnonzero(s >= kth)
                near = near[np.lexsort((m[near], v[near], -s[near]))[: self.k]]
                s, v, m = s[near], v[near], m[near]
            if len(s) == self.k:
                last = np.lexsort((-v, s))[0]
                self.floor[w], self.floor_id[w] = s[last], v[last]
            self.best[w] = s, v, m

    def found(self) -> pa.RecordBatch:
        n = [len(b[0]) for b in self.best]
        w = np.repeat(np.arange(len(self.of)), n)
        s, v, m = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*self.best, strict=True) if self.best else ([],) * 3))
        a = self.of[w]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[a], self.marks[a], self.name[w].astype(np.int32), s, v, m)], [c.split()[0] for c in _FOUND.split(", ")])


def _meet(k: int):
    def run(batches):
        block, key = None, None
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                own = (row["dim"], row["ids"], row["marks"])
                if own != key:
                    if block:
                        yield block.found()
                    block, key = Block({c: row[c] for c in row if not c.startswith("c_")}, k), own
                block.meet({c[2:]: row[c] for c in row if c.startswith("c_")})
        if block:
            yield block.found()

    return run


def _search(blocks: DataFrame, buckets: DataFrame, parts: DataFrame, k: int, spread: int) -> DataFrame:
    """Each block meets the buckets that its windows can reach, of each of their parts in a task of
    its own, the largest norms first. parts (one row a part and dim) says which have any."""
    salt = F.pmod(F.xxhash64("ids", "marks"), F.lit(spread)).cast("int")
    asks = blocks.withColumn("salt", salt).join(F.broadcast(parts), "dim").where("part_top >= reach").drop("part_top")
    cells = buckets.select("part", "dim", *[F.col(c).alias(f"c_{c}") for c in ("top", "ids", "marks", "labels", "width", "vectors")], F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"))
    asks = asks.repartition("part", "dim", "salt")
    cells = cells.repartition("part", "dim", "salt").sortWithinPartitions("part", "dim", "salt", F.desc("c_top"))
    met = asks.hint("merge").join(cells, ["part", "dim", "salt"]).where("c_top >= reach")
    return met.drop("part", "salt", "c_part").mapInArrow(_meet(k), _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each window, larger scores first, then smaller vec_id."""
    order = Window.partitionBy("anchor_id", "anchor_mark", "window").orderBy(F.desc("score"), "vec_id", "mark")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _place() -> Column:
    return F.struct("top", "part", F.xxhash64("ids", "marks").alias("mark"))


def _searched(anchors: DataFrame, buckets: DataFrame, first: DataFrame, parts: DataFrame, tables: Tables, same: bool, k: int, block: int, name: str) -> DataFrame:
    """The k best rows of each window of anchors (vec_id, mark, label, vec, dim, norm, windows), a table.
    first holds the place of the bucket of the largest norms of each dim, parts the largest norm of each part.

    The bucket of the largest norms of each dim is met first; what it gives is the running kth score
    that prunes the blocks' way through all other buckets."""

    def blocks(rows: DataFrame) -> DataFrame:
        dealt = rows.select("vec_id", "mark", "label", "vec", "dim", "norm", "windows").repartitionByRange("dim", F.desc("norm"), "vec_id")
        return dealt.sortWithinPartitions("dim", F.desc("norm"), "vec_id").mapInArrow(_blocks(same, block), f"{_ROWS}, {_WINDOWS}")

    marked = buckets.withColumn("place", _place())
    at_first = marked.join(F.broadcast(first), ["dim", "place"], "left_semi").drop("place")
    others = marked.join(F.broadcast(first), ["dim", "place"], "left_anti").drop("place")
    seeds = first.select("dim", "place.part", F.col("place.top").alias("part_top"))
    found = tables.save(_best(_search(blocks(anchors), at_first, seeds, k, PART_TASKS * SEED_TASKS), k), f"{name}-seeds")
    kth = found.where(F.col("rank") == k).select(F.col("anchor_id").alias("a"), F.col("anchor_mark").alias("b"), "window", "score", "vec_id")
    kth = kth.groupBy(F.col("a").alias("vec_id"), F.col("b").alias("mark")).agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct("score", F.col("vec_id").alias("id"))))).alias("got"))
    got = F.coalesce("got", F.create_map().cast("map<int,struct<score:bigint,id:bigint>>"))
    raised = anchors.join(kth, ["vec_id", "mark"], "left").withColumn("got", got)
    best = lambda w: F.try_element_at("got", w["name"])
    raised = raised.withColumn("windows", F.transform("windows", lambda w: w.withField("kth_id", F.coalesce(best(w)["id"], w["kth_id"])).withField("kth", F.coalesce(best(w)["score"], w["kth"])))).drop("got")
    raised = tables.save(raised, f"{name}-raised")
    more = _search(blocks(raised), others, parts, k, PART_TASKS)
    return tables.save(_best(found.drop("rank").unionByName(more), k), name)


def mine_negatives(rows: DataFrame, anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | str = "label", bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the inner product, exactly, of the floors of scale times the components of its
    vector and of the anchor's. Anchors are the rows whose id the condition `anchor` selects. Their
    positives are the first rows of the same label, and for each positive the first rows of another
    label whose score lies between low and high hundredths of the positive's; higher scores come
    first, ties by smaller id.

    Rows are sorted by norm and cut into buckets; a bucket is left out where its largest norm times the
    anchor's (Cauchy-Schwarz) reaches neither the window's lower limit nor the kth score found so far.
    The search is exact: a window that few rows fill meets every bucket that its lower limit can reach.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; a zero or
    empty vector does, all its scores are 0. Vectors meet those of their own dimension. Repeated rows
    count once; rows that share an id but differ are rows of their own, and not each other's positives.
    Inner products are exact whole numbers; one beyond 64 bits is an error. Many equal vectors fall
    into many buckets, in the order of their ids. An anchor without positives, an empty window and an
    empty table give no rows. Other columns are ignored, whatever their names."""
    spark = rows.sparkSession
    tables = Tables(spark, "negatives")
    label = F.col(label) if isinstance(label, str) else label
    base = tables.save(whole_vectors(rows, vec_id, embedding, label, scale), "whole")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("dim", F.desc("norm"), "vec_id")
    buckets = base.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_bucketed(bucket), _BUCKETS)
    buckets = tables.save(buckets, "buckets")
    # one row for each dim, and for each dim of a part
    first = tables.save(buckets.groupBy("dim").agg(F.max(_place()).alias("place")), "first")
    parts = tables.save(buckets.groupBy("part", "dim").agg(F.max("top").alias("part_top")), "parts")
    window = lambda name, lo, hi: F.struct(name.cast("int").alias("name"), lo.cast("long").alias("low"), hi.cast("long").alias("high"), F.lit(_LOW).cast("long").alias("kth"), F.lit(_HIGH).cast("long").alias("kth_id"))
    anchors = base.where(anchor(F.col("vec_id")))
    alike = _searched(anchors.withColumn("windows", F.array(window(F.lit(1), F.lit(_LOW), F.lit(_HIGH)))), buckets, first, parts, tables, True, positives, block, "positives")
    alike = alike.select("anchor_id", "anchor_mark", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # percent * score / 100, rounded inwards, in whole numbers
    part = lambda percent, rounded: F.expr(f"{percent} * (positive_score div 100)") + rounded(F.expr(f"{percent} * (positive_score % 100)") / 100.0)
    windows = alike.withColumns({"lo": part(low, F.ceil), "hi": part(high, F.floor)}).where("lo <= hi")
    windows = windows.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_mark").alias("mark")).agg(F.array_sort(F.collect_list(window(F.col("window"), F.col("lo"), F.col("hi")))).alias("windows"))
    asked = tables.save(anchors.join(windows, ["vec_id", "mark"]), "asked")
    unlike = _searched(asked, buckets, first, parts, tables, False, negatives, block, "negatives")
    out = unlike.select("anchor_id", "anchor_mark", "window", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(alike, ["anchor_id", "anchor_mark", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return tables.keep(out, "mined")
