"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, skew_join

TABLES, ROTATIONS, SEED = 12, 3, 20240501
#: Probes are fitted so that this share of the true neighbours of FIT_QUERIES queries is found.
RECALL, FIT_QUERIES = 0.95, 64
#: Rows of a sample, one of FLOOR_SHARE at most, that give each query a score its neighbours must reach.
FLOOR_ROWS, FLOOR_SHARE = 4096, 10
#: Index rows searched at once; larger cells are searched in blocks.
BLOCK = 1 << 16
#: Largest ratio of lengths in a band of vectors for which these need no extra coordinate.
EVEN = 1.01
#: Bound on the error of an inner product of unit vectors held in half precision.
SLACK = 2.0e-3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, length a power of two, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


@lru_cache(maxsize=4096)
def _signs(d: int, table: int, part: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, table, part]).choice([-1.0, 1.0], (ROTATIONS, d))


def signed_axes(x: np.ndarray, table: int, part: int = 0, least: int = 0, seed: int = SEED) -> np.ndarray:
    """Rows after a pseudo-rotation (signs and a Hadamard transform, three times), next to their
    negatives: the nearest signed axis is the largest column. Only the first coordinates, if least is given."""
    for s in _signs(x.shape[1], table, part, seed):
        x = hadamard(x * s)
    x = x[:, : least or x.shape[1]]
    return np.concatenate((x, -x), axis=1)


def second_axes(rows: int, d: int) -> int:
    """Coordinates of the second hash, which grow with the square root of the rows up to all of them:
    buckets are pairs of a signed axis of all coordinates and one of these."""
    return int(min(d, 1 << 13, max(1, 2 ** round(math.log2(max(rows, 2)) / 2 - 3.5))))


def hashes(y: np.ndarray, table: int, least: int, seed: int = SEED) -> np.ndarray:
    return signed_axes(y, table, 0, 0, seed).argmax(axis=1) * 2 * least + signed_axes(y, table, 1, least, seed).argmax(axis=1)


def probe_costs(y: np.ndarray, tables: int, least: int, seed: int = SEED) -> np.ndarray:
    """How far each bucket of each table is from each row: the squares of what its two axes lack to the
    nearest ones. Shape (rows, tables * buckets)."""
    out = []
    for t in range(tables):
        a, b = signed_axes(y, t, 0, 0, seed), signed_axes(y, t, 1, least, seed)
        a, b = (a.max(axis=1)[:, None] - a) ** 2, (b.max(axis=1)[:, None] - b) ** 2
        out.append((a[:, :, None] + b[:, None, :]).reshape(len(y), -1))
    return np.concatenate(out, axis=1)


def _padded(x: np.ndarray, extra: np.ndarray | None) -> np.ndarray:
    d = x.shape[1] + (extra is not None)
    out = np.zeros((len(x), 1 << max(0, d - 1).bit_length()))
    out[:, : x.shape[1]] = x
    if extra is not None:
        out[:, x.shape[1]] = extra
    return out


def _by_size(batch, column: str):
    """(rows, matrix) of the vectors of a batch, those of each dimension together."""
    lists = batch.column(column)
    at = np.asarray(lists.offsets)
    values = np.asarray(lists.values, dtype=np.float64)
    sizes = np.diff(at)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, values[at[rows][:, None] + np.arange(d)]


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, and lengths as a number near one and a power of two, safe from over- and underflow."""
    top = np.frexp(np.abs(x).max(axis=1))[1]
    y = np.ldexp(x, -top[:, None])
    n = np.sqrt((y * y).sum(axis=1))
    shift = np.floor(np.log2(n) + 0.5).astype(np.int64)
    return y / n[:, None], np.ldexp(n, -shift), top + shift


def _columns(rows: np.ndarray, *columns) -> list:
    return [c.take(pa.array(rows)) for c in columns]


def _lists(x: np.ndarray, kind) -> pa.ListArray:
    at = np.arange(0, x.size + 1, x.shape[1] if x.size else 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at[: len(x) + 1]), pa.array(x.reshape(-1), kind))


def _bytes(x: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(x, dtype=np.float16)
    return pa.array([r.tobytes() for r in raw], pa.binary())


class Space:
    """The bands of one dimension: by power of two of the length, the longest and whether lengths differ."""

    def __init__(self, d: int, bands: dict[int, tuple[float, float]], rows: int):
        self.d, self.least = d, second_axes(rows, d)
        self.bands = {b: (top, top > EVEN * least) for b, (least, top) in bands.items()}

    def index(self, unit: np.ndarray, length: np.ndarray, band: int) -> np.ndarray:
        top, uneven = self.bands[band]
        share = length / top
        return _padded(unit * share[:, None], np.sqrt(np.maximum(0, 1 - share**2))) if uneven else _padded(unit, None)

    def query(self, unit: np.ndarray, band: int) -> np.ndarray:
        return _padded(unit, np.zeros(len(unit)) if self.bands[band][1] else None)


def _search(batches, k: int):
    """Index rows and queries, sorted by cell, index rows first -> (q, key, score, slack) that may be
    among the k nearest. Scores are in units of the query's length and bounded in error by slack."""
    cell = None
    names = ["q", "key", "score", "slack"]
    for batch in batches:
        ids = np.stack([batch.column(c).to_numpy() for c in ("d", "band", "tab", "axis", "block")], axis=1)
        kind, key = batch.column("kind").to_numpy(), batch.column("key").to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(ids, axis=0) != 0).any(axis=1) | (np.diff(kind) != 0), [True])))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            at = tuple(ids[i].tolist())
            if at != cell:
                cell, stored = at, []
            d = at[0]
            part = batch.slice(i, j - i)
            code = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.float16).reshape(-1, d).astype(np.float32)
            if kind[i] == 0:
                stored.append((key[i:j], part.column("sub").to_numpy(), part.column("size").to_numpy(), code))
                continue
            if not stored:
                continue
            if len(stored) > 1:
                stored = [tuple(np.concatenate(c) for c in zip(*stored, strict=True))]
            keys, subs, size, vec = stored[0]
            order = np.argsort(subs, kind="stable")
            asked = part.column("subs").to_pylist()
            of = np.repeat(np.arange(j - i), [len(x) // 2 for x in asked])
            wanted = np.frombuffer(b"".join(asked), dtype=np.int16).astype(np.int32)
            floor = part.column("size").to_numpy()
            out = []
            by = np.argsort(wanted, kind="stable")
            ends = np.flatnonzero(np.concatenate(([True], np.diff(wanted[by]) != 0, [True])))
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                s = wanted[by[x]]
                lo, hi = np.searchsorted(subs[order], [s, s + 1])
                near, who = order[lo:hi], of[by[x:y]]
                for z in range(0, len(who) if len(near) else 0, 512):
                    q = who[z : z + 512]
                    score = (code[q] @ vec[near].T).astype(np.float64) * size[near]
                    slack = SLACK * size[near]
                    low = score - slack
                    if len(near) > k + 1:  # the query's own vector may be among them
                        kth = np.partition(low, len(near) - k - 1, axis=1)[:, len(near) - k - 1]
                    else:
                        kth = np.full(len(q), -np.inf)
                    r, c = np.nonzero((score + slack >= np.maximum(kth, floor[q])[:, None]) & (key[i + q][:, None] != keys[near][None, :]))
                    out.append((key[i + q[r]], keys[near[c]], score[r, c], slack[c]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)


def nearest_neighbours(
    vectors: DataFrame,
    query,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    tables: int = TABLES,
    recall: float = RECALL,
    seed: int = SEED,
) -> DataFrame:
    """The k rows of largest inner product for each row that the condition `query` (of id) selects,
    as (query_id, rank, vec_id, score), the query's own row left out; ties go to the smaller id.

    Equal vectors are one candidate that stands for its smallest k + 1 ids, so that a vector that a
    third of the rows bear is hashed once. Vectors are scaled to length one within bands of length
    (powers of two); where lengths in a band differ, a coordinate is added that makes the largest
    inner product the nearest (Neyshabur and Srebro, 2015). A table's bucket is a pair of nearest
    signed axes after two pseudo-rotations, the second of fewer coordinates where there are fewer
    rows (second_axes). A query looks into the buckets that lack least to its own axes, over all
    tables of a band at once. How many these are is fitted: FIT_QUERIES queries, chosen by a hash,
    are compared with all rows, and the probes are as many as find the share `recall` of their k
    nearest.

    Buckets hold unit vectors in half precision. Candidates whose score, with its bound of error,
    can't reach the k-th best of a sample of rows or of their bucket go no further; the rest are
    merged by query and reranked exactly, in double precision. Cells of a table are dealt into
    blocks of BLOCK rows; queries stream past them. Queries that find fewer than k rows look into
    all buckets of one table, which holds all candidates.

    Vectors that are null, empty, zero, or hold a null or a number that is not finite take no part;
    nor do rows without an id. Rows meet those of their own dimension only. Rows equal in id and
    vector count once. An empty table gives no rows. Other columns are ignored, whatever their names."""
    spark = vectors.sparkSession
    store = Tables(spark, "neighbours")
    v = F.col("vec")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are equal numbers
    rows = rows.where(F.coalesce(fine, F.lit(False))).withColumn("vec", F.transform("vec", lambda x: x + 0.0)).withColumn("key", F.xxhash64("vec"))
    rows = store.save(rows, "vectors")
    salt = F.pmod(F.xxhash64("id"), F.lit(256))
    lowest = rows.select("key", "id", salt.alias("salt")).distinct()
    lowest = lowest.withColumn("r", F.row_number().over(Window.partitionBy("key", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    lowest = lowest.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    ids = store.save(lowest.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ids")
    asked = store.save(rows.where(query(F.col("id"))).select("id", "key").distinct(), "asked")

    def scale(batches):
        for batch in batches:
            for at, x in _by_size(batch, "vec"):
                unit, size, band = _scaled(x)
                yield pa.RecordBatch.from_arrays([*_columns(at, batch.column("key"), batch.column("vec")), pa.array(np.full(len(at), x.shape[1], dtype=np.int32)), pa.array(band.astype(np.int32)), pa.array(size), _lists(unit, pa.float64())], ["key", "vec", "d", "band", "size", "unit"])

    base = rows.groupBy("key").agg(F.first("vec").alias("vec")).mapInArrow(scale, "key long, vec array<double>, d int, band int, size double, unit array<double>")
    base = store.save(base, "distinct")
    store.drop(rows)
    # one row for each dimension and power of two that lengths take
    got = base.groupBy("d", "band").agg(F.min("size").alias("least"), F.max("size").alias("top"), F.count(F.lit(1)).alias("n")).collect()
    spaces = {d: Space(d, {r["band"]: (r["least"], r["top"]) for r in got if r["d"] == d}, sum(r["n"] for r in got if r["d"] == d)) for d in {r["d"] for r in got}}
    total, longest = sum(r["n"] for r in got), max((r["band"] for r in got), default=0)  # lengths below are parts of the longest band's
    spread = F.xxhash64("key", F.lit(seed))
    sample = base.orderBy(spread, "key").limit(min(FLOOR_ROWS, -(-total // FLOOR_SHARE))).select("key", "band", "size", "unit").collect() if total else []
    queries = base.join(asked.select("key").distinct(), "key", "left_semi")
    fit = queries.orderBy(spread, "key").limit(FIT_QUERIES).select("key", "unit").collect()

    def exact(batches):
        for batch in batches:
            out = []
            for at, unit in _by_size(batch, "unit"):
                mine = [r for r in fit if len(r["unit"]) == unit.shape[1]]
                if not mine:
                    continue
                size = np.ldexp(batch.column("size").to_numpy()[at], batch.column("band").to_numpy()[at] - longest)
                score = np.array([r["unit"] for r in mine]) @ unit.T * size
                key = batch.column("key").to_numpy()[at]
                score[np.array([r["key"] for r in mine])[:, None] == key] = -np.inf
                top = np.argsort(-score, axis=1)[:, :k]
                out += [(r["key"], int(key[c]), float(score[i, c])) for i, r in enumerate(mine) for c in top[i] if score[i, c] > -np.inf]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["q", "key", "score"])

    best = base.select("key", "band", "size", "unit").mapInArrow(exact, "q long, key long, score double")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))).where(F.col("r") <= k)
    best = best.join(base.select("key", "band", "size", "unit"), "key").collect()  # at most FIT_QUERIES * k rows
    units = {r["key"]: np.array([r["unit"]]) for r in fit}
    need = []
    for q, y in units.items():
        space = spaces[y.shape[1]]
        costs = {}
        for r in (r for r in best if r["q"] == q):
            if r["band"] not in costs:
                own = probe_costs(space.query(y, r["band"]), tables, space.least, seed)[0]
                costs[r["band"]] = (np.sort(own), own.reshape(tables, -1))
            ranked, own = costs[r["band"]]
            x = space.index(np.array([r["unit"]]), np.array([r["size"]]), r["band"])
            cost = min(own[t, hashes(x, t, space.least, seed)[0]] for t in range(tables))
            need.append(int(np.searchsorted(ranked, cost, side="right")))
    probes = max(1, int(np.quantile(need, recall, method="higher"))) if need else 1

    def hashed(batches):
        for batch in batches:
            for at, unit in _by_size(batch, "unit"):
                band, size = batch.column("band").to_numpy()[at], batch.column("size").to_numpy()[at]
                space = spaces[unit.shape[1]]
                h = np.zeros((len(at), tables), dtype=np.int32)
                for b in np.unique(band).tolist():
                    of = np.flatnonzero(band == b)
                    y = space.index(unit[of], size[of], b)
                    for t in range(tables):
                        h[of, t] = hashes(y, t, space.least, seed)
                wide = np.full(len(at), 2 * space.least, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*_columns(at, batch.column("key"), batch.column("d"), batch.column("band")), pa.array(np.ldexp(size, band - longest)), _bytes(unit), _lists(h, pa.int32()), pa.array(wide)], ["key", "d", "band", "size", "code", "h", "wide"])

    index = store.save(base.select("key", "d", "band", "size", "unit").mapInArrow(hashed, "key long, d int, band int, size double, code binary, h array<int>, wide int"), "index")
    floors = {d: (np.array([r["unit"] for r in part]), np.array([math.ldexp(r["size"], r["band"] - longest) for r in part]), np.array([r["key"] for r in part])) for d in spaces if (part := [r for r in sample if len(r["unit"]) == d])}

    def probed(n_tables: int, every: bool):
        names = ["key", "d", "band", "tab", "axis", "subs", "size", "code"]

        def run(batches):
            for batch in batches:
                for at, unit in _by_size(batch, "unit"):
                    d = unit.shape[1]
                    space = spaces[d]
                    key = batch.column("key").to_numpy()[at]
                    wide = 2 * space.least
                    for i in range(0, len(at), 64):
                        some, mine = unit[i : i + 64], key[i : i + 64]
                        floor = np.full(len(some), -np.inf)
                        if d in floors:
                            s, n, owner = floors[d]
                            score = np.where(owner == mine[:, None], -np.inf, some @ s.T * n)
                            if score.shape[1] >= k:
                                floor = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                        codes = _bytes(some)
                        for b in space.bands:
                            cost = probe_costs(space.query(some, b), n_tables, space.least, seed)
                            m = cost.shape[1] if every else min(probes, cost.shape[1])
                            pick = np.sort(np.argpartition(cost, m - 1, axis=1)[:, :m], axis=1)
                            cells, sub = np.divmod(pick, wide)
                            q = np.repeat(np.arange(len(some)), m)
                            cells, sub = cells.reshape(-1), sub.reshape(-1).astype(np.int16)
                            new = np.flatnonzero(np.concatenate(([True], (np.diff(cells) != 0) | (np.diff(q) != 0))))
                            tab, axis = np.divmod(cells[new], cost.shape[1] // n_tables // wide)
                            subs = pa.array([sub[x:y].tobytes() for x, y in zip(new.tolist(), [*new[1:].tolist(), len(sub)], strict=True)], pa.binary())
                            full = lambda x: pa.array(np.full(len(new), x, dtype=np.int32))  # noqa: B023, E731
                            yield pa.RecordBatch.from_arrays([pa.array(mine[q[new]]), full(d), full(b), pa.array(tab.astype(np.int32)), pa.array(axis.astype(np.int32)), subs, pa.array(floor[q[new]]), codes.take(pa.array(q[new]))], names)

        return run

    cell = ["d", "band", "tab", "axis"]

    def search(of: DataFrame, n_tables: int, every: bool) -> DataFrame:
        """(q, near): for each query vector its nearest (score, ids), best first, for k ids beside any own."""
        spots = index.select("key", "d", "band", "size", "code", "wide", F.posexplode(F.slice("h", 1, n_tables)).alias("tab", "at"))
        spots = spots.select("key", *cell[:3], F.expr("at div wide").cast("int").alias("axis"), F.expr("cast(at % wide as int)").alias("sub"), "size", "code")
        asks = base.select("key", "unit").join(of.select("key").distinct(), "key", "left_semi").mapInArrow(probed(n_tables, every), "key long, d int, band int, tab int, axis int, subs binary, size double, code binary")
        large = store.save(spots.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(*cell, F.expr(f"1 + n div {BLOCK}").alias("blocks")), "cells")
        if large.isEmpty():
            spots, asks = spots.withColumn("block", F.lit(0)), asks.withColumn("block", F.lit(0))
        else:
            blocks = F.coalesce("blocks", F.lit(1))
            spots = spots.join(large, cell, "left").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).drop("blocks")
            asks = asks.join(large, cell, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))).drop("blocks")
        both = spots.withColumn("kind", F.lit(0)).unionByName(asks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        both = both.select(*cell, "block", "kind", "key", F.coalesce("sub", F.lit(0)).alias("sub"), "subs", "size", "code")
        met = both.repartition(*cell, "block").sortWithinPartitions(*cell, "block", "kind").mapInArrow(lambda it: _search(it, k), "q long, key long, score double, slack double")
        # a pair from two tables may differ in its last bits
        met = met.groupBy("q", "key").agg(F.max("score").alias("score"), F.max("slack").alias("slack"))
        by_query = Window.partitionBy("q")
        met = met.withColumn("r", F.row_number().over(by_query.orderBy(F.desc(F.col("score") - F.col("slack")))))
        met = met.withColumn("kth", F.max(F.when(F.col("r") == k, F.col("score") - F.col("slack"))).over(by_query))
        met = met.where(F.col("kth").isNull() | (F.col("score") + F.col("slack") >= F.col("kth"))).select("q", "key")
        with_vec = met.join(base.select("key", "vec"), "key").join(base.select(F.col("key").alias("q"), F.col("vec").alias("own")), "q")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        own = of.select("key").distinct().join(base, "key").select(F.col("key").alias("q"), "key", dot("vec", "vec").alias("score"))
        scored = with_vec.select("q", "key", dot("vec", "own").alias("score")).union(own).join(ids, "key")
        scored = scored.select("q", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("vec_id")))).alias("x"))
        # part by part first, as many rows may be as near as one another
        by_part = Window.partitionBy("q", F.pmod(F.xxhash64("x.vec_id"), F.lit(16))).orderBy("x")
        scored = scored.withColumn("r", F.row_number().over(by_part)).where(F.col("r") <= k + 1)
        scored = scored.withColumn("r", F.row_number().over(by_query.orderBy("x"))).where(F.col("r") <= k + 1)
        lists = store.save(scored.groupBy(F.col("q").alias("key")).agg(F.array_sort(F.collect_list("x")).alias("near")), "near")
        near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
        return skew_join(of, lists, "key").select("id", "key", near.alias("near"))

    found = store.save(search(asked, tables, False), "found")
    short = store.save(found.where(F.size("near") < k).select("id", "key"), "short")
    if not short.isEmpty():
        found = found.where(F.size("near") >= k).union(search(short, 1, True))
    out = found.select(F.col("id").alias("query_id"), F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score"))
    return store.keep(out, "nearest")
