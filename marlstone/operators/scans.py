"""Ordered scans within keys, and point-in-range search, without a task that holds a whole key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key that holds more than one of so many rows, and more than LEAST, is cut into parts, PARTS at
#: most; so there are fewer such keys than SHARES in any table.
SHARES, LEAST, PARTS = 200, 10000, 64


@dataclass(frozen=True)
class Scan:
    """What a scan gives each row: kind is one of row_number, sum, max, last, next, lag and lead.

    sum, max and last (not null) are over the rows before, next (the first not null) over those after,
    the row itself left out; lag and lead are the neighbours' values, null at the ends."""

    kind: str
    value: Column | None = None


def row_number() -> Scan:
    return Scan("row_number", F.lit(1))


def sum_before(value: Column) -> Scan:
    return Scan("sum", value)


def max_before(value: Column) -> Scan:
    return Scan("max", value)


def last_before(value: Column) -> Scan:
    return Scan("last", value)


def first_after(value: Column) -> Scan:
    return Scan("next", value)


def lag(value: Column) -> Scan:
    return Scan("lag", value)


def lead(value: Column) -> Scan:
    return Scan("lead", value)


def _same(left: DataFrame, keys: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & left[k].eqNullSafe(F.col(f"{prefix}{i}"))
    return out


def _bounds(df: DataFrame, keys: list[str], place: str, least: int) -> list[tuple]:
    """(key values, bounds of place) of the keys that hold more than 1 / SHARES of the rows and more than least."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counted.agg(F.sum("_n"), F.max("_n")).first()
    if not total or most <= least:
        return []
    counted = counted.where((F.col("_n") * SHARES > total) & (F.col("_n") > least))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    hot = counted.select(*named).collect()
    if not hot:
        return []
    schema = counted.select(*named).schema
    table = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in hot], schema))
    rows = df.join(table, _same(df, keys, "_k"), "left_semi")
    shares = [i / PARTS for i in range(1, PARTS)]
    got = rows.groupBy(*keys).agg(F.percentile_approx(F.col(place), shares, 1000).alias("_bounds")).collect()
    return [(*[r[k] for k in keys], sorted(set(r["_bounds"] or []))) for r in got]


def segmented(df: DataFrame, keys: list[str], order: list[str], least: int = LEAST, **scans: Scan) -> DataFrame:
    """df with a column for each scan, over the rows of equal keys in ascending order (nulls first).

    Keys of few rows are windows of their own. A key that holds more than 1 / SHARES of all rows
    and more than least is cut into parts by the values of order[0], a number; each part is a window, and what the parts
    before (or after) hand on is worked out over the parts alone, at most SHARES * PARTS rows, and
    broadcast. Rows of equal order[0] stay in one part, so rows need more order columns to be told
    apart, as in any window. Null keys are a key; an empty table stays empty."""
    spark, place = df.sparkSession, order[0]
    bounds = _bounds(df, keys, place, least)
    by_order = [F.col(c) for c in order]
    names = {n: f"_v_{n}" for n in scans}
    rows = df.withColumns({names[n]: s.value for n, s in scans.items()})
    if bounds:
        fields = ", ".join(f"_k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
        table = F.broadcast(spark.createDataFrame(bounds, f"{fields}, _bounds array<{df.schema[place].dataType.simpleString()}>"))
        rows = rows.join(table, _same(rows, keys, "_k"), "left").drop(*[f"_k{i}" for i in range(len(keys))])
        rows = rows.withColumn("_part", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(place))), F.lit(0))).withColumn("_hot", F.col("_bounds").isNotNull()).drop("_bounds")
    else:
        rows = rows.withColumns({"_part": F.lit(0), "_hot": F.lit(False)})
    # size(null) is -1 or null by Spark's settings; a cold key has one part
    rows = rows.withColumn("_part", F.when(F.col("_hot"), F.col("_part")).otherwise(F.lit(0)))
    own = Window.partitionBy(*keys, "_part").orderBy(*by_order)
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    inside = {}
    for n, s in scans.items():
        v = F.col(names[n])
        inside[n] = {"row_number": F.row_number().over(own).cast("long"), "sum": F.sum(v).over(before), "max": F.max(v).over(before), "last": F.last(v, ignorenulls=True).over(before), "next": F.first(v, ignorenulls=True).over(after), "lag": F.lag(v).over(own), "lead": F.lead(v).over(own)}[s.kind]
    done = rows.withColumns({f"_in_{n}": c for n, c in inside.items()} | {"_first": F.row_number().over(own) == 1, "_last": F.lead(F.lit(1)).over(own).isNull()})
    if not bounds:
        return done.withColumns({n: F.col(f"_in_{n}") for n in scans}).select(*df.columns, *scans)

    at = F.struct(*by_order)

    def kept(kind: str, v: Column) -> Column:
        return {"sum": F.sum(v), "row_number": F.count(F.lit(1)), "max": F.max(v), "last": F.max_by(v, F.when(v.isNotNull(), at)), "next": F.min_by(v, F.when(v.isNotNull(), at)), "lag": F.max_by(F.struct(v), at), "lead": F.min_by(F.struct(v), at)}[kind]

    parts = rows.where("_hot").groupBy(*keys, "_part").agg(*[kept(s.kind, F.col(names[n])).alias(f"_of_{n}") for n, s in scans.items()])
    along = Window.partitionBy(*keys).orderBy("_part")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    handed = {}
    for n, s in scans.items():
        v = F.col(f"_of_{n}")
        if s.kind in ("lag", "lead"):
            handed[n] = (F.lag if s.kind == "lag" else F.lead)(v).over(along).getField(names[n])
        else:
            handed[n] = {"sum": F.sum(v).over(earlier), "row_number": F.coalesce(F.sum(v).over(earlier), F.lit(0)), "max": F.max(v).over(earlier), "last": F.last(v, ignorenulls=True).over(earlier), "next": F.first(v, ignorenulls=True).over(later)}[s.kind]
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[c.alias(f"_from_{n}") for n, c in handed.items()])
    met = done.join(F.broadcast(parts), _same(done, keys, "_k") & (done["_part"] == F.col("_p")) & done["_hot"], "left")
    out = {}
    for n, s in scans.items():
        a, b = F.col(f"_in_{n}"), F.col(f"_from_{n}")
        out[n] = {"row_number": a + F.coalesce(b, F.lit(0)), "sum": F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest(a, b), "last": F.coalesce(a, b), "next": F.coalesce(a, b), "lag": F.when(F.col("_first"), b).otherwise(a), "lead": F.when(F.col("_last"), b).otherwise(a)}[s.kind]
    return met.withColumns(out).select(*df.columns, *scans)


def outside(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str = "lo", high: str = "hi", least: int = LEAST) -> DataFrame:
    """The points that lie in no range [low, high) of their keys: an interval anti join by a sweep.

    Points and ranges are events of one table in the order of place, ranges first where they start;
    a point is inside if the largest end so far exceeds its place. No pair of a point and a range is
    ever made, and a key with very many events is cut into parts (segmented). Ranges may overlap and
    be empty. Points with a null place or key stay; equal points stay as often as they are there."""
    held = points.withColumn("_row", F.struct(*points.columns))
    known = F.col(at).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    events = ranges.select(*keys, F.col(low).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col(high).cast("long").alias("_end"), F.lit(None).cast(held.schema["_row"].dataType).alias("_row")).where("_at < _end")
    marked = held.where(known).select(*keys, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), "_row")
    swept = segmented(events.unionByName(marked), keys, ["_at", "_kind"], least, _reach=max_before(F.col("_end")))
    free = swept.where((F.col("_kind") == 1) & (F.col("_reach").isNull() | (F.col("_reach") <= F.col("_at")))).select("_row.*")
    return free.unionByName(points.where(~known))
