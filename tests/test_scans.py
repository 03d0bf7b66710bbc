"""Ordered scans and the interval anti join against plain versions, with one key of most rows."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import scans


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    out = [("hot", i // 2, i, rnd.choice([None, rnd.randrange(100)])) for i in range(3000)]
    out += [(f"k{i % 150}", i, i, rnd.choice([None, i])) for i in range(600)] + [(None, i, i, i) for i in range(40)]
    rnd.shuffle(out)
    return out


def plain(rows):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == key), key=lambda r: r[:2])
        total = top = last = None
        for i, (a, b, v) in enumerate(mine):
            before = mine[i - 1][2] if i else None
            after = mine[i + 1][2] if i + 1 < len(mine) else None
            then = next((r[2] for r in mine[i + 1 :] if r[2] is not None), None)
            out[key, a, b] = (i + 1, total, top, last, before, after, then)
            if v is not None:
                total, top, last = (total or 0) + v, max(v, top if top is not None else v), v
    return out


def test_segmented_against_a_plain_version(spark, rows):
    df = spark.createDataFrame(rows, "k string, a long, b long, v long").withColumn("_n", F.lit("kept")).drop("_n").repartition(5)
    v = F.col("v")
    got = scans.segmented(df, ["k"], ["a", "b"], 50, n=scans.row_number(), s=scans.sum_before(v), m=scans.max_before(v), last=scans.last_before(v), prev=scans.lag(v), next=scans.lead(v), then=scans.first_after(v))
    found = {(r["k"], r["a"], r["b"]): (r["n"], r["s"], r["m"], r["last"], r["prev"], r["next"], r["then"]) for r in got.collect()}
    assert found == plain(rows) and got.columns == ["k", "a", "b", "v", "n", "s", "m", "last", "prev", "next", "then"]
    assert scans.segmented(df.limit(0), ["k"], ["a", "b"], n=scans.row_number()).count() == 0


def test_a_hot_key_is_in_many_tasks(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] == "hot"], "k string, a long, b long, v long")
    parts = scans._bounds(df, ["k"], "a", 50)
    assert [r[0] for r in parts] == ["hot"] and len(parts[0][1]) > 40
    held = [sum(1 for r in rows if r[0] == "hot" and sum(b < r[1] for b in parts[0][1]) == p) for p in range(len(parts[0][1]) + 1)]
    assert max(held) < 200 and sum(held) == 3000


def test_outside_against_a_plain_version(spark):
    rnd = random.Random(2)
    points = [("big", rnd.randrange(5000), i) for i in range(2000)] + [(f"d{i % 40}", rnd.randrange(60), i) for i in range(200)] + [(None, 1, 1), ("big", None, 2), ("none", 5, 1), ("big", 7, 3), ("big", 7, 3)]
    ranges = [("big", a := rnd.randrange(5000), a + rnd.randrange(-1, 9)) for _ in range(600)] + [(f"d{i % 40}", i % 50, i % 50 + 5) for i in range(80)] + [("big", 4000, 4900), ("other", 0, 9), (None, 0, 9)]
    p = spark.createDataFrame(points, "doc string, pos long, id long").withColumn("_kind", F.lit("x"))
    r = spark.createDataFrame(ranges, "doc string, lo long, hi long")
    got = sorted(scans.outside(p.drop("_kind"), r, ["doc"], "pos", least=50).collect(), key=str)
    want = [x for x in points if x[0] is None or x[1] is None or not any(d == x[0] and a <= x[1] < b for d, a, b in ranges)]
    assert [tuple(x) for x in got] == sorted(want, key=lambda x: str(spark_row(x)))
    assert sorted(tuple(x) for x in scans.outside(p.drop("_kind"), r.limit(0), ["doc"], "pos").dropna().collect()) == sorted(x for x in points if None not in x)


def spark_row(x):
    from pyspark.sql import Row

    return Row(doc=x[0], pos=x[1], id=x[2])
