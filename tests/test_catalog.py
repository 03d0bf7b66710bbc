"""Each query with SQL equals DuckDB's rows on the small tables."""

import os
from collections import Counter

import duckdb
import pytest

from marlstone import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    cols = ", ".join(f'"{c}"' for c in got.columns)
    want = duck.execute(f"SELECT {cols} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert Counter(rows) == Counter(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 281
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nfkd_of_all_code_points(spark):
    """Every code point, alone and in a text, by a class of few ranges: Java tries its members one by one."""
    import unicodedata

    from pyspark.sql import functions as F

    from marlstone.functions import scalars

    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    texts = ["a".join(points[i : i + 97]) for i in range(0, len(points), 97)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", "plain", None]], "t string")
    out = df.select("t", scalars.ascii_nfkd(F.col("t")).alias("p"))
    assert max(map(len, scalars.re.findall(r"\[\^[^\]]*\]", out._jdf.queryExecution().optimizedPlan().toString()))) < 400
    assert all(r["p"] == (None if r["t"] is None else unicodedata.normalize("NFKD", r["t"]).encode("ascii", "ignore").decode()) for r in out.collect())
