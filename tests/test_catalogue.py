"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quire import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(rows):
    return sorted(tuple("NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, views, name):
    df = catalogue.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    found = views.sql(sql)
    assert sorted(found.columns) == columns
    want = views.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()
    assert plain(got) == plain(want)


def test_limited_queries_are_totally_ordered(spark):
    """A page is the same however its input is partitioned."""
    from quire.plans.query import Sort, page

    rows = spark.createDataFrame([(i, i % 3) for i in range(60)], "k long, v long")
    once = [r["k"] for r in page(rows.repartition(7), [Sort("v", True)], ["k"], 20).collect()]
    again = [r["k"] for r in page(rows.repartition(2), [Sort("v", True)], ["k"], 20).collect()]
    assert once == again
