import os

import pytest

import __spark_entry__ as e


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(q) for q in e.queries().values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    assert df.count() > 0
