"""Every query with SQL gives the same rows at the smallest scale factor."""

import duckdb
import pytest

from kmerloom.plans import catalog, more  # noqa: F401

TABLES = "part nation supplier orders lineitem documents benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(catalog.ORACLES[name])
    at = [want.columns.index(x) for x in df.columns]
    assert sorted(want.columns) == sorted(df.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in df.collect()) == key(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"kernel_t1", "svm_score"} <= set(e.queries())
