import os

import duckdb
import pytest

import __spark_entry__ as entry
from ridgework.plans import catalogue


def rows(names, values):
    return sorted(repr(tuple(None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in values)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, data, con, name):
    df = catalogue.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = rows(cols, (tuple(r) for r in df.select(*cols).collect()))
    cur = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == rows(cols, (tuple(r[i] for i in at) for r in cur.fetchall()))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, data, name):
    catalogue.QUERIES[name](spark, data).count()


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
