import os

import duckdb
import pytest

from ridgework.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    df = queries.QUERIES[name](spark, data)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())
