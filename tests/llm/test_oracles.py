"""Queries that SQL can say, against DuckDB."""

import duckdb
import pytest

from sievedom.llm import queries

from . import cases


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from read_parquet('{cases.SMALL}/documents.parquet')")
    duck.sql(f"create view embeddings as select * from read_parquet('{cases.SMALL}/embeddings.parquet')")
    got = queries.QUERIES[name](spark, cases.SMALL)
    cols = sorted(got.columns)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())
