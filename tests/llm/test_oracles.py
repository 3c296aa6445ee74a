"""The queries of this subpackage that SQL can express, against DuckDB on small whole tables."""

import os

import duckdb
import pytest

from skillweave.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_rows(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = c.execute(oracles.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(dict(zip(names, row, strict=True))[k] for k in columns) for row in found.fetchall())
    assert sorted(tuple(r[k] for k in columns) for r in df.collect()) == want
