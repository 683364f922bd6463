"""Queries of this subpackage that SQL can express, against their SQL on the smallest tables."""

import duckdb
import pytest

from pagemill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    cols = [x[0] for x in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(str, want.fetchall()))
