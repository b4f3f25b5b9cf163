"""Queries against their SQL, on the smallest tables."""
import math

import duckdb
import pytest

from lattica.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got = QUERIES[name](spark, DIR)
    want = c.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    flat = lambda rows: sorted(repr([None if isinstance(v, float) and math.isnan(v) else v for v in r]) for r in rows)
    assert flat(got.select(*names).collect()) == flat(want.fetchall())
