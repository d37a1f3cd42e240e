"""Queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from chunkspark.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


def rows(frame):
    cols = sorted(frame.columns)
    out = [tuple(round(float(v), 5) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fiu" else (float(v) if isinstance(v, int) else str(v)) for v in r) for r in frame[cols].itertuples(index=False)]
    return cols, sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    want, got = con.sql(ORACLES[name]).df(), QUERIES[name](spark, D).toPandas()
    assert rows(got) == rows(want)
