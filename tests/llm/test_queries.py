import glob
import math
import os

import duckdb
import pytest

from cytora.llm import queries

COLUMNS = {
    "p1_found": [("event_id", "bigint"), ("cluster_id", "bigint")],
    "p4_found": [("vec_a", "bigint"), ("vec_b", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p9_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(name, spark, small):
    df = queries.QUERIES[name](spark, small)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark, small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, small).toPandas(), c.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda r: [str(v) for v in r]
    a, b = (sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).to_numpy().tolist()), key=key) for df in (got, want))
    assert len(a) == len(b)
    assert all(u == v or math.isclose(float(u), float(v), rel_tol=1e-9) for x, y in zip(a, b) for u, v in zip(x, y))
