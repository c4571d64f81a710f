"""Core queries beside their SQL on the smallest tables, as far as those are at hand."""

import glob
import os

import duckdb
import pytest

from histrata.plans.catalog import collect

BASE = "/root/testdata/sf0.001"
SLOW = {f"g{n}" for n in (2, 4, 11, 12, 13, 14, 15, 19, 20, 6, 30, 31, 35)}


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
def test_against_sql(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    queries, oracle = collect()
    assert set(oracle) <= set(queries)
    text = lambda x: "NULL" if x is None or str(x) in ("nan", "<NA>", "NaT", "None") else f"{float(x):.6g}" if isinstance(x, float) else str(x)
    for name in oracle:
        if name.split("_")[0] in SLOW:
            continue
        df = queries[name](spark, BASE)
        cols = sorted(df.columns)
        want = con.execute(oracle[name]).fetchdf()
        assert cols == sorted(want.columns), name
        rows = lambda d: sorted(tuple(map(text, r)) for r in d[cols].astype(object).itertuples(index=False))
        assert rows(df.toPandas()) == rows(want), name
