"""The queries beside their SQL on the smallest tables, as far as those are at hand."""

import glob
import os

import duckdb
import pytest

from histrata.llm import catalog

BASE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
def test_against_sql(spark):
    con = duckdb.connect()
    for p in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    for name, sql in catalog.ORACLE.items():
        df = catalog.QUERIES[name](spark, BASE)
        cols = sorted(df.columns)
        rows = lambda d: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in d[cols].astype(object).itertuples(index=False))
        assert rows(df.toPandas()) == rows(con.execute(sql).fetchdf()), name


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
@pytest.mark.parametrize("name,columns", [("p1_found", {"sig_a", "sig_b"}), ("p3_found", {"oid"}), ("p4_found", {"arrival"}), ("p5_found", {"oid", "pii_kind"}), ("p7_found", {"doc_id", "item_id"}), ("p8_found", {"doc_id"})])
def test_columns(spark, name, columns):
    df = catalog.QUERIES[name](spark, BASE)
    assert set(df.columns) == columns and df.count() == df.distinct().count()
