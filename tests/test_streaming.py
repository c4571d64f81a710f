import datetime as dt

from histrata.streaming import reflog as L


def test_log_stream(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    row = lambda ref, seq, new, d: ("r", ref, seq, None, new, "n", None, t(d), "m")
    folder = str(tmp_path / "in")
    spark.createDataFrame([row("a", 0, "1", 0), row("a", 1, "2", 1), row("a", 1, "2", 1), row("b", 0, "9", 0)], L.SCHEMA).coalesce(1).write.parquet(folder)
    spark.createDataFrame([row("a", 2, "3", 2), row("b", 0, "9", 0), row("c", 0, "7", 9)], L.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    s = L.read(spark, folder)
    L.run_once(L.once(s), "log_once", str(tmp_path / "c1"))
    assert sorted((r["ref_name"], r["seq"]) for r in spark.table("log_once").collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0)]
    L.run_once(L.per_window(s), "log_window", str(tmp_path / "c2"), "complete")
    assert sum(r["n"] for r in spark.table("log_window").collect()) == 7
    L.run_once(L.current(s), "log_now", str(tmp_path / "c3"), "update")
    now = {}
    for r in spark.table("log_now").collect():
        now[r["ref_name"]] = max(now.get(r["ref_name"], (-1, "")), (r["seq"], r["oid"]))
    assert now == {"a": (2, "3"), "b": (0, "9"), "c": (0, "7")}
