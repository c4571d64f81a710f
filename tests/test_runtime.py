import os

from histrata.functions import runtime
from histrata.functions.runtime import Scratch, parts_for


def files(folder):
    return len([d for d, _, f in os.walk(folder) if any(x.endswith(".parquet") for x in f)])


def test_scratch_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_folder", lambda s: f"file://{tmp_path}")
    s = Scratch(spark, "x")
    a = s.save(spark.range(5))
    b = s.save(a.where("id > 2"))
    assert b.count() == 2 and files(tmp_path) == 2
    s.release(a, None, spark.range(1))
    assert b.count() == 2 and files(tmp_path) == 1
    assert s.save(spark.range(3).where("id > 9")).count() == 0


def test_shared_folder(spark):
    class Named:
        class conf:
            @staticmethod
            def get(key, default):
                return "hdfs://x/y"

    assert runtime.shared_folder(Named) == "hdfs://x/y"
    own = runtime.shared_folder(spark)
    assert own == spark.conf.get("spark.checkpoint.dir", None) or own.startswith("file:///")


def test_parts():
    assert parts_for(0) == 1 and parts_for(200_001) == 2 and parts_for(5, 10, 8) == 8
