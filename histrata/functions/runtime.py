"""Session settings, table access and shared-folder scratch tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows one task should hold in operators that size their own partitions.
ROWS_PER_TASK = 200_000


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all tasks run
    in this process (tests, one machine) a temporary folder is made and removed at its end; with
    executors elsewhere an unset folder is an error, as each would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master!r} share")
    own = os.environ.get("HISTRATA_LOCAL_SCRATCH")
    if not own:
        own = tempfile.mkdtemp(prefix="histrata-")
        os.environ["HISTRATA_LOCAL_SCRATCH"] = own
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them.

    ``save`` writes and reads back, ``release`` removes what is not needed any more, and what
    remains is removed when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/histrata/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it read from there."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._histrata_scratch = path
        return back

    def release(self, *dfs: DataFrame | None) -> None:
        """Remove saved tables that no later plan reads."""
        for df in dfs:
            path = getattr(df, "_histrata_scratch", None)
            if path:
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def parts_for(rows: int, per_task: int = ROWS_PER_TASK, least: int = 1) -> int:
    """A number of partitions that follows the data."""
    return max(least, -(-rows // per_task))


def clean_key(name: str):
    """An object id by value: blanks around it dropped, hexadecimal digits in lower case."""
    return F.lower(F.regexp_replace(F.col(name), r"^[\s\x00]+|[\s\x00]+$", ""))
