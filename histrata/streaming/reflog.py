"""Reference logs as a stream: late rows, repeated rows, windows, and the current state of every reference.

An extension for feeds that append; the batch operators stay the measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "repo string, ref_name string, seq bigint, old_oid string, new_oid string, committer_name string, committer_email string, committer_when timestamp, message string"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files of log rows as a stream; times are read as UTC instants."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows without repetitions, state being dropped once the watermark has passed."""
    return stream.withWatermark("committer_when", late).dropDuplicatesWithinWatermark(["repo", "ref_name", "seq"])


def per_window(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, repo, n, refs): updates and approximate number of references per window and repository."""
    w = stream.withWatermark("committer_when", late).groupBy(F.window("committer_when", width), "repo")
    return w.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("ref_name").alias("refs")).select(F.col("window.start").alias("start"), "repo", "n", "refs")


def current(stream: DataFrame) -> DataFrame:
    """(repo, ref_name, seq, oid): what each reference points to after each batch, by the highest sequence number seen."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, oid = state.get if state.exists else (-1, None)
        for pdf in batches:
            pdf = pdf[pdf["seq"] > seq]
            if len(pdf):
                top = pdf.loc[pdf["seq"].idxmax()]
                seq, oid = int(top["seq"]), top["new_oid"]
        state.update((seq, oid))
        yield pd.DataFrame([(key[0], key[1], seq, oid)], columns=["repo", "ref_name", "seq", "oid"])

    return stream.select("repo", "ref_name", "seq", "new_oid").groupBy("repo", "ref_name").applyInPandasWithState(step, "repo string, ref_name string, seq bigint, oid string", "seq bigint, oid string", "update", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Drain a stream into a memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
