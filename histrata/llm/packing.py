"""Filling fixed-capacity containers with documents sized in tokens.

The plan is made over the histogram of lengths, never over documents: best fit in decreasing
length, where all items of one length and all containers with the same space left are handled in
one step. Its size depends on the capacity, not on the number of documents. Documents then take
the planned slots by joining on their rank within their length. Ranks come from counts per hash
bucket, so a length that a third of all documents share is ranked by many tasks.

An item longer than the capacity is cut into pieces of exactly the capacity and a rest.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.runtime import Scratch, parts_for

#: Production parameters: the vocabulary file, the pattern that splits texts before it, and rows per rank bucket.
VOCABULARY = os.environ.get("HISTRATA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROWS_PER_BUCKET = 20_000
#: The plan is broadcast up to this many rows and joined by shuffling beyond.
BROADCAST_RUNS = 300_000

_LOADED: dict = {}


def encoding(path: str, pattern: str = PATTERN):
    """The byte-level tokenizer of a vocabulary file and the pattern that splits texts for it, loaded once a process."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def token_counts(text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Tokens of a text; 0 for null."""

    @F.pandas_udf("bigint")
    def counted(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(vocabulary, pattern)
        for s in it:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s.tolist()], dtype="int64")

    return counted(text)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: runs (length, first rank, first container, containers, items each), and the number of containers.

    Items of rank r0 .. r0 + containers * each - 1 of a length fill a run's containers one after
    the other. Each container of a run has the same space left, so a run is a single decision.
    """
    runs, made = [], 0
    space: dict[int, list[tuple[int, int]]] = {}  # space left -> ranges of containers (first, how many)
    order: list[int] = []

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in space:
                space[left] = []
                insort(order, left)
            space[left].append((first, n))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(order, length)
            if k == len(order):
                each = capacity // length
                n = max(1, left // each)
                first, room, made = made, capacity, made + n
            else:
                room = order[k]
                each = room // length
                first, have = space[room].pop()
                n = min(have, max(1, left // each))
                if have > n:
                    space[room].append((first + n, have - n))
                elif not space[room]:
                    del space[room]
                    order.pop(k)
            each = min(each, left) if n == 1 else each
            runs.append((length, rank, first, n, each))
            rank, left = rank + n * each, left - n * each
            put(room - each * length, first, n)
    if counts.get(0):
        made = max(made, 1)
        runs.append((0, 0, 0, 1, counts[0]))
    return runs, made


def pieces(sized: DataFrame, key: str, size: str, capacities: list[tuple[int, int]]) -> DataFrame:
    """(container_id, key, piece, first_token, n_tokens) for every capacity: one row per document, or per piece of one that exceeds it."""
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("container_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in capacities]))
    rows = sized.select(F.col(key), F.col(size).alias("_n"), each.alias("_c"))
    last = F.greatest(F.lit(0), F.ceil(F.col("_n") / F.col("_c.capacity")).cast("int") - 1)
    rows = rows.select(key, "_n", "_c", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece") * F.col("_c.capacity")
    return rows.select(F.col("_c.container_id").alias("container_id"), key, "piece", start.alias("first_token"), F.least(F.col("_c.capacity"), F.col("_n") - start).alias("n_tokens"))


def pack(sized: DataFrame, capacities: list[tuple[int, int]], key: str = "doc_id", size: str = "n_tokens", rows: int | None = None) -> DataFrame:
    """(container_id, key, piece, first_token, n_tokens, container) for documents with sizes.

    ``capacities``: (container_id, capacity), a handful; a capacity below 1 is refused. Null sizes
    count as 0; items of size 0 go to container 0. Ties within a length are ordered by key and
    piece; repeated keys are packed as often as they occur. An empty table gives no rows.
    """
    if any(c is None or c < 1 for _, c in capacities):
        raise ValueError("capacities must be positive")
    scratch = Scratch(sized.sparkSession, "packing")
    sized = sized.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    items = pieces(sized, key, "_size", capacities)
    buckets = parts_for(rows if rows is not None else sized.count(), ROWS_PER_BUCKET, 8)
    items = items.withColumn("_b", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    counted = scratch.save(items.groupBy("container_id", "n_tokens", "_b").agg(F.count(F.lit(1)).alias("_k")))
    runs = []
    for i, capacity in capacities:  # at most ``capacity`` + 1 rows each
        hist = {r[0]: r[1] for r in counted.where(F.col("container_id") == i).groupBy("n_tokens").agg(F.sum("_k")).collect()}
        runs += [(i, *r) for r in plan(hist, capacity)[0]]
    planned = sized.sparkSession.createDataFrame(pd.DataFrame(runs, columns=["r_container", "r_len", "r_rank", "r_first", "r_n", "r_each"]).astype("int64"), "r_container bigint, r_len bigint, r_rank bigint, r_first bigint, r_n bigint, r_each bigint")
    if len(runs) <= BROADCAST_RUNS:
        planned = F.broadcast(planned)
    before = Window.partitionBy("container_id", "n_tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("container_id", "n_tokens", "_b", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_off")).hint("merge")  # grows with the documents: not for the driver, however small its file
    inner = Window.partitionBy("container_id", "n_tokens", "_b").orderBy(key, "piece")
    ranked = items.withColumn("_r", F.row_number().over(inner) - 1).join(offsets, ["container_id", "n_tokens", "_b"]).withColumn("_rank", F.col("_r") + F.col("_off"))
    fits = (F.col("container_id") == F.col("r_container")) & (F.col("n_tokens") == F.col("r_len")) & (F.col("_rank") >= F.col("r_rank")) & (F.col("_rank") < F.col("r_rank") + F.col("r_n") * F.col("r_each"))
    slot = F.col("r_first") + F.floor((F.col("_rank") - F.col("r_rank")) / F.col("r_each"))
    return ranked.join(planned, fits).select("container_id", key, "piece", "first_token", "n_tokens", slot.cast("bigint").alias("container"))


def pack_documents(docs: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` for documents (doc_id, text) and a table of capacities (container_id, capacity_tokens)."""
    capacities = [tuple(r) for r in containers.select("container_id", "capacity_tokens").orderBy("container_id").collect()]
    sized = Scratch(docs.sparkSession, "tokens").save(docs.select("doc_id", token_counts(F.col("text"), vocabulary).alias("n_tokens")))
    return pack(sized, capacities)


def validity(packed: DataFrame, docs: DataFrame, containers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per capacity the documents, those packed, overfull containers, documents cut though they fit, and documents whose pieces don't follow each other without gap or overlap.

    Every document has its pieces 0 .. n - 1, each beginning where the one before ends, all but the
    last as long as the capacity. Keys must be unique.
    """
    size = containers.select("container_id", F.col("capacity_tokens").cast("bigint").alias("cap"))
    full = packed.groupBy("container_id", "container").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(size), "container_id").groupBy("container_id").agg(F.sum((F.col("n") > F.col("cap")).cast("int")).alias("overfull"))
    each = packed.join(F.broadcast(size), "container_id").groupBy("container_id", key).agg(
        F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("numbers"), F.max("piece").alias("last"), F.sum("n_tokens").alias("tokens"), F.first("cap").alias("cap"),
        F.sum(((F.col("first_token") != F.col("piece") * F.col("cap")) | (F.col("n_tokens") > F.col("cap"))).cast("int")).alias("off"),
    )
    broken = (F.col("off") > 0) | (F.col("pieces") != F.col("numbers")) | (F.col("last") != F.col("pieces") - 1) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("cap"))))
    told = each.groupBy("container_id").agg(F.count(F.lit(1)).alias("packed"), F.sum(((F.col("pieces") > 1) & (F.col("tokens") <= F.col("cap"))).cast("int")).alias("needless_cuts"), F.sum(broken.cast("int")).alias("broken"))
    n = docs.agg(F.count(F.lit(1)).alias("documents"))
    return size.select("container_id").join(F.broadcast(n)).join(told, "container_id", "left").join(full, "container_id", "left").select("container_id", "documents", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("packed", "overfull", "needless_cuts", "broken")])


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per capacity: containers used, tokens packed, and the share of space unused."""
    used = packed.groupBy("container_id").agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("tokens"), F.sum((F.col("piece") > 0).cast("bigint")).alias("cuts"))
    both = used.join(F.broadcast(containers.select("container_id", "capacity_tokens")), "container_id")
    return both.select("container_id", "capacity_tokens", "n_containers", "tokens", "cuts", (1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("unused_share"))
