"""Parallel list ranking: position, weighted sum and last element for every element of linked lists.

A sparse ruling set is drawn by hash. Elements double their pointers only until they meet a ruler,
which takes about log2(rulers' spacing x ln n) rounds over rapidly shrinking sets; the rulers alone,
n / SPACING rows, are then ranked by full doubling; one join hands the results back. No list is
ever held by one task, so a single list may hold all elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch

#: One element in SPACING is a ruler.
SPACING = 16


def _ruler(c: str) -> Column:
    return F.pmod(F.xxhash64(F.col(c)), F.lit(SPACING)) == 0


def _double(state: DataFrame, scratch: Scratch, going: Column) -> DataFrame:
    """Double pointers of rows with ``going`` until there is none; ``state``: (e, ptr, d, w, z)."""
    while not state.where(going).isEmpty():
        left = state.where(going).alias("a")
        step = left.join(state.alias("b"), F.col("a.ptr") == F.col("b.e")).select("a.e", F.col("b.ptr").alias("ptr"), (F.col("a.d") + F.col("b.d")).alias("d"), (F.col("a.w") + F.col("b.w")).alias("w"), F.col("b.z").alias("z"))
        new = scratch.save(state.where(~going).unionByName(step))
        scratch.release(state)
        state = new
    return state


def list_rank(links: DataFrame, scratch: Scratch) -> DataFrame:
    """For ``links`` (e BIGINT unique, nxt BIGINT or null, w BIGINT): (e, to_end, sum_to_end, last).

    ``to_end`` counts the elements from e to the end of its list, e included; ``sum_to_end`` adds
    their weights; ``last`` is the end. Lists must end: ``nxt`` null, and no element twice. An
    empty input gives an empty result.
    """
    state = scratch.save(links.select("e", F.col("nxt").alias("ptr"), F.lit(1).cast("bigint").alias("d"), F.col("w").cast("bigint").alias("w"), F.col("e").alias("z")))
    state = _double(state, scratch, F.col("ptr").isNotNull() & ~_ruler("ptr"))
    rulers = scratch.save(state.where(_ruler("e")))
    rulers = _double(rulers, scratch, F.col("ptr").isNotNull())
    return state.alias("a").join(rulers.alias("b"), F.col("a.ptr") == F.col("b.e"), "left").select(
        "a.e", (F.col("a.d") + F.coalesce("b.d", F.lit(0))).alias("to_end"), (F.col("a.w") + F.coalesce("b.w", F.lit(0))).alias("sum_to_end"), F.coalesce("b.z", "a.z").alias("last")
    )
