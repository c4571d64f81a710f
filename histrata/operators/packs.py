"""Packs as tables: delta chains, fan-out, reverse index, window candidates, ordering and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.runtime import Scratch, clean_key
from .hierarchy import intervals, numbered

#: Deepest delta chain that readers accept, and objects a packer looks back at.
DEEPEST, WINDOW = 4095, 10


def rank_within(rows: DataFrame, group: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """``rows`` with their position (from 0) in their group by ``order``; ``bucket`` must not decrease along that order.

    Positions are counted per (group, bucket) and shifted by the buckets before, so no task sorts a whole group.
    """
    b = rows.withColumn("_b", bucket)
    n = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_k"))
    before = n.withColumn("_off", F.coalesce(F.sum("_k").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    r = b.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)) - 1)
    out = r.alias("r").join(before.alias("o"), [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*group, "_b"]])
    return out.select("r.*", (F.col("r._r") + F.col("o._off")).cast("bigint").alias(name)).drop("_b", "_r")


def entries(packs: DataFrame) -> DataFrame:
    """One row per place in a pack: the entry that arrived first there; repeated stretches count once."""
    p = packs.withColumn("oid", clean_key("oid"))
    rest = [c for c in p.columns if c not in ("pack", "pack_offset")]
    return p.groupBy("pack", "pack_offset").agg(F.min_by(F.struct(*rest), "arrival").alias("_e")).select("pack", "pack_offset", "_e.*")


def delta_bases(packs: DataFrame) -> DataFrame:
    """(arrival, base): each entry of a pack and the entry it is a delta of, by place or by id within the pack; null if it is whole or the base is elsewhere."""
    e = entries(packs)
    at = e.select("pack", F.col("pack_offset").alias("base_offset"), F.col("arrival").alias("by_place"))
    ids = e.where("oid IS NOT NULL").groupBy("pack", F.col("oid").alias("_b")).agg(F.min("arrival").alias("by_id"))
    j = e.withColumn("_b", clean_key("base_oid")).join(at, ["pack", "base_offset"], "left").join(ids, ["pack", "_b"], "left")
    return j.select("arrival", F.coalesce("by_place", "by_id").alias("base"))


def delta_depths(packs: DataFrame) -> DataFrame:
    """(arrival, depth): how many deltas lie between an entry and its whole base. Entries on circles have no depth and are left out."""
    scratch = Scratch(packs.sparkSession, "deltas")
    links = delta_bases(packs).select(F.col("arrival").cast("string").alias("node"), F.col("base").cast("string").alias("parent"))
    nodes, rows = numbered(links, "node", "parent", scratch)
    return intervals(nodes, rows, scratch).select(F.col("oid").cast("bigint").alias("arrival"), "depth")


def fan_out(packs: DataFrame) -> DataFrame:
    """(pack, byte, n, total): objects per first byte of the id, and cumulated: the table that heads an index."""
    n = entries(packs).where("oid IS NOT NULL").groupBy("pack", F.conv(F.substring("oid", 1, 2), 16, 10).cast("int").alias("byte")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("pack").orderBy("byte")))


def reverse_index(packs: DataFrame) -> DataFrame:
    """(pack, oid, pack_offset, by_id, by_offset): every entry's position in id order and in offset order."""
    e = entries(packs).where("oid IS NOT NULL").select("pack", "oid", "pack_offset")
    e = rank_within(e, ["pack"], F.substring("oid", 1, 3), ["oid", "pack_offset"], "by_id")
    return rank_within(e, ["pack"], F.shiftright("pack_offset", 14), ["pack_offset"], "by_offset")


def window_candidates(objects: DataFrame, window: int = WINDOW, block: int = 20_000) -> DataFrame:
    """For objects (oid, obj_type, obj_size): (oid, obj_type, obj_size, bases): the ids of the larger objects a packer would try as bases.

    Objects of a kind stand in falling size (ties by id); each looks back at ``window`` of them.
    Positions are cut into blocks that begin with the end of the block before.
    """
    o = objects.where("oid IS NOT NULL AND obj_size IS NOT NULL AND obj_type IN ('commit', 'tree', 'blob', 'tag')").groupBy("oid", "obj_type").agg(F.max("obj_size").alias("obj_size"))
    r = rank_within(o, ["obj_type"], -F.floor(F.log2(F.col("obj_size") + 1) * 64), [F.desc("obj_size"), "oid"], "pos")
    own = r.withColumn("block", F.floor(F.col("pos") / block)).withColumn("own", F.lit(True))
    tail = own.where(F.col("pos") % block >= block - window).withColumn("block", F.col("block") + 1).withColumn("own", F.lit(False))
    w = Window.partitionBy("obj_type", "block").orderBy("pos").rowsBetween(-window, -1)
    return own.unionByName(tail).withColumn("bases", F.collect_list("oid").over(w)).where("own").select("oid", "obj_type", "obj_size", "bases")


def repeated(packs: DataFrame) -> DataFrame:
    """(oid, n, packs): objects that were read more than once, and from how many packs."""
    p = packs.select(clean_key("oid").alias("oid"), "pack").where("oid IS NOT NULL")
    return p.groupBy("oid", "pack").agg(F.count(F.lit(1)).alias("_n")).groupBy("oid").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("packs")).where("n > 1")


def totals(packs: DataFrame) -> DataFrame:
    """(obj_type, n, bytes): grand totals by kind."""
    return packs.groupBy("obj_type").agg(F.count(F.lit(1)).alias("n"), F.sum("obj_size").alias("bytes"))


