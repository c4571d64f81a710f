"""Parent-child links to full hierarchies.

1. Circles. Whole layers are peeled off by pointer doubling: a round keeps the nodes whose 2^k-th
   ancestor exists and peels the rest. A round that peels nothing leaves exactly the nodes whose
   walk never ends. (Peeling one layer of leaves a round would take as many rounds as the deepest
   tree has levels; doubling takes the logarithm.)
2. Euler tours. Every remaining node gets an entry and an exit element; successors follow from
   first child, next sibling and parent.
3. Parallel list ranking of the tours gives entry, exit, depth and root of every node.
4. Intervals give descendants (entry between a node's entry and exit) and, swept block by block,
   the paths. A block starts with the nodes whose intervals span its beginning, so blocks of one
   huge tree are swept independently of each other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.runtime import Scratch, parts_for
from .list_ranking import list_rank

#: Euler positions per block of the path sweep, and rows per hash bucket of siblings and of small trees.
BLOCK = 8192
ROWS_PER_BUCKET = 50_000


def numbered(links: DataFrame, node: str, parent: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """(id, oid, pid): one row per distinct node, its number and its parent's; and how many there are."""
    once = links.select(F.col(node).alias("oid"), F.when(F.col(parent) != "", F.col(parent)).alias("p")).where(F.col("oid").isNotNull())
    once = scratch.save(once.groupBy("oid").agg(F.min("p").alias("p")).withColumn("id", F.monotonically_increasing_id()))
    up = once.select(F.col("oid").alias("p_oid"), F.col("id").alias("pid"))
    both = scratch.save(once.join(up, once["p"] == up["p_oid"], "left").select("id", "oid", "pid"))
    scratch.release(once)
    return both, both.count()


def endless(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id): the nodes whose walk along parents never ends."""
    going = scratch.save(nodes.where(F.col("pid").isNotNull()).select("id", F.col("pid").alias("ptr")))
    left = going.count()
    while left:
        a, b = going.alias("a"), going.alias("b")
        new = scratch.save(a.join(b, F.col("a.ptr") == F.col("b.id")).select("a.id", F.col("b.ptr").alias("ptr")))
        n = new.count()
        scratch.release(going)
        going = new
        if n == left:
            break
        left = n
    return going.select("id")


def circles(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(oid, cycle_oid) of every node that lies on a circle or leads into one; cycle_oid is the circle's smallest."""
    bad = endless(nodes, scratch)
    state = scratch.save(nodes.join(bad, "id", "left_semi").select("id", "oid", F.col("pid").alias("ptr"), F.col("oid").alias("low")))
    n, reach = state.count(), 1
    while reach < n:  # afterwards a pointer lies on the circle, and low covers a whole walk round it
        a, b = state.alias("a"), state.alias("b")
        new = scratch.save(a.join(b, F.col("a.ptr") == F.col("b.id")).select("a.id", "a.oid", F.col("b.ptr").alias("ptr"), F.least("a.low", "b.low").alias("low")))
        scratch.release(state)
        state, reach = new, 2 * reach
    a, b = state.alias("a"), state.alias("b")
    return a.join(b, F.col("a.ptr") == F.col("b.id")).select("a.oid", F.col("b.low").alias("cycle_oid"))


def _tours(nodes: DataFrame, rows: int) -> DataFrame:
    """Euler tours as (e, nxt, w): element 2*id enters a node (weight 1), 2*id+1 leaves it (-1)."""
    buckets = parts_for(rows, ROWS_PER_BUCKET)
    kids = nodes.where(F.col("pid").isNotNull()).select("id", "pid", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    inner = Window.partitionBy("pid", "bucket").orderBy("id")
    near = kids.select("id", "pid", "bucket", F.lead("id").over(inner).alias("sibling"))
    heads = kids.groupBy("pid", "bucket").agg(F.min("id").alias("head"))
    chain = heads.withColumn("then", F.lead("head").over(Window.partitionBy("pid").orderBy("bucket")))
    near = near.join(chain.select("pid", "bucket", "then"), ["pid", "bucket"]).select("id", F.coalesce("sibling", "then").alias("sibling"))
    first = chain.groupBy("pid").agg(F.min_by("head", "bucket").alias("child")).withColumnRenamed("pid", "id")
    full = nodes.select("id", "pid").join(near, "id", "left").join(first, "id", "left")
    enter, leave = 2 * F.col("id"), 2 * F.col("id") + 1
    after = F.coalesce(2 * F.col("sibling"), 2 * F.col("pid") + 1)
    pairs = F.array(F.struct(enter.alias("e"), F.coalesce(2 * F.col("child"), leave).alias("nxt"), F.lit(1).alias("w")), F.struct(leave.alias("e"), after.alias("nxt"), F.lit(-1).alias("w")))
    return full.select(F.explode(pairs).alias("x")).select("x.*")


def intervals(nodes: DataFrame, rows: int, scratch: Scratch, acyclic: bool = False) -> DataFrame:
    """(id, oid, root, entry, leave, depth, n_descendants) of every node of a tree.

    ``entry`` and ``leave`` count from 0 within the tree: d is a descendant of v if and only if
    both have the same root and v.entry < d.entry < v.leave. ``acyclic``: known to have no circles.
    """
    forest = nodes if acyclic else scratch.save(nodes.join(endless(nodes, scratch), "id", "left_anti"))
    ranked = scratch.save(list_rank(_tours(forest, rows), scratch))
    root = F.shiftright("last", 1)
    per = ranked.select(F.shiftright("e", 1).alias("id"), root.alias("root"), (F.col("e") % 2 == 0).alias("enters"), "to_end", "sum_to_end")
    both = per.groupBy("id").agg(F.first("root").alias("root"), F.max(F.when(F.col("enters"), F.col("to_end"))).alias("far"), F.max(F.when(~F.col("enters"), F.col("to_end"))).alias("near"), F.max(F.when(F.col("enters"), -F.col("sum_to_end"))).alias("depth"))
    sized = both.select("id", "root", "far", "near", "depth")
    whole = sized.where(F.col("id") == F.col("root")).select("root", F.col("far").alias("length"))
    placed = sized.join(whole, "root").select("id", "root", (F.col("length") - F.col("far")).alias("entry"), (F.col("length") - F.col("near")).alias("leave"), "depth", ((F.col("far") - F.col("near") - 1) / 2).cast("bigint").alias("n_descendants"))
    return forest.select("id", "oid").join(placed, "id")


def paths(placed: DataFrame, rows: int, block: int = BLOCK, wanted: DataFrame | None = None) -> DataFrame:
    """(oid, root_oid, depth, n_descendants, path ARRAY<STRING> from the root to the node).

    ``wanted`` (oid): only paths of these are made, and only blocks that hold one of them are swept.
    """
    buckets = parts_for(rows, ROWS_PER_BUCKET, 8)
    spans = F.sequence(F.floor(F.col("entry") / block), F.floor(F.col("leave") / block))
    spread = placed.select("oid", "root", "entry", "leave", "n_descendants", F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("bucket"), F.explode(spans).alias("block"))
    if wanted is None:
        spread = spread.withColumn("asked", F.lit(True))
    else:
        asked = wanted.select("oid").distinct().withColumn("asked", F.lit(True))
        held = placed.join(asked, "oid").select(F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("bucket"), F.floor(F.col("entry") / block).alias("block")).distinct()
        spread = spread.join(held, ["bucket", "block"], "left_semi").join(asked, "oid", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["root", "entry"], kind="stable")
        start = int(pdf["block"].iloc[0]) * block
        out, stack, tree = [], [], None
        for oid, root, entry, leave, n, asked in zip(pdf["oid"], pdf["root"], pdf["entry"], pdf["leave"], pdf["n_descendants"], pdf["asked"]):
            if root != tree:
                stack, tree = [], root
            while stack and stack[-1][1] < entry:
                stack.pop()
            stack.append((oid, leave))
            if asked and entry >= start:
                path = [x for x, _ in stack]
                out.append((oid, path[0], len(path) - 1, n, path))
        return pd.DataFrame(out, columns=["oid", "root_oid", "depth", "n_descendants", "path"])

    return spread.groupBy("bucket", "block").applyInPandas(sweep, "oid string, root_oid string, depth bigint, n_descendants bigint, path array<string>")


def hierarchy(links: DataFrame, node: str, parent: str) -> DataFrame:
    """Path, depth, root and number of descendants of every distinct node that has a root.

    Rows with a null node are left out; a parent that is null, empty or not a node makes a root.
    Repeated rows count once; of several parents given for one node the smallest holds. Nodes on
    or below circles are left out here and listed by ``find_circles``. An empty table gives an
    empty result, and columns other than the two named are not looked at.
    """
    scratch = Scratch(links.sparkSession, "hierarchy")
    nodes, rows = numbered(links, node, parent, scratch)
    return paths(scratch.save(intervals(nodes, rows, scratch)), rows)


def find_circles(links: DataFrame, node: str, parent: str) -> DataFrame:
    """(oid, cycle_oid): the nodes whose walk along parents never ends; same input rules as ``hierarchy``."""
    scratch = Scratch(links.sparkSession, "circles")
    nodes, _ = numbered(links, node, parent, scratch)
    return circles(nodes, scratch)
