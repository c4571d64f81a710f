"""Reachability and its relatives over commit graphs.

Plain breadth-first loops need one round per generation, several hundred here. Instead the first
parents' forest is built once (``Forest``); a start reaches all of its path to the root in one
step, and only other parents of merges start anew. Rounds are as many as merges are nested, not as
histories are deep. Where first parents run in a circle, the circle is cut above its smallest
commit, and the cut link is one more link to start anew from.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch, parts_for
from .hierarchy import BLOCK, ROWS_PER_BUCKET, circles, intervals, numbered, paths
from .tables import RepoTables


class Forest:
    """The first-parent forest of all commits: intervals and the edges that leave it."""

    def __init__(self, tables: RepoTables, stop: Column | None = None):
        """``stop``: a condition on commit columns; commits it holds of count as without parents."""
        self.scratch = Scratch(tables.spark, "forest")
        slim = tables.slim
        if stop is not None:
            slim = slim.withColumn("parents", F.when(~F.coalesce(stop, F.lit(False)), F.col("parents")))
        slim = self.scratch.save(slim)
        self.commits = slim
        links = slim.select("oid", F.get(F.col("parents"), F.lit(0)).alias("parent"))
        nodes, self.rows = numbered(links, "oid", "parent", self.scratch)
        self.endless = self.scratch.save(circles(nodes, self.scratch))
        cut = self.endless.select(F.col("cycle_oid").alias("oid")).distinct().withColumn("_cut", F.lit(True))
        nodes = self.scratch.save(nodes.join(cut, "oid", "left").select("id", "oid", F.when(F.col("_cut").isNull(), F.col("pid")).alias("pid")))
        self.placed = self.scratch.save(intervals(nodes, self.rows, self.scratch, acyclic=True))
        known = slim.select(F.col("oid").alias("parent"))
        edges = slim.select(F.col("oid").alias("child"), F.posexplode("parents").alias("ord", "parent")).where(F.col("parent").isNotNull() & (F.col("parent") != ""))
        self.edges = self.scratch.save(edges.join(known, "parent", "left_semi").select("child", "ord", "parent"))
        self.jumps = self.scratch.save(self.edges.where("ord > 0").unionByName(self.edges.where("ord = 0").join(cut.withColumnRenamed("oid", "child"), "child", "left_semi").select("child", "ord", "parent")).select("child", "parent").distinct())

    @classmethod
    def of(cls, tables: RepoTables) -> Forest:
        """The forest of these tables, built once an application for as long as the files of the commits are the same (names, sizes, times)."""
        f = tables.raw("commits").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        stamp = f.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*f.columns).cast("decimal(38,0)"))).first()
        key = (tables.spark.sparkContext.applicationId, tables.base, *stamp)
        if key not in _BUILT:
            _BUILT.clear()  # at most one is remembered
            _BUILT[key] = cls(tables)
        return _BUILT[key]

    def paths_of(self, wanted: DataFrame) -> DataFrame:
        """(oid, depth, path from the root) of the commits asked for (oid); no path of any other is made."""
        return paths(self.placed, self.rows, wanted=wanted).select("oid", "depth", "path")

    def closure(self, starts: DataFrame) -> DataFrame:
        """For starts (label, oid): (label, oid) of everything each label reaches, starts included.

        Starts that are no commit here reach nothing; repeated starts count once.
        """
        new = starts.select("label", "oid").where(F.col("oid").isNotNull()).distinct().join(self.commits.select("oid"), "oid", "left_semi").select("label", "oid")
        seen = None
        while True:
            new = self.scratch.save(new)
            up = new.join(self.paths_of(new), "oid").select("label", F.explode("path").alias("oid")).distinct()
            fresh = self.scratch.save(up if seen is None else up.join(seen, ["label", "oid"], "left_anti"))
            if fresh.isEmpty():
                return fresh if seen is None else seen
            before, seen = seen, fresh if seen is None else seen.unionByName(fresh)
            new = fresh.join(self.jumps, fresh["oid"] == self.jumps["child"]).select("label", F.col("parent").alias("oid")).distinct()
            if before is not None:
                new = new.join(seen, ["label", "oid"], "left_anti")

    def levels(self, starts: DataFrame) -> DataFrame:
        """For starts (label, oid): (label, oid, level) of everything each label reaches, with the least number of parent steps.

        A start gives levels to its whole path at once; what gets a lower level than before starts
        anew at its jumps, until nothing gets lower. Rounds are as many as a shortest way has jumps.
        """
        known = self.commits.select("oid")
        new = starts.select("label", "oid").where(F.col("oid").isNotNull()).distinct().join(known, "oid", "left_semi").select("label", "oid", F.lit(0).cast("bigint").alias("level"))
        seen = None
        while True:
            new = self.scratch.save(new)
            path = new.join(self.paths_of(new), "oid").select("label", (F.col("level") + F.col("depth")).alias("_top"), F.posexplode("path").alias("_at", "oid"))
            low = path.groupBy("label", "oid").agg(F.min(F.col("_top") - F.col("_at")).alias("level"))
            if seen is not None:
                old = seen.withColumnRenamed("level", "_old")
                low = low.join(old, ["label", "oid"], "left").where("_old IS NULL OR level < _old").select("label", "oid", "level")
            fresh = self.scratch.save(low)
            if fresh.isEmpty():
                return fresh if seen is None else seen
            if seen is None:
                seen = fresh
            else:
                seen = self.scratch.save(seen.unionByName(fresh).groupBy("label", "oid").agg(F.min("level").alias("level")))
            new = fresh.join(self.jumps, fresh["oid"] == self.jumps["child"]).groupBy("label", F.col("parent").alias("oid")).agg((F.min("level") + 1).alias("level"))

    def ancestor_max(self, values: DataFrame) -> DataFrame:
        """For values (oid, value): (oid, top), the largest value on each node's path from the root, itself included."""
        buckets = parts_for(self.rows, ROWS_PER_BUCKET, 8)
        spans = F.sequence(F.floor(F.col("entry") / BLOCK), F.floor(F.col("leave") / BLOCK))
        spread = self.placed.select("oid", "root", "entry", "leave", F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("bucket"), F.explode(spans).alias("block")).join(values, "oid")

        def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["root", "entry"], kind="stable")
            start = int(pdf["block"].iloc[0]) * BLOCK
            out, stack, tree = [], [], None
            for oid, root, entry, leave, value in zip(pdf["oid"], pdf["root"], pdf["entry"], pdf["leave"], pdf["value"]):
                if root != tree:
                    stack, tree = [], root
                while stack and stack[-1][0] < entry:
                    stack.pop()
                top = max(value, stack[-1][1]) if stack else value
                stack.append((leave, top))
                if entry >= start:
                    out.append((oid, top))
            return pd.DataFrame(out, columns=["oid", "top"])

        return spread.groupBy("bucket", "block").applyInPandas(sweep, "oid string, top bigint")

    def generations(self) -> DataFrame:
        """(oid, generation): 1 for a commit without known parents, else one more than the largest of its parents'.

        Commits on or below circles have no generation and are left out.
        """
        depth = self.scratch.save(self.placed.select("oid", "depth").join(self.endless, "oid", "left_anti"))
        others = self.edges.where("ord > 0").select("child", "parent")
        base = self.scratch.save(depth.select("oid", F.lit(1).cast("bigint").alias("base")))
        before = None
        while True:
            top = self.ancestor_max(base.join(depth, "oid").select("oid", (F.col("base") - F.col("depth")).alias("value")))
            gen = self.scratch.save(top.join(depth, "oid").select("oid", (F.col("top") + F.col("depth")).alias("generation")))
            total = gen.agg(F.sum("generation")).first()[0]
            if total == before:
                return gen
            before = total
            lift = others.join(gen, others["parent"] == gen["oid"]).groupBy("child").agg((F.max("generation") + 1).alias("lift"))
            new = self.scratch.save(base.join(lift, base["oid"] == lift["child"], "left").select("oid", F.greatest("base", F.coalesce("lift", F.lit(1))).alias("base")))
            self.scratch.release(base)
            base = new


_BUILT: dict[tuple, Forest] = {}


def reachable(tables: RepoTables, starts: DataFrame) -> DataFrame:
    """(label, oid): what each label's starts (label, oid) reach, themselves included."""
    return Forest.of(tables).closure(starts)


def is_ancestor(forest: Forest, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b): (a, b, is_ancestor), true where a is b or reachable from b."""
    reach = forest.closure(pairs.select(F.col("b").alias("label"), F.col("b").alias("oid")))
    hit = reach.select(F.col("label").alias("b"), F.col("oid").alias("a"), F.lit(True).alias("_hit"))
    return pairs.join(hit, ["a", "b"], "left").select("a", "b", F.coalesce("_hit", F.lit(False)).alias("is_ancestor"))


def merge_bases(forest: Forest, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b): (a, b, base), one row per best common ancestor; none where there is no common one.

    What a and b both reach is closed under parents, so its best members are those without a child in it.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("oid")).distinct()
    reach = forest.scratch.save(forest.closure(ends.select(F.col("oid").alias("label"), "oid")))
    x = pairs.join(reach.select(F.col("label").alias("a"), "oid"), "a")
    common = forest.scratch.save(x.join(reach.select(F.col("label").alias("b"), "oid"), ["b", "oid"]).select("a", "b", "oid"))
    inner = common.join(forest.edges, common["oid"] == forest.edges["child"]).select("a", "b", F.col("parent").alias("oid")).distinct()
    return common.join(inner, ["a", "b", "oid"], "left_anti").select("a", "b", F.col("oid").alias("base"))


def independents(forest: Forest, candidates: DataFrame) -> DataFrame:
    """For candidates (grp, oid): those not reachable from another candidate of the group."""
    c = candidates.select("grp", "oid").distinct()
    up = c.join(forest.edges, c["oid"] == forest.edges["child"]).select(F.col("grp").alias("label"), F.col("parent").alias("oid"))
    below = forest.closure(up).withColumnRenamed("label", "grp")
    return c.join(forest.commits.select("oid"), "oid", "left_semi").join(below, ["grp", "oid"], "left_anti").select("grp", "oid")


def rev_list(forest: Forest, wants: DataFrame, haves: DataFrame) -> DataFrame:
    """(label, oid): reachable from the label's wants and not from its haves."""
    return forest.closure(wants).join(forest.closure(haves), ["label", "oid"], "left_anti").select("label", "oid")


def ahead_behind(forest: Forest, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b): commits only a reaches, and only b reaches."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("oid")).distinct()
    reach = forest.scratch.save(forest.closure(ends.select(F.col("oid").alias("label"), "oid")))
    one = pairs.join(reach.select(F.col("label").alias("a"), "oid"), "a").select("a", "b", "oid", F.lit(1).alias("l"), F.lit(0).alias("r"))
    two = pairs.join(reach.select(F.col("label").alias("b"), "oid"), "b").select("a", "b", "oid", F.lit(0).alias("l"), F.lit(1).alias("r"))
    per = one.unionByName(two).groupBy("a", "b", "oid").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    found = per.groupBy("a", "b").agg(F.sum(F.when(F.col("r") == 0, 1).otherwise(0)).alias("ahead"), F.sum(F.when(F.col("l") == 0, 1).otherwise(0)).alias("behind"))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("ahead", F.lit(0)).cast("bigint").alias("ahead"), F.coalesce("behind", F.lit(0)).cast("bigint").alias("behind"))


def levels(tables: RepoTables, starts: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """(label, oid, level): the least number of parent steps from the label's starts, up to ``depth``.

    One round per level; for the few levels that depth-limited questions ask for.
    """
    edges = scratch.save(tables.edges.select("child", "parent").distinct())
    known = tables.slim.select("oid")
    new = scratch.save(starts.select("label", "oid").distinct().join(known, "oid", "left_semi").select("label", "oid", F.lit(0).alias("level")))
    seen = new
    for level in range(1, depth + 1):
        up = new.join(edges, new["oid"] == edges["child"]).select("label", F.col("parent").alias("oid")).distinct().join(known, "oid", "left_semi")
        new = scratch.save(up.join(seen.select("label", "oid"), ["label", "oid"], "left_anti").select("label", "oid", F.lit(level).alias("level")))
        if new.isEmpty():
            break
        seen = scratch.save(seen.unionByName(new))
    return seen


def shallow_boundary(tables: RepoTables, heads: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """(label, oid, shallow) of a history cut at ``depth`` commits: the last level with parents beyond it is shallow."""
    seen = levels(tables, heads, depth - 1, scratch)
    more = tables.edges.select(F.col("child").alias("oid")).distinct().withColumn("_more", F.lit(True))
    return seen.join(more, "oid", "left").select("label", "oid", (F.coalesce("_more", F.lit(False)) & (F.col("level") == depth - 1)).alias("shallow"))


def _micros(c: str):
    """A time as a number; null is the zero time."""
    return F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(0)).cast("double")


def walk(tables: RepoTables, starts: DataFrame, order: str) -> DataFrame:
    """(label, oid, ord): the walk from each label's starts in an order that is sequential by definition.

    ``order``: "dfs" (parents in order), "dfs_last_parent_first", "ctime" (newest committer time
    among discovered, ties by author time then id), "topo" (no parent before all its children,
    latest branch first), "date" (topological, newest first), "author_date". Which commits belong
    to a walk is found in the cluster; only (id, parents, two times) of one walk's commits go to
    one task, as these orders admit no other way. Plain newest-first or generation orders need no
    walk: sort by the columns.
    """
    reach = reachable(tables, starts)
    first = starts.groupBy("label").agg(F.collect_set("oid").alias("_starts"))
    rows = reach.join(tables.slim, "oid").join(first, "label").select("label", "oid", "parents", _micros("committer_when").alias("c"), _micros("author_when").alias("a"), F.array_contains("_starts", F.col("oid")).alias("start"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = ordered(dict(zip(pdf["oid"], ([p for p in (x if x is not None else [])] for x in pdf["parents"]))), dict(zip(pdf["oid"], zip(pdf["c"], pdf["a"], pdf["oid"]))), sorted(pdf["oid"][pdf["start"]]), order)
        return pd.DataFrame({"label": pdf["label"].iloc[0], "oid": out, "ord": range(len(out))})

    return rows.groupBy("label").applyInPandas(run, "label string, oid string, ord bigint")


def ordered(parents: dict[str, list[str]], key: dict[str, tuple], starts: list[str], order: str) -> list[str]:
    """The sequential orders over one walk; parents that are not in it are passed over."""
    import heapq

    up = {k: [p for p in dict.fromkeys(v) if p in parents] for k, v in parents.items()}
    seen: set[str] = set()
    out: list[str] = []
    if order in ("dfs", "dfs_last_parent_first"):
        stack = sorted(starts, key=lambda x: key[x])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                out.append(x)
                stack += [p for p in (up[x] if order != "dfs" else reversed(up[x])) if p not in seen]
        return out
    turn = lambda k: tuple((-v if isinstance(v, (int, float)) else tuple(-ord(c) for c in v)) for v in k)
    if order == "author_date":
        rank = {x: turn((k[1], k[0], k[2])) for x, k in key.items()}
    else:
        rank = {x: turn(k) for x, k in key.items()}
    if order == "ctime":
        heap = [(rank[x], x) for x in starts]
        heapq.heapify(heap)
        while heap:
            _, x = heapq.heappop(heap)
            if x not in seen:
                seen.add(x)
                out.append(x)
                for p in up[x]:
                    if p not in seen:
                        heapq.heappush(heap, (rank[p], p))
        return out
    waiting = dict.fromkeys(up, 0)
    for v in up.values():
        for p in v:
            waiting[p] += 1
    free = sorted((x for x, n in waiting.items() if not n), key=lambda x: key[x])
    if order == "topo":
        while free:
            x = free.pop()
            out.append(x)
            for p in reversed(up[x]):
                waiting[p] -= 1
                if not waiting[p]:
                    free.append(p)
        return out
    heap = [(rank[x], x) for x in free]
    heapq.heapify(heap)
    while heap:
        _, x = heapq.heappop(heap)
        out.append(x)
        for p in up[x]:
            waiting[p] -= 1
            if not waiting[p]:
                heapq.heappush(heap, (rank[p], p))
    return out


def log(tables: RepoTables, since=None, until=None, repo: str | None = None, path=None) -> DataFrame:
    """(repo, oid, committer_when, message), to be ordered by its columns: commits within limits, both inclusive.

    ``path``: a column condition over files (repo, path, added_at); a commit is listed if a file
    of its repository that meets it was added at its very committer time. Null times pass no limit.
    """
    c = tables.commits.select("repo", "oid", "committer_when", "message")
    if since is not None:
        c = c.where(F.col("committer_when") >= F.lit(since))
    if until is not None:
        c = c.where(F.col("committer_when") <= F.lit(until))
    if repo is not None:
        c = c.where(F.col("repo") == repo)
    return c
