"""Queries over commit graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import Scratch
from ..operators import graph as G
from ..operators.tables import SQL, RepoTables

_KNOWN = "k AS (SELECT e.child, e.ord, e.parent FROM edges e JOIN c p ON e.parent = p.oid)"
_WITH = f"WITH RECURSIVE {SQL}, {_KNOWN}"
_HEADS = "h AS (SELECT repo, min(oid) AS a, max(oid) AS b FROM refs WHERE kind = 'hash' AND oid IN (SELECT oid FROM c) GROUP BY repo HAVING min(oid) <> max(oid))"


def _heads(t):
    """Per repository the smallest and the largest tip, a pair to compare."""
    tips = t.refs.where("kind = 'hash'").join(t.slim.select("oid"), "oid", "left_semi")
    return tips.groupBy("repo").agg(F.min("oid").alias("a"), F.max("oid").alias("b")).where("a <> b")


def _tips(t):
    return t.refs.where("kind = 'hash' AND oid IS NOT NULL").select(F.col("repo").alias("label"), "oid")


def g2_reachable(spark, base):
    t = RepoTables(spark, base)
    return G.reachable(t, _tips(t)).select(F.col("label").alias("repo"), "oid")


def g20_unreachable(spark, base):
    """Commits no ref of their repository reaches."""
    t = RepoTables(spark, base)
    return t.slim.select("repo", "oid").join(G.reachable(t, _tips(t)).withColumnRenamed("label", "repo"), ["repo", "oid"], "left_anti")


def g4_first_parents(spark, base):
    """The first-parent chain of every tip, with the distance."""
    t = RepoTables(spark, base)
    f = G.Forest.of(t)
    tips = _tips(t).select("oid").distinct().join(f.endless, "oid", "left_anti")
    return f.paths_of(tips).select(F.col("oid").alias("tip"), "depth", F.posexplode("path").alias("at", "oid")).select("tip", "oid", (F.col("depth") - F.col("at")).alias("distance"))


def g5_levels(spark, base):
    """Breadth-first levels from every repository's tips, five deep."""
    t = RepoTables(spark, base)
    return G.levels(t, _tips(t), 5, Scratch(spark, "levels")).select(F.col("label").alias("repo"), "oid", F.col("level").cast("bigint").alias("level"))


def g5_whole_levels(spark, base):
    """Breadth-first levels from every repository's tips, over the whole history."""
    t = RepoTables(spark, base)
    return G.Forest.of(t).levels(_tips(t)).select(F.col("label").alias("repo"), "oid", "level")


def g11_merge_base(spark, base):
    t = RepoTables(spark, base)
    return G.merge_bases(G.Forest.of(t), _heads(t).select("a", "b"))


def g12_is_ancestor(spark, base):
    t = RepoTables(spark, base)
    h = _heads(t)
    return G.is_ancestor(G.Forest.of(t), h.select("a", "b").unionByName(h.select(F.col("b").alias("a"), F.col("a").alias("b"))))


def g13_independents(spark, base):
    t = RepoTables(spark, base)
    return G.independents(G.Forest.of(t), _tips(t).withColumnRenamed("label", "grp")).select(F.col("grp").alias("repo"), "oid")


def g15_rev_list(spark, base):
    """What each repository's largest tip has and its smallest has not."""
    t = RepoTables(spark, base)
    h = _heads(t)
    return G.rev_list(G.Forest.of(t), h.select(F.col("repo").alias("label"), F.col("b").alias("oid")), h.select(F.col("repo").alias("label"), F.col("a").alias("oid"))).select(F.col("label").alias("repo"), "oid")


def g14_ahead_behind(spark, base):
    t = RepoTables(spark, base)
    return G.ahead_behind(G.Forest.of(t), _heads(t).select("a", "b"))


def g23_shallow(spark, base):
    t = RepoTables(spark, base)
    return G.shallow_boundary(t, _tips(t), 3, Scratch(spark, "shallow")).select(F.col("label").alias("repo"), "oid", "shallow")


def g35_generations(spark, base):
    return G.Forest.of(RepoTables(spark, base)).generations()


def g1_log(spark, base):
    t = RepoTables(spark, base)
    return G.log(t, since="2022-06-01 00:00:00", until="2023-06-30 23:59:59").select("repo", "oid", "committer_when")


def g31_date_order(spark, base):
    """A topological order, newest first, as sort columns: no parent before a child."""
    t = RepoTables(spark, base)
    return G.Forest.of(t).generations().join(t.slim, "oid").select("repo", "oid", (-F.col("generation")).alias("key1"), "committer_when")


def g6_ctime_walk(spark, base):
    t = RepoTables(spark, base)
    return G.walk(t, _tips(t), "ctime").select(F.col("label").alias("repo"), "oid", "ord")


def g30_topo_walk(spark, base):
    t = RepoTables(spark, base)
    return G.walk(t, _tips(t), "topo").select(F.col("label").alias("repo"), "oid", "ord")


def g2_dfs_walk(spark, base):
    t = RepoTables(spark, base)
    return G.walk(t, _tips(t), "dfs").select(F.col("label").alias("repo"), "oid", "ord")


def g19_tips_of(spark, base):
    """For every commit the number of tips of its repository that reach it."""
    t = RepoTables(spark, base)
    tips = t.refs.where("kind = 'hash' AND oid IS NOT NULL").select("oid").distinct()
    return G.Forest.of(t).closure(tips.select(F.col("oid").alias("label"), "oid")).groupBy("oid").agg(F.count(F.lit(1)).alias("n_tips"))


_REACH = "r AS (SELECT DISTINCT repo, oid FROM refs WHERE kind = 'hash' AND oid IN (SELECT oid FROM c) UNION SELECT r.repo, k.parent FROM r JOIN k ON r.oid = k.child)"
_PAIRS = "w AS (SELECT a AS s, a AS oid FROM h UNION SELECT b, b FROM h UNION SELECT w.s, k.parent FROM w JOIN k ON w.oid = k.child)"
_GEN = f"{_WITH}, fp AS (SELECT child, parent FROM k WHERE ord = 0), t AS (SELECT oid FROM c WHERE oid NOT IN (SELECT child FROM fp) UNION SELECT fp.child FROM t JOIN fp ON fp.parent = t.oid), r AS (SELECT oid, 1 AS g FROM t UNION SELECT k.child, r.g + 1 FROM r JOIN k ON k.parent = r.oid JOIN t ON t.oid = k.child)"
QUERIES = {f.__name__: f for f in (g1_log, g2_reachable, g2_dfs_walk, g4_first_parents, g5_levels, g5_whole_levels, g6_ctime_walk, g11_merge_base, g12_is_ancestor, g13_independents, g14_ahead_behind, g15_rev_list, g19_tips_of, g20_unreachable, g23_shallow, g30_topo_walk, g31_date_order, g35_generations)}
ORACLE = {
    "g1_log": f"WITH {SQL} SELECT repo, oid, committer_when FROM c WHERE committer_when BETWEEN TIMESTAMP '2022-06-01 00:00:00' AND TIMESTAMP '2023-06-30 23:59:59'",
    "g2_reachable": f"{_WITH}, {_REACH} SELECT repo, oid FROM r",
    "g20_unreachable": f"{_WITH}, {_REACH} SELECT c.repo, c.oid FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.repo = c.repo AND r.oid = c.oid)",
    "g5_levels": f"{_WITH}, r AS (SELECT DISTINCT repo, oid, 0 AS level FROM refs WHERE kind = 'hash' AND oid IN (SELECT oid FROM c) UNION SELECT r.repo, k.parent, r.level + 1 FROM r JOIN k ON r.oid = k.child WHERE r.level < 5) SELECT repo, oid, CAST(min(level) AS BIGINT) AS level FROM r GROUP BY repo, oid",
    "g5_whole_levels": f"{_WITH}, r(repo, oid, level) USING KEY (repo, oid) AS (SELECT DISTINCT repo, oid, CAST(0 AS BIGINT) FROM refs WHERE kind = 'hash' AND oid IN (SELECT oid FROM c) UNION SELECT DISTINCT r.repo, k.parent, r.level + 1 FROM r JOIN k ON r.oid = k.child WHERE NOT EXISTS (SELECT 1 FROM recurring.r o WHERE o.repo = r.repo AND o.oid = k.parent)) SELECT repo, oid, level FROM r",
    "g11_merge_base": f"{_WITH}, {_HEADS}, {_PAIRS}, m AS (SELECT h.a, h.b, x.oid FROM h JOIN w x ON x.s = h.a JOIN w y ON y.s = h.b AND x.oid = y.oid) SELECT a, b, oid AS base FROM m WHERE NOT EXISTS (SELECT 1 FROM m n JOIN k ON n.oid = k.child WHERE n.a = m.a AND n.b = m.b AND k.parent = m.oid)",
    "g12_is_ancestor": f"{_WITH}, {_HEADS}, {_PAIRS}, p AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h) SELECT a, b, EXISTS (SELECT 1 FROM w WHERE w.s = p.b AND w.oid = p.a) AS is_ancestor FROM p",
    "g13_independents": f"{_WITH}, q AS (SELECT DISTINCT repo, oid FROM refs WHERE kind = 'hash' AND oid IN (SELECT oid FROM c)), r AS (SELECT q.repo, k.parent AS oid FROM q JOIN k ON q.oid = k.child UNION SELECT r.repo, k.parent FROM r JOIN k ON r.oid = k.child) SELECT repo, oid FROM q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.repo = q.repo AND r.oid = q.oid)",
    "g14_ahead_behind": f"{_WITH}, {_HEADS}, {_PAIRS} SELECT a, b, (SELECT count(*) FROM w x WHERE x.s = h.a AND x.oid NOT IN (SELECT y.oid FROM w y WHERE y.s = h.b)) AS ahead, (SELECT count(*) FROM w x WHERE x.s = h.b AND x.oid NOT IN (SELECT y.oid FROM w y WHERE y.s = h.a)) AS behind FROM h",
    "g15_rev_list": f"{_WITH}, {_HEADS}, {_PAIRS} SELECT h.repo, x.oid FROM h JOIN w x ON x.s = h.b WHERE NOT EXISTS (SELECT 1 FROM w y WHERE y.s = h.a AND y.oid = x.oid)",
    "g19_tips_of": f"{_WITH}, r AS (SELECT DISTINCT oid AS s, oid FROM refs WHERE kind = 'hash' AND oid IN (SELECT oid FROM c) UNION SELECT r.s, k.parent FROM r JOIN k ON r.oid = k.child) SELECT oid, count(*) AS n_tips FROM r GROUP BY oid",
    "g4_first_parents": f"{_WITH}, q AS (SELECT DISTINCT oid FROM refs WHERE kind = 'hash' AND oid IN (SELECT oid FROM c)), fp AS (SELECT child, parent FROM k WHERE ord = 0), w AS (SELECT oid AS tip, oid, 0 AS distance FROM q UNION ALL SELECT w.tip, fp.parent, w.distance + 1 FROM w JOIN fp ON fp.child = w.oid WHERE w.distance < 1500), e AS (SELECT DISTINCT tip FROM w WHERE distance = 1500) SELECT tip, oid, CAST(distance AS BIGINT) AS distance FROM w WHERE tip NOT IN (SELECT tip FROM e)",
    "g35_generations": f"{_GEN} SELECT oid, CAST(max(g) AS BIGINT) AS generation FROM r GROUP BY oid",
    "g31_date_order": f"{_GEN} SELECT c.repo, c.oid, -CAST(max(g) AS BIGINT) AS key1, c.committer_when FROM r JOIN c ON c.oid = r.oid GROUP BY c.repo, c.oid, c.committer_when",
    "g23_shallow": f"{_WITH}, r AS (SELECT DISTINCT repo, oid, 0 AS level FROM refs WHERE kind = 'hash' AND oid IN (SELECT oid FROM c) UNION SELECT r.repo, k.parent, r.level + 1 FROM r JOIN k ON r.oid = k.child WHERE r.level < 2), m AS (SELECT repo, oid, min(level) AS level FROM r GROUP BY repo, oid) SELECT repo, oid, level = 2 AND oid IN (SELECT child FROM edges) AS shallow FROM m",
}
