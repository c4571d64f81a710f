"""Queries over first-parent hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import table
from ..operators.hierarchy import find_circles, hierarchy

_LINKS = """
WITH RECURSIVE n AS (SELECT oid, min(CASE WHEN len(parents) > 0 AND parents[1] <> '' THEN parents[1] END) AS p FROM commits WHERE oid IS NOT NULL GROUP BY oid),
l AS (SELECT n.oid, q.oid AS p FROM n LEFT JOIN n q ON n.p = q.oid)
"""
_TREE = _LINKS + ", t AS (SELECT oid, oid AS root_oid, 0 AS depth, oid AS path FROM l WHERE p IS NULL UNION ALL SELECT l.oid, t.root_oid, t.depth + 1, t.path || '/' || l.oid FROM t JOIN l ON l.p = t.oid)"


def _first_parents(spark, base):
    return table(spark, base, "commits").select("oid", F.get(F.col("parents"), F.lit(0)).alias("parent"))


def p2_found(spark, base):
    return find_circles(_first_parents(spark, base), "oid", "parent")


def p2_hierarchy(spark, base):
    full = hierarchy(_first_parents(spark, base), "oid", "parent")
    return full.select("oid", "root_oid", "depth", "n_descendants", F.array_join("path", "/").alias("path"))


def p2_descendants(spark, base):
    full = hierarchy(_first_parents(spark, base), "oid", "parent")
    each = full.select(F.col("oid").alias("descendant_oid"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "oid"))
    return each.select("oid", "descendant_oid", (F.col("depth") - F.col("at")).alias("distance"))


QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants}
ORACLE = {
    "p2_found": _LINKS + ", r AS (SELECT oid AS a, p AS b FROM l WHERE p IS NOT NULL UNION SELECT r.a, l.p FROM r JOIN l ON r.b = l.oid WHERE l.p IS NOT NULL), c AS (SELECT a AS on_circle FROM r WHERE a = b) SELECT r.a AS oid, min(c.on_circle) AS cycle_oid FROM r JOIN c ON r.b = c.on_circle GROUP BY r.a",
    "p2_hierarchy": _TREE + ", d AS (SELECT t.path, t.oid FROM t), a AS (SELECT x.oid, count(*) - 1 AS n FROM (SELECT unnest(string_split(path, '/')) AS oid FROM d) x GROUP BY x.oid) SELECT t.oid, t.root_oid, CAST(t.depth AS BIGINT) AS depth, CAST(a.n AS BIGINT) AS n_descendants, t.path FROM t JOIN a ON a.oid = t.oid",
    "p2_descendants": _TREE + ", x AS (SELECT t.oid AS descendant_oid, t.depth, string_split(t.path, '/') AS s FROM t), y AS (SELECT descendant_oid, depth, s, unnest(range(1, depth + 1)) AS i FROM x) SELECT s[i] AS oid, descendant_oid, CAST(depth - i + 1 AS BIGINT) AS distance FROM y",
}
