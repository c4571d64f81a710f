"""Queries over packs and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import clean_key
from ..operators import config as C
from ..operators import packs as P
from ..operators.tables import RepoTables

_E = r"e AS (SELECT * FROM (SELECT pack, pack_offset, arrival, lower(regexp_replace(oid, '^\s+|\s+$', '', 'g')) AS oid, obj_type, obj_size, base_offset, lower(regexp_replace(base_oid, '^\s+|\s+$', '', 'g')) AS base_oid, row_number() OVER (PARTITION BY pack, pack_offset ORDER BY arrival) AS k FROM pack_entries) WHERE k = 1)"


def l16_delta_bases(spark, base):
    return P.delta_bases(RepoTables(spark, base).packs)


def y25_delta_depths(spark, base):
    return P.delta_depths(RepoTables(spark, base).packs)


def w6_fan_out(spark, base):
    return P.fan_out(RepoTables(spark, base).packs)


def w9_reverse_index(spark, base):
    return P.reverse_index(RepoTables(spark, base).packs)


def w2_window_candidates(spark, base):
    o = RepoTables(spark, base).packs.select(clean_key("oid").alias("oid"), "obj_type", "obj_size")
    return P.window_candidates(o).select("oid", "obj_type", F.size("bases").cast("bigint").alias("n_bases"), F.expr("get(bases, size(bases) - 1)").alias("nearest"))


def s21_repeated(spark, base):
    return P.repeated(RepoTables(spark, base).packs)


def a5_totals(spark, base):
    return P.totals(RepoTables(spark, base).packs)


def f28_remote_config(spark, base):
    return C.remote_config(RepoTables(spark, base).remotes)


def y17_remotes_back(spark, base):
    c = C.remotes_of(C.remote_config(RepoTables(spark, base).remotes))
    return c.select("repo", "name", "url", F.array_join("fetch_specs", " ").alias("specs"))


def a10_overlay(spark, base):
    """Built-in defaults under each repository's remotes: the highest scope's value of every key."""
    c = C.remote_config(RepoTables(spark, base).remotes).withColumn("subsection", F.concat_ws(":", "repo", "subsection")).drop("repo")
    low = c.where("key = 'url'").select(F.lit(0).alias("scope"), "section", "subsection", F.explode(F.array(F.lit("url"), F.lit("prune"))).alias("key"), "ord", F.lit("default").alias("value"))
    return C.get(C.merge(c.unionByName(low)))


QUERIES = {f.__name__: f for f in (l16_delta_bases, y25_delta_depths, w6_fan_out, w9_reverse_index, w2_window_candidates, s21_repeated, a5_totals, f28_remote_config, y17_remotes_back, a10_overlay)}
ORACLE = {
    "l16_delta_bases": f"WITH {_E}, i AS (SELECT pack, oid, min(arrival) AS a FROM e WHERE oid IS NOT NULL GROUP BY 1, 2) SELECT e.arrival, coalesce(p.arrival, i.a) AS base FROM e LEFT JOIN e p ON p.pack = e.pack AND p.pack_offset = e.base_offset LEFT JOIN i ON i.pack = e.pack AND i.oid = e.base_oid",
    "y25_delta_depths": f"WITH RECURSIVE {_E}, i AS (SELECT pack, oid, min(arrival) AS a FROM e WHERE oid IS NOT NULL GROUP BY 1, 2), b AS (SELECT e.arrival, coalesce(p.arrival, i.a) AS base FROM e LEFT JOIN e p ON p.pack = e.pack AND p.pack_offset = e.base_offset LEFT JOIN i ON i.pack = e.pack AND i.oid = e.base_oid), d AS (SELECT arrival, 0 AS depth FROM b WHERE base IS NULL UNION ALL SELECT b.arrival, d.depth + 1 FROM b JOIN d ON b.base = d.arrival) SELECT arrival, CAST(depth AS BIGINT) AS depth FROM d",
    "w6_fan_out": f"WITH {_E}, n AS (SELECT pack, CAST('0x' || substr(oid, 1, 2) AS INT) AS byte, count(*) AS n FROM e WHERE oid IS NOT NULL GROUP BY 1, 2) SELECT pack, byte, n, CAST(sum(n) OVER (PARTITION BY pack ORDER BY byte) AS BIGINT) AS total FROM n",
    "w9_reverse_index": f"WITH {_E} SELECT pack, oid, pack_offset, row_number() OVER (PARTITION BY pack ORDER BY oid, pack_offset) - 1 AS by_id, row_number() OVER (PARTITION BY pack ORDER BY pack_offset) - 1 AS by_offset FROM e WHERE oid IS NOT NULL",
    "w2_window_candidates": r"WITH o AS (SELECT lower(regexp_replace(oid, '^\s+|\s+$', '', 'g')) AS oid, obj_type, max(obj_size) AS obj_size FROM pack_entries WHERE oid IS NOT NULL AND obj_size IS NOT NULL AND obj_type IN ('commit', 'tree', 'blob', 'tag') GROUP BY 1, 2), w AS (SELECT *, row_number() OVER x AS k, lag(oid) OVER x AS nearest FROM o WINDOW x AS (PARTITION BY obj_type ORDER BY obj_size DESC, oid)) SELECT oid, obj_type, CAST(least(k - 1, 10) AS BIGINT) AS n_bases, nearest FROM w",
    "s21_repeated": r"SELECT lower(regexp_replace(oid, '^\s+|\s+$', '', 'g')) AS oid, count(*) AS n, count(DISTINCT pack) AS packs FROM pack_entries WHERE oid IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "a5_totals": "SELECT obj_type, count(*) AS n, CAST(sum(obj_size) AS BIGINT) AS bytes FROM pack_entries GROUP BY obj_type",
    "f28_remote_config": "SELECT repo, 1 AS scope, 'remote' AS section, name AS subsection, 'url' AS key, 0 AS ord, url AS value FROM remotes UNION ALL SELECT repo, 1, 'remote', name, 'fetch', unnest(range(1, len(fetch_specs) + 1)), unnest(fetch_specs) FROM remotes",
    "y17_remotes_back": "SELECT repo, name, url, coalesce(array_to_string(fetch_specs, ' '), '') AS specs FROM remotes",
    "a10_overlay": "WITH c AS (SELECT repo || ':' || name AS subsection, url, fetch_specs FROM remotes) SELECT 'remote' AS section, subsection, 'url' AS key, coalesce(nullif(url, ''), 'default') AS value FROM c UNION ALL SELECT 'remote', subsection, 'prune', 'default' FROM c UNION ALL SELECT 'remote', subsection, 'fetch', list_filter(fetch_specs, lambda x: x IS NOT NULL AND x <> '')[-1] FROM c WHERE len(list_filter(fetch_specs, lambda x: x IS NOT NULL AND x <> '')) > 0",
}
