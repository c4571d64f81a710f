"""Queries over set operations and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import Scratch
from ..operators import graph as G
from ..operators import plans as P
from ..operators.tables import SQL, RepoTables
from .treediff import _DIFF, _diff

QUERIES, ORACLE = {}, {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_TIP = "SELECT DISTINCT repo AS label, oid FROM refs WHERE kind = 'hash' AND oid IN (SELECT oid FROM c)"
_KNOWN = "k AS (SELECT e.child, e.ord, e.parent FROM edges e JOIN c p ON e.parent = p.oid)"


def _tips(t):
    return t.refs.where("kind = 'hash' AND oid IS NOT NULL").select(F.col("repo").alias("label"), "oid")


@q("SELECT oid, arrival FROM (SELECT arrival, lower(regexp_replace(oid, '\\s', '', 'g')) AS oid FROM pack_entries) WHERE oid IS NOT NULL AND oid NOT IN (SELECT oid FROM haves)")
def u1_difference(spark, base):
    t = RepoTables(spark, base)
    p = t.packs.select(F.lower(F.regexp_replace("oid", r"\s", "")).alias("oid"), "arrival").where("oid IS NOT NULL")
    return P.difference(p, t.raw("haves"))


@q("SELECT doc_id, blob_oid AS oid, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE strlen(text) < 512")
def pr35_object_filter(spark, base):
    b = RepoTables(spark, base).blobs.select("doc_id", F.col("blob_oid").alias("oid"), F.lit("blob").alias("type"), "size", F.lit(1).alias("depth"))
    return P.object_filter(b, "combine:blob:limit=512+object:type=blob").select("doc_id", "oid", "size")


@q(f"WITH RECURSIVE {SQL}, {_KNOWN}, r AS (SELECT label, oid, 0 AS level FROM ({_TIP}) UNION SELECT r.label, k.parent, r.level + 1 FROM r JOIN k ON r.oid = k.child JOIN c ON c.oid = r.oid WHERE r.level < 4 AND c.committer_when >= TIMESTAMP '2022-06-01') SELECT r.label AS repo, r.oid, CAST(min(level) AS BIGINT) AS level FROM r JOIN c ON c.oid = r.oid WHERE len(c.parents) = 1 GROUP BY 1, 2")
def g7_filtered_levels(spark, base):
    """Commits with one parent, not going beyond commits before June 2022, four levels deep."""
    t = RepoTables(spark, base)
    got = P.filtered_levels(t, _tips(t), F.size("parents") == 1, F.col("committer_when") < F.lit("2022-06-01 00:00:00").cast("timestamp_ntz"), 4, Scratch(spark, "levels"))
    return got.select(F.col("label").alias("repo"), "oid", F.col("level").cast("bigint").alias("level"))


@q(f"WITH RECURSIVE {SQL}, {_KNOWN}, r(label, oid, level) USING KEY (label, oid) AS (SELECT label, oid, CAST(0 AS BIGINT) FROM ({_TIP}) UNION SELECT DISTINCT r.label, k.parent, r.level + 1 FROM r JOIN k ON r.oid = k.child JOIN c ON c.oid = r.oid WHERE c.committer_when >= TIMESTAMP '2022-06-01' AND NOT EXISTS (SELECT 1 FROM recurring.r o WHERE o.label = r.label AND o.oid = k.parent)) SELECT r.label AS repo, r.oid, r.level FROM r JOIN c ON c.oid = r.oid WHERE len(c.parents) = 1")
def g7_whole_filtered_levels(spark, base):
    """Commits with one parent, not going beyond commits before June 2022, over the whole history."""
    t = RepoTables(spark, base)
    got = P.whole_filtered_levels(t, _tips(t), F.size("parents") == 1, F.col("committer_when") < F.lit("2022-06-01 00:00:00").cast("timestamp_ntz"))
    return got.select(F.col("label").alias("repo"), "oid", "level")


@q(f"{_DIFF} SELECT DISTINCT h.branch, h.oid FROM hist h JOIN d ON d.pair = h.oid WHERE d.path = 's0/p0'")
def g10_path_log(spark, base):
    t = RepoTables(spark, base)
    return P.object_path_log(t.history.select("oid", "branch"), _diff(t), F.col("path") == "s0/p0").select("branch", "oid")


@q(f"{_DIFF} SELECT DISTINCT h.branch, h.oid FROM hist h JOIN d ON d.pair = h.oid WHERE regexp_matches(d.path, '^s1/')")
def g9_path_filter_log(spark, base):
    t = RepoTables(spark, base)
    return P.object_path_log(t.history.select("oid", "branch"), _diff(t), F.col("path").rlike("^s1/")).select("branch", "oid")


@q(f"WITH {SQL} SELECT tf.tree, tf.path, tf.blob FROM tf JOIN hist h ON h.oid = tf.tree WHERE NOT EXISTS (SELECT 1 FROM tf o WHERE o.tree = h.parent AND o.path = tf.path AND o.blob = tf.blob)")
def g17_new_objects(spark, base):
    t = RepoTables(spark, base)
    return P.new_objects(t.tree_files, t.history.select(F.col("oid").alias("tree"), "parent"))


@q(f"WITH {SQL}, f AS (SELECT DISTINCT lower(regexp_replace(oid, '\\s', '', 'g')) AS oid FROM pack_entries WHERE oid IS NOT NULL AND scanned_at < TIMESTAMP '2022-06-01') SELECT c.oid FROM c JOIN f ON f.oid = c.oid WHERE c.oid NOT IN (SELECT parent FROM edges) AND c.oid NOT IN (SELECT oid FROM refs WHERE oid IS NOT NULL)")
def g21_prune_candidates(spark, base):
    """Packed commits seen before a date that nothing points to directly."""
    t = RepoTables(spark, base)
    f = t.packs.where("oid IS NOT NULL AND scanned_at < TIMESTAMP_NTZ '2022-06-01 00:00:00'").select(F.lower(F.regexp_replace("oid", r"\s", "")).alias("oid")).distinct()
    own = t.slim.select("oid").join(f, "oid", "left_semi")
    return P.difference(P.difference(own, t.edges.select(F.col("parent").alias("oid"))), t.refs.select("oid"))


@q(f"WITH RECURSIVE {SQL}, {_KNOWN}, r AS ({_TIP} UNION SELECT r.label, k.parent FROM r JOIN k ON r.oid = k.child), i AS (SELECT r.label, r.oid FROM r JOIN c ON c.oid = r.oid WHERE c.committer_when >= TIMESTAMP '2023-01-01') SELECT label AS repo, oid, EXISTS (SELECT 1 FROM edges e WHERE e.child = i.oid AND NOT EXISTS (SELECT 1 FROM i j WHERE j.label = i.label AND j.oid = e.parent)) AS shallow FROM i")
def g24_boundary_by_date(spark, base):
    t = RepoTables(spark, base)
    return P.boundary_by_date(t, G.reachable(t, _tips(t)), "2023-01-01 00:00:00").select(F.col("label").alias("repo"), "oid", "shallow")


@q(f"WITH RECURSIVE {SQL}, {_KNOWN}, fp AS (SELECT child, parent FROM k WHERE ord = 0), q AS (SELECT DISTINCT oid FROM refs WHERE kind = 'hash' AND oid IN (SELECT oid FROM c)), w AS (SELECT oid AS tip, oid, 0 AS distance FROM q UNION ALL SELECT w.tip, fp.parent, w.distance + 1 FROM w JOIN fp ON fp.child = w.oid WHERE w.distance < 1500), e AS (SELECT DISTINCT tip FROM w WHERE distance = 1500) SELECT r.repo, r.name, w.oid FROM refs r JOIN w ON w.tip = r.oid WHERE r.kind = 'hash' AND w.distance < 100 AND w.tip NOT IN (SELECT tip FROM e)")
def g27_newest_haves(spark, base):
    t = RepoTables(spark, base)
    f = G.Forest.of(t)
    return P.newest_haves(f, t.refs.where("kind = 'hash'").select("repo", "name", "oid").join(f.endless, "oid", "left_anti").select("repo", "name", "oid"))


@q(f"WITH RECURSIVE {SQL}, {_KNOWN}, o0 AS (SELECT repo, ref_name AS dst, max(seq) AS s FROM rl GROUP BY 1, 2), o AS (SELECT o0.repo, o0.dst, min(rl.old_oid) AS old_oid FROM o0 JOIN rl ON rl.repo = o0.repo AND rl.ref_name = o0.dst AND rl.seq = o0.s GROUP BY 1, 2), f AS (SELECT r.repo, r.name AS dst, r.oid AS new_oid, o.old_oid FROM refs r LEFT JOIN o ON o.repo = r.repo AND o.dst = r.name WHERE r.kind = 'hash' AND r.oid IS DISTINCT FROM o.old_oid), w AS (SELECT DISTINCT new_oid AS s, new_oid AS oid FROM f WHERE new_oid IN (SELECT oid FROM c) UNION SELECT w.s, k.parent FROM w JOIN k ON w.oid = k.child) SELECT repo, dst, old_oid, new_oid, CASE WHEN old_oid IS NULL THEN 'new' WHEN dst NOT LIKE 'refs/tags/%' AND EXISTS (SELECT 1 FROM w WHERE w.s = f.new_oid AND w.oid = f.old_oid) THEN 'fast-forward' ELSE 'rejected' END AS action FROM f")
def u10_fetch_plan(spark, base):
    """Taking each reference from what its log says before to what it is now."""
    t = RepoTables(spark, base)
    old = t.reflog.groupBy("repo", F.col("ref_name").alias("name")).agg(F.max_by("old_oid", "seq").alias("oid"))
    new = t.refs.where("kind = 'hash'").select("repo", F.col("name").alias("dst"), "oid", F.lit(False).alias("force"))
    pairs = new.join(old.select("repo", F.col("name").alias("dst"), F.col("oid").alias("a")), ["repo", "dst"]).where("a IS NOT NULL").select("a", F.col("oid").alias("b")).distinct()
    return P.fetch_plan(old, new, G.is_ancestor(G.Forest.of(t), pairs))


@q("SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY name) - 1 AS ord, oid || chr(9) || name AS line FROM refs WHERE oid IS NOT NULL")
def f37_info_refs(spark, base):
    return P.info_refs(RepoTables(spark, base).refs)


@q("SELECT repo, name, oid, target FROM refs WHERE name LIKE 'refs/heads/%' OR name = 'HEAD'")
def pr37_list_refs(spark, base):
    return P.list_refs(RepoTables(spark, base).refs, ["refs/heads/", "HEAD"]).select("repo", "name", "oid", "target")


@q("SELECT repo, name, unnest(list_filter([CASE WHEN coalesce(name, '') = '' THEN 'no name' END, CASE WHEN coalesce(url, '') = '' THEN 'no address' END, CASE WHEN len(list_filter(coalesce(fetch_specs, []), lambda s: NOT regexp_matches(coalesce(s, ''), '^[+]?([^:*]*:[^:*]+|[^:*]*[*][^:*]*:[^:*]*[*][^:*]*)$'))) > 0 THEN 'bad fetch spec' END], lambda x: x IS NOT NULL)) AS fault FROM remotes")
def l22_violations(spark, base):
    return P.violations(RepoTables(spark, base).remotes)


@q(f"{_DIFF} SELECT pair AS grp, path, action, to_blob AS blob FROM d")
def j14_pick(spark, base):
    """Putting every order's tree over its parent's."""
    t = RepoTables(spark, base)
    f = t.tree_files
    h = t.history
    side = lambda c: h.select(F.col("oid").alias("grp"), F.col(c).alias("tree")).join(f, "tree").select("grp", "path", "blob")
    return P.pick(side("parent"), side("oid"))
