"""Queries over tree differences. Trees are made of line items; a commit is an order, its parent the customer's order before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import Scratch
from ..operators import treediff as D
from ..operators.tables import SQL, RepoTables

_DIFF = f"""WITH {SQL},
a AS (SELECT h.oid AS pair, t.path, t.blob FROM hist h JOIN tf t ON t.tree = h.parent), b AS (SELECT h.oid AS pair, t.path, t.blob FROM hist h JOIN tf t ON t.tree = h.oid),
d AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.path, b.path) AS path, a.blob AS from_blob, b.blob AS to_blob, CASE WHEN a.blob IS NULL THEN 'insert' WHEN b.blob IS NULL THEN 'delete' ELSE 'modify' END AS action
 FROM a FULL JOIN b ON a.pair = b.pair AND a.path = b.path WHERE a.blob IS DISTINCT FROM b.blob)"""
_STATUS = f"""WITH {SQL}, x AS (SELECT oid, parent, lag(parent) OVER (PARTITION BY branch ORDER BY ts, oid) AS grand FROM hist),
h AS (SELECT oid AS grp, t.path, t.blob FROM x JOIN tf t ON t.tree = grand), i AS (SELECT oid AS grp, t.path, t.blob FROM x JOIN tf t ON t.tree = parent WHERE grand IS NOT NULL), w AS (SELECT oid AS grp, t.path, t.blob FROM x JOIN tf t ON t.tree = oid WHERE grand IS NOT NULL),
j AS (SELECT coalesce(h.grp, i.grp, w.grp) AS grp, coalesce(h.path, i.path, w.path) AS path, h.blob AS hb, i.blob AS ib, w.blob AS wb FROM h FULL JOIN i ON h.grp = i.grp AND h.path = i.path FULL JOIN w ON w.grp = coalesce(h.grp, i.grp) AND w.path = coalesce(h.path, i.path)),
s AS (SELECT grp, path, CASE WHEN hb IS NULL AND ib IS NULL THEN '?' WHEN hb IS NULL THEN 'A' WHEN ib IS NULL THEN 'D' WHEN hb <> ib THEN 'M' ELSE ' ' END AS staging, CASE WHEN ib IS NULL AND wb IS NOT NULL THEN '?' WHEN ib IS NULL THEN ' ' WHEN wb IS NULL THEN 'D' WHEN ib <> wb THEN 'M' ELSE ' ' END AS worktree FROM j)
SELECT grp, path, staging, worktree FROM s WHERE NOT (staging = ' ' AND worktree = ' ')"""


def _diff(t):
    h = t.history
    return D.changes(h.select(F.col("oid").alias("pair"), F.col("parent").alias("from_tree"), F.col("oid").alias("to_tree")), t.tree_files)


def log_stats(spark, base):
    """The log with per-commit change counts: every order of a date range with what it changed against its parent."""
    t = RepoTables(spark, base)
    n = D.summary(_diff(t))
    h = t.history.where("ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1996-01-01'")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return h.join(n, h["oid"] == n["pair"], "left").select("branch", "oid", "ts", "message", zero("inserted"), zero("deleted"), zero("modified"))


def j4_changes(spark, base):
    return _diff(RepoTables(spark, base)).select("pair", "action", "path", "from_blob", "to_blob")


def j6_exact_renames(spark, base):
    return D.exact_renames(_diff(RepoTables(spark, base)), Scratch(spark, "renames"))


def j10_status(spark, base):
    """Three orders of a customer in a row as HEAD, index and working copy."""
    from pyspark.sql.window import Window

    t = RepoTables(spark, base)
    x = t.history.withColumn("grand", F.lag("parent").over(Window.partitionBy("branch").orderBy("ts", "oid"))).where("grand IS NOT NULL")
    f = t.tree_files
    place = lambda c: x.select(F.col("oid").alias("grp"), F.col(c).alias("tree")).join(f, "tree").select("grp", "path", "mode", "blob")
    return D.status(place("grand"), place("parent"), place("oid"))


def s34_tree_walk(spark, base):
    return D.directories(RepoTables(spark, base).tree_files)


def a7_tree_ids(spark, base):
    return D.tree_ids(RepoTables(spark, base).tree_files, Scratch(spark, "trees"))


def pr30_checks(spark, base):
    """Files of documents as one folder per repository: which entries a check refuses."""
    from pyspark.sql.window import Window

    b = RepoTables(spark, base).blobs.where("path IS NOT NULL").select(F.col("repo").alias("tree"), F.col("path").alias("name"), F.lit(33188).alias("mode"), F.col("blob_oid").alias("oid"), "doc_id")
    return D.check(b.withColumn("ord", F.row_number().over(Window.partitionBy("tree").orderBy("doc_id")))).groupBy("tree", "fault").agg(F.count(F.lit(1)).alias("n"))


def _contents(t):
    """One content per order: its files' paths and blobs as lines. Equal contents of a customer count once, by their smallest order."""
    f = t.tree_files.groupBy("tree").agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit(" "), F.substring("blob", 1, 8), F.lit("\n")))), "").alias("text"))
    h = t.history.select("oid", "branch").join(f, F.col("oid") == F.col("tree"))
    return h.groupBy(F.col("branch").alias("grp"), "text").agg(F.min("oid").alias("a")).select("grp", "a", "text")


def j9_similar_contents(spark, base):
    """Pairs of different contents of a customer's orders that share at least half their bytes in lines, as for rename detection."""
    b = _contents(RepoTables(spark, base))
    return D.similar_contents(b, b.withColumnRenamed("a", "b"), 50).where("a < b")


def j7_content_renames(spark, base):
    """Greedy one-to-one pairs of a customer's even and odd orders, taken as deleted and inserted files."""
    b = _contents(RepoTables(spark, base))
    return D.greedy_pairs(D.similar_contents(b.where("a % 2 = 0"), b.where("a % 2 = 1").withColumnRenamed("a", "b"), 60), Scratch(spark, "renames"))


def j8_name_similarity(spark, base):
    p = RepoTables(spark, base).blobs.where("path IS NOT NULL").select("repo", "path").distinct()
    from pyspark.sql.window import Window

    q = p.withColumn("other", F.lead("path").over(Window.partitionBy("repo").orderBy("path"))).where("other IS NOT NULL")
    return q.select("repo", "path", "other", D.name_similarity(F.col("path"), F.col("other")).alias("score"))


def _common(x, y):
    """SQL for the length of the common beginning of two texts."""
    same = f"list_transform(range(1, least(strlen({x}), strlen({y})) + 1), lambda k: {x}[k] = {y}[k])"
    return f"coalesce(list_position({same}, false) - 1, least(strlen({x}), strlen({y})))"


def _similarity(a, b):
    """SQL for the likeness of two paths."""
    folder, name = (lambda p: f"regexp_extract({p}, '^(.*/)[^/]*$', 1)"), (lambda p: f"regexp_extract({p}, '([^/]*)$', 1)")
    part = lambda c, x, y: f"(CASE WHEN greatest(strlen({x}), strlen({y})) = 0 THEN 100 ELSE {c} * 100 // greatest(strlen({x}), strlen({y})) END)"
    da, db, na, nb = folder(a), folder(b), name(a), name(b)
    r = lambda x: f"reverse({x})"
    return f"CAST((({part(_common(da, db), da, db)} + {part(_common(r(da), r(db)), da, db)}) * 25 + {part(_common(r(na), r(nb)), na, nb)} * 50) // 100 AS INT)"


#: SQL that takes the pairs (grp, a, b, score) of a table s by greedy choice: best score first, then a, then b.
_GREEDY = "o AS (SELECT grp, list([{'a': a, 'b': b, 'score': score}] ORDER BY score DESC, a, b) AS ps FROM s GROUP BY grp), t AS (SELECT grp, unnest(list_reduce(ps, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a = x[1].a OR y.b = x[1].b)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS p FROM o)"

QUERIES = {f.__name__: f for f in (log_stats, j4_changes, j6_exact_renames, j7_content_renames, j8_name_similarity, j9_similar_contents, j10_status, s34_tree_walk, a7_tree_ids, pr30_checks)}
_SIMILAR = f"WITH {SQL}, f AS (SELECT tree, string_agg(l, '' ORDER BY l) AS text FROM (SELECT tree, path || ' ' || substr(blob, 1, 8) || chr(10) AS l FROM tf) GROUP BY tree) , cn AS (SELECT branch AS grp, text, min(oid) AS doc_id FROM hist JOIN f ON f.tree = hist.oid GROUP BY ALL), p AS (SELECT doc_id, grp, unnest(regexp_extract_all(text, '[^\\n]{{0,63}}\\n|[^\\n]{{1,64}}')) AS p FROM cn), b AS (SELECT grp, doc_id, p, CAST(sum(strlen(p)) AS BIGINT) AS n FROM p GROUP BY ALL), z AS (SELECT grp, doc_id, sum(n) AS size FROM b GROUP BY ALL)"
ORACLE = {
    "j7_content_renames": f"{_SIMILAR}, m AS (SELECT x.grp, x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS common FROM b x JOIN b y ON x.grp = y.grp AND x.p = y.p AND x.doc_id % 2 = 0 AND y.doc_id % 2 = 1 GROUP BY ALL), s AS (SELECT m.grp, a, b, CAST(floor(common * 100 / greatest(v.size, w.size)) AS BIGINT) AS score FROM m JOIN z v ON v.grp = m.grp AND v.doc_id = a JOIN z w ON w.grp = m.grp AND w.doc_id = b WHERE floor(common * 100 / greatest(v.size, w.size)) >= 60), {_GREEDY} SELECT grp, p.a AS a, p.b AS b, p.score AS score FROM t",
    "pr30_checks": "WITH e AS (SELECT source AS tree, path AS name, blob_oid AS oid, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord FROM documents WHERE path IS NOT NULL), f AS (SELECT *, lag(hex(name)) OVER (PARTITION BY tree ORDER BY ord) AS prev, count(*) OVER (PARTITION BY tree, name) AS n FROM e), x AS (SELECT tree, unnest([CASE WHEN name = '' THEN 'empty name' END, CASE WHEN contains(name, '/') THEN 'name with separator' END, CASE WHEN n > 1 THEN 'repeated name' END, CASE WHEN prev > hex(name) THEN 'not sorted' END, CASE WHEN oid IS NULL OR regexp_matches(oid, '^0*$') THEN 'zero id' END, CASE WHEN strlen(name) > 4096 THEN 'name too long' END, CASE WHEN regexp_matches(name, '(^|/)(\\.{1,2}|[.][gG][iI][tT]|)(/|$)') THEN 'forbidden name' END]) AS fault FROM f) SELECT tree, fault, count(*) AS n FROM x WHERE fault IS NOT NULL GROUP BY 1, 2",
    "a7_tree_ids": f"WITH {SQL}, x AS (SELECT tree, split_part(path, '/', 1) AS d, string_agg(hex('100644 ' || split_part(path, '/', 2)) || '00' || blob, '' ORDER BY path) AS b FROM tf GROUP BY 1, 2), y AS (SELECT tree, d AS path, sha1(unhex(hex('tree ' || (strlen(b) // 2)) || '00' || b)) AS oid FROM x), z AS (SELECT tree, string_agg(hex('40000 ' || path) || '00' || oid, '' ORDER BY path) AS b FROM y GROUP BY tree) SELECT tree, path, oid FROM y UNION ALL SELECT tree, '', sha1(unhex(hex('tree ' || (strlen(b) // 2)) || '00' || b)) FROM z",
    "log_stats": f"{_DIFF}, n AS (SELECT pair, count(*) FILTER (WHERE action = 'insert') AS inserted, count(*) FILTER (WHERE action = 'delete') AS deleted, count(*) FILTER (WHERE action = 'modify') AS modified FROM d GROUP BY pair) SELECT branch, oid, ts, message, coalesce(inserted, 0) AS inserted, coalesce(deleted, 0) AS deleted, coalesce(modified, 0) AS modified FROM hist LEFT JOIN n ON n.pair = hist.oid WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1996-01-01'",
    "j4_changes": f"{_DIFF} SELECT pair, action, path, from_blob, to_blob FROM d",
    "j6_exact_renames": f"{_DIFF}, s AS (SELECT {{'pair': g.pair, 'blob': g.from_blob}} AS grp, g.path AS a, i.path AS b, {_similarity('g.path', 'i.path')} AS score FROM d g JOIN d i ON g.pair = i.pair AND g.from_blob = i.to_blob WHERE g.action = 'delete' AND i.action = 'insert'), {_GREEDY} SELECT grp.pair AS pair, p.a AS from_path, p.b AS to_path, grp.blob AS blob FROM t",
    "j8_name_similarity": f"SELECT repo, path, other, {_similarity('path', 'other')} AS score FROM (SELECT repo, path, lead(path) OVER (PARTITION BY repo ORDER BY path) AS other FROM (SELECT DISTINCT source AS repo, path FROM documents WHERE path IS NOT NULL)) WHERE other IS NOT NULL",
    "j10_status": _STATUS,
    "s34_tree_walk": f"WITH {SQL} SELECT tree, path, false AS is_dir FROM tf UNION SELECT tree, split_part(path, '/', 1), true FROM tf",
    "j9_similar_contents": f"WITH {SQL}, f AS (SELECT tree, string_agg(l, '' ORDER BY l) AS text FROM (SELECT tree, path || ' ' || substr(blob, 1, 8) || chr(10) AS l FROM tf) GROUP BY tree) , cn AS (SELECT branch AS grp, text, min(oid) AS doc_id FROM hist JOIN f ON f.tree = hist.oid GROUP BY ALL), p AS (SELECT doc_id, grp, unnest(regexp_extract_all(text, '[^\\n]{{0,63}}\\n|[^\\n]{{1,64}}')) AS p FROM cn), b AS (SELECT grp, doc_id, p, CAST(sum(strlen(p)) AS BIGINT) AS n FROM p GROUP BY ALL), s AS (SELECT grp, doc_id, sum(n) AS size FROM b GROUP BY ALL), m AS (SELECT x.grp, x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS common FROM b x JOIN b y ON x.grp = y.grp AND x.p = y.p AND x.doc_id < y.doc_id GROUP BY ALL) SELECT m.grp, a, b, CAST(floor(common * 100 / greatest(s.size, t.size)) AS BIGINT) AS score FROM m JOIN s ON s.grp = m.grp AND s.doc_id = a JOIN s t ON t.grp = m.grp AND t.doc_id = b WHERE floor(common * 100 / greatest(s.size, t.size)) >= 50",
}
