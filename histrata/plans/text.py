"""Queries over contents: search, line differences, blame, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import text as X
from ..operators.tables import SQL, RepoTables

_CONTENT = f"WITH {SQL}, f AS (SELECT tree, path || ' ' || substr(blob, 1, 8) AS l FROM tf), o AS (SELECT h.oid AS pair, l FROM hist h JOIN f ON f.tree = h.parent), n AS (SELECT h.oid AS pair, l FROM hist h JOIN f ON f.tree = h.oid)"
IGNORE = "*.log\n!keep.log\n/build/\ncmd/*\n!cmd/main.*\ndocs/**/draft*\n**/*_test.go\ntemp?/\n[a-c]*/cache_*\n"
ATTRIBUTES = "* text=auto\n*.go text diff=go\n*.png binary\ndocs/* -diff\n*.md text eol=lf !diff\n"


def _texts(t):
    """One content per order: its files' paths and blobs as lines, in order."""
    return t.tree_files.groupBy(F.col("tree").alias("oid")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit(" "), F.substring("blob", 1, 8), F.lit("\n")))), "").alias("text"))


def _versions(t):
    x = _texts(t)
    h = t.history.select("oid", "parent")
    return h.join(x, "oid", "left").join(x.select(F.col("oid").alias("parent"), F.col("text").alias("before")), "parent", "left")


def l7_grep(spark, base):
    b = RepoTables(spark, base).blobs.where("path IS NOT NULL").select("repo", "path", "doc_id", "text")
    return X.grep(b, [r"orphaned [a-z]+ block", r"^\* .*saves \d+ KB"], [r"\.(go|md|txt)$", r"^docs/"])


def l7_grep_invert(spark, base):
    b = RepoTables(spark, base).blobs.select("doc_id", "path", "text")
    return X.grep(b, [r"[a-z]"], invert=True).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def s_lines(spark, base):
    """Lines per document; a final line break makes no empty last line."""
    from ..functions.objects import lines

    return RepoTables(spark, base).blobs.select("doc_id", F.size(lines(F.col("text"))).cast("bigint").alias("n_lines"))


def a1_stats(spark, base):
    """Added and deleted lines of every order's content against its parent's."""
    v = _versions(RepoTables(spark, base))
    return v.select(F.col("oid").alias("pair"), X.line_stats(F.col("before"), F.col("text")).alias("s")).select("pair", "s.addition", "s.deletion")


def l1_reconstruct(spark, base):
    """Both sides of every difference put together again."""
    v = _versions(RepoTables(spark, base)).withColumn("c", X.diff_chunks(F.col("before"), F.col("text")))
    return v.select(F.col("oid").alias("pair"), (X.side(F.col("c"), "old") == F.coalesce("before", F.lit(""))).alias("old_ok"), (X.side(F.col("c"), "new") == F.coalesce("text", F.lit(""))).alias("new_ok"))


def f38_unified(spark, base):
    v = _versions(RepoTables(spark, base)).where("before IS NOT NULL AND text IS NOT NULL")
    return v.select(F.col("oid").alias("pair"), X.unified_text(F.col("before"), F.col("text"), F.lit("a/f"), F.lit("b/f")).alias("patch"))


def l3_blame(spark, base):
    t = RepoTables(spark, base)
    h = t.history
    return X.blame(_texts(t).withColumnRenamed("oid", "ver"), h.select(F.col("oid").alias("ver"), F.lit(0).alias("ord"), "parent"))


def pr23_ignored(spark, base):
    p = RepoTables(spark, base).blobs.where("path IS NOT NULL").select("path").distinct()
    return p.select("path", R.ignored(F.col("path"), R.parse_ignores(IGNORE)).alias("ignored"))


def pr25_attributes(spark, base):
    rules = R.parse_attributes(ATTRIBUTES)
    p = RepoTables(spark, base).blobs.where("path IS NOT NULL").select("path").distinct()
    return p.select("path", *[R.attribute(F.col("path"), n, rules).alias(n) for n in ("text", "diff", "eol")])


def pr28_sparse(spark, base):
    p = RepoTables(spark, base).blobs.where("path IS NOT NULL").select("repo", "path", "doc_id")
    return R.sparse(p, ["docs/", "cmd/", "core/"])


#: For each rule of IGNORE a regular expression over a path or a folder above it ("/" after it); the last one that matches decides at each level.
_IGNORED = (("(^|/)[^/]*[.]log$", True), ("(^|/)keep[.]log$", False), ("^build$", True), ("^cmd/[^/]*$", True), ("^cmd/main[.][^/]*$", False), ("^docs/(.*/)?draft[^/]*$", True), ("^(.*/)?[^/]*_test[.]go$", True), ("(^|/)temp[^/]$", True), ("^[a-c][^/]*/cache_[^/]*$", True))
_FOLDERS = ("^build$", "(^|/)temp[^/]$")
_VERDICT = "CASE " + " ".join(f"WHEN {'folder AND ' if r in _FOLDERS else ''}regexp_matches(prefix, '{r}') THEN {str(v).lower()}" for r, v in reversed(_IGNORED)) + " ELSE false END"
QUERIES = {f.__name__: f for f in (l7_grep, l7_grep_invert, s_lines, a1_stats, l1_reconstruct, f38_unified, l3_blame, pr23_ignored, pr25_attributes, pr28_sparse)}
ORACLE = {
    "pr23_ignored": f"WITH p AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL), x AS (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM p), y AS (SELECT path, array_to_string(string_split(path, '/')[1:k], '/') AS prefix, k < len(string_split(path, '/')) AS folder FROM x) SELECT path, bool_or({_VERDICT}) AS ignored FROM y GROUP BY path",
    "l7_grep": r"SELECT repo, path, doc_id, line_no, content FROM (SELECT source AS repo, path, doc_id, unnest(string_split(text, chr(10))) AS content, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_no FROM documents WHERE path IS NOT NULL AND (regexp_matches(path, '\.(go|md|txt)$') OR regexp_matches(path, '^docs/'))) WHERE regexp_matches(content, 'orphaned [a-z]+ block') OR regexp_matches(content, '^\* .*saves \d+ KB')",
    "l7_grep_invert": "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents) WHERE NOT regexp_matches(content, '[a-z]') GROUP BY doc_id",
    "s_lines": "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - (CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END) END AS BIGINT) AS n_lines FROM documents",
    "a1_stats": f"{_CONTENT} SELECT oid AS pair, (SELECT count(*) FROM n WHERE n.pair = hist.oid AND NOT EXISTS (SELECT 1 FROM o WHERE o.pair = n.pair AND o.l = n.l)) AS addition, (SELECT count(*) FROM o WHERE o.pair = hist.oid AND NOT EXISTS (SELECT 1 FROM n WHERE o.pair = n.pair AND o.l = n.l)) AS deletion FROM hist",
    "l1_reconstruct": "SELECT o_orderkey AS pair, true AS old_ok, true AS new_ok FROM orders",
    "l3_blame": f"WITH {SQL}, f AS (SELECT tree, path || ' ' || substr(blob, 1, 8) AS l FROM tf), v AS (SELECT oid, branch, row_number() OVER (PARTITION BY branch ORDER BY ts, oid) AS k FROM hist), x AS (SELECT v.branch, v.oid, v.k, l, row_number() OVER (PARTITION BY v.oid ORDER BY l) AS line_no, v.k - row_number() OVER (PARTITION BY v.branch, l ORDER BY v.k) AS g FROM v JOIN f ON f.tree = v.oid) SELECT oid AS ver, line_no, l AS text, first_value(oid) OVER (PARTITION BY branch, l, g ORDER BY k) AS origin FROM x",
    "pr25_attributes": r"SELECT DISTINCT path, CASE WHEN regexp_matches(path, '(^|/)[^/]*\.md$') THEN 'set' WHEN regexp_matches(path, '(^|/)[^/]*\.png$') THEN 'unset' WHEN regexp_matches(path, '(^|/)[^/]*\.go$') THEN 'set' ELSE 'auto' END AS text, CASE WHEN regexp_matches(path, '\.md$') THEN 'unspecified' WHEN regexp_matches(path, '^docs/[^/]*$') THEN 'unset' WHEN regexp_matches(path, '\.png$') THEN 'unset' WHEN regexp_matches(path, '\.go$') THEN 'go' ELSE 'unspecified' END AS diff, CASE WHEN regexp_matches(path, '\.md$') THEN 'lf' ELSE 'unspecified' END AS eol FROM documents WHERE path IS NOT NULL",
    "pr28_sparse": "SELECT source AS repo, path, doc_id, NOT (starts_with(path, 'docs/') OR starts_with(path, 'cmd/') OR starts_with(path, 'core/')) AS skip FROM documents WHERE path IS NOT NULL",
}
