"""Queries over scans, lookups, references and remotes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import objects as O
from ..operators import scans as S
from ..operators.tables import SQL, RepoTables

_OBJ = "obj AS (SELECT oid, min(kind) AS kind FROM (SELECT oid, 'commit' AS kind FROM commits UNION ALL SELECT tree_oid, 'tree' FROM commits UNION ALL SELECT blob_oid, 'blob' FROM documents UNION ALL SELECT lower(regexp_replace(oid, '\\s', '', 'g')), CASE WHEN obj_type IN ('commit', 'tree', 'blob', 'tag') THEN obj_type END FROM pack_entries) WHERE oid IS NOT NULL GROUP BY oid)"
QUERIES, ORACLE = {}, {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@q(f"WITH {_OBJ} SELECT oid, kind FROM obj")
def s1_objects(spark, base):
    return S.objects(RepoTables(spark, base))


@q("SELECT DISTINCT oid, repo, tree_oid, author_name, committer_name, message FROM commits WHERE oid IS NOT NULL")
def s2_commits(spark, base):
    return RepoTables(spark, base).commits.select("oid", "repo", "tree_oid", "author_name", "committer_name", "message")


@q("SELECT tree_oid, count(DISTINCT oid) AS n_commits FROM commits WHERE tree_oid IS NOT NULL GROUP BY tree_oid")
def s3_trees(spark, base):
    return RepoTables(spark, base).raw("commits").where("tree_oid IS NOT NULL").groupBy("tree_oid").agg(F.count_distinct("oid").alias("n_commits"))


@q("SELECT blob_oid, count(*) AS n, CAST(max(strlen(text)) AS BIGINT) AS size FROM documents WHERE blob_oid IS NOT NULL GROUP BY blob_oid")
def s4_blobs(spark, base):
    return RepoTables(spark, base).blobs.where("blob_oid IS NOT NULL").groupBy("blob_oid").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))


@q("SELECT DISTINCT lower(regexp_replace(oid, '\\s', '', 'g')) AS oid FROM pack_entries WHERE obj_type = 'tag' AND oid IS NOT NULL")
def s5_tags(spark, base):
    return RepoTables(spark, base).packs.where("obj_type = 'tag' AND oid IS NOT NULL").select(F.lower(F.regexp_replace("oid", r"\s", "")).alias("oid")).distinct()


@q("SELECT repo, name, kind, oid, target, CASE WHEN name LIKE 'refs/heads/%' THEN 'branch' WHEN name LIKE 'refs/tags/%' THEN 'tag' WHEN name LIKE 'refs/notes/%' THEN 'note' WHEN name LIKE 'refs/remotes/%' THEN 'remote' ELSE 'other' END AS space FROM refs")
def s6_references(spark, base):
    n = F.col("name")
    return RepoTables(spark, base).refs.select("repo", "name", "kind", "oid", "target", F.when(N.is_branch(n), "branch").when(N.is_tag(n), "tag").when(N.is_note(n), "note").when(N.is_remote(n), "remote").otherwise("other").alias("space"))


@q("SELECT repo, count(*) FILTER (WHERE name LIKE 'refs/heads/%') AS branches, count(*) FILTER (WHERE name LIKE 'refs/tags/%') AS tags, count(*) FILTER (WHERE name LIKE 'refs/notes/%') AS notes, count(*) AS refs FROM refs GROUP BY repo")
def s7_9_namespaces(spark, base):
    n = F.col("name")
    c = lambda x: F.count(F.when(x, 1))
    return RepoTables(spark, base).refs.groupBy("repo").agg(c(N.is_branch(n)).alias("branches"), c(N.is_tag(n)).alias("tags"), c(N.is_note(n)).alias("notes"), F.count(F.lit(1)).alias("refs"))


@q(f"WITH {_OBJ} SELECT r.repo, r.name, r.oid, obj.kind FROM refs r JOIN obj ON r.oid = obj.oid")
def s13_lookup(spark, base):
    t = RepoTables(spark, base)
    return S.lookup(t.refs.select("repo", "name", "oid"), S.objects(t))[0].select("repo", "name", "oid", "kind")


@q(f"WITH {_OBJ} SELECT r.repo, r.name, r.oid FROM refs r WHERE r.oid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM obj WHERE obj.oid = r.oid)")
def s13_missing(spark, base):
    t = RepoTables(spark, base)
    return S.lookup(t.refs.select("repo", "name", "oid"), S.objects(t))[1].select("repo", "name", "oid")


@q("WITH p AS (SELECT lower(regexp_replace(oid, '\\s', '', 'g')) AS oid, pack, pack_offset FROM pack_entries WHERE oid IS NOT NULL) SELECT oid, first(pack ORDER BY pack, pack_offset) AS pack, min(pack_offset) FILTER (WHERE pack = mp) AS pack_offset FROM (SELECT *, min(pack) OVER (PARTITION BY oid) AS mp FROM p) GROUP BY oid")
def s20_first_pack(spark, base):
    p = RepoTables(spark, base).packs.where("oid IS NOT NULL").select(F.lower(F.regexp_replace("oid", r"\s", "")).alias("oid"), "pack", "pack_offset")
    return S.by_priority(p, "oid", "pack").select("oid", "pack", "pack_offset")


@q(f"WITH {_OBJ} SELECT h.oid, obj.oid IS NOT NULL AS present FROM haves h LEFT JOIN obj ON h.oid = obj.oid")
def s22_has_object(spark, base):
    t = RepoTables(spark, base)
    return t.raw("haves").join(S.objects(t).select(F.col("oid").alias("o")), F.col("oid") == F.col("o"), "left").select("oid", F.col("o").isNotNull().alias("present"))


@q("WITH o AS (SELECT DISTINCT oid FROM commits WHERE oid IS NOT NULL), p AS (SELECT DISTINCT substr(oid, 1, 4) AS prefix FROM o) SELECT p.prefix, count(*) AS n, CASE WHEN count(*) = 1 THEN min(o.oid) END AS oid FROM p JOIN o ON substr(o.oid, 1, 4) = p.prefix GROUP BY p.prefix")
def s23_prefixes(spark, base):
    c = RepoTables(spark, base).slim
    return S.prefix_matches(c, c.select(F.substring("oid", 1, 4).alias("prefix")))


@q("SELECT arrival, lower(regexp_replace(oid, '\\s', '', 'g')) AS oid, obj_type, base_offset, base_oid, obj_size FROM pack_entries WHERE obj_type IN ('ofs-delta', 'ref-delta')")
def s24_deltas(spark, base):
    return RepoTables(spark, base).packs.where(O.is_delta(F.col("obj_type"))).select("arrival", F.lower(F.regexp_replace("oid", r"\s", "")).alias("oid"), "obj_type", "base_offset", "base_oid", "obj_size")


@q("SELECT repo, pack, count(*) AS n, CAST(sum(obj_size) AS BIGINT) AS bytes FROM pack_entries GROUP BY repo, pack")
def s26_packs(spark, base):
    return RepoTables(spark, base).packs.groupBy("repo", "pack").agg(F.count(F.lit(1)).alias("n"), F.sum("obj_size").alias("bytes"))


@q(f"WITH {SQL}, l AS (SELECT repo, ref_name AS name, arg_max(new_oid, seq) AS oid FROM rl GROUP BY repo, ref_name) SELECT repo, name, oid FROM refs UNION ALL SELECT repo, name, oid FROM l WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.repo = l.repo AND r.name = l.name)")
def s30_overlay(spark, base):
    """References over what their logs say last."""
    t = RepoTables(spark, base)
    last = t.reflog.groupBy("repo", F.col("ref_name").alias("name")).agg(F.max_by("new_oid", "seq").alias("oid"))
    return S.overlay(t.refs.select("repo", "name", "oid"), last, ["repo", "name"])


@q(f"WITH {SQL} SELECT repo, ref_name, seq, old_oid, new_oid, committer_name, message FROM rl")
def s31_reflog(spark, base):
    return RepoTables(spark, base).reflog.select("repo", "ref_name", "seq", "old_oid", "new_oid", "committer_name", "message")


@q(f"WITH {SQL}, w AS (SELECT *, lag(new_oid) OVER x AS p, lag(committer_when) OVER x AS t FROM rl WINDOW x AS (PARTITION BY repo, ref_name ORDER BY seq)) SELECT repo, ref_name, seq, coalesce(p IS NOT NULL AND p IS DISTINCT FROM old_oid, false) AS gap, coalesce(t > committer_when, false) AS out_of_order FROM w")
def s31_reflog_links(spark, base):
    return S.reflog_links(RepoTables(spark, base).reflog).select("repo", "ref_name", "seq", "gap", "out_of_order")


@q(f"WITH {SQL} SELECT repo, ref_name, arg_max(new_oid, struct_pack(w := committer_when, s := seq)) AS oid FROM rl WHERE committer_when <= TIMESTAMP '2023-01-01' GROUP BY repo, ref_name")
def s31_at_time(spark, base):
    return S.at_time(RepoTables(spark, base).reflog, "2023-01-01 00:00:00")


@q("WITH RECURSIVE r AS (SELECT repo, name, oid, target, 0 AS hops FROM refs UNION ALL SELECT r.repo, r.name, t.oid, t.target, r.hops + 1 FROM r JOIN refs t ON r.repo = t.repo AND r.target = t.name WHERE r.oid IS NULL AND r.hops < 10), m AS (SELECT repo, name, max(hops) AS hops FROM r GROUP BY 1, 2) SELECT r.repo, r.name, r.oid, CAST(r.hops AS BIGINT) AS hops FROM r JOIN m ON r.repo = m.repo AND r.name = m.name AND r.hops = m.hops")
def pr10_resolve(spark, base):
    return S.resolve_symbolic(RepoTables(spark, base).refs)


@q(
    "WITH w AS (SELECT DISTINCT repo, regexp_replace(name, '^refs/(heads|tags|remotes)/', '') AS short FROM refs), rules(rule, pre, post) AS (VALUES (0, '', ''), (1, 'refs/', ''), (2, 'refs/tags/', ''), (3, 'refs/heads/', ''), (4, 'refs/remotes/', ''), (5, 'refs/remotes/', '/HEAD')), "
    "x AS (SELECT w.repo, w.short, rule, r.name, r.oid FROM w, rules JOIN refs r ON r.repo = w.repo AND r.name = pre || w.short || post) SELECT repo, short, name, oid FROM x QUALIFY row_number() OVER (PARTITION BY repo, short ORDER BY rule) = 1"
)
def pr11_expand(spark, base):
    r = RepoTables(spark, base).refs
    return S.expand_names(r.select("repo", F.regexp_replace("name", r"^refs/(heads|tags|remotes)/", "").alias("short")).distinct(), r)


@q("SELECT repo, name, CASE WHEN name LIKE 'refs/remotes/%/HEAD' THEN regexp_extract(name, '^refs/remotes/(.+)/HEAD$', 1) WHEN regexp_matches(name, '^refs/(tags|heads|remotes)/.+') THEN regexp_replace(name, '^refs/(tags|heads|remotes)/', '') WHEN regexp_matches(name, '^refs/.+') THEN substr(name, 6) ELSE name END AS short FROM refs")
def pr16_short_names(spark, base):
    return RepoTables(spark, base).refs.select("repo", "name", N.short_name(F.col("name")).alias("short"))


@q("SELECT repo, name, NOT (regexp_matches(name, '(^|/)\\.') OR regexp_matches(name, '\\.lock(/|$)') OR contains(name, '..') OR regexp_matches(name, '[\\x00-\\x20\\x7f~^:?*\\[\\\\]') OR regexp_matches(name, '^/|/$|//') OR name LIKE '%.' OR contains(name, '@{') OR name IN ('@', '') OR (NOT contains(name, '/') AND NOT regexp_matches(name, '^[A-Z][A-Z_]*$'))) AS valid FROM refs")
def pr16_valid_names(spark, base):
    return RepoTables(spark, base).refs.select("repo", "name", N.valid_name(F.col("name")).alias("valid"))


_SPECS = "sp AS (SELECT DISTINCT repo, unnest(fetch_specs) AS spec FROM remotes), sq AS (SELECT repo, spec, regexp_replace(spec, '^\\+', '') AS bare FROM sp WHERE spec IS NOT NULL), sr AS (SELECT repo, spec, CASE WHEN contains(bare, ':') THEN split_part(bare, ':', 1) ELSE bare END AS src, CASE WHEN contains(bare, ':') THEN split_part(bare, ':', 2) ELSE bare END AS dst FROM sq)"


def _specs(t):
    return t.remotes.select("repo", F.explode("fetch_specs").alias("spec")).where("spec IS NOT NULL").distinct()


@q(f"WITH {_SPECS} SELECT r.repo, r.name, r.oid, spec, CASE WHEN contains(src, '*') THEN replace(dst, '*', substr(name, strlen(split_part(src, '*', 1)) + 1, strlen(name) - strlen(split_part(src, '*', 1)) - strlen(split_part(src, '*', 2)))) ELSE dst END AS dst, spec LIKE '+%' AS force FROM refs r JOIN sr ON r.repo = sr.repo WHERE CASE WHEN contains(src, '*') THEN starts_with(name, split_part(src, '*', 1)) AND ends_with(name, split_part(src, '*', 2)) AND strlen(name) >= strlen(src) - 1 ELSE name = src END")
def pr18_refspecs(spark, base):
    t = RepoTables(spark, base)
    return S.match_specs(t.refs, _specs(t))


@q(f"WITH {_SPECS} SELECT repo, spec, src, dst, spec LIKE '+%' AS force, contains(spec, '*') AS wildcard FROM sr")
def pr19_spec_parts(spark, base):
    s = F.col("spec")
    return _specs(RepoTables(spark, base)).select("repo", "spec", N.spec_part(s, "src").alias("src"), N.spec_part(s, "dst").alias("dst"), N.spec_force(s).alias("force"), N.spec_wildcard(s).alias("wildcard"))


_RULES = [(0, "https://forge.", "ssh://git@forge."), (1, "https://", "git://"), (2, "git@", "ssh://git@")]


@q("WITH ru(ord, prefix, replacement) AS (VALUES (0, 'https://forge.', 'ssh://git@forge.'), (1, 'https://', 'git://'), (2, 'git@', 'ssh://git@')), x AS (SELECT url, replacement || substr(url, strlen(prefix) + 1) AS y, row_number() OVER (PARTITION BY url ORDER BY strlen(prefix) DESC, ord) AS k FROM (SELECT DISTINCT url FROM remotes) u JOIN ru ON starts_with(url, prefix)) SELECT u.url, coalesce(x.y, u.url) AS rewritten FROM (SELECT DISTINCT url FROM remotes) u LEFT JOIN x ON u.url = x.url AND k = 1")
def pr20_rewrite(spark, base):
    return S.rewrite_urls(RepoTables(spark, base).remotes.select("url").distinct(), spark.createDataFrame(_RULES, "ord int, prefix string, replacement string"))


@q("SELECT DISTINCT url, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'url' WHEN regexp_matches(url, '^([^@/\\\\]+@)?[^:/\\\\\\s]+:') AND NOT regexp_matches(url, '^[A-Za-z]:[\\\\/]') THEN 'scp' ELSE 'local' END AS kind FROM remotes")
def y36_url_kinds(spark, base):
    return RepoTables(spark, base).remotes.select("url", N.url_kind(F.col("url")).alias("kind")).distinct()


@q("WITH o AS (SELECT repo, ref_name AS name, arg_max(old_oid, seq) AS top, count(*) FILTER (WHERE old_oid IS NULL AND seq = m) > 0 AS none, max(seq) AS s FROM (SELECT *, max(seq) OVER (PARTITION BY repo, ref_name) AS m FROM (SELECT DISTINCT * FROM reflog)) GROUP BY 1, 2), l AS (SELECT repo, name, CASE WHEN none THEN NULL ELSE top END AS oid FROM o) SELECT r.repo, r.name, r.name AS dst, l.oid AS old_oid, r.oid AS new_oid, CASE WHEN l.oid IS NULL THEN 'create' ELSE 'update' END AS action FROM refs r LEFT JOIN l ON l.repo = r.repo AND l.name = r.name WHERE r.name LIKE 'refs/heads/%' AND r.oid IS NOT NULL AND l.oid IS DISTINCT FROM r.oid")
def u8_update_plan(spark, base):
    t = RepoTables(spark, base)
    old = t.reflog.groupBy("repo", F.col("ref_name").alias("name")).agg(F.max_by("old_oid", "seq").alias("oid"))
    return S.update_plan(t.refs, old, t.refs.select("repo", F.lit("refs/heads/*:refs/heads/*").alias("spec")).distinct())


@q("SELECT repo, name FROM refs WHERE name LIKE 'refs/heads/%' AND NOT EXISTS (SELECT 1 FROM reflog l WHERE l.repo = refs.repo AND l.ref_name = refs.name)")
def u6_prune_plan(spark, base):
    t = RepoTables(spark, base)
    remote = t.reflog.select("repo", F.col("ref_name").alias("name")).distinct()
    return S.prune_plan(t.refs, remote, t.refs.select("repo", F.lit("refs/heads/*:refs/heads/*").alias("spec")).distinct())


@q("SELECT DISTINCT mode, is_f, txt FROM (VALUES (16384, false, '40000'), (33188, true, '100644'), (33204, true, '100664'), (33261, true, '100755'), (40960, true, '120000'), (57344, false, '160000')) v(mode, is_f, txt)")
def pr32_modes(spark, base):
    m = F.col("mode")
    return spark.createDataFrame([(str(x),) for x in ("40000", "100644", "100664", "100755", "120000", "160000")], "txt string").select(O.parse_mode(F.col("txt")).alias("mode"), "txt").select("mode", O.is_file(m).alias("is_f"), O.mode_text(m).alias("txt"))


@q("SELECT doc_id, sha1(CAST('blob ' || strlen(text) || chr(0) AS BLOB) || encode(text)) AS oid FROM documents")
def a8_object_ids(spark, base):
    return RepoTables(spark, base).raw("documents").select("doc_id", O.object_id("blob", F.col("text")).alias("oid"))


@q("SELECT doc_id, contains(substr(text, 1, 8000), chr(0)) AS is_binary FROM documents WHERE text IS NOT NULL")
def pr6_sniff(spark, base):
    return RepoTables(spark, base).raw("documents").where("text IS NOT NULL").select("doc_id", O.is_binary(F.col("text")).alias("is_binary"))


@q("SELECT doc_id, CAST(len(text) - len(replace(text, chr(13) || chr(10), chr(10))) AS BIGINT) AS crlf, CAST(len(text) - len(replace(text, chr(10), '')) - (len(text) - len(replace(text, chr(13) || chr(10), chr(10)))) AS BIGINT) AS lone_lf, replace(text, chr(13) || chr(10), chr(10)) = text AS clean FROM documents WHERE text IS NOT NULL")
def l14_line_ends(spark, base):
    t = F.col("text")
    return RepoTables(spark, base).raw("documents").where("text IS NOT NULL").select("doc_id", O.stat(t)["crlf"].alias("crlf"), O.stat(t)["lone_lf"].alias("lone_lf"), (O.to_lf(t) == t).alias("clean"))


@q("SELECT DISTINCT oid, coalesce(author_name, '') || ' <' || coalesce(author_email, '') || '> ' || coalesce(CAST(epoch(author_when) AS BIGINT), 0) || ' ' || (CASE WHEN coalesce(author_tz_min, 0) < 0 THEN '-' ELSE '+' END) || lpad(CAST(abs(coalesce(author_tz_min, 0)) // 60 AS VARCHAR), 2, '0') || lpad(CAST(abs(coalesce(author_tz_min, 0)) % 60 AS VARCHAR), 2, '0') AS line FROM commits")
def f26_signatures(spark, base):
    c = RepoTables(spark, base).raw("commits")
    return c.select("oid", O.signature_text(F.col("author_name"), F.col("author_email"), F.col("author_when").cast("timestamp"), F.col("author_tz_min")).alias("line")).distinct()


@q("SELECT DISTINCT oid, trim(coalesce(author_name, '')) AS name, coalesce(author_email, '') AS email, coalesce(CAST(epoch(author_when) AS BIGINT), 0) AS epoch, coalesce(author_tz_min, 0) AS tz_min FROM commits")
def f26_parse_signatures(spark, base):
    """The lines of ``f26_signatures`` read back."""
    p = f26_signatures(spark, base).select("oid", O.parse_signature(F.col("line")).alias("s"))
    return p.select("oid", "s.name", "s.email", "s.epoch", "s.tz_min")


@q("SELECT repo, oid, committer_when FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY committer_when DESC, oid DESC) AS k FROM (SELECT repo, oid, min(committer_when) AS committer_when FROM commits GROUP BY repo, oid)) WHERE k <= 3")
def t1_newest(spark, base):
    """The three newest commits of every repository: a top-k, cut map-side by the window group limit."""
    w = Window.partitionBy("repo").orderBy(F.desc("committer_when"), F.desc("oid"))
    return RepoTables(spark, base).slim.withColumn("k", F.row_number().over(w)).where("k <= 3").select("repo", "oid", "committer_when")
