"""Byte formats over whole tables: every query writes rows in a format, reads them back, and returns what was read.

Rows of one file are a bounded group: a tree, a pack, a repository's log of one reference, or a
bucket of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import objects as O
from ..functions.revision import parse
from ..operators import plans as P
from ..operators.tables import SQL, RepoTables
from ..sources import codecs as C

QUERIES, ORACLE = {}, {}
#: Documents of one pack.
DOCS_PER_PACK = 50


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def by_row(df: DataFrame, read: Callable[[pd.Series], tuple], schema: str) -> DataFrame:
    """One row read back for each row written."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([read(r) for r in pdf.itertuples(index=False)], columns=names)

    return df.mapInPandas(run, schema)


def by_file(df: DataFrame, keys: list[str], read: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """The rows read back of each file; the keys come first. Small files share an Arrow batch; a file is in one task, as its format demands."""
    names, rest = [x.split()[0] for x in schema.split(", ")], [c for c in df.columns if c not in keys]
    files = df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_rows"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for *key, rows in pdf[[*keys, "_rows"]].itertuples(index=False):
                d = {c: [r[c] for r in rows] for c in rest} | {k: [v] * len(rows) for k, v in zip(keys, key)}
                out += [(*key, *r) for r in read(d)]
            yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(run, schema)


@q("SELECT doc_id, 'blob' AS kind, CAST(strlen(text) AS BIGINT) AS size, sha1(CAST('blob ' || strlen(text) || chr(0) AS BLOB) || encode(text)) AS oid FROM documents WHERE text IS NOT NULL")
def f1_loose(spark, base):
    """Loose object files of all documents."""

    def read(r):
        kind, content = C.read_loose(C.write_loose("blob", r.text.encode()))
        return r.doc_id, kind, len(content), C.object_id(kind, content)

    return by_row(RepoTables(spark, base).blobs.where("text IS NOT NULL").select("doc_id", "text"), read, "doc_id bigint, kind string, size bigint, oid string")


@q("SELECT doc_id, sha1(CAST('blob ' || strlen(text) || chr(0) AS BLOB) || encode(text)) AS oid, true AS same_base FROM documents WHERE text IS NOT NULL")
def l15_deltas(spark, base):
    """Deltas from a document without its first third, made and applied."""

    def read(r):
        target = r.text.encode()
        source = target[len(target) // 3 :]
        delta = C.make_delta(source, target)
        return r.doc_id, C.object_id("blob", C.apply_delta(source, delta)), C.read_varint(delta, 0)[0] == len(source)

    return by_row(RepoTables(spark, base).blobs.where("text IS NOT NULL").select("doc_id", "text"), read, "doc_id bigint, oid string, same_base boolean")


@q("SELECT arrival, pack_offset, coalesce(obj_size, 0) AS obj_size FROM pack_entries WHERE pack_offset > 0")
def l19_numbers(spark, base):
    """Offsets and sizes in the two forms of variable length."""
    p = RepoTables(spark, base).packs.where("pack_offset > 0").select("arrival", "pack_offset", F.coalesce("obj_size", F.lit(0)).alias("obj_size"))
    return by_row(p, lambda r: (r.arrival, C.read_offset(C.write_offset(r.pack_offset), 0)[0], C.read_varint(C.write_varint(r.obj_size), 0)[0]), "arrival bigint, pack_offset bigint, obj_size bigint")


@q(f"WITH {SQL} SELECT tree, replace(path, '/', '-') AS name, 33188 AS mode, blob AS oid FROM tf")
def f23_trees(spark, base):
    """The trees of all orders."""
    f = RepoTables(spark, base).tree_files.select("tree", F.regexp_replace("path", "/", "-").alias("name"), "mode", "blob")
    return by_file(f, ["tree"], lambda d: [(n, m, o) for m, n, o in C.read_tree(C.write_tree(list(zip(d["mode"], d["name"], d["blob"]))))], "tree bigint, name string, mode int, oid string")


@q(f"WITH {SQL} SELECT tree, path, 33188 AS mode, blob AS oid FROM tf")
def f15_index(spark, base):
    """A staging file for each order, versions 2 to 4 in turn."""

    def read(d):
        rows = [{"path": p, "mode": int(m), "oid": o, "stage": 0} for p, m, o in zip(d["path"], d["mode"], d["blob"])]
        return [(e["path"], e["mode"], e["oid"]) for e in C.read_index(C.write_index(rows, 2 + int(d["tree"][0]) % 3))]

    return by_file(RepoTables(spark, base).tree_files, ["tree"], read, "tree bigint, path string, mode int, oid string")


_IDX = r"x AS (SELECT pack, lower(regexp_replace(oid, '^\s+|\s+$', '', 'g')) AS oid, pack_offset, min(coalesce(crc32, 0)) AS crc32 FROM pack_entries WHERE oid IS NOT NULL AND pack_offset >= 0 GROUP BY ALL HAVING len(lower(regexp_replace(oid, '^\s+|\s+$', '', 'g'))) = 40)"


def _index_rows(spark, base):
    from ..functions.runtime import clean_key

    p = RepoTables(spark, base).packs.where("oid IS NOT NULL AND pack_offset >= 0").select("pack", clean_key("oid").alias("oid"), "pack_offset", F.coalesce("crc32", F.lit(0)).alias("crc32"))
    return p.where(F.length("oid") == 40).groupBy("pack", "oid", "pack_offset").agg(F.min("crc32").alias("crc32"))


def _rows(d):
    return sorted(zip(d["oid"], map(int, d["pack_offset"]), map(int, d["crc32"])))


@q(f"WITH {_IDX} SELECT pack, oid, pack_offset, crc32 FROM x")
def f9_idx(spark, base):
    """An index file for each pack."""
    return by_file(_index_rows(spark, base), ["pack"], lambda d: C.read_idx(C.write_idx(_rows(d), b"\0" * 20)), "pack string, oid string, pack_offset bigint, crc32 bigint")


@q(f"WITH {_IDX}, y AS (SELECT pack, pack_offset, row_number() OVER (PARTITION BY pack ORDER BY oid, pack_offset, crc32) - 1 AS by_id FROM x) SELECT pack, by_id, row_number() OVER (PARTITION BY pack ORDER BY pack_offset, by_id) - 1 AS place FROM y")
def f14_rev(spark, base):
    """A reverse index for each pack."""
    return by_file(_index_rows(spark, base), ["pack"], lambda d: [(n, k) for k, n in enumerate(C.read_rev(C.write_rev(_rows(d), b"\0" * 20), len(d["oid"])))], "pack string, by_id bigint, place bigint")


@q(f"SELECT DISTINCT doc_id // {DOCS_PER_PACK} AS bucket, 'blob' AS kind, CAST(strlen(text) AS BIGINT) AS size, sha1(CAST('blob ' || strlen(text) || chr(0) AS BLOB) || encode(text)) AS oid FROM documents WHERE text IS NOT NULL")
def f7_packs(spark, base):
    """Packs of documents with deltas, parsed again."""

    def read(d):
        data, _ = C.write_pack([("blob", t) for t in sorted({t.encode() for t in d["text"]})])
        return [(e["kind"], e["size"] if "content" not in e else len(e["content"]), e["oid"]) for e in C.parse_pack(data)]

    b = RepoTables(spark, base).blobs.where("text IS NOT NULL").select(F.floor(F.col("doc_id") / DOCS_PER_PACK).alias("bucket"), "text")
    return by_file(b, ["bucket"], read, "bucket bigint, kind string, size bigint, oid string")


@q("SELECT DISTINCT oid, tree_oid, array_to_string(coalesce(parents, []), ' ') AS parents, coalesce(message, '') AS message FROM commits WHERE oid IS NOT NULL AND tree_oid IS NOT NULL")
def f21_commits(spark, base):
    """Commit objects of all commits."""

    def read(r):
        c = C.read_commit(C.write_commit({"tree_oid": r.tree_oid, "parents": list(r.parents), "author": "A <a@x> 0 +0000", "committer": "A <a@x> 0 +0000", "message": r.message}))
        return r.oid, c["tree_oid"], " ".join(c["parents"]), c["message"]

    c = RepoTables(spark, base).raw("commits").where("oid IS NOT NULL AND tree_oid IS NOT NULL").select("oid", "tree_oid", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), F.coalesce("message", F.lit("")).alias("message")).distinct()
    return by_row(c, read, "oid string, tree_oid string, parents string, message string")


@q("SELECT repo, name, oid AS target_oid, 'commit' AS target_type FROM refs WHERE oid IS NOT NULL")
def f25_tags(spark, base):
    """A tag object for each reference."""

    def read(r):
        t = C.read_tag(C.write_tag({"target_oid": r.oid, "target_type": "commit", "name": r.name, "tagger": "A <a@x> 0 +0000", "message": "about it\n"}))
        return r.repo, t["name"], t["target_oid"], t["target_type"]

    return by_row(RepoTables(spark, base).refs.where("oid IS NOT NULL").select("repo", "name", "oid"), read, "repo string, name string, target_oid string, target_type string")


@q(f"WITH {SQL} SELECT repo, ref_name, coalesce(old_oid, repeat('0', 40)) AS old_oid, coalesce(new_oid, repeat('0', 40)) AS new_oid, replace(coalesce(message, ''), chr(10), ' ') AS message FROM rl")
def f30_reflogs(spark, base):
    """The log file of every reference."""
    zero = lambda c: F.coalesce(c, F.lit("0" * 40)).alias(c)
    log = RepoTables(spark, base).reflog.select("repo", "ref_name", "seq", zero("old_oid"), zero("new_oid"), F.regexp_replace(F.coalesce("message", F.lit("")), "\n", " ").alias("message"))
    read = lambda d: [(o, n, m) for o, n, _, m in C.read_reflog(C.write_reflog([(o, n, "A <a@x> 0 +0000", m) for _, o, n, m in sorted(zip(d["seq"], d["old_oid"], d["new_oid"], d["message"]))]))]
    return by_file(log, ["repo", "ref_name"], read, "repo string, ref_name string, old_oid string, new_oid string, message string")


@q("SELECT repo, name, oid FROM refs WHERE oid IS NOT NULL")
def y18_packed_refs(spark, base):
    """A file of packed references for each repository."""
    read = lambda d: [(n, o) for n, o, _ in C.read_packed_refs(C.write_packed_refs([(n, o, None) for n, o in zip(d["name"], d["oid"])]))]
    return by_file(RepoTables(spark, base).refs.where("oid IS NOT NULL"), ["repo"], read, "repo string, name string, oid string")


_COMMIT_GRAPH = f"WITH {SQL}, g AS (SELECT oid, repo, tree_oid FROM (SELECT oid, min(repo) AS repo, min(tree_oid) AS tree_oid FROM commits WHERE len(oid) = 40 GROUP BY oid) WHERE len(tree_oid) = 40)"


@q(_COMMIT_GRAPH + ", e AS (SELECT e.child, string_agg(e.parent, ' ' ORDER BY ord) AS parents FROM edges e JOIN g a ON a.oid = e.child JOIN g b ON b.oid = e.parent AND a.repo = b.repo GROUP BY e.child) SELECT g.repo, g.oid, g.tree_oid, coalesce(e.parents, '') AS parents FROM g LEFT JOIN e ON e.child = g.oid")
def f20_commit_graphs(spark, base):
    """A commit-graph file for each repository, with the parents it has itself."""
    t = RepoTables(spark, base)
    g = t.raw("commits").where(F.length("oid") == 40).groupBy("oid").agg(F.min("repo").alias("repo"), F.min("tree_oid").alias("tree_oid")).where(F.length("tree_oid") == 40)
    own = t.edges.select("child", "ord", "parent").join(g.select(F.col("oid").alias("child"), "repo"), "child").join(g.select(F.col("oid").alias("parent"), F.col("repo").alias("r2")), "parent").where("repo = r2")
    up = own.groupBy("child").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "parent"))), lambda x: x["parent"]).alias("parents"))
    rows = g.join(up, g["oid"] == up["child"], "left").select("repo", "oid", "tree_oid", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))
    read = lambda d: [(c["oid"], c["tree_oid"], " ".join(c["parents"])) for c in C.read_graph(C.write_graph([{"oid": o, "tree_oid": x, "parents": list(p), "generation": 1, "when": 0} for o, x, p in zip(d["oid"], d["tree_oid"], d["parents"])]))]
    return by_file(rows, ["repo"], read, "repo string, oid string, tree_oid string, parents string")


_TAGS = "'1' || substr(sha1(repo || name), 2) AS one, '2' || substr(sha1(repo || name), 2) AS two"


@q(f"SELECT one AS oid, oid AS target, 'commit' AS target_type FROM (SELECT {_TAGS}, oid FROM refs WHERE oid IS NOT NULL) UNION ALL SELECT two, oid, 'commit' FROM (SELECT {_TAGS}, oid FROM refs WHERE oid IS NOT NULL)")
def pr9_peel(spark, base):
    """A tag of a tag for each reference, followed to the commit."""
    x = RepoTables(spark, base).refs.where("oid IS NOT NULL").select(F.concat(F.lit("1"), F.substring(F.sha1(F.concat("repo", "name")), 2, 99)).alias("one"), F.concat(F.lit("2"), F.substring(F.sha1(F.concat("repo", "name")), 2, 99)).alias("two"), "oid")
    tags = x.select(F.col("one").alias("oid"), F.col("two").alias("target_oid"), F.lit("tag").alias("target_type")).unionByName(x.select(F.col("two").alias("oid"), F.col("oid").alias("target_oid"), F.lit("commit").alias("target_type")))
    return P.peel(tags, tags.select("oid"))


@q("WITH l AS (SELECT repo, ref_name AS name, arg_max(new_oid, seq) AS oid FROM (SELECT DISTINCT * FROM reflog) GROUP BY 1, 2) SELECT r.repo, r.name, r.oid AS old_oid FROM refs r JOIN l ON l.repo = r.repo AND l.name = r.name WHERE r.oid IS DISTINCT FROM l.oid")
def u9_lease(spark, base):
    """Pushes that expect of each reference what its log says last."""
    t = RepoTables(spark, base)
    last = t.reflog.groupBy("repo", F.col("ref_name").alias("name")).agg(F.max_by("new_oid", "seq").alias("oid"))
    return P.lease_violations(t.refs.select("repo", "name", F.col("oid").alias("old_oid")), last)


@q("SELECT doc_id, path, NOT (regexp_matches(path, '^/|//|/$|^$') OR regexp_matches(path, '(^|[/\\\\])\\.{1,2}($|[/\\\\])') OR regexp_matches(path, '(?i)(^|[/\\\\])(\\.git|git~[0-9]+)($|[/\\\\])')) AS valid FROM documents WHERE path IS NOT NULL")
def pr29_paths(spark, base):
    return RepoTables(spark, base).blobs.where("path IS NOT NULL").select("doc_id", "path", O.valid_path(F.col("path")).alias("valid"))


#: Revision expressions with the steps they are made of.
REVISIONS = {"main": "ref:main", "@": "ref:HEAD", "HEAD~": "ref:HEAD ~:1", "HEAD~3^2": "ref:HEAD ~:3 ^:2", "v1.0^": "ref:v1.0 ^:1", "main^0": "ref:main ^:0", "main^{/fix}": "ref:main ^{/:fix", "topic/x~2~1": "ref:topic/x ~:2 ~:1"}


@q("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in REVISIONS.items()) + ") v(revision, steps)")
def y35_revisions(spark, base):
    df = spark.createDataFrame([(k,) for k in REVISIONS], "revision string")
    return by_row(df, lambda r: (r.revision, " ".join(f"{op}:{arg}" for op, arg in parse(r.revision))), "revision string, steps string")
