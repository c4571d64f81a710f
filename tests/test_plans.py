from pyspark.sql import functions as F

from histrata.operators import plans as P
from histrata.functions.runtime import Scratch


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_sets(spark):
    a, b = df(spark, [("x",), ("x",), ("y",), (None,)], "oid string"), df(spark, [("y",), (None,)], "oid string")
    assert sorted(str(r[0]) for r in P.difference(a, b).collect()) == ["None", "x", "x"]
    assert P.is_subset(b, a) and not P.is_subset(a, b) and P.is_subset(b.where("false"), a)


def test_object_filter(spark):
    o = df(spark, [("a", "blob", 10, 2), ("b", "blob", 5000, 1), ("c", "tree", 3, 0), ("d", "commit", 3, 0), ("e", "tree", 3, 2)], "oid string, type string, size bigint, depth int")
    keep = lambda s: {r["oid"] for r in P.object_filter(o, s).collect()}
    assert keep("blob:none") == {"c", "d", "e"} and keep("blob:limit=1k") == {"a", "c", "d", "e"} and keep("tree:2") == {"b", "c", "d"}
    assert keep("object:type=tree") == {"c", "e"} and keep("combine:tree:2+blob:none") == {"c", "d"}


def test_objects_of(spark):
    entries = df(spark, [("t1", 16384, "t2"), ("t1", 33188, "b1"), ("t2", 33188, "b2"), ("t2", 57344, "sub"), ("t2", 33188, "b1")], "tree_oid string, mode int, oid string")
    got = P.objects_of(df(spark, [("l", "c1")], "label string, oid string"), df(spark, [("c1", "t1")], "oid string, tree_oid string"), entries, Scratch(spark, "test"))
    assert {(r["oid"], r["type"]) for r in got.collect()} == {("c1", "commit"), ("t1", "tree"), ("t2", "tree"), ("b1", "blob"), ("b2", "blob")}


def test_tags(spark):
    tags = df(spark, [("t1", "t2", "tag"), ("t2", "c", "commit"), ("t3", "z", "blob")], "oid string, target_oid string, target_type string")
    assert {tuple(r) for r in P.peel(tags, df(spark, [("t1",), ("c",)], "oid string")).collect()} == {("t1", "c", "commit"), ("c", "c", None)}
    assert {r["oid"] for r in P.reachable_tags(tags, df(spark, [("c",)], "oid string")).collect()} == {"t1", "t2"}
    refs = df(spark, [("r", "refs/tags/a", "t1"), ("r", "refs/heads/b", "c")], "repo string, name string, oid string")
    assert [r["line"] for r in P.info_refs(refs, P.peel(tags, refs.select("oid"))).orderBy("ord").collect()] == ["c\trefs/heads/b", "t1\trefs/tags/a", "c\trefs/tags/a^{}"]


def test_fetch_plan(spark):
    local = df(spark, [("r", "refs/x/a", "1"), ("r", "refs/x/b", "2"), ("r", "refs/tags/t", "3"), ("r", "refs/x/s", "9")], "repo string, name string, oid string")
    new = df(spark, [("r", "refs/x/a", "4", False), ("r", "refs/x/b", "5", False), ("r", "refs/tags/t", "4", True), ("r", "refs/x/n", "6", False), ("r", "refs/x/s", "9", False)], "repo string, dst string, oid string, force boolean")
    anc = df(spark, [("1", "4", True), ("2", "5", False), ("3", "4", True)], "a string, b string, is_ancestor boolean")
    assert {r["dst"]: r["action"] for r in P.fetch_plan(local, new, anc).collect()} == {"refs/x/a": "fast-forward", "refs/x/b": "rejected", "refs/tags/t": "forced", "refs/x/n": "new"}
    cmd = df(spark, [("r", "a", "1"), ("r", "b", "2")], "repo string, name string, old_oid string")
    assert [r["name"] for r in P.lease_violations(cmd, df(spark, [("r", "a", "1"), ("r", "b", "7")], "repo string, name string, oid string")).collect()] == ["b"]


def test_small_plans(spark):
    s = "grp string, path string, blob string"
    assert {tuple(r) for r in P.pick(df(spark, [("g", "a", "1"), ("g", "b", "2"), ("g", "c", "3")], s), df(spark, [("g", "a", "1"), ("g", "b", "9"), ("g", "d", "4")], s)).collect()} == {("g", "b", "modify", "9"), ("g", "c", "delete", None), ("g", "d", "insert", "4")}
    m = P.submodule_status(df(spark, [("p", "u"), ("q", "v")], "path string, url string"), df(spark, [("p", 57344, "1"), ("q", 33188, "2")], "path string, mode int, oid string"), df(spark, [("p", "1")], "path string, oid string"))
    assert {(r["path"], r["clean"]) for r in m.collect()} == {("p", True), ("q", False)}
    assert {r["oid"] for r in P.unshallowed(df(spark, [("a",), ("b",)], "oid string"), df(spark, [("b",)], "oid string"), df(spark, [("a",), ("b",), ("c",)], "oid string")).collect()} == {"a"}
    v = P.violations(df(spark, [("r", "", None, None), ("r", "o", "u", ["a:b:c"]), ("r", "p", "u", ["+refs/heads/*:refs/x/*"])], "repo string, name string, url string, fetch_specs array<string>"))
    assert {(r["name"], r["fault"]) for r in v.collect()} == {("", "no name"), ("", "no address"), ("o", "bad fetch spec")}
    st = df(spark, [("g", "p", "M", " "), ("g", "q", " ", " ")], "grp string, path string, staging string, worktree string")
    assert [r["line"] for r in P.status_text(st).collect()] == ["M  p"]
    b = df(spark, [(1, 1, "x", 12, "ab"), (1, 2, "y", 3, "c")], "ver bigint, line_no bigint, text string, origin bigint, author string")
    assert [r["line"] for r in P.blame_text(b).orderBy("line_no").collect()] == ["12 (ab    1) x", "3 (c     2) y"]
    assert P.list_refs(df(spark, [("refs/heads/a",), ("x",)], "name string"), ["refs/"]).count() == 1 and P.conflicts(df(spark, [("g", "a")], "grp string, path string"), df(spark, [("g", "a"), ("g", "b")], "grp string, path string")).count() == 1
    assert spark.range(1).select(P.fast_forward(F.lit(False), F.lit(True))).first()[0]
