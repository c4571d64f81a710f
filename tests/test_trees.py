import random

from pyspark.sql import functions as F

from histrata.functions.runtime import Scratch
from histrata.operators import treediff as D
from histrata.sources import codecs as C

B = {c: C.object_id("blob", c.encode()) for c in "abcdefgh"}
FILES = "tree string, path string, mode int, blob string"


def files(spark, trees):
    rows = [(t, p, m, B[c]) for t, fs in trees.items() for p, (m, c) in fs.items()]
    return spark.createDataFrame(rows, FILES)


def test_changes_and_reverse(spark):
    f = files(spark, {"x": {"a": (33188, "a"), "d/b": (33188, "b"), "c": (33188, "c"), "e": (33188, "e")}, "y": {"a": (33204, "a"), "d/b": (33188, "c"), "n": (33261, "d"), "e": (33261, "e")}})
    pairs = spark.createDataFrame([("1", "x", "y"), ("2", "y", "x"), ("3", None, "x"), ("4", "x", "x")], "pair string, from_tree string, to_tree string")
    got = {(r["pair"], r["path"]): r["action"] for r in D.changes(pairs, f).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "1"} == {"d/b": "modify", "c": "delete", "n": "insert", "e": "modify"}
    swap = {"insert": "delete", "delete": "insert", "modify": "modify"}
    assert {k[1]: swap[v] for k, v in got.items() if k[0] == "1"} == {k[1]: v for k, v in got.items() if k[0] == "2"}
    assert {v for k, v in got.items() if k[0] == "3"} == {"insert"} and not any(k[0] == "4" for k in got)
    s = {r["pair"]: tuple(r)[1:] for r in D.summary(D.changes(pairs, f)).collect()}
    assert s["1"] == (1, 1, 2)
    assert D.changes(pairs, f.where("false")).count() == 0


def test_exact_renames(spark):
    f = files(spark, {"x": {"p": (33188, "a"), "q": (33188, "a"), "r": (33188, "b")}, "y": {"s": (33188, "a"), "t": (33261, "b")}})
    pairs = spark.createDataFrame([("1", "x", "y")], "pair string, from_tree string, to_tree string")
    assert [(r["from_path"], r["to_path"]) for r in D.exact_renames(D.changes(pairs, f), Scratch(spark, "test")).collect()] == [("p", "s")]
    f = files(spark, {"x": {"a/x.py": (33188, "a"), "b/y.py": (33188, "a")}, "y": {"c/y.py": (33188, "a"), "d/x.py": (33188, "a")}})
    for limit in (D.RENAME_LIMIT, 1):
        got = D.exact_renames(D.changes(pairs, f), Scratch(spark, "test"), limit).collect()
        assert {(r["from_path"], r["to_path"]) for r in got} == {("a/x.py", "d/x.py"), ("b/y.py", "c/y.py")}


def test_exact_renames_broadcast_nothing(spark):
    class Seen(Scratch):
        def save(self, df):
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
            return super().save(df)

    one = lambda action, path: ("1", action, path, 33188, B["a"], 33188, B["a"])
    diff = spark.createDataFrame([one("delete", "a/x"), one("delete", "b/y"), one("insert", "c/y"), one("insert", "d/x")], "pair string, action string, path string, from_mode int, from_blob string, to_mode int, to_blob string")
    for limit in (D.RENAME_LIMIT, 1):
        assert D.exact_renames(diff, Seen(spark, "test"), limit).count() == 2


def test_name_similarity(spark):
    cases = [("foo/bar.c", "foo/baz.c", 70), ("src/utils/Foo.java", "tests/utils/Foo.java", 64), ("foo/bar/baz.py", "README.md", 0), ("src/utils/something/foo.py", "src/utils/something/other/foo.py", 69), ("src/utils/something/foo.py", "src/utils/yada/foo.py", 63), ("src/utils/something/foo.py", "src/utils/something/other/bar.py", 44), ("src/utils/something/foo.py", "src/utils/something/foo.py", 100), ("same", "same", 100)]
    df = spark.createDataFrame(cases, "a string, b string, want int").select("a", "b", "want", D.name_similarity(F.col("a"), F.col("b")).alias("got"))
    assert all(r["got"] == r["want"] for r in df.collect()), df.collect()


def test_similarity_against_brute_force(spark):
    r = random.Random(1)
    pool = [f"line {i} {'x' * (i % 9)}\n" for i in range(40)]
    texts = {i: "".join(r.choices(pool, k=r.randint(1, 12))) for i in range(40)} | {40: "", 41: "one", 42: "z" * 500}
    blocks = lambda t: __import__("collections").Counter(__import__("re").findall(r"[^\n]{0,63}\n|[^\n]{1,64}", t))

    def score(a, b):
        x, y = blocks(a), blocks(b)
        size = lambda c: sum(len(k) * n for k, n in c.items())
        return sum(min(n * len(k), y[k] * len(k)) for k, n in x.items()) * 100 // max(size(x), size(y), 1)

    df = spark.createDataFrame([("g", i, t) for i, t in texts.items()], "grp string, a bigint, text string")
    for least in (30, 60):
        got = {(x["a"], x["b"]): x["score"] for x in D.similar_contents(df, df.withColumnRenamed("a", "b"), least).collect()}
        assert got == {(i, j): score(a, b) for i, a in texts.items() for j, b in texts.items() if a and b and score(a, b) >= least}


def test_greedy(spark):
    r = random.Random(8)
    rows = list({("g", r.randint(0, 9), r.randint(0, 9)): r.randint(60, 70) for _ in range(60)}.items())
    rows = [(*k, v) for k, v in rows]
    left, right, want = set(), set(), []
    for g, a, b, s in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.append((g, a, b, s))
    got = D.greedy_pairs(spark.createDataFrame(rows, "grp string, a int, b int, score int"), Scratch(spark, "test"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_status(spark):
    mk = lambda d: spark.createDataFrame([("g", p, 33188, B[c]) for p, c in d.items()], "grp string, path string, mode int, blob string")
    got = D.status(mk({"same": "a", "mod": "a", "gone": "a", "staged": "a", "both": "a"}), mk({"same": "a", "mod": "a", "new": "b", "staged": "b", "both": "b"}), mk({"same": "a", "mod": "b", "new": "b", "staged": "b", "both": "c", "u": "d", "i.log": "d"}), spark.createDataFrame([("g", "i.log")], "grp string, path string"))
    assert {r["path"]: r["staging"] + r["worktree"] for r in got.collect()} == {"mod": " M", "gone": "D ", "new": "A ", "staged": "M ", "both": "MM", "u": "??"}


def test_tree_ids_match_the_codec(spark):
    tree = {"a.txt": (33188, "a"), "d/x": (33188, "b"), "d/e/y": (33261, "c"), "d.c": (33188, "d"), "d-": (33188, "d")}
    got = {r["path"]: r["oid"] for r in D.tree_ids(files(spark, {"t": tree}), Scratch(spark, "test")).collect()}
    e = C.object_id("tree", C.write_tree([(33261, "y", B["c"])]))
    d = C.object_id("tree", C.write_tree([(33188, "x", B["b"]), (0o40000, "e", e)]))
    root = C.object_id("tree", C.write_tree([(33188, "a.txt", B["a"]), (0o40000, "d", d), (33188, "d.c", B["d"]), (33188, "d-", B["d"])]))
    assert got == {"d/e": e, "d": d, "": root}


def test_check(spark):
    z = "0" * 40
    rows = [("t", 0, "a", 33188, B["a"]), ("t", 1, "a", 33188, B["a"]), ("t", 2, "", 33188, B["a"]), ("t", 3, ".git", 0o40000, B["a"]), ("t", 4, "b/c", 33188, z), ("t", 5, "z", 7, B["a"]), ("t", 6, None, 33188, None)]
    got = {(r["ord"], r["fault"]) for r in D.check(spark.createDataFrame(rows, "tree string, ord int, name string, mode int, oid string")).collect()}
    assert {(0, "repeated name"), (1, "repeated name"), (2, "empty name"), (3, "forbidden name"), (4, "name with separator"), (4, "zero id"), (5, "bad mode"), (2, "not sorted"), (6, "empty name"), (6, "zero id")} <= got


def test_histogram(spark):
    s = spark.createDataFrame([("g", "a", 1, 0), ("g", "long", 0, 12)], "grp string, name string, addition bigint, deletion bigint")
    assert {r["line"] for r in D.histogram(s).collect()} == {" a    |  1 +", " long | 12 ------------"}
    big = spark.createDataFrame([("g", "a", 500, 500)], "grp string, name string, addition bigint, deletion bigint")
    assert len(D.histogram(big).first()["line"]) <= 70
