import difflib
import random

import pytest
from pyspark.sql import functions as F

from histrata.operators import text as X


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_scripts_are_shortest_and_right():
    r = random.Random(1)
    for _ in range(300):
        a = [r.choice("abcd") for _ in range(r.randint(0, 14))]
        b = [r.choice("abcd") for _ in range(r.randint(0, 14))]
        s = X.line_script(a, b)
        assert [a[i] for op, i, _ in s if op != "+"] == a and [b[j] for op, _, j in s if op != "-"] == b
        assert all(a[i] == b[j] for op, i, j in s if op == "=")
        assert sum(op == "=" for op, _, _ in s) == lcs(a, b)


def test_unified_applies():
    a = "".join(f"l{i}\n" for i in range(30))
    b = a.replace("l3\n", "x\n").replace("l20\n", "").replace("l29\n", "end")
    text = X.unified(a, b, "a/f", "b/f")
    want = list(difflib.unified_diff(a.splitlines(True), b.splitlines(True), "a/f", "b/f"))
    assert [x for x in text.splitlines() if x.startswith("@@")] == [x.strip() for x in want if x.startswith("@@")]
    assert "\\ No newline at end of file" in text and X.unified(a, a, "a", "b") == ""
    assert X.unified(None, "x\n", "a", "b").splitlines()[2] == "@@ -0,0 +1 @@"


def test_diff_columns(spark):
    df = spark.createDataFrame([("a\nb\nc\n", "a\nc\nd"), (None, "x\n"), ("", ""), ("é\n", "é\n")], "o string, n string")
    o, n = F.col("o"), F.col("n")
    rows = df.select("o", "n", X.diff_chunks(o, n).alias("c"), X.line_stats(o, n).alias("s")).select("o", "n", "s", X.side(F.col("c"), "old").alias("x"), X.side(F.col("c"), "new").alias("y")).collect()
    assert all(r["x"] == (r["o"] or "") and r["y"] == (r["n"] or "") for r in rows)
    assert [tuple(r["s"]) for r in rows] == [(1, 1), (1, 0), (0, 0), (0, 0)]


def test_grep(spark):
    f = spark.createDataFrame([("a.go", "foo\nbar\n"), ("b.txt", "foo bar"), ("c.go", None), ("d.go", "")], "path string, text string")
    assert [(r["path"], r["line_no"]) for r in X.grep(f, ["^foo$"]).collect()] == [("a.go", 1)]
    assert {(r["path"], r["line_no"]) for r in X.grep(f, ["foo", "bar"], [r"\.go$"]).collect()} == {("a.go", 1), ("a.go", 2)}
    assert {(r["path"], r["line_no"]) for r in X.grep(f, ["foo", "bar"], [r"\.go$"], invert=True).collect()} == {("a.go", 1), ("a.go", 2), ("a.go", 3), ("d.go", 1)}
    assert X.grep(f, []).count() == 0
    for bad in (r"(?=x)", r"(a)\1", r"(?<!x)"):
        with pytest.raises(ValueError):
            X.grep(f, [bad])


def test_blame(spark):
    v = {1: "a\nb\n", 2: "a\nx\nb\n", 3: "a\nb\nc\n", 4: "a\nx\nb\nc\n"}
    links = [(2, 0, 1), (3, 0, 1), (4, 0, 2), (4, 1, 3)]
    got = X.blame(spark.createDataFrame(list(v.items()), "ver bigint, text string"), spark.createDataFrame(links, "ver bigint, ord int, parent bigint")).collect()
    at = {(r["ver"], r["line_no"]): (r["text"], r["origin"]) for r in got}
    assert [at[4, k] for k in (1, 2, 3, 4)] == [("a", 1), ("x", 2), ("b", 1), ("c", 3)]
    assert len(got) == sum(t.count("\n") for t in v.values())
