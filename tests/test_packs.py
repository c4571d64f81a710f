import random

from pyspark.sql import functions as F

from histrata.operators import config as C
from histrata.operators import packs as P
from histrata.operators import scans as S


def test_rank_within(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randint(0, 50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = P.rank_within(df, ["g"], F.floor(F.col("v") / 7), ["v", "i"], "k").collect()
    for g in ("a", "b", None):
        own = sorted([x for x in got if x["g"] == g], key=lambda x: (x["v"], x["i"]))
        assert [x["k"] for x in own] == list(range(len(own)))


def test_window_candidates_across_blocks(spark):
    r = random.Random(2)
    rows = [(f"{i:05d}", "blob", r.randint(1, 3000)) for i in range(300)] + [(None, "blob", 3), ("x", None, 3), ("y", "tag", None), ("00001", "blob", 1)]
    got = P.window_candidates(spark.createDataFrame(rows, "oid string, obj_type string, obj_size bigint"), 4, 50).collect()
    best = {}
    for o, t, n in rows:
        if o and t == "blob" and n:
            best[o] = max(n, best.get(o, 0))
    order = sorted(best, key=lambda o: (-best[o], o))
    assert {x["oid"]: list(x["bases"]) for x in got} == {o: order[max(0, k - 4) : k] for k, o in enumerate(order)}


def test_delta_depths(spark):
    e = lambda a, off, oid, kind, bo=None, bi=None: (a, "r", "p", oid, kind, 5, off, 0, bo, bi)
    rows = [e(1, 10, "AA ", "blob"), e(2, 20, "bb", "ofs-delta", 10), e(3, 30, "cc", "ref-delta", None, "BB"), e(4, 20, "bb", "ofs-delta", 10), e(5, 40, "dd", "ref-delta", None, "ee"), e(6, 50, None, "blob"), e(7, 60, "f1", "ref-delta", None, "f2"), e(8, 70, "f2", "ref-delta", None, "f1")]
    df = spark.createDataFrame(rows, "arrival bigint, repo string, pack string, oid string, obj_type string, obj_size bigint, pack_offset bigint, crc32 bigint, base_offset bigint, base_oid string")
    assert {r["arrival"]: r["depth"] for r in P.delta_depths(df).collect()} == {1: 0, 2: 1, 3: 2, 5: 0, 6: 0}
    assert {r["oid"]: (r["n"], r["packs"]) for r in P.repeated(df).collect()} == {"bb": (2, 1)}
    assert P.delta_depths(df.where("false")).count() == 0


def test_config_text():
    text = '[core]\n\tbare = true ; c\n[remote "o\\"x"]\n\turl = "a # b" \n\tfetch = a\\\nb\n\tflag\n[Sec.Sub]\nKey=v\n'
    rows = C.decode(text)
    assert rows == [("core", None, "bare", 0, "true"), ("remote", 'o"x', "url", 1, "a # b"), ("remote", 'o"x', "fetch", 2, "ab"), ("remote", 'o"x', "flag", 3, None), ("sec", "sub", "key", 4, "v")]
    assert C.decode(C.encode(rows)) == rows
    r = random.Random(3)
    for _ in range(200):
        rows = [("s", r.choice([None, "x", 'q"\\']), "k", i, r.choice([None, "", " a ", "b;c", 'd"e', "f\\g", "h\ni", "j\tk", "#"])) for i in range(4)]
        assert C.decode(C.encode(rows)) == rows


def test_config_overlay(spark):
    s = "scope int, section string, subsection string, key string, ord int, value string"
    df = spark.createDataFrame([(0, "core", None, "a", 0, "low"), (1, "core", None, "a", 0, "high"), (1, "core", None, "a", 1, "higher"), (1, "core", None, "b", 2, ""), (0, "core", None, "b", 1, "kept")], s)
    assert {(r["key"], r["value"]) for r in C.get(C.merge(df)).collect()} == {("a", "higher"), ("b", "kept")}
    assert {r["key"]: list(r["values"]) for r in C.get_all(df).collect()}["a"] == ["low", "high", "higher"]
    assert {r["key"] for r in C.changed(df.where("scope = 0"), df).collect()} == {"a", "b"}


def test_overlay_and_priority(spark):
    up = spark.createDataFrame([("r", "a", "1")], "repo string, name string, oid string")
    low = spark.createDataFrame([("r", "a", "2"), ("r", "b", "3"), ("r", "c", "4")], "repo string, name string, oid string")
    gone = spark.createDataFrame([("r", "c")], "repo string, name string")
    assert {(x["name"], x["oid"]) for x in S.overlay(up, low, ["repo", "name"], gone).collect()} == {("a", "1"), ("b", "3")}
    rows = spark.createDataFrame([("x", 2, "packed"), ("x", 1, "loose"), ("y", 2, "packed")], "oid string, p int, at string")
    assert {(x["oid"], x["at"]) for x in S.by_priority(rows, "oid", "p").collect()} == {("x", "loose"), ("y", "packed")}


def test_symbolic_references(spark):
    rows = [("r", "HEAD", None, "refs/heads/m"), ("r", "refs/heads/m", "1" * 40, None), ("r", "a", None, "b"), ("r", "b", None, "a"), ("r", "c", None, "gone")]
    got = {x["name"]: x["oid"] for x in S.resolve_symbolic(spark.createDataFrame(rows, "repo string, name string, oid string, target string")).collect()}
    assert got == {"HEAD": "1" * 40, "refs/heads/m": "1" * 40, "a": None, "b": None, "c": None}
