import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from histrata.functions.revision import resolve
from histrata.functions.runtime import Scratch
from histrata.operators import graph as G
from histrata.operators import plans as P
from histrata.operators.tables import RepoTables


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    r = random.Random(11)
    parents = {}
    for i in range(90):
        k = f"{i:04x}" + "0" * 36
        old = list(parents)
        ps = [] if i in (0, 40) else [old[-1] if r.random() < 0.7 else r.choice(old)]
        if ps and r.random() < 0.3:
            ps.append(r.choice(old))
        if r.random() < 0.05:
            ps.append("f" * 40)
        parents[k] = list(dict.fromkeys(ps))
    base = tmp_path_factory.mktemp("world")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, "r", p if p or i % 2 else None, t0 + dt.timedelta(hours=i), t0 + dt.timedelta(hours=i), f"message {i} " + ("fix" if i % 7 == 0 else "add")) for i, (k, p) in enumerate(parents.items())]
    df = spark.createDataFrame(rows + rows[:5], "oid string, repo string, parents array<string>, committer_when timestamp_ntz, author_when timestamp_ntz, message string").withColumn("received_at", F.lit(t0))
    df.write.parquet(f"{base}/commits.parquet")
    t = RepoTables(spark, str(base))
    return SimpleNamespace(t=t, forest=G.Forest(t), parents={k: [p for p in v if p in parents] for k, v in parents.items()})


def reach(parents, *starts):
    seen, todo = set(), list(starts)
    while todo:
        x = todo.pop()
        if x not in seen and x in parents:
            seen.add(x)
            todo += parents[x]
    return seen


def test_closure(spark, world):
    ks = list(world.parents)
    starts = [("a", ks[-1]), ("b", ks[50]), ("b", ks[30]), ("c", "none"), ("d", None)]
    got = world.forest.closure(spark.createDataFrame(starts, "label string, oid string")).collect()
    assert {(x[0], x[1]) for x in got} == {("a", o) for o in reach(world.parents, ks[-1])} | {("b", o) for o in reach(world.parents, ks[50], ks[30])}
    assert len(got) == len(set(got))


def test_pairs(spark, world):
    r, ks, p = random.Random(4), list(world.parents), world.parents
    pairs = [(r.choice(ks), r.choice(ks)) for _ in range(25)]
    pairs = list(dict.fromkeys(pairs))
    df = spark.createDataFrame(pairs, "a string, b string")
    common = {x: reach(p, x[0]) & reach(p, x[1]) for x in pairs}
    best = {(*x, o) for x, c in common.items() for o in c if not any(o in p[d] for d in c)}
    assert {tuple(x) for x in G.merge_bases(world.forest, df).collect()} == best
    assert {tuple(x) for x in G.is_ancestor(world.forest, df).collect()} == {(a, b, a in reach(p, b)) for a, b in pairs}
    assert {tuple(x) for x in G.ahead_behind(world.forest, df).collect()} == {(a, b, len(reach(p, a) - reach(p, b)), len(reach(p, b) - reach(p, a))) for a, b in pairs}


def test_independents_and_rev_list(spark, world):
    ks, p = list(world.parents), world.parents
    cand = ks[60:75]
    got = G.independents(world.forest, spark.createDataFrame([("g", c) for c in cand], "grp string, oid string")).collect()
    assert {x["oid"] for x in got} == {c for c in cand if not any(c in reach(p, o) and c != o for o in cand)}
    w, h = spark.createDataFrame([("x", ks[-1])], "label string, oid string"), spark.createDataFrame([("x", ks[45])], "label string, oid string")
    assert {x["oid"] for x in G.rev_list(world.forest, w, h).collect()} == reach(p, ks[-1]) - reach(p, ks[45])


def test_generations(world):
    gen = {}
    for k in world.parents:
        gen[k] = 1 + max((gen[x] for x in world.parents[k]), default=0)
    assert {x["oid"]: x["generation"] for x in world.forest.generations().collect()} == gen


def test_levels_and_shallow(spark, world):
    ks, p = list(world.parents), world.parents
    start = spark.createDataFrame([("x", ks[-1])], "label string, oid string")
    level, new = {}, {ks[-1]}
    for d in range(4):
        level |= {x: d for x in new}
        new = {y for x in new for y in p[x]} - set(level)
    s = Scratch(spark, "test")
    assert {x["oid"]: x["level"] for x in G.levels(world.t, start, 3, s).collect()} == level
    got = {x["oid"]: x["shallow"] for x in G.shallow_boundary(world.t, start, 3, s).collect()}
    assert set(got) == {x for x, d in level.items() if d < 3} and all(not v or level[k] == 2 for k, v in got.items())


@pytest.mark.parametrize("order", ["dfs", "dfs_last_parent_first", "ctime", "topo", "date", "author_date"])
def test_orders(world, order):
    p, ks = world.parents, list(world.parents)
    key = {k: (float(i), float(i), k) for i, k in enumerate(ks)}
    sub = reach(p, ks[-1])
    out = G.ordered({k: p[k] for k in sub}, key, [ks[-1]], order)
    assert sorted(out) == sorted(sub) and len(out) == len(set(out)) and out[0] == ks[-1]
    place = {k: i for i, k in enumerate(out)}
    if order in ("topo", "date", "author_date"):
        assert all(place[k] < place[x] for k in sub for x in p[k])
    if order == "ctime":
        assert out == sorted(sub, key=lambda k: key[k], reverse=True)
    if order == "dfs":
        assert all(place[p[k][0]] == place[k] + 1 for k in sub if p[k] and all(place[x] > place[k] for x in p[k]))


def test_walk_in_spark(spark, world):
    ks = list(world.parents)
    got = G.walk(world.t, spark.createDataFrame([("x", ks[-1])], "label string, oid string"), "ctime").orderBy("ord").collect()
    assert [x["oid"] for x in got] == sorted(reach(world.parents, ks[-1]), reverse=True)


def test_revisions(spark, world):
    ks, p = list(world.parents), world.parents
    refs = spark.createDataFrame([("r", "refs/heads/main", "hash", ks[-1], None), ("r", "HEAD", "symbolic", None, "refs/heads/main")], "repo string, name string, kind string, oid string, target string")
    c = world.t.commits
    go = lambda x: [r["oid"] for r in resolve(world.forest, c, refs, "r", x).collect()]
    first = [ks[-1]]
    while p[first[-1]]:
        first.append(p[first[-1]][0])
    assert go("main") == [ks[-1]] and go("HEAD") == [ks[-1]]
    assert go("HEAD~3") == [first[3]] and go("main^") == [first[1]]
    assert go(ks[17][:8]) == [ks[17]]
    fixes = [k for k in reach(p, ks[-1]) if ks.index(k) % 7 == 0]
    assert go("main^{/fix}") == [max(fixes)]
    assert go("nope") == []


def _brute_levels(parents, starts, stop=frozenset()):
    level, new = dict.fromkeys(starts, 0), list(starts)
    while new:
        new = [p for x in new if x not in stop for p in parents[x] if level.setdefault(p, level[x] + 1) == level[x] + 1]
        new = list(dict.fromkeys(new))
    return level


def test_whole_levels(spark, tmp_path):
    """Far below any depth limit, around a circle, and with a short cut that a later jump finds."""
    parents = {f"c{i:03}": [f"c{i - 1:03}"] if i else [] for i in range(60)}
    parents |= {"x0": ["x2"], "x1": ["x0"], "x2": ["x1", "c059"], "tip": ["c059", "m"], "m": ["n", "c010"], "n": ["m"], "gone": ["nowhere"]}
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, "r", p, t0 + dt.timedelta(days=-1 if k in ("c050", "m") else 1), t0, t0) for k, p in parents.items()]
    spark.createDataFrame(rows, "oid string, repo string, parents array<string>, committer_when timestamp_ntz, author_when timestamp_ntz, received_at timestamp_ntz").write.parquet(f"{tmp_path}/commits.parquet")
    t = RepoTables(spark, str(tmp_path))
    parents = {k: [p for p in v if p in parents] for k, v in parents.items()}
    starts = {"a": ["tip"], "b": ["x1", "c030"], "c": ["gone"]}
    df = spark.createDataFrame([(k, v) for k, vs in starts.items() for v in vs * 2] + [("a", "nowhere"), ("a", None)], "label string, oid string")
    got = sorted(map(tuple, G.Forest(t).levels(df).collect()))
    assert got == sorted((k, *x) for k, v in starts.items() for x in _brute_levels(parents, v).items())
    assert max(x[2] for x in got) > 40
    cut = sorted(map(tuple, P.whole_filtered_levels(t, df, F.size("parents") == 1, F.col("committer_when") < F.lit(t0).cast("timestamp_ntz")).collect()))
    single = {r[0] for r in rows if len(r[2]) == 1}
    assert cut == sorted((k, *x) for k, v in starts.items() for x in _brute_levels(parents, v, {"c050", "m"}).items() if x[0] in single)
    assert G.Forest(t).levels(df.where("false")).count() == 0
