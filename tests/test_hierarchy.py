import random

from histrata.functions.runtime import Scratch
from histrata.operators import hierarchy as H
from histrata.operators.components import components
from histrata.operators.list_ranking import list_rank


def brute(parent):
    nodes = set(parent)
    good, bad = {}, {}
    for n in nodes:
        path, x = [], n
        while x in nodes and x not in path:
            path.append(x)
            x = parent[x]
        if x in path:
            ring, y = [x], parent[x]
            while y != x:
                ring.append(y)
                y = parent[y]
            bad[n] = min(ring)
        else:
            good[n] = path[::-1]
    return good, bad


def test_random_forests(spark):
    r = random.Random(3)
    n = 400
    parent = {f"n{i}": (f"n{r.randrange(n)}" if r.random() < 0.15 else f"n{r.randrange(i)}" if i and r.random() < 0.93 else r.choice([None, "", "gone"])) for i in range(n)}
    rows = [(k, v, 1) for k, v in parent.items()] + [(k, v, 2) for k, v in list(parent.items())[:40]] + [(None, "n1", 3)]
    df = spark.createDataFrame(rows, "oid string, parent string, path int")
    good, bad = brute(parent)
    got = {r["oid"]: r for r in H.hierarchy(df, "oid", "parent").collect()}
    assert {k: list(v["path"]) for k, v in got.items()} == good
    down = {k: sum(k in p for p in good.values()) - 1 for k in good}
    assert all(v["depth"] == len(good[k]) - 1 and v["root_oid"] == good[k][0] and v["n_descendants"] == down[k] for k, v in got.items())
    assert {r["oid"]: r["cycle_oid"] for r in H.find_circles(df, "oid", "parent").collect()} == bad


def test_small_blocks_agree(spark):
    r = random.Random(5)
    parent = {f"n{i}": (f"n{max(0, i - r.randint(1, 4))}" if i else None) for i in range(300)}
    df = spark.createDataFrame(list(parent.items()), "oid string, parent string")
    s = Scratch(spark, "test")
    nodes, rows = H.numbered(df, "oid", "parent", s)
    placed = s.save(H.intervals(nodes, rows, s))
    good, _ = brute(parent)
    assert {x["oid"]: list(x["path"]) for x in H.paths(placed, rows, block=16).collect()} == good


def test_special_tables(spark):
    empty = spark.createDataFrame([], "oid string, parent string")
    assert H.hierarchy(empty, "oid", "parent").count() == 0
    assert H.find_circles(empty, "oid", "parent").count() == 0
    own = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", None), ("c", None)], "oid string, parent string")
    assert sorted(map(tuple, H.find_circles(own, "oid", "parent").collect())) == [("a", "a"), ("b", "a")]
    assert [r["oid"] for r in H.hierarchy(own, "oid", "parent").collect()] == ["c"]


def test_list_rank(spark):
    r = random.Random(9)
    links, want = [], {}
    ids = list(range(500))
    r.shuffle(ids)
    at = 0
    for size in (1, 2, 7, 90, 400):
        part = ids[at : at + size]
        at += size
        for k, e in enumerate(part):
            links.append((e, part[k + 1] if k + 1 < len(part) else None, e % 5))
            want[e] = (len(part) - k, sum(x % 5 for x in part[k:]), part[-1])
    got = list_rank(spark.createDataFrame(links, "e bigint, nxt bigint, w bigint"), Scratch(spark, "test"))
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == want
    assert list_rank(spark.createDataFrame([], "e bigint, nxt bigint, w bigint"), Scratch(spark, "test")).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(110)] + [(k, k + 1) for k in range(200, 260)] + [(300, 300), (None, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test"))
    assert {x["node"]: x["component"] for x in got.collect()} == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "test")).count() == 0
