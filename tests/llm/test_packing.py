import random
from collections import Counter, defaultdict

import pytest

from histrata.llm import packing as P


def check(rows, sizes, capacity):
    load, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r["container"]] += r["n_tokens"]
        parts[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
    assert all(v <= capacity for v in load.values())
    assert set(load) == set(range(len(load)))
    got = Counter()
    for r in rows:
        if r["piece"] == 0:
            got[r["doc_id"]] += 1
    assert got == Counter(k for k, _ in sizes)
    for k, n in sizes:
        if (n or 0) <= capacity:
            assert all(x == (0, n or 0) for x in parts[k])
    return len(load)


def one_by_one(lengths, capacity):
    """Containers that best fit in decreasing length needs, item by item."""
    space = []
    for n in sorted(lengths, reverse=True):
        fit = [x for x in space if x >= n]
        if fit:
            space.remove(min(fit))
            space.append(min(fit) - n)
        else:
            space.append(capacity - n)
    return len(space)


def test_plan_places_every_item():
    r = random.Random(1)
    for _ in range(200):
        cap = r.randint(1, 60)
        counts = {k: r.randint(1, 30) for k in r.sample(range(0, cap + 1), r.randint(1, min(cap, 12)))}
        runs, made = P.plan(counts, cap)
        load, done = Counter(), Counter()
        for length, rank, first, n, each in runs:
            assert rank == done[length]
            done[length] += n * each
            for c in range(first, first + n):
                load[c] += length * each
        assert done == Counter(counts) and all(v <= cap for v in load.values()) and max(load, default=0) < made
        assert made == max(1, one_by_one([k for k, v in counts.items() for _ in range(v) if k], cap))


def test_pack(spark):
    r = random.Random(2)
    sizes = [(i, r.choice([0, 1, 5, 7, 7, 7, 7, 30, 99, 100, 101, 250, None])) for i in range(600)] + [(5, 7), (5, 7)]
    sizes = [(k, n) for k, n in sizes if k != 5] + [(5, 7)] * 3
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    rows = P.pack(df, [(1, 100), (2, 333)]).collect()
    for i, cap in ((1, 100), (2, 333)):
        own = [x for x in rows if x["container_id"] == i]
        used = check(own, sizes, cap)
        parts = [x for _, n in sizes for x in [cap] * ((n or 0) // cap) + [(n or 0) % cap] if x]
        assert used == one_by_one(parts, cap)


def test_special_tables(spark):
    e = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert P.pack(e, [(1, 10)]).count() == 0
    z = spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n_tokens bigint")
    assert {x["container"] for x in P.pack(z, [(1, 10)]).collect()} == {0}
    with pytest.raises(ValueError):
        P.pack(z, [(1, 0)])


def test_one_length_shared_by_many(spark):
    df = spark.range(30000).selectExpr("id as doc_id", "bigint(case when id % 3 = 0 then 13 else id % 50 end) as n_tokens")
    rows = P.pack(df, [(1, 64)])
    assert rows.count() == 30000
    assert rows.groupBy("container").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= 64


def test_only_the_plan_is_broadcast(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "id % 50 as n_tokens")
    assert P.pack(df, [(1, 64)])._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1


def test_tokens(spark):
    enc = P.encoding(P.VOCABULARY)
    texts = ["hello world", "", None, "naïve é 日本語", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(P.token_counts(df["text"])).collect()]
    assert got == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


def test_validity_sees_faults(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id bigint, text string")
    boxes = spark.createDataFrame([(0, 10)], "container_id bigint, capacity_tokens bigint")
    schema = "container_id bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint, container bigint"
    one = lambda *rows: tuple(P.validity(spark.createDataFrame([(0, *r) for r in rows], schema), docs, boxes).first())
    assert one((1, 0, 0, 10, 0), (1, 1, 10, 3, 1), (2, 0, 0, 7, 1), (3, 0, 0, 0, 0)) == (0, 3, 3, 0, 0, 0)
    assert one((1, 0, 0, 6, 0), (2, 0, 0, 7, 0), (3, 0, 0, 1, 1)) == (0, 3, 3, 1, 0, 0)
    assert one((1, 0, 0, 6, 0), (1, 1, 6, 1, 1)) == (0, 3, 1, 0, 1, 1)
    assert one((1, 0, 0, 10, 0), (1, 2, 20, 4, 1)) == (0, 3, 1, 0, 0, 1)
    assert one((1, 0, 0, 6, 0), (1, 0, 0, 6, 1))[2:] == (1, 0, 0, 1)
