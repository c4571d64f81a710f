import random

import numpy as np
import pytest

from histrata.llm import seen_before as S


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 5000, 60000])
@pytest.mark.parametrize("bits", [8, 32])
def test_filter_holds_its_keys_and_few_others(n, bits):
    r = np.random.default_rng(n)
    keys = r.integers(0, 2**63, n, dtype=np.uint64)
    f = S.PeelFilter(keys, bits)
    assert f.holds(keys).all()
    others = r.integers(0, 2**63, 20000, dtype=np.uint64) | np.uint64(1 << 63)
    assert f.holds(others).mean() <= (0.01 if bits == 8 else 0.0005)
    if n >= 5000:
        assert f.slots.nbytes <= 1.3 * n * bits / 8 + 300


def brute(rows, known):
    key = lambda x: x.strip().lower() if x is not None else None
    seen, out = {key(k) for k in known if k is not None}, {}
    for a, k in sorted(rows, key=lambda r: r[0]):
        k = key(k)
        out[a] = k is not None and k in seen
        if k is not None:
            seen.add(k)
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    ids = [f"{r.getrandbits(160):040x}" for _ in range(300)] + [f"{r.getrandbits(256):064x}" for _ in range(40)] + ["odd", "abc", "", "00" * 20, "0" * 64]
    hot = ids[0]
    rows = [(a, None if r.random() < 0.02 else hot if r.random() < 0.33 else r.choice(ids)) for a in r.sample(range(-500, 9000), 3000)]
    rows = [(a, k if k is None or r.random() < 0.9 else r.choice([k.upper(), " " + k, k + "\t", k + " "])) for a, k in rows]
    known = [ids[5], ids[6].upper(), None, "zz"]
    df = spark.createDataFrame([(k, a, "x") for a, k in rows], "oid string, arrival bigint, seen string")
    kn = spark.createDataFrame([(k,) for k in known], "oid string")
    want = brute(rows, known)
    for shard in (200, 100_000):
        got = {x["arrival"]: x["seen"] for x in S.seen_before(df, kn, rows_per_shard=shard).collect()}
        assert got == want
    rates = S.error_rates(df, kn, bits=8).collect()
    assert {x["generation"] for x in rates} == set(range(-1, 16))
    assert sum(x["keys"] for x in rates if x["generation"] >= 0) >= len({k for _, k in rows if k})
    assert sum(x["measured"] * x["keys"] for x in rates) <= 3 + 3 * sum(x["bound"] * x["keys"] for x in rates)


def test_empty_and_single(spark):
    s = "oid string, arrival bigint"
    assert S.seen_before(spark.createDataFrame([], s)).count() == 0
    assert [tuple(x) for x in S.seen_before(spark.createDataFrame([("a", 7)], s), spark.createDataFrame([], "oid string")).collect()] == [(7, False)]
    assert [tuple(x) for x in S.seen_before(spark.createDataFrame([(None, 7)], s)).collect()] == [(7, False)]


def test_repeated_and_missing_order(spark):
    """Rows that share an order value, and rows without one, each get one answer of their own."""
    df = spark.createDataFrame([("aa", 1), ("bb", 5), ("cc", 5), ("dd", 7), ("aa", 7), ("ff", 9), ("bb", None), ("gg", None), ("hh", None), ("hh", None)], "oid string, arrival bigint")
    got = sorted(map(tuple, S.seen_before(df).collect()), key=str)
    assert got == sorted([(1, False), (5, False), (5, False), (7, False), (7, True), (9, False), (None, True), (None, False), (None, False), (None, False)], key=str)


def test_shards_follow_known_keys(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(S, "parts_for", lambda rows, *a: sizes.append(rows) or 8)
    S.seen_before(spark.createDataFrame([("k1", 1)], "oid string, arrival bigint"), spark.range(5000).selectExpr("cast(id as string) oid")).count()
    assert sizes == [5001]


def test_sealed_batches(spark, tmp_path):
    """A second and third batch read the written filters of the ones before, not their keys."""
    r = random.Random(6)
    ids = [f"{r.getrandbits(160):040x}" for _ in range(4000)]
    batches, known = [[(a, r.choice(ids) if a % 50 else None) for a in range(k * 3000, k * 3000 + 3000)] for k in range(3)], set()
    for g, rows in enumerate(batches):
        df = spark.createDataFrame([(k, a) for a, k in rows], "oid string, arrival bigint")
        path = f"{tmp_path}/filters"
        filters = spark.read.schema(S.FILTERS).parquet(path) if g else spark.createDataFrame([], S.FILTERS)
        got = {x["arrival"]: x["seen"] for x in S.first_seen(df, filters, 4).collect()}
        assert got == brute(rows, known)
        S.seal(df, g, 4).write.mode("append").parquet(path)
        known |= {k for _, k in rows if k}
    assert spark.read.parquet(path).groupBy("generation").count().count() == 3
