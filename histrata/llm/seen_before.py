"""Has this key been seen before?

Rows come in an order (``arrival``). The stream is cut into generations of equal arrival span.
Every key lives in one hash shard. ``seal`` turns a batch of keys into immutable peeling-based
fingerprint filters (three hash positions a key, 1.23 slots a key, 32-bit fingerprints), one row
(generation, shard, seed, bytes, …) a shard: a table that is written once and probed from then on.
What is kept of earlier keys is 4.9 bytes a key, whatever the hashes' length, never the keys.

``first_seen`` probes a new stream against all sealed filters, generation by generation: a key is
compared with the sealed filters of earlier batches and, within its own batch, exactly, by the
smallest order of each key; so a later batch reads filters, not keys. ``seen_before`` does this for
one stream and keys known beforehand, its generations being sealed one after the other.

Why it scales: the only shuffled rows are one row per key and generation (pre-aggregated map-side,
so a key that makes up a third of the stream arrives as a handful of rows). The number of shards
follows the keys of the stream and those known beforehand together, so a shard's memory stays the
same, and the number of generations is a parameter, so the number of probes per key does not grow.

Wrong answers: a filter never denies a key it holds. It confirms one it does not hold with
probability 2^-bits; over g probed generations this compounds to 1-(1-2^-bits)^g, to which 64-bit
hash collisions add at most n/2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch, clean_key, parts_for

#: Parameters of production runs.
GENERATIONS = 16
BITS = 32
ROWS_PER_SHARD = 100_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix constants) over ``x`` and a seed."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


class PeelFilter:
    """An immutable set of 64-bit values with false positives at rate 2^-bits and no false negatives."""

    @classmethod
    def sealed(cls, slots: bytes, bits: int, n: int, seed: int) -> PeelFilter:
        """The filter whose parts these are."""
        out = cls.__new__(cls)
        out.bits, out.n, out.seed = bits, n, seed
        out.slots = np.frombuffer(slots, dtype=np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32)
        out.block = len(out.slots) // 3
        return out

    def __init__(self, keys: np.ndarray, bits: int = BITS):
        keys = np.unique(keys.astype(np.uint64))
        self.bits, self.n, self.seed = bits, len(keys), 0
        self.block = max(4, int(1.23 * self.n / 3) + 11)
        kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32
        self.slots = np.zeros(3 * self.block, dtype=kind)
        if self.n:
            while (rounds := self._peel(keys)) is None:
                self.seed += 1
            self._assign(keys, rounds)

    def _positions(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.uint64(self.block)
        low = np.uint64(0x1FFFFF)
        return tuple(((((h >> np.uint64(21 * k)) & low) * b) >> np.uint64(21)).astype(np.int64) + k * self.block for k in range(3)) if self.block < 1 << 18 else tuple((_mix(h, k + 7) % b).astype(np.int64) + k * self.block for k in range(3))

    def _print(self, h: np.ndarray) -> np.ndarray:
        return (_mix(h, 3) >> np.uint64(64 - self.bits)).astype(self.slots.dtype)

    def _peel(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (key numbers, the slot each was alone in), or None where a core remains."""
        at = self._positions(_mix(keys, self.seed))
        degree = np.zeros(3 * self.block, dtype=np.int32)
        held = np.zeros(3 * self.block, dtype=np.int64)
        number = np.arange(len(keys), dtype=np.int64)
        for p in at:
            degree += np.bincount(p, minlength=len(degree)).astype(np.int32)
            np.bitwise_xor.at(held, p, number)
        rounds, left = [], len(keys)
        lone = np.flatnonzero(degree == 1)
        while len(lone):
            who, first = np.unique(held[lone], return_index=True)
            rounds.append((who, lone[first]))
            left -= len(who)
            touched = []
            for p in at:
                slots = p[who]
                np.subtract.at(degree, slots, 1)
                np.bitwise_xor.at(held, slots, who)
                touched.append(slots)
            touched = np.unique(np.concatenate(touched))
            lone = touched[degree[touched] == 1]
        return rounds if left == 0 else None

    def _assign(self, keys: np.ndarray, rounds: list[tuple[np.ndarray, np.ndarray]]) -> None:
        h = _mix(keys, self.seed)
        at, want = self._positions(h), self._print(h)
        for who, slot in reversed(rounds):
            self.slots[slot] = 0
            self.slots[slot] = want[who] ^ self.slots[at[0][who]] ^ self.slots[at[1][who]] ^ self.slots[at[2][who]]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """For each value whether the filter confirms it."""
        if not self.n:
            return np.zeros(len(keys), dtype=bool)
        h = _mix(keys.astype(np.uint64), self.seed)
        a, b, c = self._positions(h)
        return (self.slots[a] ^ self.slots[b] ^ self.slots[c]) == self._print(h)


def _sealed(gen: np.ndarray, keys: np.ndarray, bits: int, before: list[PeelFilter] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[PeelFilter]]]:
    """Generation by generation: its number, its rows, which of them earlier filters confirm, those filters."""
    filters: list[PeelFilter] = list(before)
    for g in np.unique(gen):
        rows = np.flatnonzero(gen == g)
        own = keys[rows]
        seen = np.zeros(len(rows), dtype=bool)
        for f in filters:
            rest = np.flatnonzero(~seen)
            seen[rest] = f.holds(own[rest])
        yield int(g), rows, seen, filters
        filters.append(PeelFilter(own[~seen], bits))


def _keys(df: DataFrame, key: str) -> DataFrame:
    """``k``: the key as bytes. Hexadecimal text by value, any other text as it is; null stays null."""
    k = clean_key(key)
    digits = k.rlike("^([0-9a-f][0-9a-f])+$")
    return df.withColumn("k", F.when(digits, F.concat(F.unhex(F.lit("01")), F.unhex(k))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(k, "UTF-8"))))


def _shard(shards: int):
    return F.pmod(F.shiftrightunsigned("h", 20), F.lit(shards)).cast("int").alias("shard")


FILTERS = "generation int, shard int, seed int, n bigint, bits int, slots binary"


def seal(keys: DataFrame, generation: int, shards: int, key: str = "oid", bits: int = BITS) -> DataFrame:
    """(generation, shard, seed, n, bits, slots): the sealed filters of a batch's distinct keys, to be written and probed ever after.

    Null keys are left out. All batches that are probed together must have the same ``shards``;
    choose them for the largest batch (``parts_for(keys, ROWS_PER_SHARD)``). An empty batch gives no row.
    """
    hashed = _keys(keys.select(F.col(key)), key).where(F.col("k").isNotNull()).select(F.xxhash64("k").alias("h")).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = PeelFilter(pdf["h"].to_numpy().view(np.uint64), bits)
        return pd.DataFrame({"generation": [generation], "shard": [int(pdf["shard"].iloc[0])], "seed": [f.seed], "n": [f.n], "bits": [bits], "slots": [f.slots.tobytes()]})

    return hashed.select("h", _shard(shards)).groupBy("shard").applyInPandas(run, FILTERS)


def first_seen(batch: DataFrame, filters: DataFrame, shards: int, key: str = "oid", order: str = "arrival") -> DataFrame:
    """(order, seen) for every row of a new batch, from the sealed filters of all earlier batches and the batch itself.

    Earlier keys are not read: a shard's task gets that shard's filters and the batch's distinct
    keys of that shard. Within the batch keys are compared exactly. Null keys are never seen, rows
    with a null order come last, and rows of one key and order are the same moment.
    """
    own = _keys(batch.select(F.col(order), F.col(key)), key)
    once = own.where(F.col("k").isNotNull()).groupBy(F.xxhash64("k").alias("h")).agg(F.min(order).alias("first"))
    keys = once.select("h", _shard(shards))

    def run(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        h = left["h"].to_numpy(dtype=np.int64).view(np.uint64)
        seen = np.zeros(len(h), dtype=bool)
        for slots, bits, n, seed in zip(right["slots"], right["bits"], right["n"], right["seed"]):
            rest = np.flatnonzero(~seen)
            seen[rest] = PeelFilter.sealed(slots, int(bits), int(n), int(seed)).holds(h[rest])
        return pd.DataFrame({"h": left["h"], "before": seen})

    told = keys.groupBy("shard").cogroup(filters.select("shard", "seed", "n", "bits", "slots").groupBy("shard")).applyInPandas(run, "h bigint, before boolean")
    known = once.join(told, "h").select(F.col("h").alias("_h"), "first", "before")
    rows = own.select(F.col(order), F.xxhash64("k").alias("h"), F.col("k").isNotNull().alias("has"))
    later = F.coalesce(F.col(order) > F.col("first"), F.col(order).isNull() & F.col("first").isNotNull())
    return rows.join(known, F.col("has") & (F.col("h") == F.col("_h")), "left").select(F.col(order), F.coalesce(F.col("has") & (F.col("before") | later), F.lit(False)).alias("seen"))


def seen_in_batches(batches: list[DataFrame], known: DataFrame | None, shards: int, key: str = "oid", order: str = "arrival", known_key: str = "oid", bits: int = BITS) -> DataFrame:
    """(order, seen) for batches that come one after the other: each is probed against the filters on disk, then sealed and added to them.

    ``known`` is sealed as generation 0. What a batch reads of the past is the table of filters only.
    """
    spark = batches[0].sparkSession
    scratch = Scratch(spark, "sealed")
    filters = scratch.save(spark.createDataFrame([], FILTERS) if known is None else seal(known, 0, shards, known_key, bits))
    out = None
    for g, batch in enumerate(batches, 1):
        answer = scratch.save(first_seen(batch, filters, shards, key, order))
        out = answer if out is None else out.unionByName(answer)
        if g < len(batches):
            filters = filters.unionByName(scratch.save(seal(batch, g, shards, key, bits)))
    return out


def first_rows(stream: DataFrame, known: DataFrame | None = None, key: str = "oid", order: str = "arrival", known_key: str = "oid", generations: int = GENERATIONS) -> tuple[DataFrame, int]:
    """One row (gen, h, at) per key and generation, ``at`` its first arrival there (null if it has none); generation -1 holds the keys known beforehand. And the number of rows of both tables."""
    low, high, rows = stream.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    low, span = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // generations))
    own = _keys(stream.select(F.col(order), F.col(key)), key).where(F.col("k").isNotNull())
    gen = F.coalesce(F.floor((F.col(order) - F.lit(low)) / F.lit(span)).cast("int"), F.lit(generations))
    own = own.select(gen.alias("gen"), "k", F.col(order).cast("bigint").alias("at"))
    if known is not None:
        before = _keys(known.select(F.col(known_key)), known_key).where(F.col("k").isNotNull())
        own = own.unionByName(before.select(F.lit(-1).alias("gen"), "k", F.lit(None).cast("bigint").alias("at")))
        rows += known.count()
    once = own.groupBy("k", "gen").agg(F.min("at").alias("at"))
    return once.select("gen", F.xxhash64("k").alias("h"), "at"), rows


def probed(stream: DataFrame, known: DataFrame | None = None, key: str = "oid", order: str = "arrival", known_key: str = "oid", generations: int = GENERATIONS, bits: int = BITS, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Per key and generation its hash and first arrival, and whether earlier generations hold the key: (h, at, seen)."""
    once, rows = first_rows(stream, known, key, order, known_key, generations)
    shards = parts_for(rows, rows_per_shard, 8)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gen, h, at = pdf["gen"].to_numpy(), pdf["h"].to_numpy(dtype=np.int64), pdf["at"]
        parts = [pd.DataFrame({"h": h[took], "at": at.iloc[took].astype("Int64").to_numpy(), "seen": seen}) for g, took, seen, _ in _sealed(gen, h.view(np.uint64), bits) if g >= 0]
        return pd.concat(parts) if parts else pd.DataFrame({"h": [], "at": [], "seen": []})

    return once.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(run, "h bigint, at bigint, seen boolean")


def seen_before(stream: DataFrame, known: DataFrame | None = None, key: str = "oid", order: str = "arrival", known_key: str = "oid", generations: int = GENERATIONS, bits: int = BITS, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(order, seen) for every row of ``stream``.

    A null key is never seen. Rows of one key and one order value are one moment and get the same
    answer; rows whose order is null come after all others. An empty stream gives no row; an empty
    or missing ``known`` adds nothing. Other columns are not touched.
    """
    new = probed(stream, known, key, order, known_key, generations, bits, rows_per_shard).where(~F.col("seen")).select(F.col("h").alias("_h"), F.col("at").alias("_first"))
    base = _keys(stream.select(F.col(order), F.col(key)), key).select(F.col(order), F.xxhash64("k").alias("h"), F.col("k").isNotNull().alias("_has"))
    both = base.join(new, F.col("h").eqNullSafe(F.col("_h")) & F.col(order).cast("bigint").eqNullSafe(F.col("_first")), "left")
    return both.select(F.col(order), (F.col("_has") & F.col("_h").isNull()).alias("seen"))


def error_rates(stream: DataFrame, known: DataFrame | None = None, key: str = "oid", order: str = "arrival", known_key: str = "oid", generations: int = GENERATIONS, bits: int = BITS, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Per generation: keys probed and found new, bytes of the sealed filters, the compounded bound, and the measured rate.

    Measured: every key of a generation, turned into one that surely never occurred, is probed too;
    each confirmation of such a key is a wrong answer.
    """
    once, rows = first_rows(stream, known, key, order, known_key, generations)
    shards = parts_for(rows, rows_per_shard, 8)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gen, h = pdf["gen"].to_numpy(), pdf["h"].to_numpy().view(np.uint64)
        out = []
        for g, took, seen, filters in _sealed(gen, h, bits):
            strange = _mix(h[took], 91)
            wrong = np.zeros(len(took), dtype=bool)
            for f in filters:
                wrong |= f.holds(strange)
            out.append((g, len(took), int((~seen).sum()), len(filters), int(wrong.sum()), sum(f.slots.nbytes for f in filters)))
        return pd.DataFrame(out, columns=["generation", "keys", "new_keys", "filters", "wrong", "filter_bytes"])

    per = once.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(run, "generation int, keys bigint, new_keys bigint, filters int, wrong bigint, filter_bytes bigint")
    total = per.groupBy("generation").agg(F.sum("keys").alias("keys"), F.sum("new_keys").alias("new_keys"), F.max("filters").alias("filters"), F.sum("wrong").alias("wrong"), F.sum("filter_bytes").alias("filter_bytes"))
    return total.select(
        "generation", "keys", "new_keys", "filters", "filter_bytes", F.lit(bits).alias("fingerprint_bits"),
        (F.lit(1.0) - F.pow(F.lit(1.0 - 2.0**-bits), F.col("filters"))).alias("bound"),
        (F.col("wrong") / F.col("keys")).alias("measured"),
    )
