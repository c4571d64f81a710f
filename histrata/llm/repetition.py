"""Repetition inside single documents, and risk-controlled cutoffs on it.

``measure`` gives for every document its words and how many of them are repeated: words are the
runs of letters and underscores of the lower-cased text without digits, and a word is repeated if
it lies in a sequence of four words that already began earlier in the document. It works on whole
texts, batch by batch, without any shuffle: words of a batch become numbers, four-word sequences
become numbers by exact pairing, and repeats are found by one hash pass.

``cutoffs`` chooses, per stratum, the lowest cutoff on a cheap score for which labelled holdout rows
prove a limited share of false rejections: the exact binomial tail P(X <= k | n, alpha) is a valid
p-value for "the rate is above alpha", cutoffs are tested from the strictest down and testing ends
at the first failure (fixed sequence), and the level is divided by the number of strata
(Bonferroni), so with probability 1 - delta all chosen cutoffs hold at once. The score is
``line_share``, the share of lines that occurred before, which built-in functions compute; the
labels are the definition's, from the words, so neither follows from the other. ``risk`` measures the
cutoffs on rows that had no part in choosing them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch

#: The length of a repeated sequence, and the share from which a document counts as repetitive.
GRAM = 4
SHARE = (2, 5)
#: Risk control: the allowed rate of false rejections, the error probability, candidate cutoffs, the holdout's part.
ALPHA, DELTA = 0.02, 0.05
GRID = tuple(round(0.02 * k, 2) for k in range(1, 51))
HOLDOUT_ONE_IN = 2
#: The score that cutoffs are on.
SCORE = "line_share"
#: Characters worked on at once; an Arrow batch of long texts is taken in pieces.
CHARS_AT_ONCE = 4_000_000

_DIGITS, _WORD = re.compile(r"\d+"), re.compile(r"[^\W\d]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text, as defined above; none for null."""
    return _WORD.findall(_DIGITS.sub("", text.lower())) if text else []


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers for pairs of numbers, equal only for equal pairs."""
    return pd.factorize(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b)[0]


def repeated_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words and repeated words of each text."""
    lists = [words_of(t) for t in texts]
    n = np.array([len(x) for x in lists], dtype=np.int64)
    total = int(n.sum())
    if total < GRAM:
        return n, np.zeros(len(n), dtype=np.int64)
    ids = pd.factorize(np.array([w for x in lists for w in x], dtype=object))[0]
    doc = np.repeat(np.arange(len(n)), n)
    two = _pair(ids[:-1], ids[1:])
    four = _pair(two[:-2], two[2:])
    inside = doc[: total - GRAM + 1] == doc[GRAM - 1 :]
    start = np.flatnonzero(inside)
    again = start[pd.Series(_pair(four[start], doc[start])).duplicated().to_numpy()]
    step = np.zeros(total + 1, dtype=np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + GRAM, -1)
    covered = np.cumsum(step[:-1]) > 0
    return n, np.bincount(doc[covered], minlength=len(n)).astype(np.int64)


def pieces_of(texts: list[str | None], chars: int = CHARS_AT_ONCE) -> Iterator[list[str | None]]:
    """The texts in order, in lists of at most so many characters (or of one text); one empty list for none."""
    part: list[str | None] = []
    held = 0
    for t in texts:
        if part and held + len(t or "") > chars:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t or "")
    yield part


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with words, repeated, share and line_share.

    ``line_share`` is the share of non-blank lines that occurred before in the document. A null or
    empty text and one of fewer than four words has share 0. Repeated rows are measured each by
    itself; other columns pass through.
    """
    keep = [c for c in docs.columns if c != text and c not in ("words", "repeated", "share", "line_share")]

    @F.pandas_udf("words bigint, repeated bigint")
    def counted(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            parts = [repeated_counts(x) for x in pieces_of(s.tolist())]
            yield pd.DataFrame({"words": np.concatenate([n for n, _ in parts]), "repeated": np.concatenate([r for _, r in parts])})

    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    line_share = F.when(F.size(lines) > 0, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0)
    out = docs.select(*keep, line_share.alias("line_share"), counted(F.col(text)).alias("_m"))
    return out.select(*keep, F.col("_m.words").alias("words"), F.col("_m.repeated").alias("repeated"), F.when(F.col("_m.words") > 0, F.col("_m.repeated") / F.col("_m.words")).otherwise(0.0).alias("share"), "line_share")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly."""
    if n == 0 or p <= 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact (Clopper-Pearson) upper bound on a rate after k of n cases, wrong with probability ``level``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > level else (low, mid)
    return high


def cutoffs(labelled: DataFrame, stratum: str, score: str, wanted: str, grid: tuple[float, ...] = GRID, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, good, cutoff or null, false_rejections, bound) per stratum, from labelled rows.

    ``wanted`` marks rows that must not be rejected. Rows are counted in the cluster, and each
    stratum's counts are judged there; only the number of strata reaches the driver. A null stratum
    is a stratum of its own; rows with a null score or label prove nothing and are left out; no
    rows, no strata.
    """
    kind = dict(labelled.dtypes)[stratum]
    good = labelled.where(F.col(score).isNotNull() & F.col(wanted))
    counts = good.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum((F.col(score) >= c).cast("bigint")) for c in grid]).alias("k"))
    strata = good.select(stratum).distinct().count()

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for name, n, ks in zip(pdf["stratum"], pdf["n"], pdf["k"]):
                level, best = delta / strata, None
                for i in sorted(range(len(grid)), key=lambda i: -grid[i]):
                    if binomial_tail(int(ks[i]), int(n), alpha) > level:
                        break
                    best = i
                k = int(ks[best if best is not None else len(grid) - 1])
                out.append((name, n, grid[best] if best is not None else None, k, upper_bound(k, int(n), level)))
            yield pd.DataFrame(out, columns=["stratum", "good", "cutoff", "false_rejections", "bound"])

    found = counts.mapInPandas(judge, f"stratum {kind}, good bigint, cutoff double, false_rejections bigint, bound double")
    return found.withColumnRenamed("stratum", stratum)


def repeats(words: str = "words", repeated: str = "repeated"):
    """Whether at least two fifths of the words are repeated."""
    return (F.col(words) > 0) & (F.col(repeated) * SHARE[1] >= F.col(words) * SHARE[0])


def holdout(measured: DataFrame, key: str, one_in: int = HOLDOUT_ONE_IN, part: int = 0) -> DataFrame:
    """The rows of one hash part of ``one_in``, labelled by the definition (``wanted``: fewer than two fifths repeated)."""
    return measured.where(F.pmod(F.xxhash64(key, F.lit(8)), F.lit(one_in)) == part).withColumn("wanted", ~repeats())


def judged(docs: DataFrame, key: str = "doc_id", stratum: str = "doc_kind") -> DataFrame:
    """(key, stratum, words, repeated, share, line_share, cutoff, rejected): every document with its stratum's cutoff; ``rejected``: its score reaches it.

    A stratum whose holdout proves no cutoff has none, and nothing of it is rejected.
    """
    scored = Scratch(docs.sparkSession, "repetition").save(measure(docs.select(key, stratum, "text")))
    found = cutoffs(holdout(scored, key), stratum, SCORE, "wanted").select(F.col(stratum).alias("_stratum"), "cutoff")
    both = scored.join(found, scored[stratum].eqNullSafe(found["_stratum"]), "left")
    return both.select(key, stratum, "words", "repeated", "share", SCORE, "cutoff", F.coalesce(F.col(SCORE) >= F.col("cutoff"), F.lit(False)).alias("rejected"))


def repetitive(docs: DataFrame, key: str = "doc_id", stratum: str = "doc_kind") -> DataFrame:
    """(key, words, repeated, share, step): the documents with at least two fifths repeated words.

    ``step`` is "cutoff" where the certified cutoff on the cheap score rejects the document and the
    exact check agrees, and "check" where the exact check alone finds it: a cutoff limits false
    rejections, not omissions, and no repetitive document may be lost.
    """
    return judged(docs, key, stratum).where(repeats()).select(key, "words", "repeated", "share", F.when(F.col("rejected"), "cutoff").otherwise("check").alias("step"))


def risk(docs: DataFrame, key: str = "doc_id", stratum: str = "doc_kind") -> DataFrame:
    """Per stratum the cutoff and, on rows outside the holdout, how many must not be rejected, are rejected all the same, and how many repetitive ones it catches."""
    rest = judged(docs, key, stratum).where(F.pmod(F.xxhash64(key, F.lit(8)), F.lit(HOLDOUT_ONE_IN)) != 0).withColumn("_r", repeats())
    c = lambda x: F.count(F.when(x, 1))
    return rest.groupBy(stratum, "cutoff").agg(c(~F.col("_r")).alias("good"), c(~F.col("_r") & F.col("rejected")).alias("false_rejections"), c(F.col("_r")).alias("repetitive"), c(F.col("_r") & F.col("rejected")).alias("caught"))
