"""Search in contents, line differences, patches, statistics and blame."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch
from .list_ranking import list_rank

#: Constructs that not all regular-expression engines have.
_OUTSIDE = re.compile(r"\(\?[=!<]|\(\?>|\\[1-9]|[*+?}]\+")


def portable(pattern: str) -> str:
    """The pattern, refused if it looks around, refers back, or is possessive."""
    if _OUTSIDE.search(pattern):
        raise ValueError(f"not portable: {pattern}")
    re.compile(pattern)
    return pattern


def grep(files: DataFrame, patterns: list[str], paths: list[str] = (), invert: bool = False, text: str = "text") -> DataFrame:
    """``files`` (with path and a text) as matching lines: their columns without the text, line_no (from 1) and content.

    A line matches if any pattern is found; inverted, if any pattern is not found; no pattern, no
    line. Lines are what lies between line breaks, so a final break makes an empty last line.
    ``paths``: regular expressions of which one must be found in the path. Null texts have no lines.
    """
    tests = [F.col("content").rlike(portable(p)) for p in patterns]
    keep = files
    if paths:
        keep = keep.where(F.exists(F.array(*[F.col("path").rlike(portable(p)) for p in paths]), lambda x: x))
    if not invert:
        keep = keep.where(F.exists(F.array(*[F.col(text).rlike("(?m)" + p) for p in patterns]), lambda x: x)) if patterns else keep.where(F.lit(False))
    cols = [c for c in files.columns if c != text]
    lines = keep.select(*cols, F.posexplode(F.split(text, "\n", -1)).alias("_n", "content"))
    hit = F.lit(False)
    for x in tests:
        hit = hit | (~x if invert else x)
    return lines.where(hit).select(*cols, (F.col("_n") + 1).cast("bigint").alias("line_no"), "content")


def line_script(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """A shortest script from a to b by the greedy O(ND) algorithm: ("=", i, j), ("-", i, j) or ("+", i, j) in order."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(x), len(y)
    middle: list[tuple[str, int, int]] = []
    if n and m:
        number: dict[str, int] = {}
        xs, ys = [number.setdefault(v, len(number)) for v in x], [number.setdefault(v, len(number)) for v in y]
        far, trace = {1: 0}, []
        for d in range(n + m + 1):
            trace.append(dict(far))
            done = False
            for k in range(-d, d + 1, 2):
                i = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
                j = i - k
                while i < n and j < m and xs[i] == ys[j]:
                    i, j = i + 1, j + 1
                far[k] = i
                if i >= n and j >= m:
                    done = True
                    break
            if done:
                break
        i, j = n, m
        for d in range(len(trace) - 1, -1, -1):
            far, k = trace[d], i - j
            back = k + 1 if k == -d or (k != d and far[k - 1] < far[k + 1]) else k - 1
            pi = far[back] if d else 0
            pj = pi - back if d else 0
            while i > pi and j > pj and (i > 0 and j > 0) and xs[i - 1] == ys[j - 1]:
                i, j = i - 1, j - 1
                middle.append(("=", i, j))
            if d:
                if i == pi:
                    j -= 1
                    middle.append(("+", i, j))
                else:
                    i -= 1
                    middle.append(("-", i, j))
        middle.reverse()
    else:
        middle = [("-", i, 0) for i in range(n)] + [("+", n, j) for j in range(m)]
    out = [("=", i, i) for i in range(start)]
    out += [(op, i + start, j + start) for op, i, j in middle]
    return out + [("=", len(a) - end + k, len(b) - end + k) for k in range(end)]


def split_lines(text: str | None) -> list[str]:
    """Lines with their line breaks; the last may lack one."""
    return re.findall(r"[^\n]*\n|[^\n]+", text) if text else []


def unified(a: str | None, b: str | None, name_a: str, name_b: str, context: int = 3) -> str:
    """The unified text of a difference; empty for equal contents."""
    x, y = split_lines(a), split_lines(b)
    script = line_script(x, y)
    changed = [k for k, (op, _, _) in enumerate(script) if op != "="]
    if not changed:
        return ""
    out = [f"--- {name_a}\n+++ {name_b}\n"]
    groups, first, last = [], changed[0], changed[0]
    for k in changed[1:] + [None]:
        if k is None or k - last > 2 * context + 1:
            groups.append((max(0, first - context), min(len(script), last + context + 1)))
            first = k
        last = k
    for s, e in groups:
        part = script[s:e]
        na, nb = sum(op != "+" for op, _, _ in part), sum(op != "-" for op, _, _ in part)
        ia, ib = part[0][1], part[0][2]
        span = lambda i, n: f"{i + (n > 0)}" + (f",{n}" if n != 1 else "")
        out.append(f"@@ -{span(ia, na)} +{span(ib, nb)} @@\n")
        for op, i, j in part:
            line = y[j] if op == "+" else x[i]
            out.append({"=": " ", "-": "-", "+": "+"}[op] + line + ("" if line.endswith("\n") else "\n\\ No newline at end of file\n"))
    return "".join(out)


def diff_chunks(old: Column, new: Column) -> Column:
    """The line difference of two texts as chunks (op, text): "=", "-" and "+" runs in order. Null is the empty text."""

    @F.pandas_udf("array<struct<op:string,text:string>>")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in it:
            out = []
            for x, y in zip(map(split_lines, a), map(split_lines, b)):
                chunks: list[dict] = []
                for op, i, j in line_script(x, y):
                    t = y[j] if op == "+" else x[i]
                    if chunks and chunks[-1]["op"] == op:
                        chunks[-1]["text"] += t
                    else:
                        chunks.append({"op": op, "text": t})
                out.append(chunks)
            yield pd.Series(out)

    return run(old, new)


def side(chunks: Column, which: str) -> Column:
    """One side of a difference put together again: "old" or "new"."""
    drop = "+" if which == "old" else "-"
    return F.array_join(F.transform(F.filter(chunks, lambda c: c["op"] != drop), lambda c: c["text"]), "")


def line_stats(old: Column, new: Column) -> Column:
    """(addition, deletion): lines added and deleted, a last line without break included."""

    @F.pandas_udf("addition bigint, deletion bigint")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in it:
            rows = []
            for x, y in zip(map(split_lines, a), map(split_lines, b)):
                ops = [op for op, _, _ in line_script(x, y)]
                rows.append((ops.count("+"), ops.count("-")))
            yield pd.DataFrame(rows, columns=["addition", "deletion"])

    return run(old, new)


def unified_text(old: Column, new: Column, name_a: Column, name_b: Column, context: int = 3) -> Column:
    @F.pandas_udf("string")
    def run(it: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, p, q in it:
            yield pd.Series([unified(*x, context=context) for x in zip(a, b, p, q)])

    return run(old, new, name_a, name_b)


def blame(versions: DataFrame, links: DataFrame) -> DataFrame:
    """For versions (ver BIGINT, text) and links (ver, ord, parent): (ver, line_no, text, origin): the version each line of each version came from.

    Every version is compared with its parents; a line that a parent has unchanged points to it
    (the first such parent), and the ends of these pointers, found by list ranking, are the
    origins. No history is walked by one task. Lines are numbered from 1, as many as there are.
    """
    scratch = Scratch(versions.sparkSession, "blame")
    v = versions.select("ver", "text")
    pairs = links.where(F.col("parent").isNotNull()).join(v, "ver").join(v.select(F.col("ver").alias("parent"), F.col("text").alias("before")), "parent")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for ver, o, parent, new, old in zip(pdf["ver"], pdf["ord"], pdf["parent"], pdf["text"], pdf["before"]):
                rows += [(ver, j, o, parent, i) for op, i, j in line_script(split_lines(old), split_lines(new)) if op == "="]
            yield pd.DataFrame(rows, columns=["ver", "n", "ord", "parent", "m"])

    kept = pairs.select("ver", "ord", "parent", "text", "before").mapInPandas(run, "ver bigint, n int, ord int, parent bigint, m int").groupBy("ver", "n").agg(F.min_by(F.struct("parent", "m"), "ord").alias("from"))
    lines = v.select("ver", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))).alias("n", "line")).withColumn("e", F.monotonically_increasing_id())
    lines = scratch.save(lines)
    number = lines.select(F.col("ver").alias("pv"), F.col("n").alias("pn"), F.col("e").alias("nxt"))
    kept = kept.select("ver", "n", F.col("from.parent").alias("pv"), F.col("from.m").alias("pn")).join(number, ["pv", "pn"]).join(lines.select("ver", "n", "e"), ["ver", "n"]).select("e", "nxt")
    ranked = list_rank(lines.select("e").join(kept, "e", "left").select("e", "nxt", F.lit(0).alias("w")), scratch)
    origin = lines.select(F.col("e").alias("last"), F.col("ver").alias("origin"))
    return lines.join(ranked, "e").join(origin, "last").select("ver", (F.col("n") + 1).cast("bigint").alias("line_no"), F.rtrim(F.col("line"), F.lit("\n")).alias("text"), "origin")
