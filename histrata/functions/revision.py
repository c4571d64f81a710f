"""Revision expressions: parsing, and resolution over a commit graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"~(\d*)|\^\{/((?:[^{}\\]|\\.)*)\}|\^(\d*)")


def parse(text: str) -> list[tuple[str, object]]:
    """Steps of a revision: ("ref", name), ("~", n), ("^", n) with n at most 2, ("^{/", regex; a leading ! negates). Other forms are refused."""
    m = re.match(r"^(?:@|[^~^:{}\s\\?*\[]+)", text)
    if not m or "@{" in text or ":" in text or m.group().endswith(".lock") or ".." in m.group():
        raise ValueError(f"unsupported revision {text!r}")
    name = "HEAD" if m.group() == "@" else m.group()
    steps: list[tuple[str, object]] = [("ref", name)]
    at = m.end()
    while at < len(text):
        s = _STEP.match(text, at)
        if not s:
            raise ValueError(f"unsupported revision {text!r}")
        if s.group().startswith("~"):
            steps.append(("~", int(s.group(1)) if s.group(1) else 1))
        elif s.group(2) is not None:
            steps.append(("^{/", s.group(2)))
        else:
            n = int(s.group(3)) if s.group(3) else 1
            if n > 2:
                raise ValueError("a parent number above 2")
            steps.append(("^", n))
        at = s.end()
    return steps


def resolve(forest, commits: DataFrame, refs: DataFrame, repo: str, text: str) -> DataFrame:
    """(oid) of the commit a revision names, or no row. A full or unique partial id goes before a reference name.

    ``~n`` is read off the stored path to the root; ``^{/re}`` takes the newest reachable commit
    (committer time, then id) whose message contains the pattern.
    """
    from ..operators.scans import expand_names, prefix_matches, resolve_symbolic

    spark = refs.sparkSession
    steps = parse(text)
    name = str(steps[0][1])
    own = commits.where(F.col("repo") == repo)
    found = None
    if re.fullmatch(r"[0-9a-f]{4,64}", name):
        hit = prefix_matches(own.select("oid"), spark.createDataFrame([(name,)], "prefix string")).where("n = 1").select("oid")
        if not hit.isEmpty():
            found = hit
    if found is None:
        wanted = spark.createDataFrame([(repo, name)], "repo string, short string")
        full = expand_names(wanted, resolve_symbolic(refs))
        found = full.select("oid").where("oid IS NOT NULL")
    for op, arg in steps[1:]:
        if op == "~":
            at = forest.paths_of(found).where(F.col("depth") >= arg)
            found = at.select(F.element_at("path", F.col("depth").cast("int") + 1 - int(arg)).alias("oid"))
        elif op == "^":
            if arg:
                e = forest.edges.where(F.col("ord") == int(arg) - 1)
                found = found.join(e, found["oid"] == e["child"]).select(F.col("parent").alias("oid"))
        else:
            pattern, negate = (str(arg)[1:], True) if str(arg).startswith("!-") is False and str(arg).startswith("!") else (str(arg), False)
            reach = forest.closure(found.select(F.lit("x").alias("label"), "oid")).select("oid")
            hit = reach.join(own, "oid").where(F.coalesce(F.col("message"), F.lit("")).rlike(pattern) != F.lit(negate))
            found = hit.orderBy(F.desc("committer_when"), F.desc("oid")).limit(1).select("oid")
    return found
