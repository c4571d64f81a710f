"""Ignore rules, attributes and path patterns over tables of paths.

Rules are configuration: lists on the driver, compiled once into one expression per column, so a
table of any size is only mapped over. Later rules win over earlier ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import glob_regex

#: What the built-in attribute macro stands for.
MACROS = {"binary": ["-diff", "-merge", "-text"]}


def parse_ignore(line: str, domain: str = "") -> dict | None:
    """One rule of an ignore file in folder ``domain``: regex over paths, whether it includes again, whether it is for folders only. None for blank and comment lines."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\)[ \t]+$", "", line)
    if not line or line.startswith("#"):
        return None
    include = line.startswith("!")
    body = line[1:] if include else line
    body = body[1:] if body[:2] in ("\\#", "\\!") else body
    folder = body.endswith("/")
    body = body.rstrip("/") if folder else body
    if not body:
        return None
    anchored = "/" in body
    rx = glob_regex(body.lstrip("/"))[1:-1]
    root = re.escape(domain.strip("/")) + "/" if domain.strip("/") else ""
    return {"regex": f"^{root}{rx}$" if anchored else f"^{root}(?:.*/)?{rx}$", "include": include, "folder": folder}


def parse_ignores(text: str, domain: str = "") -> list[dict]:
    return [r for r in (parse_ignore(x, domain) for x in text.split("\n")) if r]


def last_match(path: Column, is_dir: Column, rules: list[dict]) -> Column:
    """The number of the last rule that matches, or null."""
    hits = [F.when(path.rlike(r["regex"]) & (is_dir if r["folder"] else F.lit(True)), i) for i, r in enumerate(rules)]
    return F.greatest(*hits, F.lit(None).cast("int")) if len(hits) > 1 else hits[0] if hits else F.lit(None).cast("int")


def ignored(path: Column, rules: list[dict], is_dir: Column | None = None) -> Column:
    """Whether a path is ignored: it or a folder above it is excluded by the last rule that matches it. An excluded folder is final."""
    if not rules:
        return path.isNull() & F.lit(False)
    verdicts = F.array(*[F.lit(not r["include"]) for r in rules])
    parts = F.split(path, "/")
    self_dir = is_dir if is_dir is not None else F.lit(False)

    def excluded(k: Column) -> Column:
        prefix = F.array_join(F.slice(parts, F.lit(1), k), "/")
        at = last_match(prefix, (k < F.size(parts)) | self_dir, rules)
        return F.coalesce(F.get(verdicts, at), F.lit(False))

    return F.exists(F.sequence(F.lit(1), F.size(parts)), excluded)


def parse_attributes(text: str, domain: str = "") -> list[dict]:
    """Rules of an attributes file: a regex and the states it gives: name -> set, unset, unspecified or a value."""
    macros, out = dict(MACROS), []
    for line in text.split("\n"):
        words = line.strip().split()
        if not words or words[0].startswith("#"):
            continue
        if words[0].startswith("[attr]"):
            macros[words[0][6:]] = words[1:]
            continue
        states: dict[str, str] = {}

        def give(ws: list[str], seen: tuple = ()) -> None:
            for w in ws:
                name, state = (w[1:], "unset") if w[0] == "-" else (w[1:], "unspecified") if w[0] == "!" else (w.split("=", 1)[0], w.split("=", 1)[1]) if "=" in w else (w, "set")
                states[name] = state
                if state == "set" and name in macros and name not in seen:
                    give(macros[name], (*seen, name))

        give(words[1:])
        rule = parse_ignore(words[0], domain)
        if rule:
            out.append({"regex": rule["regex"], "states": states})
    return out


def attribute(path: Column, name: str, rules: list[dict]) -> Column:
    """The state of an attribute of a path by the last rule that speaks of it; "unspecified" if none does."""
    own = [r for r in rules if name in r["states"]]
    out = F.lit("unspecified")
    for r in own:
        out = F.when(path.rlike(r["regex"]), F.lit(r["states"][name])).otherwise(out)
    return F.when(path.isNotNull(), out)


def glob_match(path: Column, pattern: str) -> Column:
    """Whether a glob matches a path or a folder above it."""
    return path.rlike(glob_regex(pattern)[:-1] + "(?:/.*)?$")


def sparse(files: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """Files with ``skip``: true where none of the prefixes holds the path."""
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col(path).startswith(p)
    return files.withColumn("skip", ~keep)
