"""Scans, lookups and overlays over object and reference tables.

All functions keep nulls out of keys (a null id is no object), count repeated rows as the reference
semantics do (stated where it matters), give empty results for empty inputs and leave columns they
do not name alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions.runtime import Scratch
from .tables import RepoTables


def objects(t: RepoTables) -> DataFrame:
    """(oid, kind): every distinct object that any table shows, with its kind where one tells it."""
    known = [
        t.raw("commits").select("oid", F.lit("commit").alias("kind")), t.raw("commits").select(F.col("tree_oid").alias("oid"), F.lit("tree").alias("kind")), t.raw("documents").select(F.col("blob_oid").alias("oid"), F.lit("blob").alias("kind")),
        t.packs.select(F.lower(F.trim(F.regexp_replace("oid", r"\s", ""))).alias("oid"), F.when(F.col("obj_type").isin("commit", "tree", "blob", "tag"), F.col("obj_type")).alias("kind")),
    ]
    out = known[0]
    for k in known[1:]:
        out = out.unionByName(k)
    return out.where(F.col("oid").isNotNull()).groupBy("oid").agg(F.min("kind").alias("kind"))


def of_kind(all_objects: DataFrame, kind: str) -> DataFrame:
    """Objects of one kind; "any" takes all."""
    return all_objects if kind == "any" else all_objects.where(F.col("kind") == kind)


def lookup(ids: DataFrame, store: DataFrame, key: str = "oid") -> tuple[DataFrame, DataFrame]:
    """(found, missing): ids joined with their objects in the ids' order column, and ids without one. Ids repeat in ``found`` as given."""
    return ids.join(store, key), ids.where(F.col(key).isNotNull()).join(store.select(key), key, "left_anti")


def by_priority(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """One row per key: the one of the smallest priority (loose before packed before alternates). Pre-aggregated, so hot keys are harmless."""
    rest = [c for c in rows.columns if c not in (key, priority)]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(priority, *rest)).alias("_r"), F.min(priority).alias(priority)).select(key, priority, "_r.*")


def overlay(upper: DataFrame, lower: DataFrame, key: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """Rows of ``upper``, and those of ``lower`` whose key it does not have; names in ``deleted`` are gone from both."""
    out = upper.unionByName(lower.join(upper.select(*key), key, "left_anti"))
    return out if deleted is None else out.join(deleted.select(*key), key, "left_anti")


def prefix_matches(store: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For prefixes (prefix): (prefix, n, oid): how many distinct objects begin with it, and the object if it is the only one.

    Objects are first cut down by the shortest length that occurs; only what is left is joined on
    the prefix of each length, so no pairs are formed by comparison.
    """
    sizes = sorted(r[0] for r in prefixes.where(F.col("prefix").isNotNull()).select(F.length("prefix")).distinct().collect())  # at most as many as an id has digits
    if not sizes:
        return prefixes.distinct().select("prefix", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("oid"))
    each = F.explode(F.array(*[F.substring("oid", 1, k) for k in sizes]))
    short = prefixes.where(F.col("prefix").isNotNull()).select(F.substring("prefix", 1, sizes[0]).alias("_s")).distinct()
    near = store.where(F.col("oid").isNotNull()).select("oid", F.substring("oid", 1, sizes[0]).alias("_s")).join(short, "_s", "left_semi")
    cut = near.select("oid").distinct().select(each.alias("prefix"), "oid").distinct().join(prefixes.select("prefix").distinct(), "prefix", "left_semi")
    found = cut.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("oid").alias("oid"))
    return prefixes.distinct().join(found, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("oid")).alias("oid"))


#: Fixed value: the most references that are followed from one to the next.
MOST_HOPS = 1024


def resolve_symbolic(refs: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """(repo, name, oid, hops): every reference followed to an id; those that end nowhere, run in a circle or exceed ``hops`` have a null oid.

    A round follows only references that are still open, so rounds are as many as the longest chain has links.
    """
    scratch = Scratch(refs.sparkSession, "symbolic")
    plain = scratch.save(refs.select(F.col("repo").alias("r2"), F.col("name").alias("n2"), F.col("oid").alias("o2"), F.col("target").alias("t2")))
    out = refs.where("oid IS NOT NULL OR target IS NULL").select("repo", "name", "oid", F.lit(0).alias("hops"))
    state = refs.where("oid IS NULL AND target IS NOT NULL").select("repo", "name", "target", F.lit(0).alias("hops"), F.array(F.col("name")).alias("way"))
    for _ in range(hops):
        step = scratch.save(state.join(plain, (state["repo"] == plain["r2"]) & (state["target"] == plain["n2"]), "left"))
        n = F.col("hops") + F.col("n2").isNotNull().cast("int")
        open_ = F.col("o2").isNull() & F.col("t2").isNotNull() & ~F.array_contains("way", F.col("target"))
        out = out.unionByName(step.where(~open_).select("repo", "name", F.col("o2").alias("oid"), n.alias("hops")))
        state = scratch.save(step.where(open_).select("repo", "name", F.col("t2").alias("target"), n.alias("hops"), F.array_append("way", F.col("target")).alias("way")))
        if state.isEmpty():
            break
    out = out.unionByName(state.select("repo", "name", F.lit(None).cast("string").alias("oid"), "hops"))
    return out.select("repo", "name", "oid", F.col("hops").cast("bigint").alias("hops"))


def expand_names(wanted: DataFrame, refs: DataFrame) -> DataFrame:
    """For wanted (repo, short): (repo, short, name, oid) of the first search rule that names a reference."""
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.format_string(p.replace("{}", "%s"), F.col("short")).alias("name")) for i, p in enumerate(N.SEARCH)])
    tried = wanted.select("repo", "short", F.explode(rules).alias("x")).select("repo", "short", "x.rule", "x.name").join(refs.select("repo", "name", "oid"), ["repo", "name"])
    return tried.groupBy("repo", "short").agg(F.min_by(F.struct("name", "oid"), "rule").alias("x")).select("repo", "short", "x.name", "x.oid")


def match_specs(refs: DataFrame, specs: DataFrame) -> DataFrame:
    """References joined with the refspecs (repo, spec) of their repository that match: (repo, name, oid, spec, dst, force)."""
    both = refs.select("repo", "name", "oid").join(specs.select("repo", "spec"), "repo").where(N.spec_match(F.col("spec"), F.col("name")))
    return both.select("repo", "name", "oid", "spec", N.spec_dst(F.col("spec"), F.col("name")).alias("dst"), N.spec_force(F.col("spec")).alias("force"))


def rewrite_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For urls (url): (url, rewritten) by the rule (ord, prefix, replacement) of the longest prefix, the first of equals.

    Rules are a handful of configuration rows: they are compiled into one expression, longest prefix first.
    """
    out = F.col("url")
    for r in sorted(rules.select("ord", "prefix", "replacement").collect(), key=lambda r: (len(r["prefix"]), -r["ord"])):
        out = F.when(F.col("url").startswith(r["prefix"]), F.concat(F.lit(r["replacement"]), F.substring(F.col("url"), F.lit(len(r["prefix"]) + 1), F.length("url")))).otherwise(out)
    return urls.select("url", out.alias("rewritten"))


def update_plan(local: DataFrame, remote: DataFrame, specs: DataFrame) -> DataFrame:
    """(repo, name, dst, old_oid, new_oid, action): what a push of local references by refspecs would change on the remote side."""
    want = match_specs(local, specs)
    have = remote.select(F.col("repo").alias("r2"), F.col("name").alias("n2"), F.col("oid").alias("old_oid"))
    both = want.join(have, (want["repo"] == have["r2"]) & (want["dst"] == have["n2"]), "left")
    return both.where(F.col("oid").isNotNull() & (F.col("old_oid").isNull() | (F.col("old_oid") != F.col("oid")))).select("repo", "name", "dst", "old_oid", F.col("oid").alias("new_oid"), F.when(F.col("old_oid").isNull(), "create").when(F.col("force"), "force").otherwise("update").alias("action"))


def prune_plan(local: DataFrame, remote: DataFrame, specs: DataFrame) -> DataFrame:
    """(repo, name): local references that a refspec's destination covers and no remote reference maps to."""
    back = specs.select("repo", N.spec_reverse(F.col("spec")).alias("spec"))
    covered = match_specs(local, back)
    there = remote.select("repo", F.col("name").alias("dst"))
    return covered.join(there, ["repo", "dst"], "left_anti").select("repo", "name").distinct()


def reflog_links(reflog: DataFrame) -> DataFrame:
    """Log rows with whether each follows the one before: (…, gap, out_of_order)."""
    w = Window.partitionBy("repo", "ref_name").orderBy("seq")
    return reflog.withColumn("_p", F.lag("new_oid").over(w)).withColumn("_t", F.lag("committer_when").over(w)).withColumn("gap", F.col("_p").isNotNull() & ~F.col("_p").eqNullSafe(F.col("old_oid"))).withColumn("out_of_order", F.coalesce(F.col("_t") > F.col("committer_when"), F.lit(False))).drop("_p", "_t")


def at_time(reflog: DataFrame, when) -> DataFrame:
    """(repo, ref_name, oid): what each reference pointed to at a time, by its log."""
    return reflog.where(F.col("committer_when") <= F.lit(when)).groupBy("repo", "ref_name").agg(F.max_by("new_oid", F.struct("committer_when", "seq")).alias("oid"))
