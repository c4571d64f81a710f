"""Set questions, filters and guarded plans: what a fetch, push, prune or pick would do, as tables. Nothing is changed anywhere.

Null ids are no objects and drop out of every set; repeated rows stay where the meaning is that of
a list (``difference``) and count once where it is that of a set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions.runtime import Scratch
from .graph import Forest
from .tables import RepoTables


def difference(a: DataFrame, b: DataFrame, key: str = "oid") -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``; repetitions in ``a`` stay."""
    return a.join(b.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def is_subset(needle: DataFrame, hay: DataFrame, key: str = "oid") -> bool:
    return needle.where(F.col(key).isNotNull()).join(hay, key, "left_anti").isEmpty()


def object_filter(objects: DataFrame, spec: str) -> DataFrame:
    """Objects (oid, type, size, depth) that a filter expression keeps.

    ``blob:none``, ``blob:limit=<n>[k|m|g]`` (smaller blobs stay), ``tree:<depth>``,
    ``object:type=<kind>``, and ``combine:<a>+<b>``, which keeps what all parts keep.
    """
    if spec.startswith("combine:"):
        for part in spec[8:].split("+"):
            objects = object_filter(objects, part)
        return objects
    t = F.col("type")
    if spec == "blob:none":
        return objects.where(t != "blob")
    if spec.startswith("blob:limit="):
        n = spec[11:].lower()
        size = int(n[:-1]) << {"k": 10, "m": 20, "g": 30}[n[-1]] if n[-1:] in ("k", "m", "g") else int(n)
        return objects.where((t != "blob") | (F.col("size") < size))
    if spec.startswith("tree:"):
        return objects.where(~t.isin("tree", "blob") | (F.col("depth") < int(spec[5:])))
    if spec.startswith("object:type="):
        return objects.where(t == spec[12:])
    raise ValueError(f"unknown filter {spec!r}")


def filtered_levels(t: RepoTables, starts: DataFrame, valid: Column, stop: Column, depth: int, scratch: Scratch) -> DataFrame:
    """(label, oid, level) of a breadth-first walk that lists what is ``valid`` and does not go beyond what ``stop`` holds of; both are conditions on commit columns."""
    flags = scratch.save(t.slim.select("oid", F.coalesce(valid, F.lit(False)).alias("_v"), F.coalesce(stop, F.lit(False)).alias("_s")))
    edges = scratch.save(t.edges.select("child", "parent").distinct())
    new = scratch.save(starts.select("label", "oid").distinct().join(flags, "oid").select("label", "oid", F.lit(0).alias("level"), "_v", "_s"))
    seen = new
    for level in range(1, depth + 1):
        up = new.where("NOT _s").join(edges, new["oid"] == edges["child"]).select("label", F.col("parent").alias("oid")).distinct().join(flags, "oid")
        new = scratch.save(up.join(seen.select("label", "oid"), ["label", "oid"], "left_anti").select("label", "oid", F.lit(level).alias("level"), "_v", "_s"))
        if new.isEmpty():
            break
        seen = scratch.save(seen.unionByName(new))
    return seen.where("_v").select("label", "oid", "level")


def whole_filtered_levels(t: RepoTables, starts: DataFrame, valid: Column, stop: Column) -> DataFrame:
    """The walk of ``filtered_levels`` over the whole history: what ``stop`` holds of counts as without parents."""
    shown = t.slim.where(F.coalesce(valid, F.lit(False))).select("oid")
    return Forest(t, stop).levels(starts).join(shown, "oid", "left_semi").select("label", "oid", "level")


def objects_of(commits: DataFrame, trees: DataFrame, entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, oid, type): commits (label, oid), their trees (oid, tree_oid), and all that hangs below by entries (tree_oid, mode, oid); submodules are passed over."""
    new = scratch.save(commits.join(trees, "oid").select("label", F.col("tree_oid").alias("oid")).distinct())
    out = commits.select("label", "oid", F.lit("commit").alias("type")).unionByName(new.select("label", "oid", F.lit("tree").alias("type")))
    seen = new
    while True:
        below = new.join(entries.where("mode <> 57344").withColumnRenamed("oid", "_o"), new["oid"] == entries["tree_oid"]).select("label", F.col("_o").alias("oid"), F.when(F.col("mode") == 16384, "tree").otherwise("blob").alias("type")).distinct()
        below = scratch.save(below.join(seen.select("label", "oid"), ["label", "oid"], "left_anti"))
        out = out.unionByName(below)
        new = scratch.save(below.where("type = 'tree'").select("label", "oid"))
        if new.isEmpty():
            break
        seen = scratch.save(seen.select("label", "oid").unionByName(new))
    return out.distinct()


def new_objects(files: DataFrame, parents: DataFrame) -> DataFrame:
    """(tree, path, blob): files (tree, path, blob) that no parent tree (tree, parent) has under the same path."""
    old = parents.join(files.select(F.col("tree").alias("parent"), "path", "blob"), "parent").select("tree", "path", "blob")
    return files.select("tree", "path", "blob").join(old, ["tree", "path", "blob"], "left_anti")


def peel(tags: DataFrame, starts: DataFrame) -> DataFrame:
    """(oid, target, target_type): what starts (oid) come to when tags (oid, target_oid, target_type) are followed to the end; no tag stays itself with a null type.

    Chains may have any length; tags that point to each other in a circle have a null target.
    """
    scratch = Scratch(tags.sparkSession, "peel")
    state = starts.select("oid", F.col("oid").alias("target"), F.lit(None).cast("string").alias("target_type"), F.array(F.col("oid")).alias("way"))
    chain = scratch.save(tags.select(F.col("oid").alias("_o"), "target_oid", F.col("target_type").alias("_t")).where("target_oid IS NOT NULL"))
    done = None
    while True:
        j = scratch.save(state.join(chain, state["target"] == chain["_o"], "left"))
        ended = j.where("_o IS NULL").select("oid", "target", "target_type")
        circle = j.where(F.array_contains("way", F.col("target_oid"))).select("oid", F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("target_type"))
        done = ended.unionByName(circle) if done is None else done.unionByName(ended).unionByName(circle)
        state = scratch.save(j.where(~F.array_contains("way", F.col("target_oid"))).select("oid", F.col("target_oid").alias("target"), F.col("_t").alias("target_type"), F.array_append("way", F.col("target_oid")).alias("way")))
        if state.isEmpty():
            return done


def reachable_tags(tags: DataFrame, objects: DataFrame) -> DataFrame:
    """(oid): tag objects whose peeled target is in ``objects`` (oid)."""
    p = peel(tags, tags.select("oid"))
    return p.join(objects.select(F.col("oid").alias("target")).distinct(), "target", "left_semi").select("oid")


def newest_haves(forest: Forest, refs: DataFrame, k: int = 100) -> DataFrame:
    """(repo, name, oid): up to ``k`` first-parent ancestors of every reference (repo, name, oid), nearest first: what a client says it has."""
    p = refs.join(forest.paths_of(refs), "oid")
    return p.select("repo", "name", F.explode(F.slice("path", F.greatest(F.lit(1), F.size("path") - (k - 1)), F.lit(k))).alias("oid"))


def boundary_by_date(t: RepoTables, reach: DataFrame, since) -> DataFrame:
    """(label, oid, shallow): commits of ``reach`` (label, oid) since a time; those with an older or missing parent are the boundary."""
    inside = reach.join(t.slim.where(F.col("committer_when") >= F.lit(since)).select("oid"), "oid").select("label", "oid")
    up = inside.join(t.edges.select(F.col("child").alias("oid"), "parent"), "oid")
    cut = up.join(inside.select("label", F.col("oid").alias("parent")), ["label", "parent"], "left_anti").select("label", "oid").distinct().withColumn("_c", F.lit(True))
    return inside.join(cut, ["label", "oid"], "left").select("label", "oid", F.coalesce("_c", F.lit(False)).alias("shallow"))


def unshallowed(before: DataFrame, boundary: DataFrame, view: DataFrame) -> DataFrame:
    """(oid): former boundary commits that the new view holds and that are no boundary any more."""
    return before.select("oid").distinct().join(view.select("oid"), "oid", "left_semi").join(boundary.select("oid"), "oid", "left_anti")


def fast_forward(is_ancestor: Column, hit_boundary: Column) -> Column:
    """Whether an update is taken as fast-forward: the old tip is an ancestor, or the history ends before that can be told."""
    return is_ancestor | hit_boundary


def fetch_plan(local: DataFrame, fetched: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(repo, dst, old_oid, new_oid, action) for fetched references (repo, dst, oid, force): "new", "fast-forward", "forced", "rejected".

    ``ancestors``: (a, b, is_ancestor) of old and new ids.
    """
    have = local.select("repo", F.col("name").alias("dst"), F.col("oid").alias("old_oid"))
    j = fetched.join(have, ["repo", "dst"], "left").where(~F.col("oid").eqNullSafe(F.col("old_oid")))
    j = j.join(ancestors.select(F.col("a").alias("old_oid"), F.col("b").alias("oid"), "is_ancestor"), ["old_oid", "oid"], "left")
    tag = N.is_tag(F.col("dst"))
    action = F.when(F.col("old_oid").isNull(), "new").when(F.coalesce("is_ancestor", F.lit(False)) & ~tag, "fast-forward").when(F.col("force"), "forced").otherwise("rejected")
    return j.select("repo", "dst", "old_oid", F.col("oid").alias("new_oid"), action.alias("action"))


def lease_violations(commands: DataFrame, expected: DataFrame) -> DataFrame:
    """Push commands (repo, name, old_oid) whose remote id is not the one expected (repo, name, oid)."""
    e = expected.select("repo", "name", F.col("oid").alias("_e"))
    return commands.join(e, ["repo", "name"]).where(~F.col("old_oid").eqNullSafe(F.col("_e"))).drop("_e")


def conflicts(staged: DataFrame, local: DataFrame) -> DataFrame:
    """(grp, path): paths changed both by a step (grp, path) and in the working copy (grp, path)."""
    return staged.select("grp", "path").distinct().join(local.select("grp", "path"), ["grp", "path"], "left_semi")


def pick(head: DataFrame, picked: DataFrame) -> DataFrame:
    """(grp, path, action, blob): what putting the picked tree (grp, path, blob) over HEAD's changes."""
    j = head.select("grp", "path", F.col("blob").alias("h")).join(picked.select("grp", "path", F.col("blob").alias("p")), ["grp", "path"], "full")
    return j.where(~F.col("h").eqNullSafe(F.col("p"))).select("grp", "path", F.when(F.col("h").isNull(), "insert").when(F.col("p").isNull(), "delete").otherwise("modify").alias("action"), F.col("p").alias("blob"))


def submodule_status(modules: DataFrame, index: DataFrame, heads: DataFrame) -> DataFrame:
    """(path, url, expected, current, clean) of modules (path, url), staged submodule entries (path, mode, oid) and checked-out heads (path, oid)."""
    e = index.where("mode = 57344").select("path", F.col("oid").alias("expected"))
    c = heads.select("path", F.col("oid").alias("current"))
    return modules.join(e, "path", "left").join(c, "path", "left").select("path", "url", "expected", "current", F.coalesce(F.col("expected") == F.col("current"), F.lit(False)).alias("clean"))


def info_refs(refs: DataFrame, peeled: DataFrame | None = None) -> DataFrame:
    """(repo, ord, line): the listing of references by name, tags followed by what they peel to (oid, target)."""
    plain = refs.where(F.col("oid").isNotNull()).select("repo", "name", "oid")
    rows = plain.select("repo", "name", F.lit(0).alias("k"), F.concat("oid", F.lit("\t"), "name").alias("line"))
    if peeled is not None:
        p = plain.join(peeled.where("oid <> target"), "oid").select("repo", "name", F.lit(1).alias("k"), F.concat("target", F.lit("\t"), "name", F.lit("^{}")).alias("line"))
        rows = rows.unionByName(p)
    return rows.select("repo", (F.row_number().over(Window.partitionBy("repo").orderBy("name", "k")) - 1).cast("bigint").alias("ord"), "line")


def list_refs(refs: DataFrame, prefixes: list[str]) -> DataFrame:
    """References whose name begins with one of the prefixes; none given lists all. Symbolic ones show their target."""
    keep = F.lit(not prefixes)
    for p in prefixes:
        keep = keep | F.col("name").startswith(p)
    return refs.where(keep)


def object_path_log(history: DataFrame, changes: DataFrame, path: Column) -> DataFrame:
    """(oid, …): commits of a history (oid, …) whose change against the parent (pair, path) touches a path that meets the condition."""
    return history.join(changes.where(path).select(F.col("pair").alias("oid")).distinct(), "oid", "left_semi")


def blame_text(lines: DataFrame) -> DataFrame:
    """(ver, line_no, line): the origin, the author padded to the longest of the version, the line number and the text, from (ver, line_no, text, origin, author)."""
    w = F.max(F.length("author")).over(Window.partitionBy("ver"))
    return lines.select("ver", "line_no", F.concat(F.substring(F.col("origin").cast("string"), 1, 8), F.lit(" ("), F.rpad("author", w, F.lit(" ")), F.lit(" "), F.lpad(F.col("line_no").cast("string"), 4, " "), F.lit(") "), "text").alias("line"))


def status_text(status: DataFrame) -> DataFrame:
    """(grp, line): porcelain lines, unmodified rows left out."""
    return status.where("NOT (staging = ' ' AND worktree = ' ')").select("grp", F.concat("staging", "worktree", F.lit(" "), "path").alias("line"))


def violations(remotes: DataFrame) -> DataFrame:
    """(repo, name, fault): remotes without a name or address, and fetch specs that break the rules."""
    spec = F.exists(F.coalesce("fetch_specs", F.array().cast("array<string>")), lambda s: ~F.coalesce(N.spec_valid(s), F.lit(False)))
    faults = F.filter(F.array(F.when(F.coalesce(F.col("name") == "", F.lit(True)), "no name"), F.when(F.coalesce(F.col("url") == "", F.lit(True)), "no address"), F.when(spec, "bad fetch spec")), lambda x: x.isNotNull())
    return remotes.select("repo", "name", F.explode(faults).alias("fault"))
