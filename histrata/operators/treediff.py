"""Differences of trees: changes, renames, statistics, three-way status, checks, tree ids.

A tree is a set of rows (tree, path, mode, blob); several pairs of trees are compared in one join.
Deprecated regular modes equal regular ones. Rows with a null path or blob are no files and left
out; a path that repeats within a tree is reported by ``check`` and otherwise taken as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import objects as O
from ..functions.runtime import Scratch


def changes(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """For pairs (pair, from_tree, to_tree): (pair, action, path, from_mode, from_blob, to_mode, to_blob).

    A full outer join on pair and path; a null tree is the empty one. Equal rows are dropped.
    """
    f = files.where(F.col("path").isNotNull() & F.col("blob").isNotNull())
    a = pairs.join(f, pairs["from_tree"] == f["tree"]).select("pair", "path", F.col("mode").alias("from_mode"), F.col("blob").alias("from_blob"))
    b = pairs.join(f, pairs["to_tree"] == f["tree"]).select("pair", "path", F.col("mode").alias("to_mode"), F.col("blob").alias("to_blob"))
    both = a.join(b, ["pair", "path"], "full")
    same = (F.col("from_blob") == F.col("to_blob")) & (O.canonical_mode(F.col("from_mode")) == O.canonical_mode(F.col("to_mode")))
    action = F.when(F.col("from_blob").isNull(), "insert").when(F.col("to_blob").isNull(), "delete").otherwise("modify")
    return both.where(~F.coalesce(same, F.lit(False))).select("pair", action.alias("action"), "path", "from_mode", "from_blob", "to_mode", "to_blob")


def summary(diff: DataFrame) -> DataFrame:
    """(pair, inserted, deleted, modified)."""
    c = lambda x: F.count(F.when(F.col("action") == x, 1))
    return diff.groupBy("pair").agg(c("insert").alias("inserted"), c("delete").alias("deleted"), c("modify").alias("modified"))


def name_similarity(a: Column, b: Column) -> Column:
    """Likeness of two paths, 0 to 100: half for the common end of the base names, a quarter each for the folders' common beginning and end.

    A folder ends with its separator. Each part is the common length over the longer length, in
    whole hundredths; two empty folders are alike.
    """
    folder = lambda p: F.regexp_extract(p, r"^(.*/)[^/]*$", 1)
    base = lambda p: F.regexp_extract(p, r"([^/]*)$", 1)

    def prefix(x: Column, y: Column) -> Column:
        same = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.coalesce(p == q, F.lit(False)))
        first = F.array_position(same, False)
        return F.when((F.length(x) == 0) | (F.length(y) == 0), 0).when(first == 0, F.size(same)).otherwise(first - 1)

    def share(common: Column, x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, 100).otherwise(F.floor(common * 100 / longest))

    da, db, na, nb = folder(a), folder(b), base(a), base(b)
    ra, rb = F.reverse(da), F.reverse(db)
    return F.floor((share(prefix(da, db), da, db) * 25 + share(prefix(ra, rb), da, db) * 25 + share(prefix(F.reverse(na), F.reverse(nb)), na, nb) * 50) / 100).cast("int")


#: The most pairs of paths of one blob that are scored by name; of more, equal base names are paired first, then equal ranks of paths.
RENAME_LIMIT = 10_000


def exact_renames(diff: DataFrame, scratch: Scratch, limit: int = RENAME_LIMIT) -> DataFrame:
    """(pair, from_path, to_path, blob): deletions and insertions of the same blob and mode, each used once.

    Within a blob the pair of the most similar names is taken first, then the next of what is left
    (equal scores by path). A blob with more than ``limit`` pairs is not scored: paths of equal base
    names are paired by rank, and what is left is paired by rank, too, so all of the smaller side find a
    partner without forming pairs. What finds no partner stays an insertion or a deletion.
    Saved tables take about two bytes a row on disk, so their files would pass for small; all joins are
    by sorting, as a broadcast would bring millions of rows to the driver.
    """
    key = ["pair", "blob", "mode"]
    gone = diff.where("action = 'delete'").select("pair", F.col("from_blob").alias("blob"), O.canonical_mode(F.col("from_mode")).alias("mode"), F.col("path").alias("from_path"))
    come = diff.where("action = 'insert'").select("pair", F.col("to_blob").alias("blob"), O.canonical_mode(F.col("to_mode")).alias("mode"), F.col("path").alias("to_path"))
    gone, come = scratch.save(gone), scratch.save(come)
    sizes = gone.groupBy(*key).agg(F.count(F.lit(1)).alias("na")).join(come.groupBy(*key).agg(F.count(F.lit(1)).alias("nb")).hint("merge"), key)
    sizes = scratch.save(sizes.withColumn("many", F.col("na") * F.col("nb") > limit))
    few, many = sizes.where("NOT many").select(*key).hint("merge"), sizes.where("many").select(*key).hint("merge")
    grp = F.struct(*key).alias("grp")
    scored = gone.join(few, key).join(come.hint("merge"), key).select(grp, F.col("from_path").alias("a"), F.col("to_path").alias("b"), name_similarity(F.col("from_path"), F.col("to_path")).alias("score"))
    out = greedy_pairs(scored, scratch).select("grp.pair", F.col("a").alias("from_path"), F.col("b").alias("to_path"), "grp.blob")
    left, right = gone.join(many, key, "left_semi"), come.join(many, key, "left_semi")
    for base in (True, False):
        name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1) if base else F.lit("")  # noqa: B023, E731
        rank = lambda d, c: d.withColumn("n", name(c)).withColumn("k", F.row_number().over(Window.partitionBy(*key, "n").orderBy(c)))
        met = scratch.save(rank(left, "from_path").join(rank(right, "to_path").hint("merge"), [*key, "n", "k"]).select(*key, "from_path", "to_path"))
        out = out.unionByName(met.select("pair", "from_path", "to_path", "blob"))
        left, right = left.join(met.select(*key, "from_path").hint("merge"), [*key, "from_path"], "left_anti"), right.join(met.select(*key, "to_path").hint("merge"), [*key, "to_path"], "left_anti")
    return out


def blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, n): the multiset of a content's lines, cut after 64 characters, with their bytes."""
    piece = F.explode(F.regexp_extract_all(text, F.lit(r"[^\n]{0,63}\n|[^\n]{1,64}"), F.lit(0)))
    return texts.select(key, piece.alias("p")).groupBy(key, F.xxhash64("p").alias("h")).agg(F.sum(F.octet_length("p")).cast("bigint").alias("n"))


def similar_contents(left: DataFrame, right: DataFrame, least: int = 60) -> DataFrame:
    """For left (grp, a, text) and right (grp, b, text): (grp, a, b, score), score = common bytes * 100 / larger size, at least ``least``.

    The two sides meet on common blocks only. Blocks of a content beyond what could keep it under
    ``least`` need not be probed: of n bytes, a partner shares at least n * least / 100, so the
    rarest (100 - least) percent of the bytes already hold a common block. That keeps a block that
    everything contains out of the join unless it is needed.
    """
    la = blocks(left.withColumn("_k", F.struct("grp", "a")), "_k", "text").withColumnRenamed("n", "na")
    rb = blocks(right.withColumn("_k", F.struct("grp", "b")), "_k", "text").withColumnRenamed("n", "nb")
    sa = la.groupBy("_k").agg(F.sum("na").alias("size_a"))
    sb = rb.groupBy("_k").agg(F.sum("nb").alias("size_b"))
    often = rb.groupBy(F.col("_k.grp").alias("grp"), "h").agg(F.count(F.lit(1)).alias("often"))
    ranked = la.join(sa, "_k").join(often, (F.col("_k.grp") == often["grp"]) & (la["h"] == often["h"]), "left").select("_k", la["h"], "na", "size_a", F.coalesce("often", F.lit(0)).alias("often"))
    w = Window.partitionBy("_k").orderBy("often", "h").rowsBetween(Window.unboundedPreceding, -1)
    probe = ranked.withColumn("before", F.coalesce(F.sum("na").over(w), F.lit(0))).where((F.col("before") * 100 <= F.col("size_a") * (100 - least)) & (F.col("often") > 0))
    x = probe.select(F.col("_k").alias("ka"), F.col("_k.grp").alias("g"), "h", "size_a")
    y = rb.join(sb, "_k").select(F.col("_k").alias("kb"), F.col("_k.grp").alias("g"), "h", "size_b")
    cand = x.join(y, ["g", "h"]).where((F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * least)).select("ka", "kb", "size_a", "size_b").distinct()
    full = cand.join(la.withColumnRenamed("_k", "ka"), "ka").join(rb.withColumnRenamed("_k", "kb"), ["kb", "h"])
    score = full.groupBy("ka", "kb", "size_a", "size_b").agg(F.sum(F.least("na", "nb")).alias("common"))
    return score.withColumn("score", F.floor(F.col("common") * 100 / F.greatest("size_a", "size_b"))).where(F.col("score") >= least).select(F.col("ka.grp").alias("grp"), F.col("ka.a").alias("a"), F.col("kb.b").alias("b"), "score")


def greedy_pairs(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """From (grp, a, b, score) the pairs a greedy choice takes, best score first (ties by a, b), each a and b once.

    Rounds of mutual best choices: a pair that is the best of both its ends is what greedy takes, too.
    All joins are by sorting, for the reason given in ``exact_renames``.
    """
    rest, out = scratch.save(scored), None
    rank = F.struct(-F.col("score"), F.col("a"), F.col("b"))
    while not rest.isEmpty():
        best_a = rest.groupBy("grp", "a").agg(F.min(rank).alias("ra")).hint("merge")
        best_b = rest.groupBy("grp", "b").agg(F.min(rank).alias("rb")).hint("merge")
        took = scratch.save(rest.join(best_a, ["grp", "a"]).join(best_b, ["grp", "b"]).where(F.col("ra") == F.col("rb")).select("grp", "a", "b", "score"))
        out = took if out is None else out.unionByName(took)
        left = rest.join(took.select("grp", "a").hint("merge"), ["grp", "a"], "left_anti").join(took.select("grp", "b").hint("merge"), ["grp", "b"], "left_anti").select("grp", "a", "b", "score")
        rest = scratch.save(left)
    return out if out is not None else rest


def status(head: DataFrame, index: DataFrame, worktree: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """(grp, path, staging, worktree) from files (grp, path, mode, blob) of three places, codes as in porcelain output: M A D ? and blank.

    Untracked paths are '?' on both sides; those in ``ignored`` (grp, path) are not listed.
    """
    side = lambda d, n: d.select("grp", "path", F.concat_ws(" ", O.canonical_mode(F.col("mode")), "blob").alias(n))
    j = side(head, "h").join(side(index, "i"), ["grp", "path"], "full").join(side(worktree, "w"), ["grp", "path"], "full")
    untracked = F.col("h").isNull() & F.col("i").isNull()
    staging = F.when(untracked, "?").when(F.col("h").isNull(), "A").when(F.col("i").isNull(), "D").when(F.col("h") != F.col("i"), "M").otherwise(" ")
    work = F.when(F.col("i").isNull() & F.col("w").isNotNull(), "?").when(F.col("i").isNull(), " ").when(F.col("w").isNull(), "D").when(F.col("i") != F.col("w"), "M").otherwise(" ")
    out = j.select("grp", "path", staging.alias("staging"), work.alias("worktree")).where("NOT (staging = ' ' AND worktree = ' ')")
    return out if ignored is None else out.join(ignored.withColumn("_i", F.lit(True)), ["grp", "path"], "left").where(~((F.col("staging") == "?") & F.coalesce("_i", F.lit(False)))).drop("_i")


def directories(files: DataFrame) -> DataFrame:
    """(tree, path, is_dir): the files and every folder above them, each once, as a recursive walk yields them."""
    parts = F.split("path", "/")
    up = files.select("tree", "path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("parts"))
    return up.select("tree", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("path"), (F.col("k") < F.size("parts")).alias("is_dir")).distinct()


def check(entries: DataFrame) -> DataFrame:
    """Faults of tree entries (tree, ord, name, mode, oid): (tree, ord, fault), one row per fault.

    Order is that of names with "/" after folders' names, by bytes.
    """
    w = Window.partitionBy("tree").orderBy("ord")
    key = F.hex(F.encode(F.when(F.col("mode") == O.DIR, F.concat("name", F.lit("/"))).otherwise(F.col("name")), "UTF-8"))
    e = entries.withColumn("_key", key).withColumn("_prev", F.lag("_key").over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("tree", "name")))
    faults = F.filter(
        F.array(
            F.when(F.coalesce(F.col("name") == "", F.lit(True)), "empty name"), F.when(F.col("name").contains("/"), "name with separator"), F.when(~O.valid_path(F.col("name")), "forbidden name"), F.when(F.col("_n") > 1, "repeated name"), F.when(F.col("_prev") > F.col("_key"), "not sorted"),
            F.when(O.is_malformed(F.col("mode")), "bad mode"), F.when(F.coalesce(O.is_zero(F.col("oid")), F.lit(True)), "zero id"), F.when(F.octet_length("name") > 4096, "name too long"),
        ), lambda x: x.isNotNull(),
    )
    return e.select("tree", "ord", F.explode(faults).alias("fault"))


def tree_ids(files: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, path, oid): the id of every folder ("" for the root), hashed bottom-up from files (tree, path, mode, blob).

    One round per level of folders, all trees at once.
    """
    level = files.select("tree", "path", F.col("mode"), F.col("blob").alias("oid"))
    level = scratch.save(level.withColumn("depth", F.size(F.split("path", "/"))))
    top = level.agg(F.max("depth")).first()[0]
    out = None
    for d in range(top or 0, 0, -1):
        here = level.where(F.col("depth") == d)
        name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
        raw = F.concat(F.encode(F.concat(O.mode_text(F.col("mode")), F.lit(" "), name), "UTF-8"), F.unhex(F.lit("00")), F.unhex("oid"))
        order = F.hex(F.encode(F.when(F.col("mode") == O.DIR, F.concat(name, F.lit("/"))).otherwise(name), "UTF-8"))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), F.hex(raw).alias("r")))), lambda x: x["r"]), "")
        made = here.groupBy("tree", folder.alias("path")).agg(body.alias("_b")).select("tree", "path", F.lit(O.DIR).alias("mode"), O.object_id("tree", F.unhex("_b")).alias("oid"), F.lit(d - 1).alias("depth"))
        made = scratch.save(made)
        out = made if out is None else out.unionByName(made)
        level = level.where(F.col("depth") < d).unionByName(made)
    return out.select("tree", "path", "oid") if out is not None else level.select("tree", "path", "oid")


def histogram(stats: DataFrame, width: int = 53) -> DataFrame:
    """Text lines `` name | n +++--- `` of statistics (grp, name, addition, deletion), padded and scaled per group."""
    w = Window.partitionBy("grp")
    n = F.col("addition") + F.col("deletion")
    s = stats.withColumn("_l", F.max(F.length("name")).over(w)).withColumn("_d", F.max(F.length(n.cast("string"))).over(w)).withColumn("_m", F.max(n).over(w))
    scale = F.when(F.col("_m") > width, F.lit(width) / F.col("_m")).otherwise(1.0)
    bar = lambda c: F.expr("repeat('%s', cast(ceil(%s * _s) as int))" % ("+" if c == "addition" else "-", c))
    return s.withColumn("_s", scale).select("grp", "name", F.concat(F.lit(" "), F.rpad("name", F.col("_l"), F.lit(" ")), F.lit(" | "), F.lpad(n.cast("string"), F.col("_d"), F.lit(" ")), F.lit(" "), bar("addition"), bar("deletion")).alias("line"))
