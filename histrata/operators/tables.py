"""The relational image of a set of repositories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.objects import REGULAR, object_id
from ..functions.runtime import table


@dataclass
class RepoTables:
    """One DataFrame per table; all are lazy, and nothing is read before a query needs it."""

    spark: SparkSession
    base: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.base, name)

    @property
    def commits(self) -> DataFrame:
        """One row per commit: the delivery received first (repeated deliveries carry the same content)."""
        c = self.raw("commits").where(F.col("oid").isNotNull())
        rest = [x for x in c.columns if x not in ("oid", "received_at")]
        return c.groupBy("oid").agg(F.min_by(F.struct(*rest), F.struct("received_at", "repo")).alias("_c"), F.min("received_at").alias("received_at")).select("oid", "_c.*", "received_at")

    @property
    def slim(self) -> DataFrame:
        """(oid, repo, parents, committer_when, author_when) of every commit, without texts."""
        c = self.raw("commits").where(F.col("oid").isNotNull())
        return c.groupBy("oid").agg(F.min("repo").alias("repo"), F.min("parents").alias("parents"), F.min("committer_when").alias("committer_when"), F.min("author_when").alias("author_when"))

    @property
    def edges(self) -> DataFrame:
        """(child, ord, parent) for every parent link, in order; parents need not be in the table."""
        return self.slim.select(F.col("oid").alias("child"), "repo", F.posexplode("parents").alias("ord", "parent")).where(F.col("parent").isNotNull() & (F.col("parent") != ""))

    @property
    def refs(self) -> DataFrame:
        return self.raw("refs")

    @property
    def reflog(self) -> DataFrame:
        """Log rows without exact repetitions."""
        return self.raw("reflog").distinct()

    @property
    def remotes(self) -> DataFrame:
        return self.raw("remotes")

    @property
    def packs(self) -> DataFrame:
        return self.raw("pack_entries")

    @property
    def blobs(self) -> DataFrame:
        """(repo, path, blob_oid, text, size): document texts as file contents."""
        return self.raw("documents").select(F.col("doc_id"), F.col("source").alias("repo"), "path", "blob_oid", "text", F.octet_length("text").cast("bigint").alias("size"))

    @property
    def history(self) -> DataFrame:
        """(oid, branch, ts, parent): a commit per order; a customer's orders in time form one branch."""
        o = self.raw("orders").select(F.col("o_orderkey").alias("oid"), F.col("o_custkey").alias("branch"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("message"))
        from pyspark.sql.window import Window

        return o.withColumn("parent", F.lag("oid").over(Window.partitionBy("branch").orderBy("ts", "oid")))

    @property
    def tree_files(self) -> DataFrame:
        """(tree, path, mode, blob): the files of each order's tree, made of its line items (one row per path)."""
        path = F.concat(F.lit("s"), F.col("l_suppkey") % 3, F.lit("/p"), F.col("l_partkey") % 4)
        one = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("tree"), path.alias("path")).agg(F.max(F.col("l_quantity").cast("int") % 4).cast("string").alias("content"))
        return one.select("tree", "path", F.lit(REGULAR).alias("mode"), object_id("blob", F.col("content")).alias("blob"))


#: The SQL of the same tables, for comparison.
SQL = """
c AS (SELECT oid, min(repo) AS repo, min(parents) AS parents, min(committer_when) AS committer_when, min(author_when) AS author_when FROM commits WHERE oid IS NOT NULL GROUP BY oid),
edges AS (SELECT * FROM (SELECT oid AS child, repo, unnest(range(0, len(parents))) AS ord, unnest(parents) AS parent FROM c) WHERE parent IS NOT NULL AND parent <> ''),
rl AS (SELECT DISTINCT * FROM reflog),
hist AS (SELECT o_orderkey AS oid, o_custkey AS branch, o_orderdate AS ts, o_orderpriority AS message, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders),
tf0 AS (SELECT l_orderkey AS tree, 's' || (l_suppkey % 3) || '/p' || (l_partkey % 4) AS path, CAST(max(CAST(trunc(l_quantity) AS INT) % 4) AS VARCHAR) AS content FROM lineitem GROUP BY 1, 2),
tf AS (SELECT tree, path, 33188 AS mode, sha1(CAST('blob ' || length(content) || chr(0) || content AS BLOB)) AS blob FROM tf0)
"""
