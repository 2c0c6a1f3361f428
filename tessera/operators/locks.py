"""Verification of inputs against a lock: digests of files in a tree by the prefixes of their paths' hashes, of which only branches that differ are gone down.

A prefix of hash digits holds about equally many paths whatever their folders, so no node has
more than its share of children, and a tree over many files is made and compared in as many rounds as it has levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash digits of the tree's leaves: 16 ** LEVELS of them.
LEVELS = 4


def _key():
    return F.md5(F.coalesce("path", F.lit("")))


def digest_tree(files: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(level, prefix, digest, files) of files (path, digest): a node for each prefix of 0 to levels hash digits that a path has, its digest over what is below it in order.

    A path with several digests counts with each of them once; a null digest is that of a file which can't be read. An empty table has no nodes.
    """
    line = F.concat(F.octet_length(F.coalesce("path", F.lit(""))).cast("string"), F.lit(":"), F.coalesce("path", F.lit("")), F.lit(":"), F.coalesce("digest", F.lit("-")))
    rows = files.select("path", "digest").distinct().select(F.substring(_key(), 1, levels).alias("prefix"), line.alias("line"))
    level = rows.groupBy("prefix").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"), F.count("*").alias("files"))
    out = [level.select(F.lit(levels).alias("level"), "prefix", "digest", "files")]
    for n in range(levels - 1, -1, -1):
        below = out[-1].select(F.expr(f"substring(prefix, 1, {n})").alias("prefix"), F.concat("prefix", F.lit(":"), "digest").alias("line"), "files")
        level = below.groupBy("prefix").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"), F.sum("files").alias("files"))  # 16 at most
        out.append(level.select(F.lit(n).alias("level"), "prefix", "digest", "files"))
    return reduce(DataFrame.unionByName, out)


def compared_nodes(locked: DataFrame, found: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(level, prefix, differs) of the nodes of two stored trees that a comparison looks at: the roots, and what is below a node that differs. A node that one tree lacks differs."""
    spark = locked.sparkSession
    ask, out = spark.createDataFrame([("",)], "prefix string"), []
    for n in range(levels + 1):
        of = lambda tree, name: tree.filter(F.col("level") == n).join(ask, F.expr(f"substring(prefix, 1, {max(0, n - 1)})") == F.col("asked"), "left_semi").select("prefix", F.col("digest").alias(name))  # noqa: B023, E731
        ask = ask.withColumnRenamed("prefix", "asked")
        both = of(locked, "want").join(of(found, "got"), "prefix", "full").select(F.lit(n).alias("level"), "prefix", (~F.col("want").eqNullSafe(F.col("got"))).alias("differs"))
        out.append(both)
        ask = both.filter("differs").select("prefix")
    return reduce(DataFrame.unionByName, out)


def lock_violations(locked: DataFrame, found: DataFrame, compared: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(path, problem, want, got) of files (path, digest): changed, missing or added against the lock. Only files under leaves that differ by compared_nodes are looked at. A path that stands with several digests on a side is compared by all of them."""
    leaves = compared.filter((F.col("level") == levels) & F.col("differs")).select(F.col("prefix").alias("leaf"))

    def side(files: DataFrame, name: str) -> DataFrame:
        rows = files.filter("path is not null").join(leaves, F.substring(_key(), 1, levels) == F.col("leaf"), "left_semi")
        return rows.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("digest", F.lit("-")))), ",").alias(name))

    rows = side(locked, "want").join(side(found, "got"), "path", "full").filter("not want <=> got")
    return rows.select("path", F.when(F.col("want").isNull(), "added").when(F.col("got").isNull(), "missing").otherwise("changed").alias("problem"), "want", "got")
