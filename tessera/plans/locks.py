"""Queries over locked inputs: pages as files, some of them changed, gone or new since they were locked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import locks
from tessera.sources.folders import stored

QUERIES, SQL = {}, {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    path = F.concat(F.lit("pages/"), F.expr("page_id % 10"), F.lit("/"), "page_id", F.lit(".html"))
    locked = pages.select(path.alias("path"), F.sha2("html", 256).alias("digest"), "page_id")
    changed = F.when(F.col("page_id") % 50 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    now = pages.select(F.when(F.col("page_id") % 71 == 0, F.concat(F.lit("new/"), path)).otherwise(path).alias("path"), F.sha2(changed, 256).alias("digest"), "page_id")
    return stored(locked.filter("page_id % 71 <> 0 or page_id % 2 = 0").select("path", "digest"), "locked"), stored(now.filter("page_id % 67 <> 0").select("path", "digest"), "found")


_DIFFER = """f AS (SELECT page_id, 'pages/' || page_id % 10 || '/' || page_id || '.html' AS path, html FROM pages),
  w AS (SELECT path, sha256(html) AS want FROM f WHERE page_id % 71 <> 0 OR page_id % 2 = 0),
  g AS (SELECT CASE WHEN page_id % 71 = 0 THEN 'new/' || path ELSE path END AS path, sha256(html || CASE WHEN page_id % 50 = 0 THEN '!' ELSE '' END) AS got FROM f WHERE page_id % 67 <> 0),
  b AS (SELECT coalesce(w.path, g.path) AS path, want, got FROM w FULL JOIN g ON w.path = g.path)"""


@_query(f"WITH {_DIFFER} SELECT path, CASE WHEN want IS NULL THEN 'added' WHEN got IS NULL THEN 'missing' ELSE 'changed' END AS problem, want, got FROM b WHERE want IS DISTINCT FROM got")
def lock_violations(spark, d):
    locked, found = _files(spark, d)
    compared = locks.compared_nodes(stored(locks.digest_tree(locked), "tree"), stored(locks.digest_tree(found), "tree"))
    return locks.lock_violations(locked, found, compared)


@_query(
    f"""WITH {_DIFFER}, n AS (SELECT level, md5(path)[1:level] AS prefix, bool_or(want IS DISTINCT FROM got) AS differs FROM b, range(5) t(level) GROUP BY ALL)
    SELECT n.level::INT AS level, count(*) AS compared, count(*) FILTER (n.differs) AS differing FROM n LEFT JOIN n p ON p.level = n.level - 1 AND p.prefix = n.prefix[1:n.level - 1] WHERE n.level = 0 OR p.differs GROUP BY ALL"""
)
def lock_reads(spark, d):
    """Nodes of the tree that were looked at, by level, and those that differ."""
    locked, found = _files(spark, d)
    compared = locks.compared_nodes(stored(locks.digest_tree(locked), "tree"), stored(locks.digest_tree(found), "tree"))
    return compared.groupBy("level").agg(F.count("*").alias("compared"), F.count_if("differs").alias("differing"))
