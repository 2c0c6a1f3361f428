"""Queries over the brackets and scopes of programs: one a supplier, with a line of five tokens for each of its lineitems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexing
from tessera.operators import masking, scopes
from tessera.sources.folders import stored

QUERIES, SQL = {}, {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """A line opens a function, declares a constant, opens a block, or closes either; some close nothing, some are never closed."""
    kind = F.expr("(l_partkey + l_linenumber) % 5")
    line = F.when(kind == 0, F.concat(F.lit("func f"), "l_orderkey", F.lit("() {"))).when(kind == 1, F.concat(F.lit("let v"), F.expr("l_partkey % 3"), F.lit(" = "), "l_linenumber", F.lit("; // {"))).when(kind == 2, "if (a) { /* } { */").otherwise("};;;;")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", line.alias("line")).alias("x"))
    programs = rows.groupBy("l_suppkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("program"))  # 600 lines each, whatever the scale
    return stored(lexing.lex(programs, "l_suppkey", "program"), "tokens")


def _points(tokens: DataFrame) -> DataFrame:
    return tokens.filter("col = 1").select("l_suppkey", F.col("pos").cast("long").alias("at"))


_LINES = """l AS (SELECT l_suppkey, (l_partkey + l_linenumber) % 5 AS kind, 'f' || l_orderkey AS f, 'v' || l_partkey % 3 AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS k FROM lineitem),
  s AS (SELECT l_suppkey, f, v, kind, k, 6 * k AS start, CASE kind WHEN 0 THEN 1 WHEN 2 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS step, CASE WHEN kind IN (0, 2) THEN 6 * k + 4 ELSE 6 * k END AS spot FROM l),
  r AS (SELECT *, sum(step) OVER (PARTITION BY l_suppkey ORDER BY k) AS total FROM s),
  m AS (SELECT *, least(0, min(total) OVER (PARTITION BY l_suppkey ORDER BY k)) AS low, least(0, coalesce(min(total) OVER (PARTITION BY l_suppkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS was FROM r),
  b AS (SELECT *, total - low + CASE WHEN step < 0 THEN 1 ELSE 0 END AS level FROM m WHERE step <> 0 AND NOT (step < 0 AND total < was)),
  p AS (SELECT * FROM (SELECT l_suppkey, kind, f, k, start, spot AS open, level, step, CASE WHEN lead(step) OVER w < 0 THEN lead(spot) OVER w END AS close FROM b WINDOW w AS (PARTITION BY l_suppkey, level ORDER BY k)) WHERE step > 0)"""


@_query(f"WITH {_LINES} SELECT l_suppkey, '{{' AS bracket, open::BIGINT AS open, close::BIGINT AS close, level::INT AS level FROM p UNION ALL SELECT l_suppkey, '(', 6 * k + 2, 6 * k + 3, 1 FROM l WHERE kind = 0 UNION ALL SELECT l_suppkey, '(', 6 * k + 1, 6 * k + 3, 1 FROM l WHERE kind = 2")
def bracket_pairs(spark, d):
    rows = scopes.bracket_pairs(_tokens(spark, d), "l_suppkey", chunk=1000)
    return rows.select("l_suppkey", "bracket", F.col("open").cast("long").alias("open"), F.col("close").cast("long").alias("close"), "level")


@_query(
    f"""WITH {_LINES} SELECT l_suppkey, 'function' AS family, f AS name, start::BIGINT AS pos, open::BIGINT AS open, close::BIGINT AS close FROM p WHERE kind = 0
    UNION ALL SELECT l_suppkey, 'constant', v, 6 * k, NULL, NULL FROM l WHERE kind = 1"""
)
def declarations(spark, d):
    rows = scopes.declarations(_tokens(spark, d), "l_suppkey", chunk=1000)
    return rows.select("l_suppkey", "family", "name", *(F.col(c).cast("long").alias(c) for c in ("pos", "open", "close")))


@_query(
    f"""WITH {_LINES}, x AS (SELECT s.l_suppkey, s.start AS place, arg_max(p.f, p.open) AS function, max(p.open) AS open, arg_max(coalesce(p.close, -1), p.open) AS close
      FROM s LEFT JOIN p ON p.l_suppkey = s.l_suppkey AND p.kind = 0 AND p.open < s.start AND coalesce(p.close > s.start, true) GROUP BY ALL)
    SELECT l_suppkey, place::BIGINT AS place, function, open::BIGINT AS open, nullif(close, -1)::BIGINT AS close FROM x"""
)
def open_functions(spark, d):
    tokens = _tokens(spark, d)
    return scopes.open_functions(tokens, _points(tokens), "l_suppkey", chunk=1000).withColumnRenamed("at", "place")


@_query(
    f"""WITH {_LINES}, c AS (SELECT s.l_suppkey, s.v, s.start AS spot, coalesce(max(p.open), -1) AS scope, arg_max(p.close, p.open) AS close
      FROM s LEFT JOIN p ON p.l_suppkey = s.l_suppkey AND p.open < s.start AND coalesce(p.close > s.start, true) WHERE s.kind = 1 GROUP BY ALL),
    q AS (SELECT *, lag(spot) OVER (PARTITION BY l_suppkey, v, scope ORDER BY spot) AS before FROM c),
    o AS (SELECT DISTINCT c.l_suppkey, c.v, c.scope, coalesce(p.close, 1000000000) AS ends FROM c LEFT JOIN p ON p.l_suppkey = c.l_suppkey AND p.open = c.scope)
    SELECT l_suppkey, v AS name, spot AS pos, scope, 'duplicate' AS problem, before AS other FROM q WHERE before IS NOT NULL
    UNION ALL SELECT q.l_suppkey, q.v, q.spot, q.scope, 'shadowing', max(o.scope) FROM q JOIN o ON o.l_suppkey = q.l_suppkey AND o.v = q.v AND o.scope < q.scope AND o.ends > q.scope WHERE q.before IS NULL GROUP BY ALL"""
)
def scope_conflicts(spark, d):
    rows = scopes.scope_conflicts(_tokens(spark, d), "l_suppkey", chunk=1000)
    return rows.select("l_suppkey", "name", *(F.col(c).cast("long").alias(c) for c in ("pos", "scope", "other")), "problem")


@_query(
    r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '(?s)//[^\n\r]*|/\*.*?(?:\*/|\z)|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\\?\z)|"(?:\\.|[^"\\])*(?:"|\\?\z)|''(?:\\.|[^''\\])*(?:''|\\?\z)|[^/"'']+|/') AS parts FROM pages WHERE html IS NOT NULL)
    SELECT page_id, sha256(array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^(//|/\*|"|'')') THEN regexp_replace(x, '[^\n\r]', ' ', 'g') ELSE x END), '')) AS digest,
      len(list_filter(parts, lambda x: regexp_matches(x, '^(//|/\*|"|'')'))) > 0 AS masks FROM t"""
)
def masked_pages(spark, d):
    """Pages, read as if they were programs, without what would be comments and texts; in parts of 4096 characters."""
    pages = spark.read.parquet(f"{d}/pages.parquet").filter("html is not null")
    rows = masking.mask_non_code(pages, "page_id", "html", part=4096).join(pages.select("page_id", "html"), "page_id")
    return rows.select("page_id", F.sha2("masked", 256).alias("digest"), (F.col("masked") != F.col("html")).alias("masks"))
