"""Queries over generic types: nominals from parts and their brands, calls from orders, interfaces from suppliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import generics, types

QUERIES, SQL = {}, {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_FIXED = (("Seq", 0, "Col<E>"), ("Col", 0, "Seq<Col<F>>"), ("Col", 1, "Any"))


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nominals and edges: a part is its brand or an array's brand, some are a Seq, too; brands lead to makers, makers to Seq, and Seq and Col to each other, growing."""
    part = _t(spark, d, "part").selectExpr("p_partkey", "p_size", "regexp_replace(p_brand, '[^0-9]', '') as b")
    brand = part.selectExpr("b", "substring(b, 1, 1) as m").distinct()
    maker = brand.select("m").distinct()
    edges = (
        part.selectExpr("concat('P', p_partkey) as sub", "0 as ord", "concat('B', b, if(p_size % 2 = 1, '<Array<T>>', '<T>')) as super"), part.filter("p_partkey % 7 = 0").selectExpr("concat('P', p_partkey)", "1", "'Seq<T>'"),
        brand.selectExpr("concat('B', b)", "0", "concat('M', m, '<X>')"), brand.selectExpr("concat('B', b)", "1", "'Seq< Array<X> >'"), maker.selectExpr("concat('M', m)", "0", "'Seq<Y>'"), maker.selectExpr("concat('M', m)", "1", "'Any'"),
        spark.createDataFrame(_FIXED, "sub string, ord int, super string"),
    )
    names = (
        part.selectExpr("concat('P', p_partkey) as name", "array('T') as type_params"), brand.selectExpr("concat('B', b)", "array('X')"), maker.selectExpr("concat('M', m)", "array('Y')"),
        spark.createDataFrame([("Seq", ["E"]), ("Col", ["F"]), ("Any", [])], "name string, type_params array<string>"),
    )
    return reduce(DataFrame.union, names), reduce(DataFrame.union, edges)


_CLOSURE = """p AS (SELECT p_partkey, p_size, regexp_replace(p_brand, '[^0-9]', '', 'g') AS b FROM part),
  e(sub, par, ord, super) AS (
    SELECT 'P' || p_partkey, 'T', 0, 'B' || b || CASE WHEN p_size % 2 = 1 THEN '<Array<T>>' ELSE '<T>' END FROM p UNION ALL SELECT 'P' || p_partkey, 'T', 1, 'Seq<T>' FROM p WHERE p_partkey % 7 = 0
    UNION ALL SELECT DISTINCT 'B' || b, 'X', 0, 'M' || b[1] || '<X>' FROM p UNION ALL SELECT DISTINCT 'B' || b, 'X', 1, 'Seq<Array<X>>' FROM p
    UNION ALL SELECT DISTINCT 'M' || b[1], 'Y', 0, 'Seq<Y>' FROM p UNION ALL SELECT DISTINCT 'M' || b[1], 'Y', 1, 'Any' FROM p UNION ALL VALUES ('Seq', 'E', 0, 'Col<E>'), ('Col', 'F', 0, 'Seq<Col<F>>'), ('Col', 'F', 1, 'Any')),
  walks(sub, par, head, term, path, heads) AS (
    SELECT DISTINCT sub, par, sub, sub || '<' || par || '>', []::INT[], [sub] FROM e UNION ALL SELECT 'Any', '', 'Any', 'Any', []::INT[], ['Any']
    UNION ALL
    SELECT w.sub, w.par, regexp_extract(e.super, '^[^<]*'), replace(e.super, e.par, regexp_extract(w.term, '^[^<]*<(.*)>$', 1)), list_append(w.path, e.ord), list_append(w.heads, regexp_extract(e.super, '^[^<]*'))
    FROM walks w JOIN e ON e.sub = w.head WHERE NOT list_contains(w.heads, regexp_extract(e.super, '^[^<]*'))),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sub, head ORDER BY path) AS k FROM walks) WHERE k = 1),
  c AS (SELECT sub, par, super, min(steps) AS steps FROM (
    SELECT sub, par, term AS super, 0 AS steps FROM best WHERE len(path) = 0
    UNION ALL SELECT b.sub, b.par, replace(e.super, e.par, regexp_extract(b.term, '^[^<]*<(.*)>$', 1)), len(b.path) + 1 FROM best b JOIN e ON e.sub = b.head WHERE NOT list_contains(b.heads, regexp_extract(e.super, '^[^<]*'))) GROUP BY ALL)"""


@_query(f"WITH RECURSIVE {_CLOSURE} SELECT sub, par AS params, super, steps::INT AS steps FROM c")
def generic_closure(spark, d):
    return generics.generic_closure(*_model(spark, d)).select("sub", F.array_join("type_params", ",").alias("params"), "super", "steps")


@_query(
    f"""WITH RECURSIVE {_CLOSURE},
    l AS (SELECT l_orderkey, l_linenumber, 'P' || l_partkey AS sub, CASE l_orderkey % 3 WHEN 0 THEN 'Int64' WHEN 1 THEN 'Array<Int64>' ELSE '' END AS arg,
      CASE l_linenumber % 5 WHEN 0 THEN 'Seq<Int64>' WHEN 1 THEN 'Seq<Array<Int64>>' WHEN 2 THEN 'Col<Array<Array<Int64>>>' WHEN 3 THEN 'Any' ELSE 'Seq' END AS want FROM lineitem),
    fits AS (SELECT DISTINCT sub, arg, CASE WHEN super LIKE '%<%' THEN replace(super, 'T', CASE WHEN arg = '' THEN 'T' ELSE arg END) ELSE super END AS super FROM c, (VALUES ('Int64'), ('Array<Int64>'), ('')) a(arg) WHERE c.sub LIKE 'P%'),
    w AS (SELECT sub, arg, super AS want FROM fits UNION SELECT sub, arg, regexp_extract(super, '^[^<]*') FROM fits)
    SELECT l_orderkey, l_linenumber, w.want IS NOT NULL AS compatible FROM l LEFT JOIN w USING (sub, arg, want)"""
)
def generic_compatibility(spark, d):
    """A part of some elements, or of unknown ones, for a Seq or Col of given ones, for any Seq, or for anything."""
    got = F.expr("concat('P', l_partkey, case l_orderkey % 3 when 0 then '<Int64>' when 1 then '< Array<Int64> >' else '' end)")
    want = F.expr("case l_linenumber % 5 when 0 then 'Seq<Int64>' when 1 then 'Seq<Array<Int64>>' when 2 then 'Col<Array<Array<Int64>>>' when 3 then 'Any' else 'Seq' end")
    pairs = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", got.alias("got"), want.alias("want"))
    return types.compatible(pairs, generics.generic_closure(*_model(spark, d))).select("l_orderkey", "l_linenumber", "compatible")


@_query(
    """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 3 AS f, o_orderkey % 2 = 0 AS even, c_mktsegment AS s, 'P' || left(o_orderpriority, 1) AS p FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT id AS call_id, 0 AS overload, 'K' AS variable, s AS bound, even AS conflict FROM o WHERE f = 0 UNION ALL SELECT id, 0, 'V', 'Array<' || p || '>', false FROM o WHERE f = 0 UNION ALL
    SELECT id, 0, 'K', p, false FROM o WHERE f = 1 UNION ALL SELECT id, 0, 'V', 'Box<' || s || '>', even FROM o WHERE f = 1 UNION ALL SELECT id, 1, 'W', '(' || p || ',' || s || ')->Box<' || s || '>', true FROM o WHERE f = 1 UNION ALL
    SELECT id, 0, 'K', s, false FROM o WHERE f = 2 UNION ALL SELECT id, 0, 'V', CASE WHEN even THEN p ELSE 'Q' END, even FROM o WHERE f = 2"""
)
def type_bindings(spark, d):
    """Calls of functions over maps, functions and tuples, whose arguments agree or not."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderkey as call_id", "concat('f', o_orderkey % 3) as name", "o_orderkey % 2 = 0 as even", "c_mktsegment as s", "concat('P', left(o_orderpriority, 1)) as p")
    args = """case name when 'f0' then array(concat('Map<', s, ', Array<', p, '>>'), if(even, p, s)) when 'f1' then array(concat('(', p, ', ', s, ') -> Box<', s, '>'), if(even, concat('Array<', p, '>'), concat('List<', p, '>')))
      else array(if(even, concat('(', s, ', Box<', p, '>)'), concat('(', s, ', Bag<', p, '>)')), 'Q') end"""
    overloads = [("f0", 0, ["K", "V"], ["Map<K, V>", "K"]), ("f1", 0, ["K", "V"], ["(K) -> V", "Array<V>"]), ("f1", 1, ["W"], ["W", "W", "W"]), ("f2", 0, ["K", "V"], ["(K, Box<V>)", "V"])]
    return generics.bind_type_variables(rows.selectExpr("call_id", "name", f"{args} as args"), spark.createDataFrame(overloads, "name string, overload int, type_params array<string>, params array<string>"))


@_query(
    """WITH q AS (SELECT 'N' || n_nationkey AS class, 'R' || n_regionkey AS interface, s_suppkey, 'm' || s_suppkey AS name, s_acctbal > 0 AS same FROM nation JOIN supplier ON s_suppkey % 5 = n_regionkey)
    SELECT class, interface, name, CASE WHEN 'N' || s_nationkey = class THEN 'signature mismatch' ELSE 'not implemented' END AS problem FROM q JOIN supplier USING (s_suppkey) WHERE NOT ('N' || s_nationkey = class AND (s_acctbal > 5000) = same)"""
)
def renamed_requirements(spark, d):
    """Generic methods that suppliers ask of the classes of a region, which name their type parameters otherwise, in another order."""
    from tessera.plans.catalog import _edges

    supplier = _t(spark, d, "supplier")
    owed = supplier.selectExpr("concat('R', s_suppkey % 5) as interface", "concat('m', s_suppkey) as name", "array('T', 'U') as type_params", "array('T', if(s_acctbal > 0, 'Map<T, T>', 'Map<T, U>')) as params", "'Array<T>' as result")
    own = supplier.selectExpr("concat('N', s_nationkey) as class", "concat('m', s_suppkey) as name", "array('A', 'T') as type_params", "array('T', if(s_acctbal > 5000, 'Map<T,T>', 'Map<T,A>')) as params", "'Array<T>' as result")
    reached = types.subtype_closure(_edges(spark, d)).filter("sub <> super").selectExpr("sub as class", "super as interface")
    required = reached.join(owed, "interface").select("class", "interface", "name", "type_params", "params", "result")
    return generics.unmet_up_to_renaming(required.filter("class like 'N%'"), own)


@_query(
    """WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS sub, 'R' || n_regionkey AS super FROM nation UNION ALL SELECT 'N' || n_nationkey, 'S' || n_nationkey % 3 FROM nation UNION ALL SELECT 'R' || r_regionkey, 'Any' FROM region UNION ALL VALUES ('S0', 'Any'), ('S1', 'S0'), ('S2', 'Other')),
    r(sub, super) AS (SELECT t, t FROM (SELECT sub AS t FROM e UNION SELECT super FROM e) UNION SELECT r.sub, e.super FROM r JOIN e ON e.sub = r.super),
    p AS (SELECT DISTINCT 'N' || c_nationkey AS one, CASE WHEN l_linenumber = 1 THEN 'S2' ELSE 'N' || s_nationkey END AS other FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
    b AS (SELECT one, other, x.super FROM p JOIN r x ON x.sub = one JOIN r y ON y.sub = other AND y.super = x.super)
    SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b o JOIN r ON r.sub = o.super AND r.super = b.super WHERE o.one = b.one AND o.other = b.other AND o.super <> b.super)"""
)
def common_supers(spark, d):
    """The least common types of the nations of customers and their suppliers, which have regions and groups above them."""
    nation = _t(spark, d, "nation")
    fixed = spark.createDataFrame([("S0", "Any"), ("S1", "S0"), ("S2", "Other")], "sub string, super string")
    edges = nation.selectExpr("concat('N', n_nationkey) sub", "concat('R', n_regionkey) super").union(nation.selectExpr("concat('N', n_nationkey)", "concat('S', n_nationkey % 3)")).union(_t(spark, d, "region").selectExpr("concat('R', r_regionkey)", "'Any'")).union(fixed)
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.selectExpr("concat('N', c_nationkey) as one", "if(l_linenumber = 1, 'S2', concat('N', s_nationkey)) as other")
    return generics.common_supers(pairs, types.subtype_closure(edges))
