"""Exact summaries of measurements: three percentile rules, medians, counts over several sets of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Accuracy of the approximate percentiles that bracket an exact one: a bracket holds about 4 / ACCURACY of a group's rows.
ACCURACY = 10_000


def bracketed(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """(group, value, n, upto): a group's different values around the share p of its rows, n rows in all, upto of them up to this value.

    Sketches that are merged before the shuffle give a lower and an upper bound; what lies below is
    counted, and only the values between are ranked. Groups of at most 10 * ACCURACY rows are
    ranked whole. Null values don't count; a group without others has no row; a null group is a group.
    """
    known = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("v is not null")
    reach = 2 / ACCURACY
    stats = known.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", [max(0.0, p - reach), min(1.0, p + reach)], ACCURACY).alias("q"))
    small = F.col("n") <= 10 * ACCURACY
    stats = stats.select(F.col("g").alias("sg"), "n", F.when(~small, F.col("q")[0]).alias("lo"), F.when(~small, F.col("q")[1]).alias("hi"))
    both = known.join(stats, F.col("g").eqNullSafe(F.col("sg")))
    inside = F.expr("(lo is null or v >= lo) and (hi is null or v <= hi)")
    counted = both.groupBy("g", "n", F.when(inside, F.col("v")).alias("v")).agg(F.count_if(inside | (F.col("v") < F.col("lo"))).alias("times"))
    upto = F.sum("times").over(W.partitionBy("g").orderBy(F.asc_nulls_first("v")))  # what lies below is the row without a value
    return counted.withColumn("upto", upto).filter("v is not null").select(F.col("g").alias(group), F.col("v").alias(value), "n", "upto")


def _at(rank: Column, value: str) -> Column:
    return F.min(F.when(F.col("upto") > F.when(rank < 0, F.col("n") - 1).otherwise(rank), F.col(value)))


def p95_rules(rows: DataFrame, group: str, value: str, p: float = 0.95) -> DataFrame:
    """Per group the value at three ranks (from 0): (n - 1) * p rounded half to even; ceil(n * p) - 1; floor(n * p) - 1, of which -1 is the last. Nulls and ties as in bracketed."""
    half_even, upper, lower = (F.expr(x) for x in (f"cast(bround((n - 1) * {p}D) as bigint)", f"cast(ceil(n * {p}D) as bigint) - 1", f"cast(floor(n * {p}D) as bigint) - 1"))
    ranked = bracketed(rows, group, value, p)
    return ranked.groupBy(group).agg(F.max("n").alias("n"), _at(half_even, value).alias("p95_half_even"), _at(upper, value).alias("p95_ceil"), _at(lower, value).alias("p95_floor"))


def summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Per group n, least, median (the mean of the middle two), p95 (ceil(0.95 n) - 1 from 0), most, total and mean (rounded to 2 and 6 places) of a value; null values don't count, and a group without others has n 0 and nulls."""
    amount = F.sum(F.col(value).cast("decimal(30,6)"))
    plain = rows.groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(amount, 2).cast("double").alias("total"), F.round(amount / F.count(value), 6).cast("double").alias("mean"))
    middle = bracketed(rows, group, value, 0.5).groupBy(F.col(group).alias("mg")).agg(((_at(F.expr("cast((n - 1) / 2 as bigint)"), value) + _at(F.expr("cast(n / 2 as bigint)"), value)) / 2).alias("median"))
    high = bracketed(rows, group, value, 0.95).groupBy(F.col(group).alias("hg")).agg(_at(F.expr("cast(ceil(n * 0.95D) as bigint) - 1"), value).alias("p95"))
    rows = plain.join(middle, F.col("g").eqNullSafe(F.col("mg")), "left").join(high, F.col("g").eqNullSafe(F.col("hg")), "left")
    return rows.select(F.col("g").alias(group), "n", "least", "median", "p95", "most", "total", "mean")


def family_counts(cases: DataFrame, *by: str) -> DataFrame:
    """(by..., n), most frequent first, then in the order of the columns; a null is a value."""
    return cases.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *(F.asc_nulls_first(c) for c in by))


def covered_counts(cases: DataFrame, covers: str, *by: str) -> DataFrame:
    """(by..., target, n) over the elements of a list column; null and empty lists cover nothing."""
    return cases.select(*by, F.explode(covers).alias("target")).groupBy(*by, "target").agg(F.count("*").alias("n"))


def timeline(**kinds: DataFrame) -> DataFrame:
    """The events (at, id) of several kinds as one table (at, priority, kind, id) by time and then in the order the kinds are given; a null time comes first."""
    parts = [rows.select("at", F.lit(k).alias("priority"), F.lit(kind).alias("kind"), "id") for k, (kind, rows) in enumerate(kinds.items())]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.orderBy(F.asc_nulls_first("at"), "priority", "id")


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts over each column alone, over all together and over nothing, in one pass: a row (dimension, value..., n)."""
    spark = rows.sparkSession
    sets = ", ".join([*(f"({c})" for c in columns), f"({', '.join(columns)})", "()"])
    marks = " || ".join(f"cast(1 - grouping({c}) as string)" for c in columns)
    return spark.sql(f"SELECT {marks} AS dimension, {', '.join(columns)}, count(*) AS n FROM {{rows}} GROUP BY GROUPING SETS ({sets})", rows=rows)


def coverage_missing(required: DataFrame, covered: DataFrame, on: str) -> DataFrame:
    """Required targets that nothing covers."""
    return required.select(on).distinct().join(covered.select(on), on, "left_anti")


def catalog_diff(left: DataFrame, right: DataFrame, on: str, dimensions: tuple[str, ...], expected: DataFrame | None = None) -> DataFrame:
    """Members of two catalogs: left only, right only, the first dimension in which both differ, or same; a difference of a member that expected (a column named as on) lists is expected. Nulls are equal to each other; a null key matches none."""
    a = left.select(on, *(F.col(d).alias(f"a_{d}") for d in dimensions), F.lit(1).alias("in_a"))
    b = right.select(on, *(F.col(d).alias(f"b_{d}") for d in dimensions), F.lit(1).alias("in_b"))
    kind = F.when(F.col("in_b").isNull(), "left only").when(F.col("in_a").isNull(), "right only")
    for d in dimensions:
        kind = kind.when(~F.col(f"a_{d}").eqNullSafe(F.col(f"b_{d}")), f"changed: {d}")
    rows = a.join(b, on, "full_outer").select(on, kind.otherwise("same").alias("category"))
    if expected is None:
        return rows
    known = expected.select(on).distinct().withColumn("known", F.lit(True))
    return rows.join(known, on, "left").select(on, F.when(F.col("known") & (F.col("category") != "same"), "expected").otherwise(F.col("category")).alias("category"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with their count) that left has more often than right: none if and only if left is contained in right."""
    names = left.columns
    row = F.struct(*names).alias("row")  # so that no column's name can clash
    counted = left.select(row, F.lit(1).alias("d")).unionByName(right.select(row, F.lit(-1).alias("d"))).groupBy("row").agg(F.sum("d").alias("surplus"))
    return counted.filter("surplus > 0").select("row.*", "surplus")


def multisets_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """(equal, more_left, more_right): whether both hold the same rows equally often, and how many rows each has more."""
    row = F.struct(*left.columns).alias("row")
    counted = left.select(row, F.lit(1).alias("d")).unionByName(right.select(row, F.lit(-1).alias("d"))).groupBy("row").agg(F.sum("d").alias("d"))
    more = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0)).cast("long")
    return counted.agg((F.count_if(F.col("d") != 0) == 0).alias("equal"), more(F.col("d")).alias("more_left"), more(-F.col("d")).alias("more_right"))


def clusters(rows: DataFrame, key: tuple[str, ...], example: str, most: int = 3) -> DataFrame:
    """Per key its count and its `most` smallest examples. Tasks pass on no more examples of a key than that, so a key with many rows is no more work than others; null keys are equal."""
    rank = F.row_number().over(W.partitionBy(*(F.col(f"k.{c}") for c in key)).orderBy("example"))
    ranked = rows.select(F.struct(*key).alias("k"), F.col(example).alias("example")).withColumn("rank", rank).filter(F.col("rank") <= most)
    shown = ranked.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("example")), ",").alias("shown"))
    counts = rows.groupBy(F.struct(*key).alias("k")).agg(F.count("*").alias("rows"))
    return counts.join(shown.withColumnRenamed("k", "of"), F.col("k").eqNullSafe(F.col("of"))).select("k.*", F.col("rows").alias("n"), F.col("shown").alias("examples"))


def running_offsets(parts: DataFrame, stream: str, order: str, text: str) -> DataFrame:
    """Byte offset at which each part of a stream ends."""
    by = W.partitionBy(stream).orderBy(order)
    return parts.withColumn("end_byte", F.sum(F.octet_length(text)).over(by))


def offsets_of_parts(counts: DataFrame, part: str, n: str) -> DataFrame:
    """(part, before): rows of all parts before each; one light row per partition meets in the window."""
    return counts.select(part, F.coalesce(F.sum(n).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def gates(rows: DataFrame, every: dict[str, Column], some: dict[str, Column], count: dict[str, Column] | None = None) -> DataFrame:
    """One row: for each name of every whether its condition holds of all rows, of some whether of any, of count of how many. A null condition doesn't count for or against; without rows all are null, counts 0."""
    return rows.agg(*(F.bool_and(c).alias(n) for n, c in every.items()), *(F.bool_or(c).alias(n) for n, c in some.items()), *(F.count_if(c).alias(n) for n, c in (count or {}).items()))
