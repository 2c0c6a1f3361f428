"""Verdicts of streams: rows (stream, seq, ok) reduced, cut, inverted and compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.folders import stored


def first_reject(verdicts: DataFrame, stream: str = "stream_id") -> DataFrame:
    """Per stream the smallest seq whose verdict is a reject (a missing one counts as such), null if none, and the number of verdicts."""
    return verdicts.groupBy(stream).agg(F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("seq"))).alias("first_reject"), F.count("*").alias("n"))


def stop_after_first(verdicts: DataFrame, stream: str = "stream_id") -> DataFrame:
    """The verdicts up to and including a stream's first reject: nothing is answered after it."""
    bad = F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("seq"))).over(W.partitionBy(stream))
    first = max(verdicts.columns, key=len) + "_first"  # longer than any of the columns' names, so none of them
    return verdicts.withColumn(first, bad).filter(F.col(first).isNull() | (F.col("seq") <= F.col(first))).drop(first)


def protocol_bit(ok: Column, competition: bool = False) -> Column:
    """0 for continue and 1 for error, or the other way round."""
    return F.when(ok, F.lit(int(competition))).otherwise(F.lit(1 - int(competition)))


def transcript_diff(left: DataFrame, right: DataFrame, key: str = "stream_id") -> DataFrame:
    """Per key the first seq at which two transcripts (key, seq, bit) differ, where one that is missing differs; null if none; and both lengths."""
    a = left.select(key, "seq", F.col("bit").alias("a"))
    b = right.select(key, "seq", F.col("bit").alias("b"))
    both = a.join(b, [key, "seq"], "full_outer")
    return both.groupBy(key).agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("seq"))).alias("first_diff"), F.count("a").alias("n_left"), F.count("b").alias("n_right"))


def transition_classes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per key how its first reject moved: kept, deferred, earlier, fixed, new or clean."""
    a, b = F.col("old_at"), F.col("new_at")
    rows = old.select(key, F.col("first_reject").alias("old_at")).join(new.select(key, F.col("first_reject").alias("new_at")), key, "full_outer")
    kind = F.when(a.isNull() & b.isNull(), "clean").when(a.isNull(), "new").when(b.isNull(), "fixed").when(a == b, "kept").when(b > a, "deferred").otherwise("earlier")
    return rows.withColumn("transition", kind)


def context_rule(tokens: DataFrame, stream: str, order: str, kind: str, heads: tuple[str, ...], follow: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows that break a rule of two steps: after one of heads comes one of follow[head]. Adds previous and violates."""
    previous = F.lag(kind).over(W.partitionBy(stream).orderBy(order))
    allowed = F.lit(False)
    for head in heads:
        allowed = allowed | ((F.col("previous") == head) & F.col(kind).isin(*follow[head]))
    return tokens.withColumn("previous", previous).withColumn("violates", F.coalesce(F.col("previous").isin(*heads) & ~allowed, F.lit(False)))


def context_rule_after(tokens: DataFrame, stream: str, order: str, kind: str, heads: dict[str, tuple[str, ...]], middle: str) -> DataFrame:
    """Adds violates: a row two after a head, with a middle between them, that is none of heads[head]. Rows of equal order follow their kind; the last rows of a stream break nothing."""
    by = W.partitionBy(stream).orderBy(order, kind)
    rows = tokens.withColumns({"one_before": F.lag(kind).over(by), "two_before": F.lag(kind, 2).over(by)})
    broken = F.lit(False)
    for head, allowed in heads.items():
        broken = broken | ((F.col("two_before") == head) & (F.col("one_before") == middle) & ~F.col(kind).isin(*allowed))
    return rows.withColumn("violates", F.coalesce(broken, F.lit(False))).drop("one_before", "two_before")


def call_frontier(overloads: DataFrame, calls: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """Per call and overload of its name: alive, waiting or dead, and why.

    overloads: name, overload, params array, required (0: all). calls: call_id, name, args array,
    closed. An argument of an unknown type (null) fits every parameter. With a closure of super
    types arguments must be compatible, each pair of types being looked up once; without one equal.
    Where overloads have type_params, a parameter or result that names one of them fits everything. Where overloads
    have a result and calls an expected type (null: none), a result that doesn't fit it is told as the reason expected return only of an
    overload that isn't dead; it kills none. Calls that are alike but for their ids are answered once.
    """
    from .generics import names_one_of
    from .types import compatible

    need = F.when(F.col("required") == 0, F.size("params")).otherwise(F.col("required"))
    results = "result" in overloads.columns and "expected" in calls.columns
    alike = ["name", "args", "closed", *(["expected"] if results else [])]
    # stored, so their sizes are known and no join deals calls out by a few names
    rows = stored(calls.select(*alike).distinct().withColumn("kind", F.monotonically_increasing_id()), "call-kinds").join(stored(overloads, "overloads"), "name")
    variables = F.coalesce("type_params", F.array().cast("array<string>")) if "type_params" in overloads.columns else F.array().cast("array<string>")
    rows = rows.withColumn("params", F.transform("params", lambda p: F.when(~names_one_of(p, variables), p)))
    if closure is None:
        clash = F.expr("exists(sequence(0, greatest(least(size(args), size(params)), 1) - 1), i -> i < size(args) and i < size(params) and get(args, i) <> get(params, i))")
    else:
        both = rows.select("kind", "overload", F.explode(F.arrays_zip(F.col("args").alias("got"), F.slice("params", 1, F.greatest(F.size("args"), F.lit(0))).alias("want"))).alias("p")).select("kind", "overload", "p.got", "p.want").filter("want is not null")
        bad = compatible(both.select("got", "want").distinct(), closure).filter(~F.col("compatible")).select("got", "want")
        hit = both.join(bad, ["got", "want"]).select("kind", "overload").distinct().withColumn("hit", F.lit(True))
        rows, clash = rows.join(hit, ["kind", "overload"], "left"), F.coalesce("hit", F.lit(False))
    reason = F.when(F.size("args") > F.size("params"), "arity exceeded").when(clash, "argument type").when(F.col("closed") & (F.size("args") < need), "arity short at close")
    state = F.when(F.col("reason").isNotNull(), "dead").when(F.size("args") < need, "waiting").otherwise("alive")
    rows = rows.withColumn("reason", reason).withColumn("state", state)
    if results:
        asked = F.col("expected").isNotNull() & ~names_one_of(F.col("result"), variables)
        if closure is None:
            other = F.col("result") != F.col("expected")
        else:
            bad = compatible(rows.filter(asked).selectExpr("result as got", "expected as want").distinct(), closure).filter(~F.col("compatible")).selectExpr("got as result", "want as expected", "true as other")
            rows, other = rows.join(bad, ["result", "expected"], "left"), F.col("other")
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(asked & other, "expected return only")))
    answers = stored(rows.select(*(F.col(c).alias(f"of_{c}") for c in alike), "overload", "state", "reason"), "call-answers")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in alike))
    return calls.select("call_id", *alike).join(answers, same).select("call_id", "name", "overload", "state", "reason")
