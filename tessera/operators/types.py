"""Nominal types: closure over their super types, and which type may stand for which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.types import arguments, canonical, function_parts, head, leaf_pairs
from tessera.operators.generics import bound, substituted
from tessera.sources.folders import forget, shared_folder, stored


def subtype_closure(edges: DataFrame) -> DataFrame:
    """(sub, super, steps) of all pairs that edges (sub, super) lead to, each with its fewest steps; a type is its own at 0 steps.

    Paths double in length in each round, so a chain of n types takes log2(n) rounds, and of each
    pair only the fewest steps go on: cycles and lattices end like trees. A round joins what the one before
    has changed, on either side, and it ends when nothing has changed, whatever the depth. Edges with a null are left out; repeated ones count once.
    """
    spark = edges.sparkSession
    known = edges.filter("sub is not null and super is not null").select("sub", "super").distinct()
    names = known.select(F.explode(F.array("sub", "super")).alias("sub")).distinct()
    now = names.select("sub", F.col("sub").alias("super"), F.lit(0).cast("long").alias("steps"), F.lit(False).alias("new")).unionByName(known.filter("sub <> super").select("sub", "super", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("new")))
    old = None
    while True:
        path = shared_folder(spark, "closure")
        now.write.parquet(path)
        if old:
            forget(spark, old)
        now, old = spark.read.schema(now.schema).parquet(path), path
        if not now.filter("new").limit(1).count():
            return now.select("sub", "super", F.col("steps").cast("int").alias("steps"))
        apart = now.filter("sub <> super")
        on = apart.select(F.col("sub").alias("super"), F.col("super").alias("end"), F.col("steps").alias("more"), F.col("new").alias("more_new"))
        longer = apart.join(on, "super").filter("(new or more_new) and sub <> end").select("sub", F.col("end").alias("super"), (F.col("steps") + F.col("more")).alias("steps"), F.lit(True).alias("new"))
        both = now.withColumn("new", F.lit(False)).unionByName(longer)
        now = both.groupBy("sub", "super").agg(F.min(F.struct("steps", "new")).alias("m")).select("sub", "super", "m.steps", "m.new")


def _unknown(kind: Column) -> Column:
    return kind.isNull() | kind.isin("", "?")


def compatible(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """Adds compatible: whether got may stand for want.

    Unknown (null, '' or '?') fits everything; otherwise equal, a subtype, or the same head where
    want has no arguments. closure has sub and super, and type_params where super types are spelled by
    them: then got's arguments stand for those. A function fits one with as many parameters, each of which fits in the
    other direction, and whose result fits. A pair of types is looked up once however often it stands in the table; only pairs of
    functions are taken apart in Python.
    """
    named = pairs.withColumn("pair_got", canonical(F.col("got"))).withColumn("pair_want", canonical(F.col("want")))
    todo = stored(named.select("pair_got", "pair_want").distinct(), "type-pairs")
    params = F.col("type_params") if "type_params" in closure.columns else F.array().cast("array<string>")
    known = closure.select(F.col("sub").alias("known_sub"), canonical(F.col("super")).alias("known_super"), params.alias("known_params")).distinct().withColumn("known_head", head(F.col("known_super")))
    plain_want = ~F.contains("want", F.lit("<"))
    spelled = substituted(F.col("known_super"), bound(F.col("known_params"), F.col("args"))) == F.col("want")
    fits = _unknown(F.col("got")) | _unknown(F.col("want")) | (F.col("got") == F.col("want")) | (plain_want & (F.col("known_sub").isNotNull() | (F.col("g") == F.col("w")))) | spelled

    def looked_up(parts: DataFrame, *by: str) -> DataFrame:
        rows = parts.withColumns({"g": head(F.col("got")), "w": head(F.col("want")), "args": arguments(F.col("got"))}).join(known, (F.col("g") == F.col("known_sub")) & (F.col("w") == F.col("known_head")), "left")
        return rows.groupBy("pair_got", "pair_want", *by).agg(F.bool_or(F.coalesce(fits, F.lit(False))).alias("fits"))

    functions = F.coalesce(F.startswith("pair_got", F.lit("(")) & F.startswith("pair_want", F.lit("(")), F.lit(False))
    plain = looked_up(todo.filter(~functions).select("pair_got", "pair_want", F.col("pair_got").alias("got"), F.col("pair_want").alias("want")))
    leaves = todo.filter(functions).select("pair_got", "pair_want", F.posexplode_outer(leaf_pairs(F.col("pair_got"), F.col("pair_want"))).alias("at", "leaf")).select("pair_got", "pair_want", "at", "leaf.got", "leaf.want")
    apart = looked_up(leaves, "at").groupBy("pair_got", "pair_want").agg(F.bool_and(F.col("at").isNotNull() & F.col("fits")).alias("fits"))
    all_fit = stored(plain.unionByName(apart).select(F.col("pair_got").alias("of_got"), F.col("pair_want").alias("of_want"), F.col("fits").alias("compatible")), "type-answers")
    same = F.col("pair_got").eqNullSafe(F.col("of_got")) & F.col("pair_want").eqNullSafe(F.col("of_want"))
    return named.join(all_fit, same).select(*pairs.columns, "compatible")


def compatible_strict(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """Adds compatible by the stricter rule: an unknown:, type: or interface-type: never fits; otherwise equal, or a subtype or the same head of which either side has no arguments. Nulls don't fit."""
    known = closure.select(F.col("sub").alias("known_sub"), F.col("super").alias("known_super")).distinct()
    rows = pairs.select(F.struct(*pairs.columns).alias("own"), "got", "want").withColumn("pair", F.struct(canonical(F.col("got")).alias("got"), canonical(F.col("want")).alias("want"), head(F.col("got")).alias("g"), head(F.col("want")).alias("w")))
    rows = rows.join(known, (F.col("pair.g") == F.col("known_sub")) & (F.col("pair.w") == F.col("known_super")), "left")
    raw = ~F.contains("pair.got", F.lit("<")) | ~F.contains("pair.want", F.lit("<"))
    never = F.col("got").rlike("^(unknown:|type:|interface-type:)")
    fits = ~never & ((F.col("pair.got") == F.col("pair.want")) | (raw & ((F.col("pair.g") == F.col("pair.w")) | F.col("known_sub").isNotNull())))
    return rows.select("own.*", F.coalesce(fits, F.lit(False)).alias("compatible"))


def type_facts(kinds: DataFrame, kind: str) -> DataFrame:
    """The rows with canonical, head, args, params and result of a type; params and result are null unless it is a function."""
    parts = kinds.withColumn("canonical", canonical(F.col(kind))).withColumn("head", head(F.col(kind))).withColumn("args", arguments(F.col(kind))).withColumn("f", function_parts(F.col(kind)))
    return parts.select(*kinds.columns, "canonical", "head", "args", "f.params", "f.result")
