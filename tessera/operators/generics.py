"""Generic types: substitution, closures over parameterised super types, bindings of type variables, signatures up to renaming, common super types.

Types are texts. Null or repeated rows of a table are left out or count once, and an empty table
gives an empty one, unless a docstring says otherwise. The type parameters of a nominal or a
signature are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.types import arguments, canonical, head, type_nodes
from tessera.sources.folders import forget, shared_folder, stored

#: A name with what makes it another type than the name alone (a path, a mark, an opening <), or any other sign.
_PIECE = r"[A-Za-z0-9_.:?\[\]]+<?|[^A-Za-z0-9_.:?\[\]]"


def _pieces(kind: Column) -> Column:
    return F.regexp_extract_all(kind, F.lit(_PIECE), F.lit(0))


def substituted(kind: Column, bindings: Column) -> Column:
    """A canonical type with what a map has for its parts that are names alone; what is put in isn't substituted again."""
    return F.array_join(F.transform(_pieces(kind), lambda p: F.coalesce(F.try_element_at(bindings, p), p)), "")


def names_one_of(kind: Column, names: Column) -> Column:
    """Whether a type has one of the names, as a part that is a name alone. False for null."""
    return F.coalesce(F.arrays_overlap(_pieces(canonical(kind)), names), F.lit(False))


def bound(params: Column, args: Column) -> Column:
    """Map from parameters to arguments, as many as there are of both."""
    n = F.least(F.size(params), F.size(args))
    return F.map_from_arrays(F.slice(params, F.lit(1), n), F.slice(args, F.lit(1), n))


def generic_closure(nominals: DataFrame, edges: DataFrame) -> DataFrame:
    """(sub, type_params, super, steps): every super type of each nominal, spelled by the nominal's own parameters; itself at 0 steps.

    nominals: name, type_params; edges: sub, ord, super, where super is spelled by sub's parameters. From a nominal each head
    is followed once, on its first path in order of ord, and no path leads to a head that it has passed; so cycles
    that grow end, and a head that several paths reach keeps one way on, while all its spellings are super types.
    A round extends the heads that the round before has found, or found a better path to, by one edge; the edges of these heads
    are stored, so that few of them need no join that deals all states out by a few heads. A nominal without a row in nominals has no parameters.
    """
    spark = edges.sparkSession
    own = nominals.filter("name is not null").groupBy("name").agg(F.min("type_params").alias("type_params"))
    steps = edges.filter("sub is not null and super is not null").select("sub", F.col("ord").cast("int").alias("ord"), canonical(F.col("super")).alias("super")).distinct()
    names = steps.select(F.col("sub").alias("name")).union(own.select("name")).distinct().join(own, "name", "left")
    names = names.select("name", F.coalesce("type_params", F.array().cast("array<string>")).alias("type_params"))
    names = stored(names, "closure-names")
    next_ = names.join(steps, F.col("name") == F.col("sub")).select(F.col("name").alias("head"), F.col("type_params").alias("params"), "ord", "super")
    whole = F.when(F.size("type_params") > 0, F.concat("name", F.lit("<"), F.array_join("type_params", ","), F.lit(">"))).otherwise(F.col("name"))
    start = names.select(F.col("name").alias("sub"), "type_params", F.col("name").alias("head"), F.array().cast("array<int>").alias("path"), F.lit(1).alias("fresh"), whole.alias("term"), F.array("name").alias("heads"))

    def keep(rows: DataFrame, old: str | None) -> tuple[DataFrame, str]:
        path = shared_folder(spark, "generic-closure")
        rows.write.parquet(path)
        if old:
            forget(spark, old)
        return spark.read.schema(rows.schema).parquet(path), path

    def over(states: DataFrame) -> DataFrame:
        here = stored(next_.join(states.select("head").distinct(), "head", "left_semi"), "closure-edges")
        rows = states.drop("fresh").withColumn("args", arguments(F.col("term"))).join(here, "head")
        rows = rows.withColumn("term", substituted(F.col("super"), bound(F.col("params"), F.col("args")))).withColumn("head", head(F.col("term")))
        return rows.filter(~F.array_contains("heads", F.col("head"))).withColumn("path", F.array_append("path", F.col("ord")))

    known, folder = keep(start, None)
    while known.filter("fresh = 1").limit(1).count():
        found = over(known.filter("fresh = 1")).select("sub", "type_params", "head", "path", F.lit(1).alias("fresh"), "term", F.array_append("heads", F.col("head")).alias("heads"))
        best = known.withColumn("fresh", F.lit(0)).unionByName(found).groupBy("sub", "head").agg(F.min(F.struct("path", "fresh", "term", "heads", "type_params")).alias("b"))
        known, folder = keep(best.select("sub", "b.type_params", "head", "b.path", "b.fresh", "b.term", "b.heads"), folder)
    supers = over(known.filter("size(path) = 0")).unionByName(over(known.filter("size(path) > 0"))).select("sub", "type_params", F.col("term").alias("super"), F.size("path").alias("steps"))
    return known.filter("size(path) = 0").select("sub", "type_params", F.col("term").alias("super"), F.lit(0).alias("steps")).unionByName(supers).groupBy("sub", "super").agg(F.min("type_params").alias("type_params"), F.min("steps").alias("steps")).select("sub", "type_params", "super", "steps")


def bind_type_variables(calls: DataFrame, overloads: DataFrame) -> DataFrame:
    """(call_id, overload, variable, bound, conflict): what the arguments of calls (call_id, name, args) bind the type variables of overloads (name, overload, type_params, params) to.

    Types are taken apart into nodes with the way that leads to each (heads and places). A variable is bound to the argument's node
    at the end of the same way; where heads differ, ways do. The first binding in order of the parameters and of
    their nodes counts; conflict says whether another one is different. Variables without a binding have no row.
    Equal lists of arguments are bound once a name; only calls that share an id are put together by it.
    """
    on = stored(overloads.select(F.col("name").alias("of"), "overload", "type_params", "params"), "overloads")  # stored, so its size is known and no join deals calls out by a few names
    rows = stored(calls.select("name", "args").distinct(), "call-kinds").join(on, F.col("name") == F.col("of"))
    zipped = F.slice(F.arrays_zip("params", "args"), F.lit(1), F.least(F.size("params"), F.size("args")))
    rows = rows.select("name", "args", "overload", "type_params", F.posexplode(zipped).alias("at", "pair"))
    rows = rows.withColumn("wanted", type_nodes(F.col("pair.params"))).withColumn("given", type_nodes(F.col("pair.args")))
    ways = F.map_from_entries(F.transform("given", lambda n: F.struct(n["way"], n["text"])))
    rows = rows.withColumn("ways", ways)
    nodes = F.filter(F.transform("wanted", lambda n, i: F.struct(i.alias("ord"), n["text"].alias("variable"), F.try_element_at(F.col("ways"), n["way"]).alias("bound"))), lambda x: F.array_contains(F.col("type_params"), x["variable"]) & x["bound"].isNotNull())
    found = rows.select("name", "args", "overload", "at", F.explode(nodes).alias("n")).select("name", "args", "overload", "n.variable", F.struct(F.col("at"), F.col("n.ord").alias("ord"), F.col("n.bound").alias("bound")).alias("first"))
    first, least, most = F.min("first").alias("first"), F.min("first.bound").alias("least"), F.max("first.bound").alias("most")
    kinds = stored(found.groupBy(F.col("name").alias("of"), F.col("args").alias("given"), "overload", "variable").agg(first, least, most), "call-bindings")

    shared = stored(calls.groupBy(F.col("call_id").alias("id")).count().filter("count > 1").select("id"), "call-ids")
    same, fields = F.col("call_id").eqNullSafe(F.col("id")), ["call_id", "overload", "variable", "first", "least", "most"]
    bound_by = lambda some: some.select("call_id", "name", "args").join(kinds, (F.col("name") == F.col("of")) & (F.col("args") == F.col("given"))).select(*fields)
    merged = bound_by(calls.join(shared, same, "left_semi")).groupBy("call_id", "overload", "variable").agg(first, F.min("least").alias("least"), F.max("most").alias("most"))
    out = bound_by(calls.join(shared, same, "left_anti")).unionByName(merged)
    return out.select("call_id", "overload", "variable", F.col("first.bound").alias("bound"), (F.col("least") != F.col("most")).alias("conflict"))


def renamed_signature(type_params: Column, params: Column, result: Column) -> Column:
    """A signature's canonical text with its type parameters numbered in order of use, so that signatures that differ in their names alone are equal."""
    whole = F.concat(F.lit("("), F.array_join(F.transform(params, lambda p: canonical(p)), ","), F.lit(")->"), canonical(result))
    pieces = _pieces(whole)
    used = F.array_distinct(F.filter(pieces, lambda p: F.array_contains(F.coalesce(type_params, F.array().cast("array<string>")), p)))
    number = lambda p: F.array_position(used, p)
    return F.array_join(F.transform(pieces, lambda p: F.when(number(p) > 0, F.concat(F.lit("#"), number(p).cast("string"))).otherwise(p)), "")


def unmet_up_to_renaming(required: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, interface, name, problem) of requirements (class, interface, name, type_params, params, result) that no method (class, name, type_params, params, result) meets up to the names of type parameters: not implemented, or signature mismatch where the class has one of that name."""
    form = renamed_signature(F.col("type_params"), F.col("params"), F.col("result"))
    own = methods.select("class", "name", form.alias("form")).distinct()
    have = own.groupBy("class", "name").agg(F.lit(True).alias("named"))
    rows = required.select("class", "interface", "name", form.alias("form")).distinct().join(own, ["class", "name", "form"], "left_anti").join(have, ["class", "name"], "left")
    return rows.select("class", "interface", "name", F.when(F.col("named"), "signature mismatch").otherwise("not implemented").alias("problem")).distinct()


def common_supers(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """(one, other, super): of each different pair all types that both reach by closure (sub, super; each its own) and below which there is no other such type.

    Types that reach each other don't lie below each other. A pair without a common type has no row.
    """
    reach = closure.select("sub", "super").distinct()
    each = pairs.select("one", "other").distinct()
    both = each.join(reach.select(F.col("sub").alias("one"), "super"), "one").join(reach.select(F.col("sub").alias("other"), "super"), ["other", "super"])
    # what lies strictly below, once a pair of types
    strict = reach.filter("sub <> super").join(reach.select(F.col("super").alias("sub"), F.col("sub").alias("super")), ["sub", "super"], "left_anti")
    above = both.join(strict.select(F.col("sub").alias("super"), F.col("super").alias("upper")), "super").select("one", "other", F.col("upper").alias("super")).distinct()
    return both.join(above, ["one", "other", "super"], "left_anti").select("one", "other", "super")
