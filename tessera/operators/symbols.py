"""A checker's symbol tables as relations: imports, overlays, resolution in a fixed order, requirements of interfaces.

Unless a docstring says otherwise a null name resolves to nothing, repeated rows of a table count
once, and an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.lexing import lex
from tessera.functions.types import canonical, head

# The language's primitive types.
PRIMITIVES = (
    "Int8", "Int16", "Int32", "Int64", "IntNative", "UInt8", "UInt16", "UInt32", "UInt64", "UIntNative",
    "Float16", "Float32", "Float64", "Bool", "Rune", "String", "Unit", "Nothing",
)


def imports(sources: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, type): the last part of each path that a text imports, once, as a global of type namespace:name. What stands in texts and comments imports nothing, nor does a null text.

    A path is names with dots between, after the keyword. The tokens after each import are numbered;
    the path ends before the first of them that is no name at an odd place or no dot at an even one.
    """
    tokens = lex(sources, id_col, text_col).filter("kind <> 'newline'")
    order = W.partitionBy(id_col).orderBy("pos")
    starts = (F.col("kind") == "keyword") & (F.col("token") == "import")
    tokens = tokens.withColumn("at", F.sum(starts.cast("int")).over(order)).filter("at > 0")
    tokens = tokens.withColumn("k", F.row_number().over(W.partitionBy(id_col, "at").orderBy("pos")) - 1).filter("k > 0")
    fits = F.when(F.col("k") % 2 == 1, F.col("kind") == "name").otherwise(F.col("token") == ".")
    end = F.coalesce(F.min(F.when(~fits, F.col("k"))).over(W.partitionBy(id_col, "at")), F.lit(1 << 30))
    names = tokens.withColumn("end", end).filter("k < end and k % 2 = 1").groupBy(id_col, "at").agg(F.max_by("token", "k").alias("name"))
    return names.select(id_col, "name").distinct().select(id_col, "name", F.concat(F.lit("namespace:"), "name").alias("type"))


def overlay(*layers: DataFrame, on: str = "name") -> DataFrame:
    """Per key the rows of the last layer that has it (several if that layer has several), with layer, its number from 0. Null keys are equal."""
    rows = reduce(DataFrame.unionByName, (layer.withColumn("layer", F.lit(k)) for k, layer in enumerate(layers)))
    return rows.withColumn("last", F.max("layer").over(W.partitionBy(on))).filter("layer = last").drop("last")


def model_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows (with side) that one model has more often than the other: none if and only if they are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.select(left.columns).exceptAll(left).withColumn("side", F.lit("right")))


def resolve(uses: DataFrame, scope: str, locals_: DataFrame, functions: DataFrame, globals_: DataFrame, nominals: DataFrame, order: tuple[str, ...] = ("local", "function", "global", "type", "primitive")) -> DataFrame:
    """The uses (scope, name, ...) with kind: the first of order in which the name is found, else unknown.

    Symbols are looked for as local, function, global, type, primitive; expressions look for the
    global before the function. locals_ has (scope, name), the others name.
    """
    rows = uses
    for kind, table, on in (("local", locals_, [scope, "name"]), ("function", functions, ["name"]), ("global", globals_, ["name"]), ("type", nominals, ["name"])):
        known = table.select(*on).distinct().select(*(F.col(c).alias(f"at_{c}") for c in on), F.lit(True).alias(f"is_{kind}"))
        rows = rows.join(known, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"at_{c}") for c in on)), "left").drop(*(f"at_{c}" for c in on))
    rows = rows.withColumn("is_primitive", F.col("name").isin(*PRIMITIVES))
    kind = F.coalesce(*(F.when(F.col(f"is_{k}"), F.lit(k)) for k in order), F.lit("unknown"))
    return rows.select(*uses.columns, kind.alias("kind"))


def resolve_members(uses: DataFrame, scope: str, locals_: DataFrame, globals_: DataFrame, members: DataFrame) -> DataFrame:
    """The uses (scope, receiver, member, ...) with owner and kind: field, method, static, or unknown.

    A receiver is a local or a global variable of a type (locals_ scope, name, type; globals_ name,
    type), or else the name of an owner itself, all of whose members are then static. members has
    (owner, member, kind); a field comes before a method, a method before a static member.
    """
    own = locals_.groupBy(scope, "name").agg(F.min("type").alias("local_type")).select(F.col(scope).alias("at_scope"), F.col("name").alias("at_name"), "local_type")
    rows = uses.join(own, (F.col(scope) == F.col("at_scope")) & (F.col("receiver") == F.col("at_name")), "left")
    far = globals_.groupBy("name").agg(F.min("type").alias("global_type")).select(F.col("name").alias("far_name"), "global_type")
    rows = rows.join(far, F.col("receiver") == F.col("far_name"), "left").withColumn("type", F.coalesce("local_type", "global_type"))
    rows = rows.withColumn("owner", F.coalesce(head(F.col("type")), F.col("receiver")))
    rank = F.when(F.col("kind") == "field", 0).when(F.col("kind") == "method", 1).otherwise(2)
    table = members.groupBy(F.col("owner").alias("of_owner"), F.col("member").alias("of_member")).agg(F.min(rank).alias("rank"))
    rows = rows.join(table, (F.col("owner") == F.col("of_owner")) & (F.col("member") == F.col("of_member")), "left")
    kind = F.when(F.col("rank").isNull(), "unknown").when(F.col("type").isNull() | (F.col("rank") == 2), "static").when(F.col("rank") == 0, "field").otherwise("method")
    return rows.select(*uses.columns, "owner", kind.alias("kind"))


def requirements(classes: DataFrame, closure: DataFrame, interface_methods: DataFrame) -> DataFrame:
    """(class, interface, name, params, result): what a class owes by all interfaces that it reaches. classes: class; closure: sub, super; interface_methods: interface, name, params, result."""
    reached = closure.filter("sub <> super").select(F.col("sub").alias("class"), F.col("super").alias("interface")).distinct()
    return classes.select("class").distinct().join(reached, "class").join(interface_methods, "interface").select("class", "interface", "name", "params", "result").distinct()


def unmet_requirements(required: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, interface, name, problem) of requirements (class, interface, name, params, result) that the methods (class, name, params, result) don't meet: not implemented, or signature mismatch where none of that name has the same types, blanks aside."""
    same = lambda c: F.transform(c, lambda x: canonical(x))
    named = methods.select("class", "name").distinct().withColumn("named", F.lit(True))
    exact = methods.select("class", "name", same("params").alias("params"), canonical(F.col("result")).alias("result")).distinct().withColumn("met", F.lit(True))
    rows = required.withColumn("params", same("params")).withColumn("result", canonical(F.col("result"))).join(named, ["class", "name"], "left").join(exact, ["class", "name", "params", "result"], "left")
    return rows.filter("met is null").select("class", "interface", "name", F.when(F.col("named"), "signature mismatch").otherwise("not implemented").alias("problem"))


def duplicate_parameters(signatures: DataFrame, params: str = "param_names") -> DataFrame:
    """The signatures with all their columns that name a parameter twice, and duplicated, those names in order. A null list names none."""
    twice = F.array_sort(F.array_distinct(F.filter(params, lambda x: F.size(F.filter(params, lambda y: y == x)) > 1)))
    return signatures.withColumn("duplicated", twice).filter(F.size("duplicated") > 0)


def member_collisions(members: DataFrame) -> DataFrame:
    """(owner, member, problem) of members (owner, member, kind): a field declared twice, or a field and a method of one name. Overloads of methods are no collision."""
    fields, methods = F.count_if(F.col("kind") == "field"), F.count_if(F.col("kind") == "method")
    rows = members.groupBy("owner", "member").agg(fields.alias("fields"), methods.alias("methods"))
    problem = F.when(F.col("fields") > 1, "duplicate class field").when((F.col("fields") > 0) & (F.col("methods") > 0), "class member name collision")
    return rows.withColumn("problem", problem).filter("problem is not null").select("owner", "member", "problem")
