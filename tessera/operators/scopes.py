"""Brackets, declarations and scopes of texts as relations over their tokens.

Nesting is one running sum a kind of bracket. A text's tokens may be more than a task should walk
through in a row, so the sum is taken by chunks: each chunk is reduced to what it adds and the lowest it
goes, those are summed up over the chunks, and each chunk goes on from what lies before it. A closing bracket that
closes nothing changes nothing. Rows that repeat a text's id are one text only if their tokens' places differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.folders import stored

#: Tokens that a chunk of a text holds at most.
CHUNK = 10_000
PAIRS = {"(": ")", "[": "]", "{": "}"}

# Keywords after which a name is declared, and the family of the declaration.
FAMILIES = {"func": "function", "class": "class", "struct": "struct", "enum": "enum", "interface": "interface", "let": "constant", "var": "variable", "init": "constructor", "extend": "extension"}


def levels(rows: DataFrame, *by: str, at: str = "pos", step: str = "step", chunk: int = CHUNK) -> DataFrame:
    """rows with level, how many openings (step 1) up to and with each row are not closed (step -1) yet, and stray, whether it closes nothing.

    by names the columns of a text, at its order, which is unique in it; other rows have step 0. Levels start from 0 in each text.
    """
    part = W.partitionBy(*by, "chunk__")
    upto = part.orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("chunk__", F.expr(f"{at} div {chunk}")).withColumn("sum__", F.sum(step).over(upto)).withColumn("low__", F.min("sum__").over(upto))
    parts = rows.groupBy(*by, "chunk__").agg(F.sum(step).alias("adds__"), F.min("sum__").alias("lowest__"))
    before = W.partitionBy(*by).orderBy("chunk__").rowsBetween(W.unboundedPreceding, -1)  # a row a chunk
    parts = parts.withColumn("start__", F.coalesce(F.sum("adds__").over(before), F.lit(0)))
    parts = parts.withColumn("floor__", F.least(F.lit(0), F.coalesce(F.min(F.col("start__") + F.col("lowest__")).over(before), F.lit(0))))
    same = [F.col(c).eqNullSafe(F.col(f"{c}__of")) for c in by]
    parts = parts.select(*(F.col(c).alias(f"{c}__of") for c in by), F.col("chunk__").alias("chunk__of"), "start__", "floor__")
    joined = rows.join(parts, _all(*same, F.col("chunk__") == F.col("chunk__of")))
    total, low = F.col("start__") + F.col("sum__"), F.least("floor__", F.col("start__") + F.col("low__"))
    earlier = F.least("floor__", F.coalesce(F.col("start__") + F.lag("low__").over(part.orderBy(at)), F.col("floor__")))
    out = joined.withColumn("level", (total - low).cast("int")).withColumn("stray", (F.col(step) < 0) & (total < earlier))
    return out.select(*(c for c in rows.columns if not c.endswith("__")), "level", "stray")


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def bracket_pairs(tokens: DataFrame, id_col: str, chunk: int = CHUNK) -> DataFrame:
    """(id, bracket, open, close, level) of tokens (id, pos, kind, token): each opening bracket's place, that of the one which closes it (null if none does), and how many of its kind are open with it.

    Kinds are matched apart, as if there were no others. Brackets in texts and comments are no tokens.
    """
    of = F.create_map(*(F.lit(x) for a, b in PAIRS.items() for x in (a, a, b, a)))
    signs = tokens.filter(F.col("kind").isin("sign", "operator") & F.col("token").isin(*PAIRS, *PAIRS.values()))
    step = F.when(F.col("token").isin(*PAIRS), 1).otherwise(-1)
    rows = levels(signs.select(id_col, F.try_element_at(of, F.col("token")).alias("bracket"), "pos", step.alias("step")), id_col, "bracket", chunk=chunk).filter("not stray")
    # on one level an opening bracket is followed by the one that closes it
    rows = rows.withColumn("level", F.col("level") + F.when(F.col("step") < 0, 1).otherwise(0))
    order = W.partitionBy(id_col, "bracket", "level").orderBy("pos")
    rows = rows.withColumn("close", F.when(F.lead("step").over(order) < 0, F.lead("pos").over(order)))
    return rows.filter("step > 0").select(id_col, "bracket", F.col("pos").alias("open"), "close", "level")


def innermost(intervals: DataFrame, points: DataFrame, *by: str, chunk: int = CHUNK) -> DataFrame:
    """points (by, at, ...) with open and close of the innermost interval (by, open, close) around each, nulls where there is none.

    Intervals of a text lie in each other or apart, and one without a close goes on to the end; no place is the end of two, and a point
    at an interval's open or close lies outside of it. A sweep: at a point's level, the last interval of that level is the
    one around it, so nothing is joined but neighbours in order. Points may repeat; a point without a place has no interval.
    """
    kept = points.select(F.struct(*points.columns).alias("own"), *by, F.col("at").alias("pos")).filter("pos is not null")
    marks = intervals.filter("open is not null").select(*by, "open", "close").distinct()
    none = F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType.simpleString())
    rows = kept.select(*by, (F.col("pos") * 3).alias("pos"), F.lit(0).alias("step"), F.lit(None).cast("long").alias("open"), F.lit(None).cast("long").alias("close"), "own")
    rows = rows.unionByName(marks.select(*by, (F.col("open") * 3 + 1).alias("pos"), F.lit(1).alias("step"), F.col("open").cast("long").alias("open"), F.col("close").cast("long").alias("close"), none.alias("own")))
    rows = rows.unionByName(marks.filter("close is not null").select(*by, (F.col("close") * 3 - 1).alias("pos"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("open"), F.lit(None).cast("long").alias("close"), none.alias("own")))
    found = levels(rows.withColumnsRenamed({"open": "from", "close": "to"}), *by, chunk=3 * chunk)
    last = W.partitionBy(*by, "level").orderBy("pos", "step").rowsBetween(W.unboundedPreceding, 0)
    found = found.withColumn("at_", F.last(F.when(F.col("step") > 0, F.struct("from", "to")), True).over(last)).filter("step = 0")
    inside = F.when(F.col("level") > 0, F.col("at_"))
    out = found.select("own.*", inside["from"].alias("open"), inside["to"].alias("close"))
    return out.unionByName(points.filter("at is null").select("*", F.lit(None).cast("long").alias("open"), F.lit(None).cast("long").alias("close")))


def declarations(tokens: DataFrame, id_col: str, chunk: int = CHUNK) -> DataFrame:
    """(id, family, name, pos, open, close) of what tokens (id, pos, kind, token) declare after a keyword of FAMILIES: place of the keyword, and of the braces of its body.

    The body is the first brace after the keyword and before the next declaration or end of a statement outside of
    brackets; null where there is none, its close null while it is open. A keyword without a name (init aside) declares nothing.
    """
    order = W.partitionBy(id_col).orderBy("pos")
    code = tokens.filter("kind <> 'newline'").withColumn("next_kind", F.lead("kind").over(order)).withColumn("next", F.lead("token").over(order))
    family = F.try_element_at(F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv)), F.col("token"))
    named = (F.col("kind") == "keyword") & family.isNotNull() & ((F.col("next_kind").isin("name", "raw")) | (F.col("token") == "init"))
    found = code.withColumn("family", F.when(named, family)).withColumn("name", F.when(F.col("token") == "init", F.lit("init")).otherwise(F.col("next")))
    # up to the next declaration, the first brace, or a semicolon before it
    stop = F.col("family").isNotNull() | ((F.col("kind") == "sign") & F.col("token").isin("{", "}", ";"))
    stops = found.filter(stop).withColumn("then_pos", F.lead("pos").over(order)).withColumn("then", F.lead("token").over(order)).filter("family is not null")
    body = F.when((F.col("then") == "{") & ~F.col("family").isin("constant", "variable"), F.col("then_pos"))
    rows = stops.select(id_col, "family", "name", "pos", body.alias("open"))
    braces = bracket_pairs(tokens, id_col, chunk).filter("bracket = '{'").select(F.col(id_col).alias("of_id"), F.col("open").alias("of_open"), "close")
    return rows.join(braces, F.col(id_col).eqNullSafe(F.col("of_id")) & (F.col("open") == F.col("of_open")), "left").select(id_col, "family", "name", "pos", "open", "close")


def open_functions(tokens: DataFrame, points: DataFrame, id_col: str, chunk: int = CHUNK) -> DataFrame:
    """points (id, at, ...) with the innermost function or constructor whose body is around each: function (its name), open and close; nulls outside of all."""
    bodies = declarations(tokens, id_col, chunk).filter("family in ('function', 'constructor') and open is not null")
    found = innermost(bodies.select(id_col, "open", "close"), points, id_col, chunk=chunk)
    names = bodies.select(F.col(id_col).alias("of_id"), F.col("open").alias("of_open"), F.col("name").alias("function")).distinct()
    return found.join(names, F.col(id_col).eqNullSafe(F.col("of_id")) & (F.col("open") == F.col("of_open")), "left").select(*points.columns, "function", "open", "close")


def scope_conflicts(tokens: DataFrame, id_col: str, families: tuple[str, ...] = ("constant", "variable"), chunk: int = CHUNK) -> DataFrame:
    """(id, name, pos, scope, problem, other) of declarations of the given families: duplicate if the same braces (scope is their opening one, -1 outside of all) declare the name before, at other, else shadowing if braces around those declare it, at other, the scope's opening brace.

    Scopes are braces in each other. Which of those around declares a name is asked a name at a time, over the scopes with that name alone.
    """
    named = declarations(tokens, id_col, chunk).filter(F.col("family").isin(*families)).select(id_col, "name", F.col("pos").alias("at"))
    braces = bracket_pairs(tokens, id_col, chunk).filter("bracket = '{'").select(id_col, "open", "close")
    placed = innermost(braces, named, id_col, chunk=chunk).withColumn("scope", F.coalesce("open", F.lit(-1).cast("long")))
    before = F.lag("at").over(W.partitionBy(id_col, "name", "scope").orderBy("at"))
    placed = stored(placed.withColumn("before", before), "placed")
    scopes = placed.select(id_col, "name", F.col("scope").alias("open"), "close").distinct()
    asked = placed.filter("before is null and scope >= 0").select(id_col, "name", F.col("scope").alias("at"), F.col("at").alias("pos"))
    around = innermost(scopes, asked, id_col, "name", chunk=chunk).filter("open is not null")
    shadows = around.select(id_col, "name", "pos", F.col("at").alias("scope"), F.lit("shadowing").alias("problem"), F.col("open").alias("other"))
    twice = placed.filter("before is not null").select(id_col, "name", F.col("at").alias("pos"), "scope", F.lit("duplicate").alias("problem"), F.col("before").cast("long").alias("other"))
    return twice.unionByName(shadows)
