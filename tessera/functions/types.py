"""The spelling of types: canonical text, head, arguments, the parts of a function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def canonical(kind: Column) -> Column:
    """Without blanks, but for one between two names. Null stays null."""
    kept = F.regexp_replace(kind, r"(?<=[A-Za-z0-9_])\s+(?=[A-Za-z_])", "\x01")
    return F.translate(F.regexp_replace(kept, r"\s+", ""), "\x01", " ")


def head(kind: Column) -> Column:
    """What stands before the arguments, and after 'type:'."""
    return F.regexp_extract(canonical(kind), r"^(?:type:)?([^<]*)", 1)


def _parts(text: str) -> list[str]:
    """A list's parts between commas outside of all brackets; an arrow's sign closes none."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in "<([{":
            depth += 1
        elif c in ">)]}" and text[i - 1 : i + 1] != "->":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]] if text else []


def split_parts(texts: Column) -> Column:
    """What _parts gives, without a Python worker: pieces between all commas, put together again until their brackets close."""
    count = lambda p, signs: F.length(p) - F.length(F.translate(p, signs, ""))
    deeper = lambda p: count(p, "<([{") - count(F.replace(p, F.lit("->"), F.lit("")), ">)]}")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("depth"))

    def add(s: Column, p: Column) -> Column:
        whole, depth = F.concat(F.coalesce(F.concat(s["open"], F.lit(",")), F.lit("")), p), s["depth"] + deeper(p)
        closed = depth == 0
        return F.struct(F.when(closed, F.array_append(s["done"], whole)).otherwise(s["done"]).alias("done"), F.when(~closed, whole).alias("open"), depth.alias("depth"))

    parts = F.aggregate(F.split(texts, ","), start, add, lambda s: F.when(s["open"].isNotNull(), F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    return F.when(texts == "", F.array().cast("array<string>")).when(~F.contains(texts, F.lit(",")), F.array(texts)).otherwise(parts)


def arguments(kind: Column) -> Column:
    """The type arguments in order; none where the type has none, null for null."""
    return split_parts(F.regexp_extract(canonical(kind), r"^[^<]*<(.*)>$", 1))


def _function(text: str) -> tuple[list[str], str] | None:
    if not text.startswith("("):
        return None
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "(<[") - (c in ")]" or (c == ">" and text[i - 1] != "-"))
        if not depth:
            return (_parts(text[1:i]), text[i + 3 :]) if text[i + 1 : i + 3] == "->" else None
    return None


@F.pandas_udf(StructType([StructField("params", ArrayType(StringType())), StructField("result", StringType())]))
def _function_parts(texts: pd.Series) -> pd.DataFrame:
    found = [_function(t) if isinstance(t, str) else None for t in texts]
    return pd.DataFrame({"params": [f[0] if f else None for f in found], "result": [f[1] if f else None for f in found]})


def function_parts(kind: Column) -> Column:
    """struct<params, result> of a function type, nulls in it for any other type."""
    return _function_parts(canonical(kind))


def _walk(text: str, way: str) -> list[tuple[str, str]]:
    out, function = [(way, text)], _function(text)
    if function:
        for i, part in enumerate(function[0]):
            out += _walk(part, f"{way}->{i}/")
        return out + _walk(function[1], f"{way}->r/")
    if text.startswith("(") and text.endswith(")"):
        start, inner = "()", text[1:-1]
    else:
        start, _, inner = text.partition("<")
        start, inner = start + "<", inner[:-1] if inner.endswith(">") else ""
    for i, part in enumerate(_parts(inner)):
        out += _walk(part, f"{way}{start}{i}/")
    return out


@F.pandas_udf(ArrayType(StructType([StructField("way", StringType()), StructField("text", StringType())])))
def _type_nodes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"way": w, "text": x} for w, x in _walk(t, "")], na_action="ignore")


def type_nodes(kind: Column) -> Column:
    """The nodes of a type in preorder, each with the way from the root: heads and places; a function's result is at place r. Null for null."""
    return _type_nodes(canonical(kind))


def _leaves(got: str | None, want: str | None) -> list[tuple[str | None, str | None]] | None:
    a, b = (_function(t) if t else None for t in (got, want))
    if not a or not b:
        return [(got, want)]
    if len(a[0]) != len(b[0]):
        return None
    out = []
    for pair in (*zip(b[0], a[0], strict=True), (a[1], b[1])):
        found = _leaves(*pair)
        if found is None:
            return None
        out += found
    return out


@F.pandas_udf(ArrayType(StructType([StructField("got", StringType()), StructField("want", StringType())])))
def _leaf_pairs(got: pd.Series, want: pd.Series) -> pd.Series:
    pairs = (_leaves(g if isinstance(g, str) else None, w if isinstance(w, str) else None) for g, w in zip(got, want, strict=True))
    return pd.Series([None if p is None else [{"got": g, "want": w} for g, w in p] for p in pairs])


def leaf_pairs(got: Column, want: Column) -> Column:
    """What must fit what for a type to stand for another: functions are taken apart, parameters in the other direction. Null where they take different numbers of parameters."""
    return _leaf_pairs(canonical(got), canonical(want))
