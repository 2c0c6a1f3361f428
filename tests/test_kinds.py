"""Calls and pairs of types that are alike are looked at once, however many rows there are, and rows that share an id keep their answers."""

import random

from pyspark.sql import functions as F

from tessera.functions import types as kinds
from tessera.operators import generics, types, verdicts

CALL, OVERLOAD = "call_id int, name string, args array<string>", "name string, overload int, type_params array<string>, params array<string>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bindings_parse_each_list_of_arguments_once(spark):
    calls = [(i, "f", ["Box<A>", "A" if i % 2 else "B"]) for i in range(40)] + [(50, "f", ["Box<C>"]), (50, "f", ["Box<D>", "C"]), (50, "g", ["E"]), (None, "f", ["Box<A>"]), (51, "f", None), (52, None, ["A"])]
    overloads = [("f", 0, ["T"], ["Box<T>", "T"]), ("g", 0, ["T"], ["T"]), ("g", 1, ["U"], ["U"])]
    got = generics.bind_type_variables(spark.createDataFrame(calls, CALL), spark.createDataFrame(overloads, OVERLOAD))
    want = [(i, 0, "T", "A", i % 2 == 0) for i in range(40)] + [(50, 0, "T", "E", True), (50, 1, "U", "E", False), (None, 0, "T", "A", False)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    # the rows of calls go through no parser of their own
    assert "EvalPython" not in plan(got)


def test_frontier_answers_calls_that_are_alike_once(spark):
    call, overload = CALL + ", closed boolean, expected string", OVERLOAD + ", required int, result string"
    calls = [(i, "f", ["A"] * (i % 3), i % 2 == 0, None if i % 5 else "X") for i in range(60)] + [(70, "f", ["B"], None, "R"), (70, "f", ["A"], False, "R"), (None, "f", ["B"], True, None), (71, "f", [None], True, None), (72, "none", ["A"], True, None)]
    overloads = [("f", 0, None, ["A"], 0, "R"), ("f", 1, ["T"], ["T", "T"], 2, "T")]
    closure = types.subtype_closure(spark.createDataFrame([("A", "Any"), ("B", "Any"), ("R", "Any"), ("X", "Any")], "sub string, super string"))
    got = verdicts.call_frontier(spark.createDataFrame(overloads, overload), spark.createDataFrame(calls, call), closure)

    def answer(args, closed, expected, o):
        n = len(args)
        dead = "arity exceeded" if n > o + 1 else "argument type" if not o and "B" in args else "arity short at close" if closed and n < o + 1 else None
        other = "expected return only" if not o and expected == "X" else None
        return "dead" if dead else "waiting" if n < o + 1 else "alive", dead or other

    want = [(i, "f", o, *answer(args, closed, expected, o)) for i, name, args, closed, expected in calls if name == "f" for o in (0, 1)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    # the rows of calls meet stored answers, and are grouped by nothing
    assert "Aggregate" not in plan(got) and plan(got).count("Join") == 1


def test_arguments_are_split_in_no_python_worker(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("ab,,<>(-)->[]{}") for _ in range(rng.randrange(14))),) for _ in range(2000)] + [(None,), ("->",), (",",), ("",)]
    got = spark.createDataFrame(rows, "t string").select("t", kinds.split_parts(F.col("t")).alias("p"))
    assert "EvalPython" not in plan(got)
    assert [r for r in got.collect() if r["p"] != (None if r["t"] is None else kinds._parts(r["t"]))] == []
