"""Generic types against plain recursion: substitution, closures, bindings, renaming and common types."""

import random

from pyspark.sql import functions as F

from tessera.functions.types import _function, _parts
from tessera.operators import generics, types


def parts(text):
    """(kind, children) of a canonical type."""
    if _function(text):
        params, result = _function(text)
        return "->", params, result
    if text.startswith("("):
        return "()", _parts(text[1:-1]), None
    name, _, inner = text.partition("<")
    return name, _parts(inner[:-1]) if inner else [], None


def put(text, to):
    if text in to:
        return to[text]
    kind, inner, result = parts(text)
    done = [put(t, to) for t in inner]
    if kind == "->":
        return f"({','.join(done)})->{put(result, to)}"
    return f"({','.join(done)})" if kind == "()" else f"{kind}<{','.join(done)}>" if done else kind


def bind(pattern, actual, variables, out):
    if pattern in variables:
        out.append((pattern, actual))
        return
    (k, a, r), (j, b, s) = parts(pattern), parts(actual)
    if k == j:
        for x, y in zip(a, b):
            bind(x, y, variables, out)
        if k == "->":
            bind(r, s, variables, out)


def made(rng, depth, names):
    kind = rng.randrange(6) if depth else 0
    inner = lambda n: [made(rng, depth - 1, names) for _ in range(n)]
    if kind in (1, 2):
        return f"{rng.choice(['Box', 'Map'])}<{','.join(inner(kind))}>"
    if kind == 3:
        return f"({','.join(inner(2))})"
    if kind == 4:
        return f"({','.join(inner(rng.randrange(3)))})->{inner(1)[0]}"
    return rng.choice(names)


def test_substitution(spark):
    rng, to = random.Random(1), {"T": "Box<U>", "U": "(A,T)->B"}
    rows = [(t,) for t in {made(rng, 4, ["T", "U", "A", "TT", "T?"]) for _ in range(200)} | {"T<A>", "type:T", "T[]", "a.T"}]
    table = spark.createDataFrame(rows, "t string").select("t", generics.substituted(F.col("t"), F.create_map(*[F.lit(x) for kv in to.items() for x in kv])).alias("s"))
    assert {r["t"]: r["s"] for r in table.collect()} == {t: put(t, to) if t not in ("T[]", "type:T", "a.T") else t for (t,) in rows}


def test_bindings_equal_a_plain_unifier(spark):
    rng = random.Random(2)
    overloads = [(f"f{i % 20}", i, ["T", "U"], [made(rng, 3, ["T", "U", "A"]) for _ in range(rng.randrange(4))]) for i in range(60)]
    calls = [(i, f"f{i % 20}", [made(rng, 3, ["A", "B"]) for _ in range(rng.randrange(4))]) for i in range(200)]
    calls += [(1000 + i, o[0], [put(p, {"T": made(rng, 2, ["A", "B"]), "U": "Box<A>"}) for p in o[3]]) for i, o in enumerate(overloads)] + [(5000, None, ["A"]), (5001, "f0", None)]
    want = set()
    for call, name, args in calls:
        for of, overload, variables, params in overloads:
            found = []
            for p, a in zip(params, args or []) if of == name else []:
                bind(p, a, variables, found)
            for v in {v for v, _ in found}:
                own = [b for x, b in found if x == v]
                want.add((call, overload, v, own[0], len(set(own)) > 1))
    got = generics.bind_type_variables(spark.createDataFrame(calls, "call_id int, name string, args array<string>"), spark.createDataFrame(overloads, "name string, overload int, type_params array<string>, params array<string>"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def closure(spark, names, edges):
    found = generics.generic_closure(spark.createDataFrame(names, "name string, type_params array<string>"), spark.createDataFrame(edges, "sub string, ord int, super string"))
    return found, {(r["sub"], r["super"], r["steps"]) for r in found.collect()}


def test_generic_closure(spark):
    names = [("Box", ["T"]), ("Seq", ["E"]), ("Pair", ["A", "B"]), ("Grow", ["T"]), ("Back", ["U"]), ("D", ["T"]), ("L", ["T"]), ("R", ["T"]), ("M", ["X"])]
    edges = [("Box", 0, "Seq< T >"), ("Seq", 0, "Any"), ("Pair", 0, "Seq<(A)->Box<B>>"), ("Grow", 0, "Back<Grow<T>>"), ("Back", 0, "Grow<Back<U>>")]
    edges += [("D", 0, "L<T>"), ("D", 1, "R<T>"), ("L", 0, "M<T>"), ("R", 0, "M<Array<T>>"), ("M", 0, "Z<X>"), (None, 0, "Any"), ("Box", 1, None)] + [("Box", 0, "Seq<T>")]
    table, found = closure(spark, names, edges)
    assert {("Box", "Seq<T>", 1), ("Box", "Any", 2), ("Pair", "Seq<(A)->Box<B>>", 1), ("Pair", "Pair<A,B>", 0)} <= found
    assert {x for x in found if x[0] == "Grow"} == {("Grow", "Grow<T>", 0), ("Grow", "Back<Grow<T>>", 1)}
    # both spellings of M, but the way on is that of the first path
    assert {x[1] for x in found if x[0] == "D"} == {"D<T>", "L<T>", "R<T>", "M<T>", "M<Array<T>>", "Z<T>"}
    pairs = [("Box<Int64>", "Seq<Int64>", True), ("Box<Int64>", "Seq<Bool>", False), ("Box< Map<A, B> >", "Seq<Map<A,B>>", True), ("Box", "Seq<T>", True), ("Box<A>", "Any", True), ("Box<A>", "Seq", True), ("Seq<A>", "Box<A>", False)]
    pairs += [("(Seq<A>)->Box<B>", "(Box<A>)->Seq<B>", True), ("(Box<A>)->Box<B>", "(Seq<A>)->Seq<B>", False), ("(A)->B", "(A,A)->B", False), (None, "A", True), ("?", "Seq<A>", True), ("A", None, True), ("Pair<P,Q>", "Seq<(P)->Box<Q>>", True), ("D<A>", "M<Array<A>>", True)]
    got = types.compatible(spark.createDataFrame(pairs + pairs[:2], "got string, want string, expected boolean"), table).collect()
    assert len(got) == len(pairs) + 2 and [r for r in got if r["compatible"] != r["expected"]] == []


def test_closure_of_nothing(spark):
    assert closure(spark, [], [])[1] == set() and closure(spark, [("A", [])], [])[1] == {("A", "A", 0)}


def test_renaming(spark):
    rows = [(0, ["T"], ["T"], "T"), (1, ["U"], ["U"], "U"), (2, ["T", "U"], ["T", "U"], "T"), (3, ["A", "B"], ["B", " A "], "B"), (4, ["T"], ["T", "T"], "T"), (5, [], ["T"], "T"), (6, None, ["T"], "T"), (7, ["T"], ["T<A>", "T"], "T"), (8, ["T", "U"], ["T", "T"], "T")]
    table = spark.createDataFrame(rows, "i int, v array<string>, p array<string>, r string").select("i", generics.renamed_signature(F.col("v"), F.col("p"), F.col("r")).alias("f"))
    f = {r["i"]: r["f"] for r in table.collect()}
    assert f[0] == f[1] == "(#1)->#1" and f[2] == f[3] != f[4] == f[8] and f[5] == f[6] == "(T)->T" and f[7] == "(T<A>,#1)->#1"


def test_unmet_up_to_renaming(spark):
    kind = "class string, interface string, name string, type_params array<string>, params array<string>, result string"
    owed = [("C", "I", "f", ["T"], ["T"], "T"), ("C", "I", "g", ["T", "U"], ["T", "U"], "T"), ("C", "I", "h", [], ["A"], "A"), ("C", "I", "h", [], ["A"], "A")]
    own = [("C", None, "f", ["U"], ["U"], "U"), ("C", None, "g", ["T"], ["T", "T"], "T"), ("D", None, "h", [], ["A"], "A")]
    got = generics.unmet_up_to_renaming(spark.createDataFrame(owed, kind), spark.createDataFrame(own, kind)).collect()
    assert sorted(map(tuple, got)) == [("C", "I", "g", "signature mismatch"), ("C", "I", "h", "not implemented")]


def test_common_supers(spark):
    edges = [("A", "X"), ("B", "X"), ("A", "Y"), ("B", "Y"), ("X", "Any"), ("Y", "Any"), ("C", "Any"), ("E", "Alone"), ("X2", "P"), ("P", "Q"), ("Q", "P"), ("X3", "Q")]
    pairs = [("A", "B"), ("A", "C"), ("A", "E"), ("A", "X"), ("A", "A"), ("X2", "X3"), ("A", None), ("A", "B")]
    got = generics.common_supers(spark.createDataFrame(pairs, "one string, other string"), types.subtype_closure(spark.createDataFrame(edges, "sub string, super string"))).collect()
    assert sorted(map(tuple, got)) == [("A", "A", "A"), ("A", "B", "X"), ("A", "B", "Y"), ("A", "C", "Any"), ("A", "X", "X"), ("X2", "X3", "P"), ("X2", "X3", "Q")]
