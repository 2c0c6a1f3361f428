"""Brackets, scopes and declarations against stacks, with texts cut into chunks of several sizes."""

import random

import pytest

from tessera.functions import lexing
from tessera.operators import scopes

SIGNS = "()[]{}"


def stacks(tokens):
    """(bracket, open, close, level) of one text's (pos, token), each kind by its own stack."""
    out, open_ = [], {"(": [], "[": [], "{": []}
    for pos, token in tokens:
        if token in open_:
            open_[token].append((pos, len(open_[token]) + 1))
        elif token in ")]}":
            own = "([{"[")]}".index(token)]
            if open_[own]:
                at, level = open_[own].pop()
                out.append((own, at, pos, level))
    return out + [(k, at, None, level) for k, rest in open_.items() for at, level in rest]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return {i: [(p, rng.choice(SIGNS + "x")) for p in range(rng.randrange(80))] for i in range(40)} | {100: [(p, "({"[p % 2]) for p in range(300)] + [(300 + p, "})"[p % 2]) for p in range(400)]}


@pytest.mark.parametrize("chunk", [1, 3, 16, scopes.CHUNK])
def test_pairs_equal_stacks(spark, texts, chunk):
    rows = [(i, p, "name" if t == "x" else "sign", t) for i, own in texts.items() for p, t in own] + [(None, 0, "sign", "{"), (None, 1, "sign", "}"), (7, 1000, "text", "}")]
    got = scopes.bracket_pairs(spark.createDataFrame(rows, "id int, pos int, kind string, token string").repartition(5), "id", chunk)
    want = [(i, *x) for i, own in texts.items() for x in stacks(own)] + [(None, "{", 0, 1, 1)]
    assert rows_of(got) == sorted(want, key=repr)


@pytest.mark.parametrize("chunk", [2, scopes.CHUNK])
def test_innermost_interval(spark, texts, chunk):
    intervals = [(i, a, b) for i, own in texts.items() for k, a, b, _ in stacks(own) if k == "{"]
    points = [(i, p, f"n{p}") for i, own in texts.items() for p in range(-1, len(own) + 2)] + [(3, 5, "again"), (999, 4, "no text"), (3, None, "no place")]
    got = scopes.innermost(spark.createDataFrame(intervals + intervals[:5], "id int, open int, close int"), spark.createDataFrame(points, "id int, at int, open_ string"), "id", chunk=chunk)
    want = []
    for i, p, n in points:
        around = [(a, b) for j, a, b in intervals if j == i and p is not None and a < p and (b is None or p < b)]
        want.append((i, p, n, *max(around, default=(None, None))))
    assert rows_of(got) == sorted(want, key=repr)


def test_nothing(spark):
    none = spark.createDataFrame([], "id int, pos int, kind string, token string")
    assert rows_of(scopes.bracket_pairs(none, "id")) == rows_of(scopes.declarations(none, "id")) == rows_of(scopes.scope_conflicts(none, "id")) == []


PROGRAM = """class A <: B { init(x: Int64) { let y = x } // { not a brace
  func f(a: Int64): Int64 { let y = "}"; if (a) { let y = 2; var z = 1 } else { var z = 3 }; let y = 4 }
  func g(): Unit
  var `raw` = 1
}
func { let let = 5 }
interface I { func h(); }
func open() { let y = 1; let x = { => let y = 2"""


def test_declarations_and_conflicts(spark):
    tokens = lexing.lex(spark.createDataFrame([(1, PROGRAM), (2, None), (3, "let a = 1\nlet a = 2\n{ let a = 3 } { let a = 4; let a = 5 }")], "id int, text string"), "id", "text")
    at = {(r["line"], r["col"]): r["pos"] for r in tokens.filter("id = 1").collect()}

    def spot(text):
        """The place of the token that starts at the end of the first such text."""
        upto = PROGRAM[: PROGRAM.index(text) + len(text) - 1]
        return at[upto.count("\n") + 1, len(upto) - upto.rfind("\n")]

    found = {(r["family"], r["name"], r["pos"]): (r["open"], r["close"]) for r in scopes.declarations(tokens, "id").filter("id = 1").collect()}
    name = lambda family, n: [v for (f, x, _), v in sorted(found.items(), key=lambda e: e[0][2]) if (f, x) == (family, n)]
    assert name("class", "A") == [(spot("B {"), spot("= 1\n}"))] and name("constructor", "init") == [(spot("(x: Int64) {"), spot("let y = x }"))]
    f = spot("f(a: Int64): Int64 {")
    assert name("function", "f") == [(f, spot("y = 4 }"))] and name("function", "g") == [(None, None)] and name("function", "h") == [(None, None)]
    assert name("interface", "I") == [(spot("I {"), spot("h(); }"))] and name("function", "open") == [(spot("open() {"), None)] and name("variable", "`raw`") == [(None, None)]
    assert ("constant", "let") not in {(f, n) for f, n, _ in found}
    conflicts = {(r["id"], r["name"], r["scope"], r["problem"]): r["other"] for r in scopes.scope_conflicts(tokens, "id", chunk=4).collect()}
    assert {k[1:]: v for k, v in conflicts.items() if k[0] == 1} == {("y", f, "duplicate"): spot('Int64 { l'), ("y", spot("(a) {"), "shadowing"): f, ("y", spot("x = {"), "shadowing"): spot("open() {")}
    third = {k[2:]: v for k, v in conflicts.items() if k[0] == 3}
    assert sorted(v for (_, problem), v in third.items() if problem == "shadowing") == [-1, -1] and sum(problem == "duplicate" for _, problem in third) == 2


def test_open_functions(spark):
    tokens = lexing.lex(spark.createDataFrame([(1, PROGRAM)], "id int, text string"), "id", "text")
    points = tokens.filter("token = 'let'").selectExpr("id", "pos as at", "line")
    got = [(r["line"], r["function"]) for r in scopes.open_functions(tokens, points, "id", chunk=5).orderBy("at").collect()]
    assert got == [(1, "init"), (2, "f"), (2, "f"), (2, "f"), (6, None), (6, None), (8, "open"), (8, "open"), (8, "open")]
