"""The harness's relations on small tables: nulls, ties, repeats, empty tables and names that could clash."""

import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import reports, summaries, symbols, types, verdicts
from tessera.sinks import lines
from tessera.sources import context, harness


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_selecting_cases(spark):
    cases = spark.createDataFrame([("a", "x-1"), ("b", "x-2"), (None, "x-1"), ("a", None)], "family string, name string")
    assert rows_of(reports.select_cases(cases, ("a",))) == [("a", "x-1"), ("a", None)]
    assert rows_of(reports.select_cases(cases, skip=("a",))) == [("b", "x-2"), (None, "x-1")]
    assert rows_of(reports.select_cases(cases, name_part="-1")) == [("a", "x-1"), (None, "x-1")]
    assert reports.first_rows(cases, 1, "family", "name").collect()[0]["family"] is None
    assert reports.within_scale(cases, {"b": (1, 1)}).count() == 3


def test_counters_and_trials(spark):
    records = spark.createDataFrame([("c", {"a": 1, "b": None}), ("c", {"a": 2}), (None, {"a": 5}), ("d", None)], "corpus string, counters map<string,int>")
    assert rows_of(reports.sum_counters(records, "counters", "corpus")) == [("c", "a", 3, 2), ("c", "b", 0, 1), (None, "a", 5, 1)]
    runs = spark.createDataFrame([("x", True, True, 9.0), ("x", None, False, 1.0), ("x", False, True, 3.0), ("y", True, None, None)], "g string, timed_out boolean, ok boolean, took double")
    assert rows_of(reports.trial_counts(runs, 3, ("g",))) == [("x", 3, 3, 2, 1, 2, 0, 2.0), ("y", 3, 1, 0, 1, 0, 2, None)]
    assert reports.trial_counts(runs.limit(0), 3, ("g",)).count() == 0


def test_digests(spark):
    answers = spark.createDataFrame([(1, 1, "bé"), (1, 0, "a"), (1, 2, None), (2, 0, "")], "k int, seq int, t string")
    framed = lambda xs: hashlib.sha256(b"".join(len(x.encode()).to_bytes(8, "big") + x.encode() for x in xs)).hexdigest()
    assert rows_of(reports.transcript_digest(answers, "k", "seq", "t")) == [(1, 3, framed(["a", "bé", ""])), (2, 1, framed([""]))]
    files = [(f"p{i}", f"s{i}") for i in range(40)] + [("p1", "s1"), (None, None)]
    df = spark.createDataFrame(files, "path string, source string")
    first = reports.corpus_digest(df, "path", "source").first()
    assert first["n"] == 42 and tuple(reports.corpus_digest(df.repartition(5), "path", "source").first()) == tuple(first)
    assert reports.corpus_digest(df.filter("path <> 'p3'"), "path", "source").first()["digest"] != first["digest"]
    assert tuple(reports.corpus_digest(df.limit(0), "path", "source").first()) == (0, hashlib.sha256(b"").hexdigest())


def test_lookups_thresholds_and_gates(spark):
    rows = spark.createDataFrame([(1, "n"), (None, "m"), (3, "k")], "id int, n string")
    table = spark.createDataFrame([(1, 5), (1, 4), (None, 9)], "id int, x int")
    assert rows_of(reports.lookup(rows, table, "id", "x")) == [(1, "n", 4), (3, "k", None), (None, "m", None)]
    shapes = spark.createDataFrame([("a", True), ("a", None), ("b", False), (None, False), ("c", True)], "member string, ok boolean")
    exempt = spark.createDataFrame([(None,)], "member string")
    assert rows_of(reports.below_threshold(shapes, ("member",), F.col("ok"), 0.6, exempt)) == [("a", 2, 1, 0.5), ("b", 1, 0, 0.0)]
    found = spark.createDataFrame([("BUG_A",), ("BUG_A",), ("EXPECTED",), (None,)], "category string")
    assert rows_of(reports.gate(found, "category")) == [("BUG_A", 2, True), ("EXPECTED", 1, False), (None, 1, False)]
    probes = [("f", "A", "ACCEPT", None), ("f", "B", "REJECT", "E_SYNTH_NOT_CALLABLE"), ("f", "C", "REJECT", "x"), ("m", "A", "REJECT", "x"), ("m", "B", "ACCEPT", None), ("m", "C", "ACCEPT", None), ("e", "A", None, None)]
    kinds = reports.classify_probes(spark.createDataFrame(probes, "n string, probe string, verdict string, code string"), ("n",))
    assert {r["n"]: r["kind"] for r in kinds.collect()} == {"f": "field", "m": "method", "e": "error"}


def test_transcripts(spark):
    bits = spark.createDataFrame([("x", 0, 0), ("x", 1, 1), ("y", 0, 0)], "k string, seq int, bit int")
    other = spark.createDataFrame([("x", 0, 1), ("x", 1, 0), ("y", 0, 0), ("z", 0, 1)], "k string, seq int, bit int")
    assert rows_of(reports.inversion_errors(bits, other, "k")) == [("x", 2, 0, True), ("y", 1, 1, False), ("z", 1, 1, False)]
    results = spark.createDataFrame([("a", "byte", True), ("a", "line", True), ("b", "byte", True), ("b", "line", None)], "c string, layout string, accepted boolean")
    assert rows_of(reports.fragmentation_invariance(results, "c")) == [("a", 2, 1, True), ("b", 2, 2, False)]
    mutated = spark.createDataFrame([(1, False, 5, 5), (2, False, 6, 5), (3, True, 1, 5), (4, None, 1, 5), (5, False, None, 5)], "i int, expected_valid boolean, reject_byte int, mutation_start int")
    assert [r["i"] for r in reports.premature_rejects(mutated).collect()] == [1]
    runs = [("a", 1, 0, 0), ("a", 1, 1, 0), ("a", 1, 2, 1), ("a", 2, 0, 0), ("a", 2, 1, 0), ("a", 2, 2, 0), ("b", 1, 0, 1), ("c", 1, 1, 0), ("d", 1, 0, None)]
    assert rows_of(reports.common_prefix(spark.createDataFrame(runs, "c string, run int, seq int, bit int"), "c", "run")) == [("a", 2, 2), ("b", 1, 0), ("c", 1, 0), ("d", 1, 0)]


def test_schedule_and_order(spark):
    plan = spark.createDataFrame([("a", 3, 1), ("b", 0, 2), ("c", None, 0)], "c string, control int, candidate int")
    got = [tuple(r) for r in reports.interleaved(plan, "c").orderBy("c", "place").collect()]
    assert got == [("a", 0, "control", 1), ("a", 1, "candidate", 1), ("a", 2, "control", 2), ("a", 3, "control", 3), ("b", 0, "candidate", 1), ("b", 1, "candidate", 2)]
    values = [random.Random(1).randrange(1000) for _ in range(500)] + [None]
    placed = reports.in_order(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, n int"), "v", "n").collect()
    assert sorted(r["place"] for r in placed) == list(range(501))
    assert [r["v"] for r in sorted(placed, key=lambda r: r["place"])][1:] == sorted(v for v in values if v is not None)
    assert rows_of(reports.duplicates(spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "n int"), "n")) == [(1, 2), (None, 2)]


def test_policies_and_metrics(spark):
    messages = spark.createDataFrame([(1, "authoritative"), (2, None)], "i int, tier string")
    assert rows_of(reports.split_by_policy(messages)) == [(1, "authoritative", True), (2, None, False)] and reports.split_by_policy(messages, "all").filter("fatal").count() == 2
    timings = spark.createDataFrame([("a", 100, 50.0, 5.0), ("a", 100, 50.0, None), ("b", 0, 0.0, 0.0)], "g string, tokens int, slow_ms double, fast_ms double")
    assert rows_of(reports.derived_metrics(timings, "g")) == [("a", 200, 100.0, 5.0, 20.0, 25.0, 12.5, True), ("b", 0, 0.0, 0.0, 0.0, 0.0, 0.0, True)]


def test_programs_of_members_and_witnesses(spark):
    members = spark.createDataFrame([("x", "size"), (None, "at")], "receiver string, member string")
    assert rows_of(reports.shapes_of_members(members, {"call": "{receiver}.{member}()"})) == [("x", "size", "call", "x.size()"), (None, "at", "call", ".at()")]
    fires = spark.createDataFrame([("abcdef", 3, "Z"), (None, 1, "Z")], "source string, frontier_end int, suffix string")
    assert [r["rebuilt"] for r in reports.splice(fires).collect()] == ["abcZ", None]
    checked = spark.createDataFrame([(True, True), (True, False), (True, None), (None, True)], "found boolean, accepted boolean")
    assert rows_of(reports.witness_buckets(checked)) == [("confirmed", 1), ("no witness", 1), ("refuted", 1), ("unchecked", 1)]
    records = spark.createDataFrame([("func f() {\n  let a = 1\n\n}",), ("{\n}",), (None,), ("\tx \r\nmain() {",)], "source string")
    assert [r["statement"] for r in reports.last_statement(records).collect()] == ["let a = 1", "?", "?", "x"]


def test_exact_ranks(spark, monkeypatch):
    monkeypatch.setattr(summaries, "ACCURACY", 20)  # so that brackets are used on few rows
    rng = random.Random(7)
    data = [("a", float(rng.randrange(300))) for _ in range(2500)] + [("b", 1.0), ("c", None), (None, 2.0), (None, 4.0)] + [("t", 5.0)] * 700
    rows = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r for r in summaries.p95_rules(rows, "g", "v").collect()}
    for g in ("a", "b", None, "t"):
        own = sorted(v for k, v in data if k == g and v is not None)
        n = len(own)
        assert (got[g]["n"], got[g]["p95_half_even"], got[g]["p95_ceil"], got[g]["p95_floor"]) == (n, own[round((n - 1) * 0.95)], own[-(-n * 95 // 100) - 1], own[int(n * 0.95) - 1])
    assert "c" not in got
    found = {r["g"]: r for r in summaries.summary(rows, "g", "v").collect()}
    assert found["a"]["median"] == statistics.median(v for k, v in data if k == "a") and found[None]["mean"] == 3.0 and (found["c"]["n"], found["c"]["median"]) == (0, None)


def test_comparisons(spark):
    a = spark.createDataFrame([("x", 1), ("y", None), (None, 3)], "n string, d int")
    b = spark.createDataFrame([("x", 2), ("y", None), ("z", 1)], "n string, d int")
    assert rows_of(summaries.catalog_diff(a, b, "n", ("d",))) == [("x", "changed: d"), ("y", "same"), ("z", "right only"), (None, "left only")]
    assert ("x", "expected") in rows_of(summaries.catalog_diff(a, b, "n", ("d",), a.select("n")))
    clash = spark.createDataFrame([(1, 1), (1, 1)], "surplus int, d int")
    assert rows_of(summaries.multisets_equal(clash, clash.limit(1))) == [(False, 1, 0)] and rows_of(summaries.multisets_equal(clash.limit(0), clash.limit(0))) == [(True, 0, 0)]
    events = spark.createDataFrame([(1, 1), (None, 2)], "at int, id int")
    assert [r["kind"] for r in summaries.timeline(start=events, stop=events).collect()] == ["start", "stop", "start", "stop"]


def test_closure_has_no_depth(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(300)]
    lattice = [(f"l{i}{a}", f"l{i + 1}{b}") for i in range(12) for a in "xy" for b in "xy"]
    cycle = [("r", "s"), ("s", "t"), ("t", "r"), ("r", None), ("r", "r")]
    got = {(r["sub"], r["super"]): r["steps"] for r in types.subtype_closure(spark.createDataFrame(chain + lattice + cycle, "sub string, super string")).collect()}
    expect = {(f"c{i}", f"c{j}"): j - i for i in range(301) for j in range(i, 301)}
    expect |= {(f"l{i}{a}", f"l{j}{b}"): j - i for i in range(13) for j in range(i, 13) for a in "xy" for b in "xy" if j > i or a == b}
    expect |= {(a, b): k for k in range(3) for a, b in zip("rst", ("rst" * 2)[k:])}
    assert got == expect
    assert types.subtype_closure(spark.createDataFrame([], "sub string, super string")).count() == 0


def test_compatibility(spark):
    closure = types.subtype_closure(spark.createDataFrame([("Cat", "Animal"), ("Box", "Any")], "sub string, super string"))
    pairs = [
        ("Cat", "Animal", True), ("Animal", "Cat", False), (None, "Cat", True), ("?", "Cat", True), ("Box<Int64>", "Box", True), ("Box", "Box<Int64>", False), ("Box < Int64 >", "Box<Int64>", True), ("Box<Int64>", "Any", True),
        ("(Animal) -> Cat", "(Cat) -> Animal", True), ("(Cat) -> Cat", "(Animal) -> Cat", False), ("(Cat)->Cat", "(Cat,Cat)->Cat", False), ("((Cat)->Cat)->Cat", "((Animal)->Cat)->Animal", True), ("()->Cat", "()->Animal", True), ("()->Cat", "Cat", False),
    ]
    df = spark.createDataFrame([(i, g, w) for i, (g, w, _) in enumerate(pairs)], "known_sub int, got string, want string")
    assert {r["known_sub"]: r["compatible"] for r in types.compatible(df, closure).collect()} == {i: p[2] for i, p in enumerate(pairs)}
    strict = {(r["got"], r["want"]): r["compatible"] for r in types.compatible_strict(df.unionByName(spark.createDataFrame([(99, "unknown:Cat", "Cat")], df.schema)), closure).collect()}
    assert strict[("Box", "Box<Int64>")] and strict[("Cat", "Animal")] and not strict[("unknown:Cat", "Cat")] and not strict[(None, "Cat")]
    facts = types.type_facts(spark.createDataFrame([("type: Map < Int64 , (A, B) -> C >",), ("(A, (B)->C) -> D<E>",), (None,), ("in out x",)], "t string"), "t").collect()
    assert [(r["canonical"], r["head"], r["args"], r["params"], r["result"]) for r in facts] == [
        ("type:Map<Int64,(A,B)->C>", "Map", ["Int64", "(A,B)->C"], None, None), ("(A,(B)->C)->D<E>", "(A,(B)->C)->D", ["E"], ["A", "(B)->C"], "D<E>"), (None, None, None, None, None), ("in out x", "in out x", [], None, None),
    ]


def test_symbols(spark):
    sources = spark.createDataFrame([(1, "import a.b.C\nimport d import C"), (2, None), (3, "reimport x")], "i int, t string")
    assert rows_of(symbols.imports(sources, "i", "t")) == [(1, "C", "namespace:C"), (1, "d", "namespace:d")]
    odd = spark.createDataFrame([(1, "// import no\n/* import no */ import a . b /* c */ . `x`\nimport e.f.*; let s = \"import no\" import"), (2, "import import g.h\nimport 7 import i")], "i int, t string")
    assert rows_of(symbols.imports(odd, "i", "t")) == [(1, "b", "namespace:b"), (1, "f", "namespace:f"), (2, "h", "namespace:h"), (2, "i", "namespace:i")]
    low, high = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "name string, v int"), spark.createDataFrame([("b", 9)], "name string, v int")
    assert rows_of(symbols.overlay(low, high)) == [("a", 1, 0), ("b", 9, 1)]
    assert symbols.model_difference(low, low).count() == 0 and rows_of(symbols.model_difference(low, high)) == [("a", 1, "left"), ("b", 2, "left"), ("b", 3, "left"), ("b", 9, "right")]
    name = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    uses = spark.createDataFrame([(1, "a"), (1, "f"), (2, "a"), (1, "T"), (1, "Int64"), (1, None)], "scope int, name string")
    tables = (spark.createDataFrame([(1, "a"), (1, "a")], "scope int, name string"), name("f", "a"), name("f", "a"), name("T"))
    assert {(r["scope"], r["name"]): r["kind"] for r in symbols.resolve(uses, "scope", *tables).collect()} == {(1, "a"): "local", (1, "f"): "function", (2, "a"): "function", (1, "T"): "type", (1, "Int64"): "primitive", (1, None): "unknown"}
    assert symbols.resolve(uses, "scope", *tables, order=("local", "global", "function", "type", "primitive")).filter("kind = 'global'").count() == 2
    sigs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, None)], "i int, param_names array<string>")
    assert rows_of(symbols.duplicate_parameters(sigs)) == [(1, ["a", "b", "a"], ["a"])]
    members = spark.createDataFrame([("O", "x", "field"), ("O", "x", "field"), ("O", "y", "field"), ("O", "y", "method"), ("O", "z", "method"), ("O", "z", "method")], "owner string, member string, kind string")
    assert rows_of(symbols.member_collisions(members)) == [("O", "x", "duplicate class field"), ("O", "y", "class member name collision")]


def test_call_frontier_by_types(spark):
    closure = types.subtype_closure(spark.createDataFrame([("Cat", "Animal")], "sub string, super string"))
    overloads = spark.createDataFrame([("f", 0, ["Animal", "Int64"], 1), ("f", 1, ["Cat"], 0)], "name string, overload int, params array<string>, required int")
    calls = spark.createDataFrame([(1, "f", ["Cat"], True), (2, "f", ["Animal"], False), (3, "f", [None, "Bool"], False), (4, "f", [], True), (5, "g", [], True)], "call_id int, name string, args array<string>, closed boolean")
    got = {(r["call_id"], r["overload"]): (r["state"], r["reason"]) for r in verdicts.call_frontier(overloads, calls, closure).collect()}
    dead = lambda why: ("dead", why)
    assert got == {(1, 0): ("alive", None), (1, 1): ("alive", None), (2, 0): ("alive", None), (2, 1): dead("argument type"), (3, 0): dead("argument type"), (3, 1): dead("arity exceeded"), (4, 0): dead("arity short at close"), (4, 1): dead("arity short at close")}


CATALOG = {
    "global_variables": {"v": {"type": "Int64", "kind": "var"}, "w": "Bool"},
    "global_functions": {"f": [{"params": ["a: Int64", "Bool"], "ret": "Unit"}, {"params": [{"name": "x", "type": {"nominal": "Array", "args": ["Int64", {"tparam": "T"}]}}], "type_params": ["T"], "defaults": {"x": 1}, "returns": {"function": {"params": ["Int64"], "ret": None}}}], "g": {}},
    "nominals": {"Box": {"type_params": ["T"], "instance_fields": {"v": "T"}, "static_fields": [{"name": "n", "ty": "Int64"}], "constructors": [{"params": {"v": "T"}}], "instance_methods": {"get": {"ret": {"tparam": "T"}}}, "supers": [{"nominal": "Any"}, "Show"]}},
    "classes": [{"identifier": "P", "inits": [{"parameters": []}], "members": {"a": {"tuple": ["Int64", "Bool"]}}}, {"kind": "struct"}],
    "interfaces": [{"name": "Show", "methods": {"show": [{"ret": "String"}]}, "supers": ["Any"]}, "Any"],
}


def test_catalog_of_all_spellings(spark):
    docs = spark.createDataFrame([(json.dumps(CATALOG),), (None,), ("{bad",), ("{}",)], "json string")
    assert rows_of(context.globals_of(docs)) == [("v", "Int64", True), ("w", "Bool", False)]
    assert rows_of(context.nominals_of(docs)) == [("Any", "interface", True, [], None), ("Box", "class", False, ["T"], None), ("P", "class", False, [], None), ("Show", "interface", True, [], None)]
    assert rows_of(context.supers_of(docs)) == [("Box", 0, "Any"), ("Box", 1, "Show"), ("Show", 0, "Any")]
    assert rows_of(context.fields_of(docs)) == [("Box", "n", "Int64", True), ("Box", "v", "T", False), ("P", "a", "(Int64, Bool)", False)]
    assert rows_of(context.signatures_of(docs)) == [
        ("Box", "constructor", "Box", 0, ["T"], ["v"], ["T"], 1, "Box<T>"), ("Box", "method", "get", 0, [], [], [], 0, "T"), ("P", "constructor", "P", 0, [], [], [], 0, "P"), ("Show", "method", "show", 0, [], [], [], 0, "String"),
        (None, "function", "f", 0, [], ["a", "arg1"], ["Int64", "Bool"], 2, "Unit"), (None, "function", "f", 1, ["T"], ["x"], ["Array<Int64, T>"], 0, "(Int64) -> Unit"), (None, "function", "g", 0, [], [], [], 0, "Unit"),
    ]
    assert ("<global>", "f", "function", 2) in rows_of(context.members_of(docs))
    dumped = [r["line"] for r in lines.catalog_lines(context.signatures_of(docs)).orderBy("owner").collect()]
    assert dumped == [r["line"] for r in lines.catalog_lines(context.signatures_of(docs.repartition(3))).orderBy("owner").collect()] and [json.loads(x)["owner"] for x in dumped] == ["", "Box", "P", "Show"]


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([("4a4B",), ("",), ("4",), ("zz",), (None,)], "raw string")
    assert [(bytes(r["fragment"]) if r["fragment"] is not None else None, r["valid"]) for r in harness.hex_fragments(raw).collect()] == [(b"JK", True), (b"", True), (None, False), (None, False), (None, False)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.cj").write_text("main() {}\n")
    (tmp_path / "b.txt").write_text("no")
    assert [r["source"] for r in harness.programs(spark, str(tmp_path)).collect()] == ["main() {}\n"]
    registry = spark.createDataFrame([('{"wrong_examples": [{"name": "a", "first_error_token_index": 4}, {"name": "b"}]}',), ("nope",), (None,)], "json string")
    assert rows_of(harness.first_errors(registry)) == [("a", 4, True), ("b", None, False)]
    trace = spark.createDataFrame([('{"event": "fire", "token": 3}',), ('{"event": "stats"}',), ("{broken",), (' {"event": "fire"}',), (None,)], "line string")
    assert [r["token"] for r in harness.trace_events(trace).collect()] == [3]
    profile = spark.createDataFrame([(1, 'PROFILE {"a": 2}'), (1, "x"), (2, "PROFILE {}"), (2, 'PROFILE {"a": 1}'), (3, None)], "run int, line string")
    assert rows_of(harness.profile_counters(profile, "run", prefix="p_")) == [(1, 1, {"p_a": 2}), (2, 2, None), (3, 0, None)]


def test_manifests(spark):
    good = {"name": "a", "family": "f", "file": "a.cj", "expected": "reject", "complete": True, "safe_prefix_bytes": 1, "source_sha256": hashlib.sha256(b"xyz").hexdigest()}
    bad = [
        {"name": "b", "family": "", "file": "../b.cj", "expected": "accept", "complete": False, "safe_prefix_bytes": 1}, {"name": "c", "family": "f", "file": "c.txt", "expected": "maybe", "complete": None}, {"name": "c", "family": "f", "file": "d.cj", "expected": "reject", "complete": True, "safe_prefix_bytes": 1, "source_sha256": "0" * 64},
        {"name": "e", "family": "f", "file": "e.cj", "expected": "reject", "complete": True, "safe_prefix_bytes": 2},
    ]
    sources = spark.createDataFrame([("a.cj", "xyz"), ("../b.cj", ""), ("c.txt", ""), ("d.cj", "é"), ("e.cj", "é")], "file string, source string")
    read = lambda cases, n: harness.manifest_cases(spark.createDataFrame([(json.dumps({"schema_version": 1, "case_count": n, "cases": cases}),), (None,), ("{",)], "json string"))
    assert harness.manifest_violations(read([good], 1), sources).count() == 0 and read([good], 1).first()["stage"] == "semantic"
    found = set(rows_of(harness.manifest_violations(read([good, *bad], 7), sources)))
    expect = {("b", "family"), ("b", "path"), ("b", "incomplete"), ("b", "safe prefix"), ("c", "file"), ("c", "expected"), ("c", "complete"), ("c", "duplicate name"), ("c", "sha256"), ("c", "prefix cuts a character"), ("e", "prefix length"), (None, "case count")}
    assert found == expect


def test_sinks(spark, tmp_path):
    steps = spark.createDataFrame([("s", 1, "x", 0, 1, "bad"), ("s", 0, "let", 0, 0, None), ("t", 0, None, 1, None, None)], "k string, seq int, token string, syntax int, semantic int, message string")
    assert rows_of(lines.result_text(steps, "k")) == [("s", "token: let x\n语法: 0, 0\n语义: 0, 1\n错误: bad"), ("t", "token: \n语法: 1\n语义: ")]
    fires = spark.createDataFrame([(1, None, True), (2, "m", None)], "token int, message string, cached boolean")
    assert [r["line"] for r in lines.event_lines(fires, "fire", "token", "message").collect()] == ['{"event":"fire","token":1}', '{"event":"fire","token":2,"message":"m"}']
    watched, seen = lines.with_stats(fires.withColumn("found", F.lit(True)), "found", "cached")
    assert watched.count() == 2 and seen.get == {"queries": 2, "witness_found": 2, "cache_hits": 1}
    cases = spark.createDataFrame([("a", "f", "accept", True, "x"), ("b", "f", "reject", True, "y"), ("c", "f", "accept", False, "z")], "name string, family string, expected string, complete boolean, source string")
    lines.write_corpus(cases, str(tmp_path / "out"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).select("group", "file")) == [("invalid", "f__b.cj"), ("prefix", "f__c.cj"), ("valid", "f__a.cj")]
    with pytest.raises(Exception, match="exist"):
        lines.write_corpus(cases, str(tmp_path / "out"))
