import random

from tessera.functions import lexing
from tessera.sources import vocabulary
from tessera.streaming import checker, lexer

TEXTS = {"a": "main() { let x = [1, 2] }", "b": "f(x))\ny", "c": "s = \"(\" // )\n(", "d": "/* ) /* ] */ } */ }", "e": "", "f": "'\\'' )"}
#: Place of the first sign that no continuation can save.
BAD = {"b": 4, "d": 18, "f": 5}


def cut(text, rng, most):
    out, at = [], 0
    while at < len(text):
        n = rng.randint(1, most)
        out.append(text[at : at + n])
        at += n
    return out


def test_where_a_text_is_cut_makes_no_difference(spark):
    rng = random.Random(1)
    rows = []
    for most in (1, 3, 50):
        for name, text in TEXTS.items():
            rows += [(f"{name}{most}", i, part) for i, part in enumerate(cut(text, rng, most))]
    got = checker.check_batch(spark.createDataFrame(rows, "stream_id string, seq long, fragment string")).collect()
    for most in (1, 3, 50):
        for name in TEXTS:
            own = [r for r in got if r["stream_id"] == f"{name}{most}"]
            parts = [p for s, _, p in rows if s == f"{name}{most}"]
            rejected = [r["seq"] for r in own if not r["ok"]]
            at, expect = 0, []
            for i, p in enumerate(parts):
                if name in BAD and at <= BAD[name] < at + len(p):
                    expect = [i]
                at += len(p)
            assert rejected == expect, (name, most)
            assert len(own) == (expect[0] + 1 if expect else len(parts))


def test_nulls_and_repeats(spark):
    rows = [("x", 0, None), ("x", 0, None), ("x", 1, "("), (None, 0, ")"), ("y", None, ")")]
    got = checker.check_batch(spark.createDataFrame(rows, "stream_id string, seq long, fragment string")).collect()
    assert [(r["stream_id"], r["seq"], r["ok"], r["depth"]) for r in got] == [("x", 0, True, 0), ("x", 1, True, 1)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(name, i, part) for name, text in TEXTS.items() for i, part in enumerate(cut(text, rng, 4))]
    batch = {(r["stream_id"], r["seq"], r["ok"], r["depth"]) for r in checker.check_batch(spark.createDataFrame(rows, "stream_id string, seq long, fragment string")).collect()}
    shuffled = rows + rows[:5]
    rng.shuffle(shuffled)
    for i in range(0, len(shuffled), 12):  # late, early and repeated fragments over several micro-batches
        spark.createDataFrame(shuffled[i : i + 12], "stream_id string, seq long, fragment string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id string, seq long, fragment string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = checker.check_stream(source).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["stream_id"], r["seq"], r["ok"], r["depth"]) for r in spark.table("verdicts").collect()} == batch


def test_ids_of_lines(spark):
    lines = ["65", " +66\t", "", " ", "x", "1.0", "-1", "+-1", "300", "99999999999999999999", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string")
    got = {r["i"]: (r["token_id"], r["found"]) for r in vocabulary.decode_ids(rows, vocabulary.byte_vocabulary(spark)).collect()}
    assert [got[i] for i in range(len(lines))] == [(65, True), (66, True), (None, False), (None, False), (None, False), (None, False), (-1, False), (-1, False), (300, False), (None, False), (None, False)]


def test_lexing(spark):
    rows = spark.createDataFrame([(1, 'let x = 0..10 // hi\n"a(b" >>= 3i8 /* a /* b */ c */ <: """m\n"q""" r\'a\' `raw` new'), (2, None), (3, "")], "i int, t string")
    got = [(r["token"], r["kind"], r["line"], r["col"]) for r in lexing.lex(rows, "i", "t").orderBy("pos").collect()]
    assert got == [
        ("let", "keyword", 1, 1), ("x", "name", 1, 5), ("=", "sign", 1, 7), ("0..10", "float", 1, 9), ("\n", "newline", 1, 20), ('"a(b"', "text", 2, 1), (">>=", "operator", 2, 7), ("3i8", "integer", 2, 11),
        ("<:", "operator", 2, 33), ('"""m\n"q"""', "multiline", 2, 36), ("r'a'", "rune", 3, 7), ("`raw`", "raw", 3, 12), ("new", "keyword", 3, 18),
    ]
    assert lexing.lex(rows.limit(0), "i", "t").count() == 0


def test_fragments_make_the_same_tokens():
    rng = random.Random(3)
    signs = ['"', '"""', "\\", "r'", "'", "`", "/*", "*/", "//", "\n", " ", "a", "r", "1", ".", "..", "<", "<:", "=", "&&", "if", "e"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 14))) + "\n x "
        whole, cut_at = lexing.scan(text, last=False)
        open_, line, col, got = "", 1, 1, []
        for part in cut(text, rng, 4):
            tokens, open_, line, col = lexer.feed(open_, line, col, part)
            got += [(t["kind"], t["token"]) for t in tokens]
        assert got == [(k, text[a:b]) for k, a, b in whole] and open_ == text[cut_at:], text


def test_open_ends():
    assert lexing.candidates("whi") == ["name", "while"] and lexing.candidates("r")[:2] == ["name", "rune"]
    assert lexing.candidates("1") == ["integer", "float"] and lexing.candidates("1.") == ["float"] and lexing.candidates("") == lexing.candidates("// x") == []
    assert lexing.candidates("&") == ["&&=", "&&", "&=", "sign"] and lexing.candidates("`a") == ["raw"] and lexing.candidates('"a') == ["text"]
    assert lexing.viable("") and lexing.viable("/* a") and lexing.viable('"""') and not lexing.viable("\x01\x02")


def test_lexing_batch_equals_stream(spark, tmp_path):
    rng = random.Random(4)
    kinds = "stream_id string, seq long, fragment string"
    rows = [(name, i, part) for name, text in TEXTS.items() for i, part in enumerate(cut(text + "\nlet a = 1 ", rng, 3))]
    rows = [r for r in rows if r[:2] != ("d", 4)]  # a gap: nothing after it
    plain = lambda found: sorted((r["stream_id"], r["seq"], tuple(t["token"] for t in r["tokens"]), r["partial"], tuple(r["candidates"])) for r in found)
    batch = plain(lexer.lex_batch(spark.createDataFrame(rows + [(None, 0, "x"), ("z", None, "x"), ("y", 0, None)], kinds)).collect())
    assert max(s for n, s, *_ in batch if n == "d") == 3 and ("y", 0, (), "", ()) in batch
    shuffled = rows + rows[:5] + [("y", 0, None)]
    rng.shuffle(shuffled)
    for i in range(0, len(shuffled), 20):
        spark.createDataFrame(shuffled[i : i + 20], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = lexer.lex_stream(source).writeStream.format("memory").queryName("tokens").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert plain(spark.table("tokens").collect()) == batch


def test_gap_in_a_batch(spark):
    rows = [("x", 0, "("), ("x", 2, ")"), ("w", 1, "a"), ("v", 0, "b"), ("v", 0, "a)"), ("v", 1, "c")]
    got = checker.check_batch(spark.createDataFrame(rows, "stream_id string, seq long, fragment string")).collect()
    assert sorted((r["stream_id"], r["seq"], r["ok"]) for r in got) == [("v", 0, False), ("x", 0, True)]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
