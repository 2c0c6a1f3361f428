"""Texts cut into random pieces, and the checker's step over the signs alone."""

import random
import time

from pyspark.sql import functions as F

from tessera.functions import lexing
from tessera.streaming import checker


def test_pieces_are_where_the_sizes_say(spark):
    rng = random.Random(5)
    texts = [None, "", "x", "é\n" * 9, *("".join(rng.choice("ab é😀\n") for _ in range(rng.randrange(200))) for _ in range(30)), "a" * 300_000]
    rows = [(None if i == 4 else f"d{i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {}
    for i, seq, part in lexing.fragments(df, "id", "text", "random", 7).collect():
        got.setdefault(i, {})[seq] = part
    longest = max(len(t or "") for t in texts)
    sizes = df.select("id").crossJoin(spark.range(200).selectExpr("cast(id as int) k")).select("id", "k", (F.pmod(F.xxhash64("id", "k", F.lit(7)), F.lit(17)) + 1).alias("n"))
    n = {(r["id"], r["k"]): r["n"] for r in sizes.collect()}
    assert longest == 300_000 and len(got) == sum(bool(t) for t in texts)
    for i, text in rows:
        if text:
            parts, at = [got[i][k] for k in range(len(got[i]))], 0
            assert "".join(parts) == text and all(1 <= len(p) <= 17 for p in parts)
            for k, p in enumerate(parts):
                if at >= 200:
                    break
                assert len(p) == n[i, at] or k == len(parts) - 1
                at += len(p)


def test_time_grows_with_a_text(spark):
    text = "some words (of a text) " * 70_000
    began = time.time()
    rows = lexing.fragments(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", "random").groupBy("id").agg(F.sum(F.length("fragment")).alias("n")).collect()
    assert rows[0]["n"] == len(text) and time.time() - began < 30


def walked(open_, mode, last, fragment):
    """step(), a character at a time."""
    ok = True
    for c in fragment:
        ok, open_, mode, last = checker.step(open_, mode, last, c)
        if not ok:
            break
    return ok, open_, mode, last


def test_a_step_equals_its_characters():
    rng = random.Random(3)
    for _ in range(20_000):
        state = "".join(rng.choice("([{") for _ in range(rng.randrange(3))), rng.choice(["", "/", "*", "**", '"', "'"]), ""
        fragment = "".join(rng.choice("()[]{}\"'/*\\\nab é") for _ in range(rng.randrange(12)))
        assert checker.step(*state, fragment) == walked(*state, fragment)
    text = "words without signs " * 2_000_000
    began = time.time()
    assert checker.step("", "", "/", text) == (True, "", "", "") and time.time() - began < 3
