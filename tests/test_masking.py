"""Masks against a walk by characters, whole and in parts of every size."""

import random

import pytest

from tessera.operators import masking


def plain(text):
    out, mode, depth, i = list(text), None, 0, 0

    def blank(k):
        for j in range(i, min(i + k, len(text))):
            out[j] = text[j] if text[j] in "\n\r" else " "

    while i < len(text):
        rest = text[i:]
        if mode is None:
            mark = next((m for m in ("//", "/*", '"""', '"', "'") if rest.startswith(m)), None)
            if mark:
                mode, depth = mark, 1
            k = len(mark or "x")
            if mark:
                blank(k)
        elif mode == "//":
            k = 1
            if rest[0] in "\n\r":
                mode = None
            else:
                blank(1)
        elif mode == "/*":
            k = 2 if rest.startswith(("/*", "*/")) else 1
            depth += (rest[:2] == "/*") - (rest[:2] == "*/")
            blank(k)
            mode = mode if depth else None
        else:
            k = 2 if rest[0] == "\\" else len(mode) if rest.startswith(mode) else 1
            blank(k)
            if rest.startswith(mode):
                mode = None
        i += k
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    bits = ["/", "*", "/*", "*/", '"', "'", '"""', "\\", "\n", "\r", "//", "a", "é", " ", "/*/", "{"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)] + ["/*" * 9 + "*/" * 5 + "x" + "*/" * 4 + "y '", '"""a"b\\"""" c', ""]


def test_walk(texts):
    assert [masking.masked(t, len(t)) for t in texts] == [plain(t) for t in texts]


@pytest.mark.parametrize("part", [1, 2, 3, 7])
def test_parts_put_together(texts, part):
    for t in texts:
        state, out = (masking.CODE, 0, 0), []
        for i in range(0, max(len(t), 1), part):
            piece = t[i : i + part + 2]
            n = min(len(piece), part)
            out.append(masking.masked(piece, n, state))
            assert masking.after(state, masking.ends(piece, n)) == masking.walk(piece, n, state)
            state = masking.walk(piece, n, state)
        assert "".join(out) == plain(t)


@pytest.mark.parametrize("part", [1, 5, masking.PART])
def test_tables(spark, texts, part):
    rows = [(i % 300, t) for i, t in enumerate(texts)] + [(1000, None)]
    got = masking.mask_non_code(spark.createDataFrame(rows, "id int, text string").repartition(4), "id", "text", part).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, t if t is None else plain(t)) for i, t in rows], key=repr)
