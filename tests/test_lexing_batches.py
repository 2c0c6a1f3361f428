"""Tasks pass tokens on a few at a time, whether they are of many texts or of a long one."""

import pyarrow as pa

from tessera.functions import lexing


def test_few_tokens_at_a_time(spark):
    texts = [None, "", "let x = 1\n" * 9_000, '"' + "é" * 5_000_000 + '" + y', *(f"let v{i} = {i}; // c\n" for i in range(9_000))]
    ids = [None, 2**60 + 1, *range(len(texts) - 2)]
    got = list(lexing.lexed([pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})]))
    assert all(b.num_rows <= lexing.HELD for b in got) and len(got) >= 5 and max(b.nbytes for b in got) < 12_000_000
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    want = [(i, p, *row) for i, text in zip(ids, texts, strict=True) for p, row in enumerate(lexing._rows(text or "", lexing.scan(text or "")[0], 1, 1))]
    assert rows == want
    some = spark.createDataFrame([(None, "a b"), (2**60 + 1, "c"), (7, None)], "doc long, text string")
    assert sorted(((r["doc"], r["pos"], r["token"]) for r in lexing.lex(some, "doc", "text").collect()), key=repr) == [(2**60 + 1, 0, "c"), (None, 0, "a"), (None, 1, "b")]
