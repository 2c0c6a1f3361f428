"""Texts go to a tokenizer a part of a batch at a time, with the ids that each has alone."""

import public_tokenizers
import pyarrow as pa

from tessera.sources import harness

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_parts_of_a_batch(spark, monkeypatch):
    asked, tokenizer = [], harness._tokenizer(PATH)

    class Counted:
        def encode_batch_fast(self, texts, **more):
            asked.append(sum(len(t.encode()) for t in texts))
            return tokenizer.encode_batch(texts, **more)

        encode_batch = encode_batch_fast

    monkeypatch.setattr(harness, "_tokenizer", lambda path: Counted())
    texts = [None, "", "a long one " * 100_000, *(f"text {i} é " * 40 for i in range(5_000))]
    ids = [None, 2**60 + 1, *range(len(texts) - 2)]
    got = list(harness.encoded([pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})], PATH))
    assert [i for b in got for i in b.column(0).to_pylist()] == ids
    assert sorted(asked)[-2] <= harness.ENCODED_BYTES < max(asked) == 1_100_000 and len(asked) > 4
    assert [x for b in got for x in b.column(1).to_pylist()] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_of_rows(spark):
    rows = harness.token_ids(spark.createDataFrame([(None, "ab cd"), (2**60 + 1, "x"), (5, None)], "doc long, text string"), "doc", "text", PATH).collect()
    want = [(i, p, t) for i, text in ((None, "ab cd"), (2**60 + 1, "x")) for p, t in enumerate(harness._tokenizer(PATH).encode(text, add_special_tokens=False).ids)]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
