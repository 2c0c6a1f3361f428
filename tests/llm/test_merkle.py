"""The Merkle manifest against a plain tree, on sources of many sizes, nulls, ties and blocks of several sizes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return sha("".join(told(v) for v in (row[0], row[3], row[2], row[4], text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, i):
    out = []
    for row in levels[:-1]:
        start = i - i % 3
        out.append((i - start, row[start:i] + row[i + 1 : start + 3]))
        i //= 3
    return out


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources}
    trees = {s: levels_of([leaf(r, r[1]) for r in own[s]]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            proof = path(trees[s], i) + path(top, k)
            shown = r[1]
            if shown is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                shown = shown.replace("\n", "")
            node = leaf(r, shown)
            for at, others in proof:
                node = sha("".join([*others[:at], node, *others[at:]]))
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], sha("".join(x for _, o in proof for x in o)), node, node == top[-1][0]))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, f"text {i}\nof {i % 5}\n", "en", f"é{i % 2}", i, "clash", 1) for i in range(0, 160, 2)]
    out += [(1000 + i, None if i % 3 else "", None, None, None, None, None) for i in range(7)]
    out += [(5000, "one\nlone", "fr", "lone", 8, None, None), (5001, "x" * 90_000 + "\n", "de", "two", 3, None, None), (5002, "y", "de", "two", 1, None, None)]
    out += [out[3], out[3], (None, "no id\n", "en", "é0", 5, None, None), (None, "no id\n", "en", "é0", 5, None, None), (8, "other text\n", "en", "é0", 5, None, None)]
    rng.shuffle(out)
    return out


def audit(docs, levels):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = merkle.tamper_audit(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")), levels)
    return sorted(repr(tuple(r)) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_audit_against_plain_trees(spark, rows, levels):
    assert audit(spark.createDataFrame(rows, SCHEMA).repartition(4), levels) == plain(rows)


def test_manifest_is_folded_to_its_root(spark, rows):
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), 2)
    assert found.columns == ["source", "doc_id", "pos", "leaf", "proof", "subroot", "root"]
    assert found.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0 and found.select("root").distinct().count() == 1
    assert found.groupBy("source", "pos").count().filter("count > 1").count() == 0


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("band", [1, 2, 3, 5])
def test_traversal_against_levels(band):
    for n in [*range(1, 30), 80, 81, 82, 243]:
        leaves = [sha(str(i)) for i in range(n)]
        whole = levels_of(leaves)
        got = list(merkle.authentication_paths([x.encode() for x in leaves], len(whole) - 1, band))
        assert [[(at, o.decode()) for at, o in p] for p in got] == [[(at, "".join(o)) for at, o in path(whole, i)] for i in range(n)]
