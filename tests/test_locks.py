"""The tree of a lock names what a plain comparison names, and looks at no branch that is equal."""

import hashlib

import pytest

from tessera.operators import locks

KIND = "path string, digest string, size int"


def problems(spark, want, got, levels=2):
    a, b = (spark.createDataFrame([(*r, 1) for r in rows], KIND) for rows in (want, got))
    compared = locks.compared_nodes(locks.digest_tree(a, levels), locks.digest_tree(b, levels), levels)
    return sorted((r["path"], r["problem"]) for r in locks.lock_violations(a, b, compared, levels).collect()), compared.collect()


@pytest.mark.parametrize("levels", [1, 3])
def test_problems(spark, levels):
    want = [(f"d{i % 7}/{i}", f"x{i}") for i in range(300)]
    got = [(p, "other" if p.endswith("7") else x) for p, x in want if not p.endswith("11")] + [("new/é", "y"), ("d1/new", None)]
    expect = sorted([(p, "missing" if p.endswith("11") else "changed") for p, _ in want if p.endswith(("7", "11"))] + [("new/é", "added"), ("d1/new", "added")])
    found, compared = problems(spark, want, got, levels)
    assert found == expect
    hashed = lambda p: hashlib.md5(p.encode()).hexdigest()
    differ = {hashed(p)[:n] for p, _ in expect for n in range(levels + 1)}
    assert {r["prefix"] for r in compared if r["differs"]} == differ and all(r["prefix"][:-1] in differ for r in compared if r["prefix"])


def test_equal_trees_are_compared_at_the_root(spark):
    rows = [("a", "1"), ("b", None), ("a", "1"), ("b", "2")]
    assert [(r["prefix"], r["differs"]) for r in problems(spark, rows, rows[::-1])[1]] == [("", False)]
    assert problems(spark, [], []) == ([], [])
    assert problems(spark, [("a", "1"), ("a", "2")], [("a", "1")])[0] == [("a", "changed")]
