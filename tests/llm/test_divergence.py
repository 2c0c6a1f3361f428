"""The audit against counting by hand, in one block of terms and in many."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, id int, n string"


def plain(rows, least):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))) for r in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted((t for t, n in seen[lang].items() if n >= least), key=str.encode)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        own = {s: share(c) for (lng, s), c in counts.items() if lng == lang}
        whole = share(sum((c for (lng, _), c in counts.items() if lng == lang), Counter()))
        for s, p in own.items():
            pair = sorted(((-sum(abs(p[t] - q[t]) for t in kept), o.encode(), o) for o, q in own.items() if o != s))
            term = sorted((whole[t] - p[t], t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[t] > whole[t])[:50]
            out += [(lang, s, part, item, -v, i) for part, found in (("pair", pair), ("term", term)) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def audit(spark, rows, **how):
    return sorted(tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    pool = [f"{a}{b}" for a in ("Wort", "mot", "é", "ß", "the", "a") for b in "abcdefghijklm"]
    signs = [" ", "  ", "1", "-", "\n", "\x00", "[", "`", "{", "\x7f", ", "]
    out = [(i, "".join(rng.choice(pool) + rng.choice(signs) for _ in range(rng.randrange(60))), ("en", "de", None)[i % 3], (f"s{i % 4}", "é", None)[i % 5 % 3], None, None, None) for i in range(120)]
    out += [(200, None, "en", "only null", None, 1, None), (201, "", "xx", "a", None, 1, None), (202, "alone", "xx", None, None, 1, None), (203, "word " * 40_000, "en", "s1", None, 1, None)]
    return out + [out[0]] * 3 + [(None, "Wortawortb", "", "s1", None, None, None)] * 4


@pytest.mark.parametrize("how", [{}, {"block_bytes": 400}])
def test_against_counting(spark, rows, how):
    assert audit(spark, rows, min_docs=3, **how) == plain(rows, 3)


def test_nothing_kept_and_empty(spark, rows):
    assert audit(spark, rows, min_docs=1000) == plain(rows, 1000)
    assert audit(spark, []) == []
