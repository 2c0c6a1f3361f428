"""Edge cases and brute-force checks of the operators on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, fingerprints, media, mixing, ngram_join, quality, queries, sentencepiece_lattice, substring_dedup, token_store, toxicity, warc

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randint(8, 300)) for _ in range(25)]
    passage = words(rng, 70)
    texts = [None, "", " \n\t", "one", "One two", "one two", *base]
    for t in base[:8]:  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += base[:3] + base[:1] * 4 + [t + " " + passage + " tail" for t in base[10:14]]
    texts.append("x" * 70_000 + " " + words(rng, 3000, 50_000))
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, "clash", 1) for i, t in enumerate(texts)]
    return out + [out[10], (None, base[0], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_mixing(spark, docs, rows, nothing):
    got = mixing.fair_queue(docs).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert abs(sum(x[0]["target"] for x in by.values()) - total) < 1e-6 * total
    for own in by.values():
        assert 0 <= sum(r["taken"] for r in own) - int(own[0]["target"]) <= len(by) and own[0]["target"] <= 3 * own[0]["source_size"]
    assert sum(r["taken"] for r in got) == total
    assert sorted(map(str, mixing.fair_queue(docs.repartition(2)).collect())) == sorted(map(str, got))
    assert sum(r["take"] for r in mixing.mix_sequence(mixing.fair_queue(docs)).collect()) == sum(r["taken"] for r in got)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.fair_queue(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_ngram_groups(docs, rows, nothing):
    got = ngram_join.ngram_groups(docs).collect()
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    expect = Counter((i, len(s), least.get(find(x), i)) for x, (i, s) in enumerate(sets))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expect
    assert ngram_join.ngram_groups(nothing).count() == 0
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[None] == 1 and {i for i in ids if i is not None} == {i for i, _, c in expect if i is not None and i == c} and max(ids.values()) == 1


def test_ngram_pairs_lose_none(docs, rows):
    sets = {frozenset(s) for _, t, *_ in rows if (s := shingles(t))}
    links = sum(100 * len(a & b) >= 75 * len(a | b) for a in sets for b in sets if a is not b) // 2
    assert ngram_join.ngram_pairs(docs).count() == links


def test_trees_make_a_pair_once(spark, monkeypatch):
    rng, rows = random.Random(5), []
    first = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    for i in range(80):  # near copies with many trees in common, which lie in different tasks
        text = list(first)
        for at in rng.sample(range(300), 4):
            text[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed, shared = ngram_join.set_keys(docs), ngram_join._shared_keys(docs, "text", ngram_join.N)
    points = ngram_join._sets_of(docs, keyed, shared.select("key").distinct(), "doc_id", "text", ngram_join.N, grams=False)
    members = shared.select("sig", "key", "times", F.col("key").alias("part"))
    found = ngram_join._tree_pairs(members, points).count()
    monkeypatch.setattr(type(docs), "distinct", lambda self: self)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = ngram_join._tree_pairs(members, points).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sets = [set(s.tolist()) for s in ngram_join.shingle_sets(pa.array([t for _, t in rows]))]
    links = sum(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert links > 100 and links <= found == made


def test_members_without_partners_stay_out_of_the_trees(spark, monkeypatch):
    """Texts that share a passage alone have no partner; no member of a link's common trees is lost."""
    monkeypatch.setattr(ngram_join, "_often", lambda *_: np.zeros(ngram_join.COUNTERS, np.int64))  # as where all counters are full
    rng, rows = random.Random(6), []
    lines = [words(rng, 20, 10**6) for _ in range(40)]
    for i in range(120):
        text = words(rng, rng.randint(80, 90), 10**6)
        rows.append((len(rows), f"{text} {lines[i % 40]}"))
        if i % 4 == 0:
            rows.append((len(rows), f"{text} {lines[i % 40]} {words(rng, rng.randint(1, 15), 10**6)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed, shared = ngram_join.set_keys(docs), ngram_join._shared_keys(docs, "text", ngram_join.N)
    points = ngram_join._sets_of(docs, keyed, shared.select("key").distinct(), "doc_id", "text", ngram_join.N, grams=False)
    members = shared.select("sig", "key", "times", F.col("key").alias("part"))
    left = {(r["sig"], r["key"]) for r in ngram_join._with_partners(members, points).collect()}
    trees = defaultdict(set)
    for r in members.collect():
        trees[r["key"]].add(r["sig"])
    sets = {ngram_join._key(s): set(s.tolist()) for s in ngram_join.shingle_sets(pa.array([t for _, t in rows]))}
    links = [(a, b) for a in trees for b in trees if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) > 20 and all((sig, key) in left for pair in links for sig in trees[pair[0]] & trees[pair[1]] for key in pair)
    linked = {key for pair in links for key in pair}
    assert len(trees.keys() - linked) > 50 and len({key for _, key in left}) <= 1.2 * len(linked)


def test_partnered_by_brute_force():
    rng = np.random.default_rng(8)
    counts = np.concatenate([rng.integers(1, 12, 300), [40, 200]])
    first, m = np.cumsum(counts) - counts, int(counts.sum())
    part, sizes, total = rng.integers(0, 4, m), rng.integers(3, 400, m), rng.integers(1, 60, m)
    got = ngram_join.partnered(first, part, sizes, total)
    for a, c in zip(first.tolist(), counts.tolist()):
        for u in range(a, a + c):
            can = [part[u] != part[v] and 4 * min(sizes[u], sizes[v]) >= 3 * max(sizes[u], sizes[v]) and min(total[u], total[v]) + max(ngram_join.after_prefix(sizes[u]), ngram_join.after_prefix(sizes[v])) >= ngram_join.needed(sizes[u], sizes[v]) for v in range(a, a + c)]
            assert got[u] == any(can)


@pytest.mark.parametrize("named", [3, 64])
def test_common_trees_by_brute_force(named):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 20))) for _ in range(30)]
    times = rng.integers(1, 5, 40)
    u, v = np.triu_indices(30, 1)
    most, first, sure = ngram_join.common_trees([s[:named] for s in sets], [times[s[:named]] for s in sets], np.array([times[s].sum() for s in sets]), u, v)
    for i, (a, b) in enumerate(zip(u, v)):
        both = np.intersect1d(sets[a], sets[b])
        assert most[i] >= times[both].sum() and (named < 20 or most[i] == times[both].sum())
        assert not sure[i] or first[i] == both[0]
        assert sure[i] or not len(both) or both[0] > min(sets[a][:named][-1], sets[b][:named][-1])


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(500, x) for x in range(501, 560)] + [(x, x + 1) for x in range(600, 640)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_tree_join_bound():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(3, 400)).astype(np.uint64)) for _ in range(120)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**63, 2).astype(np.uint64)])) for s in sets[:40]]
    points = np.stack([ngram_join.fold(ngram_join.point(s)[None], ngram_join.GROUPS)[0] for s in sets])
    sizes = np.array([len(s) for s in sets])
    u, v = ngram_join.tree_join(points, sizes, np.arange(len(sets)))
    found = {(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist())}
    raw = [ngram_join.unpacked(ngram_join.packed(ngram_join.point(s)), ngram_join.groups_for(len(s))) for s in sets]
    for a in range(len(sets)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            assert ngram_join.fine_bound(raw, np.array([a]), np.array([b]))[0] >= shared
            if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                assert (b, a) in found


def test_toxicity(spark, nothing):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 9 == 0
        w = words(rng, rng.randint(5, 400), 3000).split()
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "rotten,", "(Nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "vile rotten nasty vile"), (5002, "vile rotten " * 30_000), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1200 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum(r["predicted"] == int(r["doc_id"] % 9 == 0) for r in held)
    assert right / len(held) > 0.97
    texts = dict(rows[:1200])
    for r in held:
        for s in r["spans"]:
            assert any(x in texts[r["doc_id"]][s["start"] : s["end"]].lower() for x in ("vile", "rotten", "nasty"))
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, empty).count() == len(rows)
    assert toxicity.score(nothing, model).count() == 0


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(2)
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.linspace(-3, 3, toxicity.STEPS + 1), np.log([[0.9, 0.1], [0.3, 0.7]]), -2.0, np.zeros(6))
    lengths = [0, 1, 700, 3, 0, 256, 513]
    steps = rng.integers(0, toxicity.STEPS + 1, sum(lengths)).astype(np.uint8)
    first = np.concatenate([[0], np.cumsum(lengths)])
    got = toxicity.marginals(steps, first, model)
    e, m = np.stack([np.ones(len(steps)), np.exp(model.emit[steps])], 1), np.exp(model.move)
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        f = [np.array([1, np.exp(-2.0)]) * e[a]]
        for t in range(a + 1, b):
            f.append((f[-1] / f[-1].sum()) @ m * e[t])
        r = [np.ones(2)]
        for t in range(b - 1, a, -1):
            x = m @ (e[t] * r[-1])
            r.append(x / x.sum())
        for t, (x, y) in enumerate(zip(f, r[::-1])):
            p = x * y
            assert abs(p[1] / p.sum() - got[a + t]) < 1e-9


def test_passages(docs, rows, nothing):
    got = substring_dedup.shared_passages(docs).collect()
    n = substring_dedup.MIN_WORDS
    first, need = {}, set()
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").lower().split()
        for j in range(len(w) - n + 1):
            if first.setdefault(tuple(w[j : j + n]), i) != i:
                need.add(i)
    assert need <= {r["doc_id"] for r in got}
    assert all(r["ref_doc_id"] < r["doc_id"] and r["n_words"] >= n and r["identity"] >= substring_dedup.MIN_IDENTITY for r in got)
    tails = {i for i, t, *_ in rows if t and t.endswith(" tail")}
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.without_passages(docs, substring_dedup.shared_passages(docs)).filter("doc_id is not null").collect()}
    assert sorted(len(kept[i].split()) for i in tails if i in kept)[:-1] != [] and sum("tail" in kept.get(i, "") for i in tails) >= 1
    assert substring_dedup.shared_passages(nothing).count() == 0


def test_passages_whose_parts_have_other_holders(spark):
    rng, n, rows = random.Random(11), substring_dedup.MIN_WORDS, []
    fill = lambda k: words(rng, k, 10**6).split()
    for case in range(30):
        passage = fill(50 + 2 * case)
        half = len(passage) // 2 if case % 3 else 20
        parts = [passage[:half], passage[half:], passage, passage] if case % 2 else [passage[:half], passage[half:], [*passage, *fill(12), *passage[:8]], passage]
        rows += [(100 * case + k, " ".join(fill(rng.randrange(60)) + part + fill(rng.randrange(60)))) for k, part in enumerate(parts)]
    got = substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    texts, spans, first = {i: t.split() for i, t in rows}, defaultdict(set), {}
    for r in got:
        spans[r["doc_id"]].update(range(r["start_word"], r["start_word"] + r["n_words"]))
    for i, w in sorted(texts.items()):
        for j in range(len(w) - n + 1):
            if first.setdefault(tuple(w[j : j + n]), i) != i:
                assert spans[i] >= set(range(j, j + n)), (i, j)
    assert {i for i in texts if i % 100 == 3} <= set(spans)


def test_hashes_of_windows():
    got = substring_dedup.windows(np.array([5, 7, 5, 9, 1] * 30 + [3], np.uint32), 50)
    assert len(got) == 102 and len(set(got.tolist())) == 6 and (got[:5] == got[5:10]).all()


def test_equal_words_are_kept_of_a_poor_chain():
    a, b = np.arange(300), np.arange(300)
    b[60:110:2] += 1000
    b[130:] += 1000
    chain = [(0, 0, 120)]
    (s, e, _, _, same), *_ = substring_dedup.passages(a, b, chain, 50, 0.9)
    assert s == 0 and 60 <= e <= 62 and same >= 0.9 * (e - s)


def test_seeds_of_pairs_as_lists():
    rng, names = random.Random(4), [f"{side}_{c}" for side in ("held", "own") for c in ("one", "other", "pos")]
    lists = lambda: [(rng.randrange(3), rng.randrange(4), rng.randrange(90)) for _ in range(rng.randrange(9))]
    pairs = [({(one, other): pos for one, other, pos in lists()}, lists()) for _ in range(60)]
    held = [[(*seed, pos) for seed, pos in h.items()] for h, _ in pairs]
    rows = pa.RecordBatch.from_arrays([pa.array([[s[k] for s in x] for x in side], pa.list_(pa.int64())) for side in (held, [own for _, own in pairs]) for k in range(3)], names)
    for some in (rows, rows.slice(7, 30), rows.slice(0, 0)):
        start = 7 if some.num_rows == 30 else 0
        want = [(i, pos, h[one, other]) for i, (h, own) in enumerate(pairs[start : start + some.num_rows]) for one, other, pos in own if (one, other) in h]
        assert sorted(zip(*(x.tolist() for x in substring_dedup._in_common(some, names)))) == sorted(want)


def test_straight_chains_at_once():
    rng, rows = np.random.default_rng(8), []
    for _ in range(200):
        a = rng.integers(0, 1000, rng.integers(10, 200)).astype(np.int32)
        b = np.where(rng.random(len(a)) < rng.choice([0.02, 0.1, 0.3]), -1, a).astype(np.int32)
        cut = rng.integers(0, len(a))
        b = np.delete(b, cut) if rng.random() < 0.5 else b
        p = int(rng.integers(max(0, cut - 60), cut + 1))
        rows.append((a, b, p, min(p, len(b)), int(rng.integers(0, min(len(a) - p, len(b) - min(p, len(b)), 64) + 1))))
    x, y = (pa.array([r[k][max(0, r[2 + k] - substring_dedup.MARGIN) : r[2 + k] + r[4] + substring_dedup.MARGIN].tolist() for r in rows], pa.list_(pa.int32())) for k in (0, 1))
    p, r = (np.array([min(row[k], substring_dedup.MARGIN) for row in rows]) for k in (2, 3))
    n = np.array([row[4] for row in rows])
    after, before = substring_dedup._extended(x, y, p, p + n, r, r + n, 50)
    got = np.stack(substring_dedup._straight(x, y, p, r, n, after, before, 50), 1)
    for i, (u, v) in enumerate(zip(x, y)):
        assert tuple(got[i].tolist()) == substring_dedup.align(u.values.to_numpy(), v.values.to_numpy(), [(int(p[i]), int(r[i]), int(n[i]))], 50)


def test_runs_of_many_groups_at_once():
    rng = np.random.default_rng(9)
    group, at, ref = np.sort(rng.integers(0, 20, 400)), rng.integers(0, 90, 400), rng.integers(0, 4, 400)
    ref, size = at + ref, np.full(400, 6)
    got = substring_dedup.runs(at, ref, size, group=group)
    assert got.tolist() == [[*row, g] for g in np.unique(group).tolist() for row in substring_dedup.runs(at[group == g], ref[group == g], size[group == g]).tolist()]


def test_far_match_hides_no_near_one(spark):
    rng = random.Random(3)
    fill = lambda k: words(rng, k, 10**6).split()
    assert [(105, 105, 22), (128, 127, 22), (151, 149, 22)] in substring_dedup.chains(np.array([(0, 0, 60), (105, 105, 22), (128, 127, 22), (151, 149, 22)]))
    long, fuzzy = fill(60), fill(66)
    mended = [*fuzzy[:22], *fill(1), *fuzzy[22:44], *fill(1), *fuzzy[44:]]
    rows = [(1, " ".join([*long, *fill(45), *fuzzy])), (2, " ".join([*long, *fill(45), *mended]))]
    got = substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any(r["start_word"] >= 100 and r["n_words"] >= 60 for r in got) and len(got) == 2
    cost, gap, k = substring_dedup.GAP_COST, substring_dedup.MAX_GAP, substring_dedup.K
    for _ in range(200):  # the best chain, by brute force
        found = sorted((rng.randrange(200), rng.randrange(200), rng.randrange(k, 30)) for _ in range(rng.randrange(2, 25)))
        best = []
        for p, r, n in found:
            near = [s - cost * (p + r - q - u - 2 * m) for (q, u, m), s in zip(found, best) if -k // 2 <= p - q - m <= gap and -k // 2 <= r - u - m <= gap]
            best.append(n + max([0.0, *near]))
        chain = substring_dedup.chains(np.array(found))[0]
        total = sum(n for _, _, n in chain) - sum(cost * (p + r - q - u - 2 * m) for (q, u, m), (p, r, _) in zip(chain, chain[1:]))
        assert abs(total - max(best)) < 1e-6


def test_fingerprints(spark, docs, rows, nothing):
    got = fingerprints.edited_fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    expect = Counter()
    for i, t in enumerate(texts):
        m = len(t) // 3
        edited = t[: len(t) - m] + texts[(i + 1) % len(texts)][:m]
        expect[(order[i][0], len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expect
    prints = defaultdict(set)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_id = {r[0]: r[1] or "" for r in rows}
    for r in got:
        prints[by_id[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == {""}
    assert fingerprints.edited_fingerprints(nothing).count() == 0
    alone = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "abcdefghi")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefabc").hexdigest()


def test_syncmers_are_context_free():
    rng = random.Random(4)
    data = bytes(rng.choice(b"abcdefghij ") for _ in range(3000))
    at, hashes, _ = fingerprints.syncmers(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    brute = []
    for i in range(len(data) - fingerprints.K + 1):
        inner = [int(fingerprints.mix(np.frombuffer(data[j : j + fingerprints.S] + bytes(8 - fingerprints.S), "<u8") << np.uint64(16))[0] >> np.uint64(32)) for j in range(i, i + fingerprints.K - fingerprints.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            brute.append(i)
    assert at.tolist() == brute
    moved, same, _ = fingerprints.syncmers(np.frombuffer(b"zz" + data, np.uint8), np.array([0, len(data) + 2]))
    assert set(hashes.tolist()) <= set(same.tolist())


def test_media(docs, rows, nothing):
    got = media.media_column(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        raw = texts[r["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and media.from_wav(bytes(r["media"])) == payload
        assert (len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) == (r["media_bytes"], r["media_sha256"])
    assert media.media_column(nothing).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/x?y#z", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "http://b", ""), (4, "u", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (None, "n", "other"), (5, "http://c d", "é" * 50_000), (4, "u", "<p>é</p>\r\n\r\nWARC/1.1\r\n")]
    got = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), keep_payload=True).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 6  # the row that is repeated as a whole is one capture
    assert {i: (r["response"]["kind"], r["refers_to_page"]) for i, r in by.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 2), 4: ("revisit", 1), None: ("response", None), 5: ("response", None)}
    import base64

    for i, _, html in pages:
        raw = (html or "").encode()
        assert (by[i]["response"]["payload_bytes"], by[i]["response"]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert by[i]["request"] is not None and by[i]["metadata"] is not None
    assert bytes(by[1]["response"]["payload"]).decode() == pages[0][2]
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 300, 2000), [50256, 0, 50256], np.full(700, 7)]).astype(np.uint32)
    m = token_store.WaveletMatrix(token_store.build_matrix(ids))
    assert np.array_equal(m.decode(), ids)
    assert [m.access(i) for i in (0, 1, 511, 512, 1999, 2000, 2702)] == ids[[0, 1, 511, 512, 1999, 2000, 2702]].tolist()
    for token in (7, 0, 50256, 299, 60_000, 1 << 20):
        places = np.flatnonzero(ids == token).tolist()
        assert m.count(token) == len(places) and m.occurrences(token)[:50] == places[:50]
        assert m.rank(token, 1234) == sum(p < 1234 for p in places)
    assert len(token_store.WaveletMatrix(token_store.build_matrix(ids[:0])).decode()) == 0


def test_token_store(spark, docs, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = [(900, "a\xa0\n b  c\n\n d \t", *[None] * 5), (901, "<|endoftext|> x", *[None] * 5), (902, "日本 語　ＡＢ​", *[None] * 5)]
    both = docs.unionByName(spark.createDataFrame(odd, DOCS))
    got = token_store.token_store(both, path, shard_tokens=500).orderBy("start").collect()
    order = sorted(rows + odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, text, *_) in zip(got, order, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_store.token_store(nothing, path).count() == 0


def test_sentencepiece(spark, docs, rows, nothing):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    odd = ["  lead  and trail ", "é日本語 ▁x\t\n\r\x00", "a" * 300, "==========----" * 20, "http://x.y/z?q=%20&r=123456789", "ÀÉ ﬁ 👩‍👩‍👧 ẞ"]
    both = docs.unionByName(spark.createDataFrame([(900 + i, t, *[None] * 5) for i, t in enumerate(odd)], DOCS))
    got = sentencepiece_lattice.decode(sentencepiece_lattice.encode(both, model), model).collect()
    expect = Counter((r[0], tuple(sp.encode(r[1] or ""))) for r in [*rows, *((900 + i, t) for i, t in enumerate(odd))])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == expect
    texts = {r[0]: r[1] or "" for r in rows} | {900 + i: t.replace("▁", " ") for i, t in enumerate(odd)}
    assert all(r["text"] == texts[r["doc_id"]] for r in got)
    assert sentencepiece_lattice.encode(nothing, model).count() == 0


def test_viterbi_takes_the_best_sum(spark):
    rng = random.Random(6)
    pieces = {c: -5.0 for c in "abc"} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))): -rng.uniform(1, 12) for _ in range(40)}
    table = sentencepiece_lattice.Pieces(tuple((p, i, s) for i, (p, s) in enumerate(pieces.items())), None, 999, ())
    units = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    folded = sentencepiece_lattice.fold_viterbi(sentencepiece_lattice.lattice(spark.createDataFrame([(u,) for u in set(units)], "unit string"), table)).toArrow().combine_chunks().to_batches()[0]
    counts, ids = sentencepiece_lattice.ids_of(folded, table)
    ends = np.concatenate([[0], np.cumsum(counts)])
    got = [{"unit": u, "ids": ids[a:b].tolist()} for u, a, b in zip(folded.column("unit").to_pylist(), ends, ends[1:])]
    worst = min(pieces.values()) - 10
    names = {i: p for i, p in enumerate(pieces)}

    def best(u):
        out = [0.0]
        for j in range(1, len(u) + 1):
            out.append(max(out[i] + pieces.get(u[i:j], worst if j == i + 1 else -1e9) for i in range(j)))
        return out[-1]

    assert len(got) == len(set(units))
    for r in got:
        assert abs(sum(pieces[names[i]] if i in names else worst for i in r["ids"]) - best(r["unit"])) < 1e-6


def test_quality(spark, docs, rows, nothing):
    rng = random.Random(8)
    made = [(i, words(rng, 50) if i % 4 else "### $$$ " * 20, "en", f"h{i % 5}") for i in range(400)]
    train = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    model = quality.fit(train, spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int"))
    got = quality.posterior(train, model).collect()
    assert sum(r["keep"] == (r["doc_id"] % 4 > 0) for r in got) == len(got)
    wide = quality.posterior(docs, model).collect()
    assert len(wide) == len(rows) and all(0 <= r["path_rate"] <= 1 and 0 <= r["score"] <= 1 for r in wide)
    assert quality.posterior(nothing, model).count() == 0
    flat = quality.fit(train, spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r["evidence"], 9) for r in quality.posterior(docs, flat).collect()} == {0.0}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, DIR), con.sql(queries.oracle_sql()[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in ours.collect()))) == sorted(map(repr, theirs.select(*names).fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, DIR)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
    assert out.count() > 0 and {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, DIR).count() == out.count()


def test_recall_of_near_passages(spark):
    rng = random.Random(5)
    w = lambda k: [f"w{rng.randrange(20000)}" for _ in range(k)]
    rows, rate = [], 0.05
    for i in range(150):
        near = []
        passage = w(rng.randint(60, 160))
        for x in passage:
            u = rng.random() / rate
            near += [f"x{rng.randrange(20000)}"] if u < 0.6 else [] if u < 0.8 else [x, f"y{rng.randrange(20000)}"] if u < 1 else [x]
        rows += [(2 * i, " ".join(w(100) + passage + w(80))), (2 * i + 1, " ".join(w(60) + near + w(120)))]
    found = {r["doc_id"] for r in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["ref_doc_id"] == r["doc_id"] - 1}
    assert len(found) >= 0.9 * 150


@pytest.mark.parametrize("rate", [0.05, 0.1])
def test_recall_of_near_passages_whose_parts_have_other_holders(spark, rate):
    rng, rows, cases = random.Random(17), [], 120
    w = lambda k: [f"w{rng.randrange(20000)}" for _ in range(k)]
    for i in range(cases):
        passage, holders = w(rng.randint(80, 110)), 1 + i % 3
        cuts = [len(passage) * k // (holders + (holders == 1)) for k in range(holders + 1 + (holders == 1))]
        near = []
        for x in passage:
            u = rng.random() / rate
            near += [f"x{rng.randrange(20000)}"] if u < 0.6 else [] if u < 0.8 else [x, f"y{rng.randrange(20000)}"] if u < 1 else [x]
        parts = [passage[a:b] for a, b in zip(cuts, cuts[1:])][:holders]
        parts += [passage, *parts, near]
        rows += [(100 * i + k, " ".join(w(rng.randrange(20, 90)) + part + w(rng.randrange(20, 90)))) for k, part in enumerate(parts)]
    last = {}
    for i, _ in rows:
        last[i // 100] = i
    got = substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = Counter(case % 3 for case in {r["doc_id"] // 100 for r in got if r["doc_id"] == last[r["doc_id"] // 100]})
    assert all(found[k] >= 0.9 * cases / 3 for k in range(3)), found


def test_pages_without_ids(spark):
    rows = [(None, f"http://a/{i}", "same") for i in range(5)] + [(1, "http://a/", "same")] + [(None, f"http://b/{i}", "other") for i in range(2)] + [(7, "http://c/", "own"), (None, "http://c/", "own")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "response.kind", "refers_to_page", "response.payload_bytes").collect()
    assert Counter((r["page_id"], r["kind"], r["refers_to_page"], r["payload_bytes"]) for r in got) == Counter({(None, "revisit", 1, 4): 5, (1, "response", None, 4): 1, (None, "response", None, 5): 2, (7, "response", None, 3): 1, (None, "revisit", 7, 3): 1})


def test_groups_of_texts_under_one_id(spark):
    rng = random.Random(11)
    a, b, c = words(rng, 40), words(rng, 40), words(rng, 40)
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (7, c, 3), (7, b + " more", 4), (7, c, 3), (None, a, 5), (8, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = Counter((r["doc_id"], r["key"]) for r in ngram_join.one_of_each_group(docs).collect())
    assert got == Counter([(1, 0), (5, 2), (7, 3), (None, 5), (8, 6), (8, 7)])


def test_passages_of_nulls_and_repeats(spark):
    rng = random.Random(12)
    passage = words(rng, 80)
    rows = [(1, passage + " end", "a"), (2, "start " + passage, "b"), (2, "start " + passage, "c"), (2, None, "d"), (3, None, "e"), (None, passage, "f"), (4, words(rng, 90), "g"), (4, words(rng, 200), "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    passages = substring_dedup.shared_passages(docs)
    assert {(r["doc_id"], r["ref_doc_id"], r["n_words"]) for r in passages.collect()} == {(2, 1, 80)}
    got = {r["spans"]: r["text"] for r in substring_dedup.without_passages(docs, passages).collect()}
    expect = {r[2]: r[1] for r in rows} | {"b": "start ", "c": "start "}
    assert {k: (v or "").strip() for k, v in got.items()} == {k: (v or "").strip() for k, v in expect.items()}


def test_cut_stage_runs_in_no_batches_of_the_callers(spark):
    import corpus_pipeline

    rng = random.Random(14)
    passage = words(rng, 60, 5000)
    rows = [(1, f"{words(rng, 9)} {passage} \u00a0", "a"), (2, f"\u00e9 \tB {passage}\n{words(rng, 3)} \u4e2d", "b"), (3, passage, "c"), (4, " ", "d"), (5, None, "e"), (None, passage, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = dict(corpus_pipeline.STAGES)["shared_passages"](spark, docs, DIR)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # texts, or chains with words, 10,000 rows at a time
    assert out.columns == docs.columns
    got = {r["spans"]: r["text"] for r in out.collect()}
    assert got == {r[2]: r[1] for r in rows if r[2] != "c"} | {"b": rows[1][1].replace(passage + "\n", "")}


def test_mixing_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "s", i, i, "x", "y") for i in range(20)], "doc_id long, text string, source string, size int, copies int, own string, own_id string")
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs).count() == 20


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    """Each stage's result against a plain version over its own input."""
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    stages = dict(corpus_pipeline.STAGES)
    rng = random.Random(21)
    passage = words(rng, 60, 5000)
    texts = [words(rng, rng.randint(60, 200), 5000) for _ in range(30)]
    texts += [t + " more" for t in texts[:5]] + [words(rng, 70, 5000) + " " + passage + " " + words(rng, 70, 5000) for _ in range(3)] + ["", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = stages["near_copies"](spark, docs, DIR)
    sets = {i: shingles(t) for i, t, *_ in rows}
    gone = {j for i in sets for j in sets if i < j and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert {r["doc_id"] for r in copies.collect()} == set(sets) - gone and gone == set(range(30, 35))
    cut = stages["shared_passages"](spark, copies, DIR).collect()
    seen = Counter(tuple(w[i : i + 50]) for r in cut if (w := (r["text"] or "").split()) for i in range(len(w) - 49))
    assert max(seen.values()) == 1 and sum(passage in (r["text"] or "") for r in cut) == 1
    before = {r["doc_id"]: r["text"] for r in copies.collect()}
    assert all(r["text"] == before[r["doc_id"]] for r in cut if r["doc_id"] not in (36, 37))
    mixed = stages["mixing"](spark, docs, DIR)
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.fair_queue(docs).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: (2 * t + n) // (2 * n) for i, (t, n) in taken.items() if n})
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: (r["ids"], r["n_tokens"]) for r in stages["encoding"](spark, docs, DIR).collect()} == {i: (x := sp.encode(t or ""), len(x)) for i, t, *_ in rows}
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxic_documents_are_found_by_labels_of_others(spark):
    rng = random.Random(31)
    slurs = [f"vile{c}" for c in "abcdef"]
    rows = []
    for i in range(600):
        w = words(rng, rng.randint(10, 120)).split()
        if i % 6 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(slurs))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(got[i]["predicted"] == (i % 6 == 0) for i in held)
    assert right >= 0.98 * len(held)
    for i in held:
        named = {rows[i][1][s["start"] : s["end"]] for s in got[i]["spans"]}
        assert not named or named & set(" ".join(slurs).split()) or any(x in n for n in named for x in slurs)


def test_landmarks_by_plain_transform():
    payload = bytes(random.Random(2).randrange(32, 127) for _ in range(64 * 40))
    samples = [b - 128 for b in payload] + [0] * 64
    window, peaks = np.hanning(128), []
    for at in range(0, len(samples) - 127, 64):
        x = np.array(samples[at : at + 128]) * window
        power = [abs(sum(x * np.exp(-2j * np.pi * k * np.arange(128) / 128))) ** 2 for k in range(2, 65)]
        peaks.append((int(np.argmax(power)), max(power)))
    kept = [t for t, (_, p) in enumerate(peaks) if (t == 0 or p >= peaks[t - 1][1]) and (t == len(peaks) - 1 or p >= peaks[t + 1][1])]
    expect = sorted((kept[i], peaks[kept[i]][0] << 13 | peaks[kept[i + j]][0] << 6 | min(63, kept[i + j] - kept[i])) for j in (1, 2, 3) for i in range(len(kept) - j))
    times, codes = media.landmarks(payload)
    assert sorted(zip(times.tolist(), codes.tolist())) == expect
    assert media.feature_text(times, codes) == f"{len(expect)};" + " ".join(f"{t}:{c:x}" for t, c in expect)


def test_likeness_by_sets(spark, docs, rows):
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.edited_fingerprints(docs).collect())
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))

    def sketch(text):
        data = text.encode()
        hashes = fingerprints.syncmers(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1]
        return sorted({int(h) >> 32 for h in hashes})[:64]

    def like(a, b):
        a, b = set(sketch(a)), set(sketch(b))
        if not a and not b:
            return 1.0
        least = sorted(a | b)[:64]
        return len([x for x in least if x in a and x in b]) / len(least)

    expect = Counter()
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        expect[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(text, edited), 9), round(like(text, after), 9)] += 1
    assert got == expect


def test_shrunk_rates_against_sql(spark):
    rng = random.Random(41)
    rows = [(i, words(rng, rng.randint(3, 60)), f"h{rng.randrange(4)}" if i % 9 else None, f"p{i}" if i % 2 else "p") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(0, 300, 3)], "doc_id long, quality int"))
    found = quality.posterior(docs, model).toPandas()
    p = 1 / (1 + np.exp(-found["evidence"]))
    found = found.assign(p=p, host=found["host"].fillna("-"), path=found["path"].fillna("-"))
    overall = min(0.999, max(0.001, p.mean()))
    own = duckdb.sql(
        f"""WITH s AS (SELECT *, sum(p) OVER (PARTITION BY host) - p AS hg, count(*) OVER (PARTITION BY host) - 1 AS hn, sum(p) OVER (PARTITION BY host, path) - p AS pg, count(*) OVER (PARTITION BY host, path) - 1 AS pn FROM found)
        SELECT hg, hn, pg, pn, host_rate, path_rate FROM s"""
    ).fetchall()
    worth_host = [(hg - hr * hn) / (hr - overall) for hg, hn, _, _, hr, _ in own if abs(hr - overall) > 1e-6]
    worth_path = [(pg - pr * pn) / (pr - hr) for _, _, pg, pn, hr, pr in own if pn and abs(pr - hr) > 1e-6]
    for worth in (worth_host, worth_path):  # one weight of the prior for all
        assert len(worth) > 20 and max(worth) - min(worth) < 1e-3 * max(worth) and min(worth) > 0.999
    assert all(abs(pr - hr) < 1e-9 for _, _, _, pn, hr, pr in own if not pn)  # a site without other documents is its host
