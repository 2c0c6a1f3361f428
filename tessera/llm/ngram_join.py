"""N-gram Jaccard join with a count-vector R-tree.

A document is its set of distinct word 5-grams. The 5-grams are hashed into groups, and the
counts per group are a point. Two sets share at most the sum over the groups of the smaller
count, which an R-tree over the points bounds for whole boxes; pairs that survive are verified
on the sets.

The points have tens of dimensions and texts without relation lie close together, so one tree
over all documents would compare all boxes with all. The forest here has a tree for each key that
similar sets must share: with the hashes of a set in one order for all sets, each of the first
quarter, to be exact of the first n - ceil(0.75 n) + 1. Two sets of a Jaccard similarity of 0.75 have
at least 0.75 n of the larger one's hashes in common, so the smallest common hash lies in both of
these parts: no link is lost, and nothing is capped. The order puts hashes in few sets first, as far
as COUNTERS counters tell them apart, so passages that many texts share give few keys.

Of two sets let the first part of one end before the other's in that order. A hash of the former's first
part that both have is in both parts, so they share at most the keys they have in common and all
hashes after the former's part. What tells near copies apart is rare and comes first, so this
bound is close where points say little, and a pair is made in the first of its common trees alone.
Most sets share a few hashes with texts that are nothing like them; where sizes and numbers of shared hashes
leave a set no partner in a tree, its points do not go there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .base import buffers, cut, different, freeing, mix, sequences, whole_runs, words, written
from .components import components

N, GROUPS, LEAF, BLOCK = 5, 64, 64, 512
#: Similarity of at least PART / WHOLE.
PART, WHOLE = 75, 100
BITS = 23
COUNTERS = 1 << 18
#: Trees of a set that its rows name; how many hashes the others stand for is told as one number.
NAMED = 64


def shingle_sets(texts: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """Per text its different n-gram hashes, sorted; all words as one where there are fewer; none without words."""
    data, offsets = buffers(texts)
    _, hashes, first = words(data, offsets)
    grams, whole = sequences(hashes, first, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield different(grams[a : b - n + 1])
        elif b > a:
            yield mix(np.array([np.sum(hashes[a:b] * np.array([3, 5, 7, 11, 13, 17, 19, 23][: b - a], np.uint64)) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _key(grams: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(grams), dtype=np.uint64) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def _place(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(COUNTERS - 1)).astype(np.int64)


def _prefix(grams: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The keys of a set, as above; none for sets of one or two, which nothing but an equal set resembles."""
    n = len(grams)
    if n < 3:
        return np.zeros(0, np.int64)
    order = np.argsort(often[_place(grams)], kind="stable")[: n - -(-PART * n // WHOLE) + 1]  # grams are in order of their values
    return grams[order].view(np.int64)


def groups_for(n: int) -> int:
    """Groups for a set of n: so many that most hold a hash or none, and the bound comes near the overlap. Always GROUPS times a power of two, so a point folds to a coarser one."""
    groups = GROUPS
    while groups < 4 * n:
        groups *= 2
    return groups


def point(grams: np.ndarray) -> np.ndarray:
    groups = groups_for(len(grams))
    return np.bincount((mix(grams) % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.uint32)


def packed(counts: np.ndarray) -> bytes:
    """A byte per count where all fit, as a first byte says, compressed: about a bit for each."""
    kind = "u1" if counts.max() < 256 else "<u4"
    return kind[-1].encode() + pa.compress(counts.astype(kind).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, groups: int) -> np.ndarray:
    kind = f"<u{raw[:1].decode()}"
    return np.frombuffer(pa.decompress(raw[1:], groups * int(kind[-1]), codec="zstd", asbytes=True), kind)


def rough_for(n: int) -> int:
    """Groups of the points that go through the trees: about one hash each, which tells sets that share half of theirs from near copies, at less bytes."""
    return max(GROUPS, groups_for(n) // 4)


def fold(points: np.ndarray, groups: int) -> np.ndarray:
    """Points [rows, finer groups] with their groups added up to fewer."""
    return points.reshape(len(points), -1, groups).sum(axis=1, dtype=np.uint32)


def fine_bound(points: list[np.ndarray], u: np.ndarray, v: np.ndarray, coarser: int = 1) -> np.ndarray:
    """For pairs (u, v) of rows of points the sum of smaller counts, at the finest groups that both have, or that many times fewer."""
    levels = np.array([len(x) for x in points])
    common = np.minimum(levels[u], levels[v])
    out = np.zeros(len(u), np.int64)
    for groups in np.unique(common).tolist():
        rows = np.flatnonzero(common == groups)
        groups = max(GROUPS, groups // coarser)
        need = np.unique(np.concatenate([u[rows], v[rows]]))
        table = np.stack([points[i] if levels[i] == groups else fold(points[i][None], groups)[0] for i in need])
        table = table.astype(np.uint8) if table.max() < 256 else table
        a, b = np.searchsorted(need, u[rows]), np.searchsorted(need, v[rows])
        step = max(1, (1 << 21) // groups)
        for i in range(0, len(rows), step):
            out[rows[i : i + step]] = np.minimum(table[a[i : i + step]], table[b[i : i + step]]).sum(axis=1)
    return out


def needed(a, b):
    """Least overlap of sets of a and b hashes at the threshold: WHOLE * overlap >= PART * (a + b - overlap)."""
    return -(-PART * (a + b) // (WHOLE + PART))


def common_trees(trees: list[np.ndarray], times: list[np.ndarray], total: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs (u, v) of sets the most hashes of their first parts that they can share, and the first tree they share, if known (a number and whether it is).

    trees: the first NAMED trees of a set in order, times: how many hashes each stands for, total: all
    trees' hashes. Past the last tree that a set names the others may be any of the pair's.
    """
    counts = np.array([len(x) for x in trees], np.int64)
    starts = np.cumsum(counts) - counts
    trees, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (trees, times))
    known = np.add.reduceat(np.append(times, 0), starts) if len(counts) else counts
    last = np.where(known < total, trees[starts + counts - 1], np.iinfo(np.int64).max)
    numbers, code = np.unique(trees, return_inverse=True)
    last = np.searchsorted(numbers, last, "right")  # codes below are told
    most, first, sure = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), np.zeros(len(u), bool)
    sizes = np.cumsum(counts[u] + counts[v])
    at = 0
    while at < len(u):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 20), "right")))
        n = to - at
        end, rest, sides = np.minimum(last[u[at:to]], last[v[at:to]]), [], []
        for own in (u[at:to], v[at:to]):
            pair = np.repeat(np.arange(n), counts[own])
            entry = np.arange(len(pair)) + np.repeat(starts[own] - (np.cumsum(counts[own]) - counts[own]), counts[own])
            inside = code[entry] < end[pair]
            pair, entry = pair[inside], entry[inside]
            rest.append(total[own] - np.bincount(pair, times[entry], n).astype(np.int64))
            sides.append((pair * len(numbers) + code[entry], entry))
        (meets, entry), (meets_v, _) = sides
        spot = np.searchsorted(meets_v, meets)
        both = np.append(meets_v, -1)[spot] == meets
        pair, entry = meets[both] // max(1, len(numbers)), entry[both]
        most[at:to] = np.bincount(pair, times[entry], n).astype(np.int64) + np.minimum(*rest)
        head = np.flatnonzero(np.diff(pair, prepend=-1))
        first[at + pair[head]], sure[at + pair[head]] = trees[entry[head]], True
        at = to
    return most, first, sure


def after_prefix(n):
    """Hashes of a set of n that are no keys."""
    return -(-PART * n // WHOLE) - 1


def tree_join(points: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of left, or of left and right) whose bound reaches the threshold, over boxes of LEAF points packed by size and place."""

    def pack(rows: np.ndarray) -> list[np.ndarray]:
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        out = []
        for i in range(0, len(rows), LEAF * 16):  # slabs of like size, then along the widest coordinates
            slab = rows[i : i + LEAF * 16]
            if len(slab) > LEAF:
                wide = np.argsort(points[slab].var(axis=0))[-2:]
                slab = slab[np.lexsort((points[slab][:, wide[0]], points[slab][:, wide[1]] // 2))]
            out += [slab[j : j + LEAF] for j in range(0, len(slab), LEAF)]
        return out

    if right is None and len(left) <= LEAF // 4:  # one leaf has nothing to prune
        u, v = np.triu_indices(len(left), 1)
        u, v = left[u], left[v]
        near = np.minimum(points[u], points[v]).sum(axis=1) >= needed(sizes[u], sizes[v])
        return u[near], v[near]
    a = pack(left)
    b = a if right is None else pack(right)
    if not a or not b:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    high = lambda leaves: np.array([points[x].max(axis=0) for x in leaves])
    low_n = lambda leaves: np.array([sizes[x].min() for x in leaves])
    high_a, high_b, n_a, n_b = high(a), high(b), low_n(a), low_n(b)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, x in enumerate(a):
        box = np.minimum(high_a[i], high_b).sum(axis=1) >= needed(n_a[i], n_b)
        for j in np.flatnonzero(box):
            if right is None and j < i:
                continue
            y = b[j]
            bound = np.zeros((len(x), len(y)), np.uint32)
            for g in range(points.shape[1]):
                bound += np.minimum.outer(points[x, g], points[y, g])
            hit = bound >= needed(sizes[x][:, None], sizes[y][None, :])
            if right is None and i == j:
                hit = np.triu(hit, 1)
            u, v = np.nonzero(hit)
            us.append(x[u])
            vs.append(y[v])
    return np.concatenate(us), np.concatenate(vs)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def set_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """(doc_id, n_shingles, key): key is a 64-bit hash of the set, null for an empty one; equal sets have equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            sets = list(shingle_sets(batch.column("text"), n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n_shingles", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(freeing(run), f"doc_id {kind}, n_shingles long, key long")


def _often(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """COUNTERS counts of the sets whose hashes fall on each; a set that a task meets again counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(COUNTERS, np.int64), set()
        for batch in cut(batches, "text"):
            for grams in shingle_sets(batch.column("text"), n):
                if len(grams) > 2 and (key := _key(grams)) not in seen:
                    seen.add(key)
                    np.add.at(counts, _place(grams), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["place", "times"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(freeing(run), "place long, times long")
    table = counted.groupBy("place").agg(F.sum("times").alias("times")).toArrow()  # COUNTERS rows at most
    often = np.zeros(COUNTERS, np.int64)
    often[table.column("place").to_numpy()] = table.column("times").to_numpy()
    return often


def _signatures(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """(sig, key) of every set; a set that a task meets again is not repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(_often(docs, text_col, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in cut(batches, "text"):
            sigs, keys = [], []
            for grams in shingle_sets(batch.column("text"), n):
                if len(grams) > 2 and (key := _key(grams)) not in seen:
                    seen.add(key)
                    sigs.append(_prefix(grams, shared.value))
                    keys.append(np.full(len(sigs[-1]), key, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(keys))], ["sig", "key"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(freeing(run), "sig long, key long")


def _sets_of(docs: DataFrame, keyed: DataFrame, keys: DataFrame, id_col: str, text_col: str, n: int, grams: bool) -> DataFrame:
    """(key, n, and point and rough, or grams) of the sets named in keys, made again from a text of each, as keyed (set_keys of docs) tells.

    A bitmap of fixed size (2**BITS bits) of the documents' ids says which texts to read; what it
    lets through besides is dropped by the join.
    """
    spark = docs.sparkSession
    holders = keyed.join(keys, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITS)).alias("p")
    rows = holders.select(place).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).collect()
    table = np.zeros(1 << (BITS - 6), np.int64)
    for w, bits in rows:
        table[w] = bits
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = shared.value.view(np.uint64), set()
        for batch in cut(batches, "text"):
            p = batch.column("p").to_numpy().astype(np.uint64)
            batch = batch.filter(pa.array(((bitmap[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)))
            out = []
            for own in shingle_sets(batch.column("text"), n):
                if len(own) > 2 and (key := _key(own)) not in seen:
                    seen.add(key)
                    out.append((key, own))
            if out:
                lengths = np.cumsum([0, *(len(g) for _, g in out)])
                if grams:
                    what = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([g for _, g in out]).view(np.int64)))
                else:
                    points = [point(g) for _, g in out]
                    what = pa.array([packed(x) for x in points], pa.binary())
                    rough = pa.array([packed(fold(x[None], rough_for(len(g)))[0]) for x, (_, g) in zip(points, out)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array(np.diff(lengths), pa.int64()), what, *([] if grams else [rough])], ["key", "n", *(["grams"] if grams else ["point", "rough"])])

    texts = _texts(docs, id_col, text_col).select(place, "text")
    sets = texts.mapInArrow(freeing(run), f"key long, n long, {'grams array<bigint>' if grams else 'point binary, rough binary'}")
    return written(sets.join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets")


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose points reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if m := batch.num_rows:
                n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                points = [unpacked(x, groups_for(k)) for p, n in (("p_a", n_a), ("p_b", n_b)) for x, k in zip(batch.column(p).to_pylist(), n.tolist())]
                bound = fine_bound(points, np.arange(m), np.arange(m, 2 * m))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(bound >= needed(n_a, n_b)))

    one, two = (points.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"p_{x}")) for x in "ab")
    rows = pairs.join(one, "a").join(two, "b")
    return rows.filter(f"least(n_a, n_b) * {WHOLE} >= greatest(n_a, n_b) * {PART}").mapInArrow(freeing(run), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, keyed: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(a, b, shared, n_a, n_b) of the pairs that meet the threshold on their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = []
            for x, y in zip(batch.column("g_a"), batch.column("g_b")):
                both = np.sort(np.concatenate([x.values.to_numpy(), y.values.to_numpy()]))
                shared.append(int(np.count_nonzero(both[1:] == both[:-1])))
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            s = np.array(shared, np.int64)
            rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s), batch.column("n_a"), batch.column("n_b")], ["a", "b", "shared", "n_a", "n_b"])
            yield rows.filter(pa.array(WHOLE * s >= PART * (n_a + n_b - s)))

    pairs = written(pairs, "pairs")
    sets = _sets_of(docs, keyed, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), id_col, text_col, n, grams=True)
    one = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("g_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(freeing(run), "a long, b long, shared long, n_a long, n_b long")


def _near_rows(batch: pa.RecordBatch, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of a batch of whole trees (each from a row of first on) the pairs of rows (u, v) of different parts that may reach the threshold, their tree, and the different sets' points, and which of these each row has.

    Trees of a leaf at most have nothing to prune by boxes; their pairs of like size are made all at once.
    """
    key, part, sizes, block = (batch.column(c).to_numpy() for c in ("key", "part", "n", "block"))
    counts = np.diff(np.append(first, batch.num_rows))
    tree = np.repeat(np.arange(len(first)), counts)
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    points = [unpacked(x, rough_for(k)) for x, k in zip(batch.column("rough").take(pa.array(one)).to_pylist(), sizes[one].tolist())]
    split = batch.column("i").to_numpy()[first] != batch.column("j").to_numpy()[first]
    whole = (counts > LEAF // 4) | split
    rows = np.arange(batch.num_rows)
    us, vs = [], []
    for step in range(1, LEAF // 4):
        u = rows[:-step]
        u = u[(tree[u] == tree[u + step]) & ~whole[tree[u]]]
        if not len(u):
            break
        us.append(u)
        vs.append(u + step)
    for t in np.flatnonzero(whole).tolist():
        own = rows[first[t] : first[t] + counts[t]]
        coarse = np.stack([fold(points[k][None], GROUPS)[0] for k in which[own]])
        if split[t]:
            low = block[own] == block[own].min()
            u, v = tree_join(coarse, sizes[own], np.flatnonzero(low), np.flatnonzero(~low))
        else:
            u, v = tree_join(coarse, sizes[own], np.arange(len(own)))
        us.append(own[u])
        vs.append(own[v])
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
    near = (part[u] != part[v]) & (WHOLE * np.minimum(sizes[u], sizes[v]) >= PART * np.maximum(sizes[u], sizes[v]))
    u, v = u[near], v[near]
    swap = key[u] > key[v]
    return np.where(swap, v, u), np.where(swap, u, v), tree[u], points, which


def _blocks(members: DataFrame) -> DataFrame:
    """The members with the block of their sig that they are in, and the number of blocks."""
    by = W.partitionBy("sig")
    return members.withColumn("block", ((F.row_number().over(by.orderBy("key")) - 1) / BLOCK).cast("int")).withColumn("blocks", F.max("block").over(by) + 1)


def _dealt(rows: DataFrame, *names: str) -> DataFrame:
    """(sig, i, j, block and the columns named): a row for each pair (i, j) of blocks that a member's is in."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *names)


def _tree_starts(batch: pa.RecordBatch) -> np.ndarray:
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for c in ("sig", "i", "j"):
        x = batch.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def partnered(first: np.ndarray, part: np.ndarray, sizes: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Which rows of whole trees (each from a row of first on) have one of another part in theirs with which the threshold can be reached, if they share no more hashes of first parts than each shares with any."""
    counts = np.diff(np.append(first, len(part)))
    tree, rows, out = np.repeat(np.arange(len(first)), counts), np.arange(len(part)), np.zeros(len(part), bool)

    def can(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        low, high = np.minimum(sizes[u], sizes[v]), np.maximum(sizes[u], sizes[v])
        return (part[u] != part[v]) & (WHOLE * low >= PART * high) & (np.minimum(total[u], total[v]) + after_prefix(high) >= needed(low, high))

    whole = counts > LEAF // 4
    for step in range(1, LEAF // 4):
        u = rows[:-step]
        u = u[(tree[u] == tree[u + step]) & ~whole[tree[u]]]
        if not len(u):
            break
        u = u[can(u, u + step)]
        out[u] = out[u + step] = True
    for t in np.flatnonzero(whole).tolist():
        own = rows[first[t] : first[t] + counts[t]]
        for i in range(0, len(own), LEAF):
            out[own[i : i + LEAF]] = can(own[i : i + LEAF, None], own[None]).any(axis=1)
    return out


def _with_partners(members: DataFrame, points: DataFrame) -> DataFrame:
    """The members (sig, key, part, times) that partnered() leaves. Two sets that can reach the threshold both stay in each tree that they have in common, so such a pair's trees are told as before."""
    rows = _blocks(members).join(points.select("key", "n"), "key").withColumn("total", F.sum("times").over(W.partitionBy("key")))
    names = ["sig", "key", "part", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in whole_runs(batches, _tree_starts):
            stay = partnered(first, *(batch.column(c).to_numpy() for c in ("part", "n", "total")))
            yield batch.select(names).filter(pa.array(stay))

    rows = _dealt(rows, "key", "part", "times", "n", "total").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return rows.mapInArrow(freeing(run), "sig long, key long, part long, times long").dropDuplicates(["sig", "key"])


def _tree_pairs(members: DataFrame, points: DataFrame, smallest: bool = False) -> DataFrame:
    """Pairs (a, b) of members (sig, key, part, times) of different parts that meet in a sig and whose bounds, by rough points and by common trees, reach the threshold; if smallest, of each b only the one with the smallest a in each tree.

    A pair that meets in several trees is made in the first, as far as its sets' NAMED trees tell. A
    sig with many members is dealt out in pairs of blocks, each a task's worth; points stay in numpy
    and go with the members alone that sizes and numbers of hashes leave a partner.
    """
    members = written(_with_partners(members, points), "members")
    rows = _dealt(_blocks(members), "key", "part")
    named = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("sig", F.col("times").cast("int").alias("times")))).alias("all"), F.sum("times").alias("total"))
    named = named.select("key", "total", F.slice("all", 1, NAMED).alias("all")).select("key", "total", F.col("all.sig").alias("trees"), F.col("all.times").alias("times"))
    rows = rows.join(points.select("key", "n", "rough").join(named, "key"), "key").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in whole_runs(batches, _tree_starts):
            u, v, tree, points, which = _near_rows(batch, first)
            if not len(u):
                continue
            key, sizes = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            own, one, counts = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), np.int64(len(points))
            own[which], one[which] = sizes, np.arange(batch.num_rows)
            pairs, back = np.unique(which[u] * counts + which[v], return_inverse=True)  # a pair may meet in many trees
            x, y = pairs // counts, pairs % counts
            close = np.flatnonzero(fine_bound(points, x, y) >= needed(own[x], own[y]))
            if not len(close):
                continue
            ends, which_end = np.unique(np.concatenate([x[close], y[close]]), return_inverse=True)
            rows = batch.select(["trees", "times", "total"]).take(pa.array(one[ends]))
            named, times = ([np.asarray(k.values, np.int64) for k in rows.column(c)] for c in ("trees", "times"))
            most, tree_of, sure = common_trees(named, times, rows.column("total").to_numpy(), which_end[: len(close)], which_end[len(close) :])
            near = most + np.maximum(after_prefix(own[x[close]]), after_prefix(own[y[close]])) >= needed(own[x[close]], own[y[close]])
            good, only, at = np.zeros(len(pairs), bool), np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
            good[close], only[close], at[close] = near, sure, tree_of
            rows = np.flatnonzero(good[back] & (~only[back] | (at[back] == batch.column("sig").to_numpy()[first][tree])))
            if smallest:
                order = rows[np.lexsort((key[u[rows]], key[v[rows]], tree[rows]))]
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(tree[order]) != 0) | (np.diff(key[v[order]]) != 0)
                rows = order[new]
            rows = rows[np.unique(back[rows], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(key[u[rows]]), pa.array(key[v[rows]])], ["a", "b"])

    columns = ["sig", "i", "j", "block", "key", "part", "n", "rough", "trees", "times", "total"]
    return rows.select(*columns).mapInArrow(freeing(run), "a long, b long").distinct()


def _shared_keys(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """(sig, key, lo, times): the groups of sets that a key of the forest joins, with their smallest set. Keys that the same sets share are one tree: sig is a hash of the sets, times how many keys it stands for."""
    by, mixed = W.partitionBy("sig"), F.xxhash64("key")
    rows = _signatures(docs, text_col, n).repartition("sig").withColumns({"lo": F.min("key").over(by), "hi": F.max("key").over(by)}).filter("lo <> hi")
    rows = rows.dropDuplicates(["sig", "key"])
    halves = {"x": F.sum(F.shiftrightunsigned(mixed, 32)).over(by), "y": F.sum(mixed.bitwiseAND(0xFFFFFFFF)).over(by), "sets": F.count("*").over(by)}
    same = rows.withColumns(halves).select(F.xxhash64("x", "y", "sets").alias("sig"), "key", "lo")
    return written(same.groupBy("sig", "key", "lo").agg(F.count("*").alias("times")), "shared")


def ngram_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """Every linked pair of different sets: (a, b, shared, n_a, n_b), a and b keys of set_keys. For corpora whose groups are small; ngram_groups needs no pairs within a group."""
    keyed = written(set_keys(docs, id_col, text_col, n), "keys")
    shared = _shared_keys(docs, text_col, n)
    points = _sets_of(docs, keyed, shared.select("key").distinct(), id_col, text_col, n, grams=False)
    return _verified(_bounded(_tree_pairs(shared.select("sig", "key", F.col("key").alias("part"), "times"), points), points), docs, keyed, id_col, text_col, n)


def _grouped(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """ngram_groups with key, the set's, and root, a key of the component; both null for a document without words."""
    keyed = written(set_keys(docs, id_col, text_col, n), "keys")
    shared = _shared_keys(docs, text_col, n)
    points = _sets_of(docs, keyed, shared.select("key").distinct(), id_col, text_col, n, grams=False)
    stars = shared.filter("key <> lo").groupBy("key", "lo").agg(F.sum("times").alias("times"))
    best = stars.groupBy("key").agg(F.max(F.struct("times", "lo")).alias("best")).select(F.col("best.lo").alias("a"), F.col("key").alias("b"))
    edges = written(_verified(_bounded(best, points), docs, keyed, id_col, text_col, n).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    roots = written(components(edges), "roots")
    by = W.partitionBy("sig")
    links, smallest, last = edges.count(), True, False
    while not last:
        last = not smallest
        parts = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").select("sig", "key", F.coalesce("root", "key").alias("part"), "times")
        open_keys = parts.withColumns({"p": F.min("part").over(by), "q": F.max("part").over(by)}).filter("p <> q").select("sig", "key", "part", "times")
        found = _bounded(written(_tree_pairs(open_keys, points, smallest), "found"), points)
        if smallest:  # over all trees, two partners a set
            ends = found.groupBy("b").agg(F.min("a").alias("x"), F.max("a").alias("y"))
            found = ends.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "b")
        more = written(_verified(found, docs, keyed, id_col, text_col, n).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        if new := more.count():
            edges = edges.unionByName(more)
            roots = written(components(edges), "roots")
        smallest, links = new > links, links + new
    least = keyed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    own = least.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "root", "component_id")
    return keyed.join(named, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "key", "root")


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, the smallest id that links of similarity >= 0.75 reach.

    Null, empty and blank texts have no set and stand alone; a null id can only be the component
    of a group without any other. Rows that repeat an id stand for themselves. An empty table
    gives an empty one; other columns are left out.

    First each set is verified against one other, the smallest of the keys it shares most often;
    that makes components without pairs within a group. Then only sets of different components
    that still share a key go through the R-trees; their verified pairs join components. The first
    round of trees gives each set its smallest partner in each tree, and two of those at most go
    on, so that a group of near copies grows together without its pairs; such a round follows as long as one doubles
    the links. The last gives every pair of sets that are still apart. Equal
    sets are one set (its 64-bit hash; the 5-grams are 64-bit hashes too).
    """
    return _grouped(docs, id_col, text_col, n).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, of each group the one with the smallest id. Rows without an id or without words stay.

    Texts that stand under one id are told apart by their sets: those of different groups are
    documents of their own, and of rows with the same id and set the one with the smallest text
    stays. An empty table gives an empty one.
    """
    groups = written(_grouped(docs, id_col, text_col, N).filter("doc_id is not null and key is not null").select("doc_id", "key", "root"), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    gone = groups.join(first, "root").filter("first.doc_id <> doc_id or first.key <> key").select("doc_id", "key").distinct()
    twice = written(groups.groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1").select("doc_id"), "twice")
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))  # so that no column's name can clash
    kept = own.join(gone.join(twice, "doc_id", "left_anti").select("doc_id").distinct().unionByName(twice), "doc_id", "left_anti").select("own.*")
    if twice.isEmpty():
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            keys = [_key(s) if len(s) else None for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("doc_id"), batch.column("text"), pa.array(keys, pa.int64())], ["own", "doc_id", "text", "key"])

    some = own.join(twice, "doc_id", "left_semi").select("own", "doc_id", "text")
    some = some.mapInArrow(freeing(run), StructType([*some.schema.fields, StructField("key", LongType())]))
    rank = F.row_number().over(W.partitionBy("doc_id", "key").orderBy("text"))
    some = some.join(gone, ["doc_id", "key"], "left_anti").withColumn("rank", rank).filter("rank = 1 or key is null")
    return kept.unionByName(some.select("own.*"))
