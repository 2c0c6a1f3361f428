"""Passages that documents share, exactly or nearly, by collinear chaining.

Seeds are word 6-grams picked by winnowing: of any 10 in a row the one with the smallest hash, so
that equal passages of 15 words have equal seeds. Each seed is joined to its first holder (the
smallest document with it). The seeds of one passage may have several first holders, none with the
whole of it, so every run of MIN_WORDS words whose seeds are all shared is joined to the smallest
document with that run, too, and where the seeds' holders change on the way, the document is matched with the
first one in which those holders meet as far from each other. Per document and holder the matches are chained in order with a
cost for gaps, through a tree of the largest scores that near enough matches have (they leave it again,
which a Fenwick tree can't do), and the chains are aligned word by word, on to where the texts part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import _STEP, buffers, cut, freeing, mix, sequences, small_batches, word_starts, words, written

K, WINDOW, MIN_WORDS, MIN_IDENTITY = 6, 10, 50, 0.75
GAP_COST, MAX_GAP, MARGIN, DROP, BAND = 0.2, 40, 64, 8, 6
BITS = 24
#: Words between seeds of different holders that may belong to one passage; holders further on that are looked at; words that what was put in or left out may move them by.
SEAM, FURTHER, SHIFT = 64, 3, 32


def seeds(texts: pa.Array, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place (in words of its text) and text of each seed."""
    data, offsets = buffers(texts)
    _, hashes, first = words(data, offsets)
    grams, _ = sequences(hashes, first, k)
    _, inside = sequences(hashes, first, k + window - 1)
    small = (grams >> np.uint64(32)).astype(np.uint32)
    n = len(small)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, have = small, 1
    while have < window:
        step = min(have, window - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    least = np.where(inside[: len(least)], least, np.uint32(0))
    most = np.concatenate([np.zeros(window - 1, np.uint32), least, np.zeros(window - 1, np.uint32)])
    have = 1
    while have < window:
        step = min(have, window - have)
        most = np.maximum(most[:-step], most[step:])
        have += step
    at = np.flatnonzero((most[:n] == small) & (most[:n] > 0))
    of = np.searchsorted(first, at, "right") - 1
    return grams[at].view(np.int64), at - first[of], of


class Tree:
    """Largest value of a range of places, each of which holds one value or none."""

    def __init__(self, n: int):
        self.n, self.best = n, [(-1e18, -1)] * (2 * n)

    def put(self, i: int, value: tuple[float, int] = (-1e18, -1)) -> None:
        i += self.n
        self.best[i] = value
        while i > 1:
            i //= 2
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def top(self, i: int, j: int) -> tuple[float, int]:
        """Of places i to j - 1."""
        out, i, j = (-1e18, -1), i + self.n, j + self.n
        while i < j:
            if i & 1:
                out = max(out, self.best[i])
                i += 1
            if j & 1:
                j -= 1
                out = max(out, self.best[j])
            i, j = i // 2, j // 2
        return out


def runs(at: np.ndarray, ref: np.ndarray, size: np.ndarray, apart: int = WINDOW, group: np.ndarray | None = None) -> np.ndarray:
    """Matches of size words (of one document and holder, or of many groups, numbered in order) on one diagonal, at most apart words after the last one's end, as one: rows (start, holder's start, words, with group its number)."""
    of = np.zeros(len(at), np.int64) if group is None else group
    order = np.lexsort((at, at - ref, of))
    at, ref, size, of = at[order], ref[order], size[order], of[order]
    line = np.concatenate([[0], np.cumsum((np.diff(at - ref) != 0) | (np.diff(of) != 0))]) << 32
    far = np.maximum.accumulate(line + at + size)
    new = np.ones(len(at), bool)
    new[1:] = line[1:] + at[1:] > far[:-1] + apart
    begins = np.flatnonzero(new)
    ends = np.concatenate([begins[1:], [len(at)]]) - 1
    out = np.stack([at[begins], ref[begins], far[ends] - line[ends] - at[begins]], 1)
    return out if group is None else np.column_stack([out, of[begins]])


def chains(segments: np.ndarray, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[tuple[int, int, int]]]:
    """Best-scoring chains of segments (start, holder's start, words) that go forward in both texts, each segment in one chain.

    A chain's score is its words less gap_cost for each word of a gap in either text; a gap of
    more than max_gap words ends it.
    """
    rows = segments[np.lexsort((segments[:, 1], segments[:, 0]))].tolist()
    if len(rows) == 1:
        return [[tuple(rows[0])]]
    by_ref = sorted(range(len(rows)), key=lambda i: rows[i][1] + rows[i][2])
    rank = {i: place for place, i in enumerate(by_ref)}
    ends, starts = [rows[i][1] + rows[i][2] for i in by_ref], [r for _, r, _ in rows]
    low = np.searchsorted(ends, [r - max_gap for r in starts], "left").tolist()
    high = np.searchsorted(ends, [r + K // 2 for r in starts], "right").tolist()  # seeds may overlap a little
    score, before = [0.0] * len(rows), [-1] * len(rows)
    tree, waiting, done, over = Tree(len(rows)), sorted(range(len(rows)), key=lambda i: rows[i][0] + rows[i][2]), 0, 0
    for j, (p, r, n) in enumerate(rows):
        while done < len(waiting) and (i := waiting[done]) is not None and rows[i][0] + rows[i][2] <= p + K // 2 and i < j:
            end_p, end_r = rows[i][0] + rows[i][2], rows[i][1] + rows[i][2]
            tree.put(rank[i], (score[i] + gap_cost * (end_p + end_r), i))
            done += 1
        while over < done and rows[i := waiting[over]][0] + rows[i][2] < p - max_gap:  # too far from all that follow
            tree.put(rank[i])
            over += 1
        value, i = tree.top(low[j], high[j])
        joined = value - gap_cost * (p + r)
        score[j] = n + max(0.0, joined)
        if i >= 0 and joined > 0:
            before[j] = i
    out, used = [], [False] * len(rows)
    for j in sorted(range(len(rows)), key=lambda j: -score[j]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(tuple(rows[j]))
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


def _edit_matches(a: np.ndarray, b: np.ndarray) -> int:
    """Words that an alignment of two short runs has in common."""
    if not len(a) or not len(b):
        return 0
    if len(a) == 1 or len(b) == 1:
        return int(len(np.intersect1d(a, b)) > 0) if len(a) * len(b) > 1 else int(a[0] == b[0])
    if len(a) * len(b) > 64:
        a, b, total = *sorted((a, b), key=len), np.zeros(max(len(a), len(b)) + 1, np.int64)
        for x in a:
            total[1:] = np.maximum.accumulate(np.maximum(total[1:], total[:-1] + (b == x)))
        return int(total[-1])
    row = [0] * (len(b) + 1)
    for x in a.tolist():
        new = [0]
        for j, y in enumerate(b.tolist()):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two runs go on alike from their start (a mismatch costs 2, given up after a fall of DROP), and the equal words up to there."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    fallen = np.flatnonzero(total < np.maximum.accumulate(np.maximum(total, 0)) - DROP)
    if len(fallen):
        total, same = total[: fallen[0]], same[: fallen[0]]
    if not len(total) or total.max() <= 0:
        return 0, 0
    far = int(total.argmax()) + 1
    return far, int(same[:far].sum())


def _extend_over_gaps(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far two runs go on alike from their start, in a and in b, and the equal words up to there, words put in or left out included: a word that is changed or missing costs 1, BAND of them one way at most, given up after a fall of DROP or MARGIN words."""
    shifts = np.arange(-BAND, BAND + 1)
    one = 1 << 20  # a score in units of one, and below it the equal words
    value = np.where(shifts < 0, -(1 << 50), -one * shifts)
    best = (0, 0, 0)
    for i in range(1, min(len(a), MARGIN) + 1):
        j = i + shifts
        inside = (j >= 1) & (j <= len(b))
        same = np.zeros(len(j), bool)
        same[inside] = b[j[inside] - 1] == a[i - 1]
        value = np.maximum(value + np.where(same, one + 1, -one), np.append(value[1:], -(1 << 50)) - one)
        value = np.where((j >= 0) & (j <= len(b)), value, -(1 << 50))
        value = np.maximum.accumulate(value + one * shifts) - one * shifts
        k = int(value.argmax())
        if value[k] > best[0]:
            best = int(value[k]), i, i + int(shifts[k])
        if value[k] < best[0] - DROP * one:
            break
    return best[1], best[2], best[0] & (one - 1)


def _reaches(a: np.ndarray, a_at: np.ndarray, a_left: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_left: np.ndarray, step: int) -> np.ndarray:
    """_extend_over_gaps for many places at once, a row each: from a_at and b_at on, forwards or backwards, where a_left and b_left words follow."""
    shifts = np.arange(-BAND, BAND + 1, dtype=np.int32)[:, None]
    one, none = np.int32(1 << 10), np.int32(-(1 << 28))  # MARGIN words at most: below one there is room for the equal ones
    slope = one * shifts
    beside = np.lib.stride_tricks.sliding_window_view(np.pad(b, MARGIN + 2 * BAND), 2 * BAND + 1)[:, ::step]  # of each place the words up to BAND away
    value = np.repeat(np.where(shifts < 0, none, -slope), len(a_at), 1)
    best, out, live = np.zeros(len(a_at), np.int32), np.zeros((len(a_at), 3), np.int64), np.arange(len(a_at))
    for i in range(1, MARGIN + 1):
        on = a_left[live] >= i
        if not on.all():
            live, value = live[on], value[:, on]
        if not len(live):
            break
        j, n = i + shifts, b_left[live]
        same = (beside[b_at[live] + (step * (i - 1) + MARGIN + BAND)] == a[a_at[live] + step * (i - 1)][:, None]).T
        same &= (j >= 1) & (j <= n)
        straight = value + np.where(same, one + np.int32(1), -one)
        straight[:-1] = np.maximum(straight[:-1], value[1:] - one)
        value = np.where((j >= 0) & (j <= n), straight, none)
        value = np.maximum.accumulate(value + slope, 0) - slope
        k = value.argmax(0)
        top = value[k, np.arange(len(live))]
        more = top > best[live]
        best[live[more]] = top[more]
        out[live[more]] = np.stack([np.full(int(more.sum()), i), i + shifts[k[more], 0], top[more] & (one - 1)], 1)
        on = top >= best[live] - DROP * one
        if not on.all():
            live, value = live[on], value[:, on]
    return out


def _extended(a: pa.ListArray, b: pa.ListArray, begins: np.ndarray, ends: np.ndarray, b_begins: np.ndarray, b_ends: np.ndarray, least: int) -> np.ndarray:
    """How far what is alike goes on over gaps after and before chains of fewer than least words that begin and end at these places of the lists."""
    (x, x0), (y, y0) = ((c.values.to_numpy(), c.offsets.to_numpy().astype(np.int64)) for c in (a, b))
    if not len(x) or not len(y):
        return np.zeros((2, len(begins), 3), np.int64)
    out = np.zeros((2, len(begins), 3), np.int64)
    some = np.flatnonzero(ends - begins < least)  # none of the others is looked at
    begins, ends, b_begins, b_ends = (c[some] for c in (begins, ends, b_begins, b_ends))
    x0, x_n, y0, y_n = x0[:-1][some], np.diff(x0)[some], y0[:-1][some], np.diff(y0)[some]
    out[0, some] = _reaches(x, x0 + ends, x_n - ends, y, y0 + b_ends, y_n - b_ends, 1)
    out[1, some] = _reaches(x, x0 + begins - 1, begins, y, y0 + b_begins - 1, b_begins, -1)
    return out


def _ahead(a: np.ndarray, a_at: np.ndarray, a_left: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_left: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """_extend for many places at once, as _reaches; MARGIN words follow at most."""
    i, n = np.arange(MARGIN)[:, None], np.minimum(np.minimum(a_left, b_left), MARGIN)
    same = (a[np.clip(a_at + step * i, 0, len(a) - 1)] == b[np.clip(b_at + step * i, 0, len(b) - 1)]) & (i < n)
    total = np.cumsum(np.where(same, 1, -2), 0, dtype=np.int16)
    fallen = (i >= n) | (total < np.maximum.accumulate(np.maximum(total, 0), 0) - DROP)
    total[np.logical_or.accumulate(fallen, 0)] = -1
    far, rows = total.argmax(0), np.arange(len(n))
    far = np.where(total[far, rows] > 0, far + 1, 0)
    return far, (same & (i < far)).sum(0)


def _straight(a: pa.ListArray, b: pa.ListArray, p: np.ndarray, r: np.ndarray, n: np.ndarray, after: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """align for many chains of one segment (p, r, n), a row each, with how far they go on over gaps after and before them."""
    (x, x0), (y, y0) = ((c.values.to_numpy(), c.offsets.to_numpy().astype(np.int64)) for c in (a, b))
    p_left, r_left = np.diff(x0) - p - n, np.diff(y0) - r - n
    x_at, y_at, ends = x0[:-1] + p, y0[:-1] + r, np.cumsum(n)
    inside = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
    equal = x[inside + np.repeat(x_at, n)] == y[inside + np.repeat(y_at, n)]
    matches = np.diff(np.append(0, np.cumsum(equal))[np.append(0, ends)])
    more, equal = _ahead(x, x_at + n, p_left, y, y_at + n, r_left, 1)
    back, equal_back = _ahead(x, x_at - 1, p, y, y_at - 1, r, -1)
    short = n + more + back < least
    more_b, back_b = (np.where(short, far[:, 1], m) for far, m in ((after, more), (before, back)))
    more, back = (np.where(short, far[:, 0], m) for far, m in ((after, more), (before, back)))
    same = matches + np.where(short, after[:, 2], equal) + np.where(short, before[:, 2], equal_back)
    return p - back, p + n + more, r - back_b, r + n + more_b, same


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]], least: int = 0, over_gaps: tuple | None = None) -> tuple[int, int, int, int, int]:
    """Start and end in a and in b, and equal words, of a chain (places in a and b) with its gaps aligned and its ends extended, over gaps where it has fewer than least words otherwise; over_gaps is how far after and before it, where that is known."""
    p, r, n = chain[0]
    matches, start_a, start_b = 0, p, r
    at, ref = p, r
    for p, r, n in chain:
        skip = max(0, at - p, ref - r)
        matches += _edit_matches(a[at : p + skip], b[ref : r + skip])
        at, ref = p + n, r + n
        x, y = a[p + skip : at], b[r + skip : ref]
        m = min(len(x), len(y))
        matches += int((x[:m] == y[:m]).sum())
    more, equal = _extend(a[at:], b[ref:])
    back, equal_back = _extend(a[:start_a][::-1], b[:start_b][::-1])
    if at + more - start_a + back < least:
        over_gaps = over_gaps or (_extend_over_gaps(a[at:], b[ref:]), _extend_over_gaps(a[:start_a][::-1], b[:start_b][::-1]))
        (more, more_b, equal), (back, back_b, equal_back) = over_gaps
        return start_a - back, at + more, start_b - back_b, ref + more_b, matches + equal + equal_back
    return start_a - back, at + more, start_b - back, ref + more, matches + equal + equal_back


def passages(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]], least: int, identity: float, over_gaps: tuple | None = None) -> list[tuple[int, int, int, int, int]]:
    """As align, of a chain's passages of least words and the identity: the whole chain, else what is left when it is parted at its widest gap, else the best parts of a segment."""
    s, e, rs, re, same = align(a, b, chain, least, over_gaps)
    if same >= identity * max(e - s, re - rs):
        return [(s, e, rs, re, same)] if e - s >= least else []
    if len(chain) > 1:
        gaps = [max(q - p - n, u - r - n) for (p, r, n), (q, u, _) in zip(chain, chain[1:])]
        at = 1 + gaps.index(max(gaps))
        return passages(a, b, chain[:at], least, identity) + passages(a, b, chain[at:], least, identity)
    p, r, n = chain[0]
    back, more = min(p, r), min(len(a) - p, len(b) - r)
    return [(p + i, p + j, r + i, r + j, same) for i, j, same in _alike(a[p - back : p + more] == b[r - back : r + more], -back, least, identity)]


def _alike(same: np.ndarray, start: int, least: int, identity: float) -> list[tuple[int, int, int]]:
    """Start, end and equal words of parts of least words and the identity; a run of least equal words is always in one."""
    todo, out = [(0, len(same))], []
    while todo:
        i, j = todo.pop()
        if j - i < least:
            continue
        total = np.concatenate([[0.0], np.cumsum(np.where(same[i:j], 1.0, -identity / max(1 - identity, 1e-9)))])
        rise = total - np.minimum.accumulate(total)
        to = int(rise.argmax())
        at = int(total[: to + 1].argmin())
        if to == at:
            continue
        if to - at >= least:
            out.append((start + i + at, start + i + to, int(same[i + at : i + to].sum())))
        todo += [(i, i + at), (i + to, j)]
    return sorted(out)


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first of them (by in number), never parted within a group."""
    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            now = [np.concatenate([x, y]) for x, y in zip(held, now)]
        if not len(now[0]):
            continue
        keep = int(np.argmax(np.logical_and.reduce([x == x[-1] for x in now[:by]])))  # the last group may go on in the next batch
        if keep:
            yield [x[:keep] for x in now]
        held = [x[keep:] for x in now]
    if held is not None:
        yield held


def _areas(shared: DataFrame, least: int) -> DataFrame:
    """(id, areas) from the shared seeds (id, pos): the first and last word, in turn, at which least words that another document has may start.

    Each WINDOW seeds' places within such words have a shared one: the first of them lies at most
    WINDOW - 1 words after the start, the last one at most K + WINDOW - 1 before the end, and no two
    that follow one another are more than WINDOW words apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, pos in _grouped(batches, ["id", "pos"], 1):
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(pos) > WINDOW)]))
            ends = np.concatenate([begins[1:], [len(ids)]]) - 1
            spans = np.stack([pos[begins] - WINDOW + 1, pos[ends] - (least - K - WINDOW + 1)], 1)
            good = spans[:, 0] <= spans[:, 1]
            of, spans = ids[begins][good], spans[good]
            if len(of):
                heads = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0]))
                yield pa.RecordBatch.from_arrays([pa.array(of[heads]), pa.ListArray.from_arrays(pa.array(2 * np.append(heads, len(of)), pa.int32()), pa.array(spans.ravel()))], ["id", "areas"])

    return shared.repartition("id").sortWithinPartitions("id", "pos").mapInArrow(freeing(run), "id long, areas array<bigint>")


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, as far as there are n."""
    step = lambda k: np.uint64(pow(_STEP, 3 * k, 2**64))
    out, have, part, size = None, 0, hashes.astype(np.uint64), 1
    while True:
        if n & size:
            m = len(hashes) - have - size + 1
            out = part[:m] if out is None else out[:m] + part[have : have + m] * step(have)
            have += size
        if have == n:
            return mix(out)
        m = len(part) - size
        part, size = part[:m] + part[size:] * step(size), 2 * size


def _whole(own: DataFrame, least: int) -> DataFrame:
    """(doc_id, ref_id, pos, ref_pos) of each least words of an area (own: id, words, areas) that a smaller document has, with the smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, i = batch.column("words").offsets.to_numpy(), 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 19), "right")) - 1)
                ids, lists, areas = (batch.slice(i, j - i).column(c) for c in ("id", "words", "areas"))
                i = j
                first, ends = lists.offsets.to_numpy().astype(np.int64), areas.offsets.to_numpy()
                values = lists.values.to_numpy()[first[0] : first[-1]].view(np.uint32)
                first = first - first[0]
                if len(values) < least:
                    continue
                spans = areas.values.to_numpy()[ends[0] : ends[-1]].reshape(-1, 2)
                of = np.repeat(np.arange(len(ids)), np.diff(ends) // 2)
                low, high = first[of] + np.maximum(spans[:, 0], 0), np.minimum(first[of] + spans[:, 1], first[of + 1] - least) + 1
                good = low < high
                turns = np.zeros(len(values) + 1, np.int64)
                np.add.at(turns, low[good], 1)
                np.add.at(turns, high[good], -1)
                at = np.flatnonzero(np.cumsum(turns) > 0)
                of = np.searchsorted(first, at, "right") - 1
                hashes = windows(values, least)[at].view(np.int64)
                heads = np.zeros(len(at), bool)
                heads[_first_of_each(of, hashes)] = True
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids.to_numpy()[of]), pa.array(at - first[of]), pa.array(heads)], ["seed", "id", "pos", "head"])

    found = own.mapInArrow(freeing(run), "seed long, id long, pos long, head boolean")
    return found.join(_first_holders(found), "seed").filter("id <> ref_id").select(F.col("id").alias("doc_id"), "ref_id", "pos", "ref_pos")


def _first_holders(found: DataFrame) -> DataFrame:
    """(seed, ref_pos, ref_id) of the seeds that several ids have."""
    first = found.groupBy("seed").agg(F.min_by("pos", F.expr("if(head, id, null)")).alias("ref_pos"), F.min("id").alias("ref_id"), F.max("id").alias("last_id"))
    return first.filter("ref_id < last_id").drop("last_id")


def _loose(shared: DataFrame, least: int) -> DataFrame:
    """(id, pos, one, other, apart) of two sorts: seeds that lie in no stretch of least words with one holder (apart null, one and other the holder's id and place), and seams, where two such holders follow each other (pos null, apart what lies between, measured in the holders' places).

    The parts of a passage may have first holders of their own, of which none has enough of it. What a document holds
    first itself is passed over. Distances are the same if one of two rows of SHIFT words, half of it apart, has both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "pos", "one", "other", "apart"]
        for ids, pos, ref, at in _grouped(batches, ["id", "pos", "ref_id", "ref_pos"], 1):
            row = (at - pos) // SHIFT
            order = np.lexsort((pos, row, ref, ids))
            new = np.ones(len(ids), bool)
            new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (ids, ref, row)]) | (np.diff(pos[order]) > SEAM)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(ids)) - 1
            short = np.zeros(len(ids), bool)
            short[order] = np.repeat(pos[order][tails] + K - pos[order][heads] < least, tails - heads + 1)
            short &= ids != ref
            ids, pos, ref, at = ids[short], pos[short], ref[short], at[short]
            if not len(ids):
                continue
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (ids, pos, ref, at)), pa.nulls(len(ids), pa.int64())], names)
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(ref) != 0)]))
            ends = np.concatenate([begins[1:], [len(ids)]]) - 1
            for step in range(1, FURTHER + 1):
                a, b = ends[:-step], begins[step:]
                near = (ids[a] == ids[b]) & (ref[a] != ref[b]) & (pos[b] - pos[a] <= SEAM)
                a, b = a[near], b[near]
                if len(a):
                    apart = (at[b] - pos[b]) - (at[a] - pos[a])
                    rows = np.concatenate([2 * (apart // SHIFT), 2 * ((apart + SHIFT // 2) // SHIFT) + 1])
                    twice = [pa.array(np.tile(x, 2)) for x in (ids[a], ref[a], ref[b])]
                    yield pa.RecordBatch.from_arrays([twice[0], pa.nulls(len(rows), pa.int64()), *twice[1:], pa.array(rows)], names)

    rows = shared.select("id", "pos", "ref_id", "ref_pos").repartition("id").sortWithinPartitions("id", "pos")
    return rows.mapInArrow(freeing(run), "id long, pos long, one long, other long, apart long")


def _met(loose: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, ref_id, pos, ref_pos): the loose seeds that a document has in common with the smallest one that has a seam of it, too. A seed is known by its first holder's place.

    A pair of documents is one row with the seeds of both, not a row a seed.
    """
    key = ["one", "other", "apart"]
    seams = loose.filter("apart is not null").select("id", *key).distinct()
    first = seams.groupBy(*key).agg(F.min("id").alias("ref_id"), F.max("id").alias("last_id")).filter("ref_id < last_id").drop("last_id")
    pairs = written(seams.join(first, key).filter("id <> ref_id").select("id", "ref_id").distinct(), "pairs")
    listed = lambda rows, by, name: rows.join(pairs.select(by).distinct(), by, "left_semi").groupBy(by).agg(F.collect_list(F.struct("one", "other", "pos")).alias(name))
    own = listed(loose.filter("apart is null"), "id", "own")
    held = listed(shared.filter("head").select(F.col("id").alias("ref_id"), F.col("ref_id").alias("one"), F.col("ref_pos").alias("other"), "pos"), "ref_id", "held")
    names = [f"{side}_{c}" for side in ("held", "own") for c in ("one", "other", "pos")]
    rows = pairs.join(own, "id").join(held, "ref_id").select("id", "ref_id", *(F.col(n.replace("_", ".")).alias(n) for n in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, at, ref_at = _in_common(batch, names)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(pair)), batch.column("ref_id").take(pa.array(pair)), pa.array(at), pa.array(ref_at)], ["doc_id", "ref_id", "pos", "ref_pos"])

    with small_batches(loose.sparkSession, 100):  # a row has the seeds of two documents
        return written(rows.mapInArrow(freeing(run), "doc_id long, ref_id long, pos long, ref_pos long"), "met")


def _in_common(rows: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seeds (one, other, pos) of each row's own list that its held list has, too: row, and places in both."""
    sides = []
    for some in (names[:3], names[3:]):
        lists = [rows.column(c) for c in some]
        of = np.repeat(np.arange(rows.num_rows), np.diff(lists[0].offsets.to_numpy()))
        sides.append([of, *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)])
    of, one, other, pos = (np.concatenate(x) for x in zip(*sides))
    is_own = np.arange(len(of)) >= len(sides[0][0])
    order = np.lexsort((is_own, other, one, of))
    last = np.maximum.accumulate(np.where(is_own[order], -1, np.arange(len(order))))  # the held one before, if any
    mine = np.flatnonzero(is_own[order] & (last >= 0))
    x, y = order[mine], order[last[mine]]
    same = (of[x] == of[y]) & (one[x] == one[y]) & (other[x] == other[y])
    x, y = x[same], y[same]
    return of[x], pos[x], pos[y]


def _chained(anchors: DataFrame) -> DataFrame:
    """(doc_id, ref_id, p0, p1, r0, r1, chain) of all chains, those of one seed among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(doc, ref, p, r, size):
            order = np.lexsort((size, r, p, ref, doc))
            doc, ref, p, r, size = (x[order] for x in (doc, ref, p, r, size))
            other = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(ref) != 0) | (np.diff(p) != 0) | (np.diff(r) != 0) | (np.diff(size) != 0)])
            doc, ref, p, r, size = (x[other] for x in (doc, ref, p, r, size))  # a match may have been found twice
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(ref) != 0)]))
            doc, ref, group = doc[heads], ref[heads], np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(doc))))
            found = runs(p, r, size, group=group)
            segments, bounds = found[:, :3], np.searchsorted(found[:, 3], np.arange(len(heads) + 1))
            names = ["doc_id", "ref_id", "p0", "p1", "r0", "r1", "chain"]
            alone = np.flatnonzero(np.diff(bounds) == 1)
            if len(alone):  # a group's only segment is its chain
                one = np.ascontiguousarray(segments[bounds[alone]])
                (p, r, n), offsets = one.T, pa.array(np.arange(len(one) + 1) * 3, pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (doc[alone], ref[alone], p, p + n, r, r + n)), pa.ListArray.from_arrays(offsets, pa.array(one.ravel()))], names)
            out = []
            for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
                for chain in chains(segments[bounds[i] : bounds[i + 1]]):
                    (p0, r0, _), (p1, r1, n) = chain[0], chain[-1]
                    out.append((doc[i], ref[i], p0, p1 + n, r0, r1 + n, [x for s in chain for x in s]))
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.array(c, np.int64)) for c in list(zip(*out))[:6]), pa.array([o[6] for o in out], pa.list_(pa.int64()))], names)

        for columns in _grouped(batches, ["doc_id", "ref_id", "pos", "ref_pos", "size"], 2):
            yield from flush(*columns)

    rows = anchors.repartition("doc_id", "ref_id").sortWithinPartitions("doc_id", "ref_id", "pos")
    return rows.mapInArrow(freeing(run), "doc_id long, ref_id long, p0 long, p1 long, r0 long, r1 long, chain array<bigint>")


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, words array<int>) of the documents wanted (one row an id), with wanted's columns: their words' hashes. A bitmap of 2**BITS bits says which to make; the join drops what else it lets through."""
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("id"), F.lit(1 << BITS))
    rows = wanted.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).collect()
    table = np.zeros(1 << (BITS - 6), np.int64)
    for w, bits in rows:
        table[w] = bits
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value.view(np.uint64)
        for batch in batches:
            p = batch.column("p").to_numpy()
            batch = batch.filter(pa.array((bitmap[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for part in cut([batch], "text"):
                _, hashes, first = words(*buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)))], ["id", "words"])

    rows = docs.filter("id is not null").withColumn("p", place).mapInArrow(freeing(run), "id long, words array<int>")
    return rows.join(wanted, "id").dropDuplicates(["id"])


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """Passages that a document shares with an earlier holder: doc_id, ref_doc_id, start_word, n_words, ref_start_word, ref_n_words, matches, identity.

    Words are runs between blanks, A-Z as a-z. identity: equal words in the alignment over the
    longer side's words. The holder is the smallest id with the seeds or with min_words equal words
    in a row, so a passage in thousands of documents gives a row for each but the first, never a
    pair for any two; each min_words words that a smaller id has are in a row. Repeats within
    one document are not reported. Null and short texts and null ids give no row. Rows that
    repeat an id and its text are one document; of an id's different texts the one with the smallest
    hash is looked at. An empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    several = written(_texts_of_one_id(base.select(F.col("id").alias("span_id"), F.xxhash64("text").alias("mark"))), "texts")
    if not several.isEmpty():  # ids with several texts: one is looked at
        base = base.join(several, F.col("id") == F.col("span_id"), "left").filter("mark is null or mark = xxhash64(text)").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            hashes, at, of = seeds(batch.column("text"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)[of].astype(np.int64)
            heads = np.zeros(len(of), bool)
            heads[_first_of_each(of, hashes)] = True
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids), pa.array(at), pa.array(heads)], ["seed", "id", "pos", "head"])

    occurrences = base.filter("id is not null").mapInArrow(freeing(run), "seed long, id long, pos long, head boolean")
    shared = written(occurrences.join(_first_holders(occurrences), "seed").select("id", "ref_id", "pos", "ref_pos", "head"), "shared")
    if min_words >= K + WINDOW - 1:
        areas = written(_areas(shared.select("id", "pos"), min_words), "areas")
    else:  # so few words need not have a seed
        areas = base.filter("id is not null").select("id", F.array(F.lit(0).cast("long"), F.length("text").cast("long")).alias("areas")).filter("areas[1] is not null").dropDuplicates(["id"])
    whole = _whole(_words_of(base, areas), min_words).withColumn("size", F.lit(min_words).cast("long"))
    matches = shared.filter("id <> ref_id").select(F.col("id").alias("doc_id"), "ref_id", "pos", "ref_pos").unionByName(_met(written(_loose(shared, min_words), "loose"), shared))
    anchors = matches.withColumn("size", F.lit(K).cast("long")).unionByName(whole)
    chained = written(_chained(anchors), "chains")
    wanted = chained.select(F.explode(F.array("doc_id", "ref_id")).alias("id")).distinct()
    own = written(_words_of(base, wanted), "words")
    part = lambda words, a, b: F.slice(words, F.greatest(F.col(a) - MARGIN, F.lit(0)).cast("int") + 1, (F.col(b) - F.greatest(F.col(a) - MARGIN, F.lit(0)) + MARGIN).cast("int"))
    rows = chained.join(own.withColumnRenamed("id", "doc_id"), "doc_id").withColumn("a", part("words", "p0", "p1")).drop("words")
    rows = rows.join(own.withColumnRenamed("id", "ref_id"), "ref_id").withColumn("b", part("words", "r0", "r1")).drop("words")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            p0, r0, p1, r1 = (batch.column(c).to_numpy() for c in ("p0", "r0", "p1", "r1"))
            p_, r_ = np.maximum(0, p0 - MARGIN), np.maximum(0, r0 - MARGIN)
            after, before = _extended(batch.column("a"), batch.column("b"), p0 - p_, p1 - p_, r0 - r_, r1 - r_, min_words)
            # ten words are left for what other costs of a mismatch make of it
            worth = p1 - p0 + after[:, 0] + before[:, 0] >= min_words - 10
            batch, after, before, p_, r_ = batch.filter(pa.array(worth)), after[worth], before[worth], p_[worth], r_[worth]
            if not batch.num_rows:
                continue
            names = ["doc_id", "ref_doc_id", "start_word", "n_words", "ref_start_word", "ref_n_words", "matches", "identity"]
            rest = np.ones(batch.num_rows, bool)  # chains of one segment that are alike throughout are made all at once
            if len(one := np.flatnonzero(np.diff(batch.column("chain").offsets.to_numpy()) == 3)):
                some, at, ref_at = batch.take(pa.array(one)), p_[one], r_[one]
                p, r, q = (some.column(c).to_numpy() for c in ("p0", "r0", "p1"))
                s, e, rs, re, same = _straight(some.column("a"), some.column("b"), p - at, r - ref_at, q - p, after[one], before[one], min_words)
                longer = np.maximum(e - s, re - rs)
                good = same >= min_identity * longer
                rest[one[good]] = False
                good &= e - s >= min_words
                found = [some.column("doc_id").to_numpy(), some.column("ref_id").to_numpy(), s + at, e - s, rs + ref_at, re - rs, same, same / longer]
                yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in found], names)
            batch, rest = batch.filter(pa.array(rest)), np.flatnonzero(rest)
            for doc, ref, p, r, chain, a, b, *over_gaps in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ref_id")), p_[rest].tolist(), r_[rest].tolist(), *(batch.column(c) for c in ("chain", "a", "b")), after[rest].tolist(), before[rest].tolist()):
                steps = chain.values.to_numpy().reshape(-1, 3) - [p, r, 0]
                for s, e, rs, re, same in passages(a.values.to_numpy(), b.values.to_numpy(), [tuple(x) for x in steps.tolist()], min_words, min_identity, over_gaps):
                    out.append((doc, ref, s + p, e - s, rs + r, re - rs, same, same / max(e - s, re - rs)))
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out))[:7]), pa.array([o[7] for o in out])], names)

    return rows.select("doc_id", "ref_id", "p0", "p1", "r0", "r1", "chain", "a", "b").mapInArrow(freeing(aligned), "doc_id long, ref_doc_id long, start_word long, n_words long, ref_start_word long, ref_n_words long, matches long, identity double")


def _first_of_each(of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of the first occurrence of each hash in each text (places ascend)."""
    order = np.lexsort((hashes, of))  # stable
    new = np.ones(len(of), bool)
    new[1:] = (np.diff(of[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
    return order[new]


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their columns, the passages' words cut from the texts; a document of which no word is left goes. Whatever else stands in a text stays as it is.

    Null texts and ids stay. Of an id's different texts only the one that shared_passages looks at is
    cut, with its exact copies. Passages that overlap are cut once. Empty tables give empty ones.
    """
    spans = passages.groupBy(F.col("doc_id").cast("long").alias("span_id")).agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias("spans"))
    id_, mark = F.col(id_col).cast("long"), F.xxhash64(text_col)
    spans = spans.join(_texts_of_one_id(docs.select(id_.alias("span_id"), mark.alias("mark"))), "span_id", "left")
    own = docs.select(F.struct(*docs.columns).alias("own"), id_.alias("own_id"), mark.alias("own_mark"))  # so that no column's name can clash
    text = F.col("own").getField(text_col)
    looked_at = text.isNotNull() & F.col("spans").isNotNull() & (F.col("mark").isNull() | (F.col("mark") == F.col("own_mark")))

    def left(text: str | None, spans: list | None) -> str | None:
        return None if text is None or spans is None else _without(text, spans)

    # row by row and only what is cut, as the caller's batches, in which a lazy result runs, may hold many texts; once, as nondeterministic
    cut_ = F.udf(left, "string", useArrow=False).asNondeterministic()(F.when(looked_at, text), F.when(looked_at, F.col("spans")))
    rows = own.join(spans, F.col("own_id") == F.col("span_id"), "left").select("own", looked_at.alias("cut"), cut_.alias("left")).filter("cut is null or not cut or left is not null")
    return rows.select(*(F.when(F.col("cut"), F.col("left")).otherwise(F.col("own").getField(n)).alias(n) if n == text_col else F.col("own").getField(n).alias(n) for n in docs.columns))


def _without(text: str, spans: list[tuple[int, int]]) -> str | None:
    """The text without words, given as first ones and numbers of them; null if no word is left."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    starts, _ = word_starts(raw, np.array([0, len(raw)]))
    bounds = [*starts.tolist(), len(data)]
    pieces, at = [], 0
    for start, n in spans:
        a, b = bounds[min(start, len(bounds) - 1)], bounds[min(start + n, len(bounds) - 1)]
        if a > at:
            pieces.append(data[at:a])
        at = max(at, b)
    left = b"".join([*pieces, data[at:]]).decode()
    return left if left.strip(" \t\n\v\f\r") else None


def _texts_of_one_id(marks: DataFrame) -> DataFrame:
    """(span_id, mark) of ids that stand with several texts: the smallest of the texts' hashes (span_id, mark)."""
    return marks.filter("span_id is not null").groupBy("span_id").agg(F.min("mark").alias("mark"), F.max("mark").alias("other")).filter("mark <> other").drop("other")
