"""Toxic spans by a linear-chain conditional random field.

Labels are given per document. A term, or a beginning of one, that stands in far more toxic than
clean documents is evidence; in toxic documents the terms with evidence are the labelled tokens.
The field has two states and learns a weight for each strength of evidence, the changes of state
and the start. Forward-backward marginals of all tokens of a whole text add up to what a
logistic score per document and the offending offsets are made of.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import buffers, cut, freeing, terms

PREFIXES = (4, 5, 6, 7, 8, 9, 10)
#: At most so many labelled documents, those whose md5 of the id comes first, are learnt from.
TRAIN_DOCS = 20_000
#: Least documents with a feature, least lower bound of its log odds, steps of evidence and their width.
LEAST_DOCS, LEAST_ODDS, STEPS, WIDTH = 3, 1.25, 8, 0.6
SEGMENT, SEGMENTS, BLOCK = 64, 4000, 256
THRESHOLD = 0.3


@dataclass
class Model:
    """features (sorted hashes) with their steps of evidence; the field's log weights; the document score's weights."""

    features: np.ndarray
    steps: np.ndarray
    emit: np.ndarray
    move: np.ndarray  # [2, 2], log
    start: float
    score: np.ndarray

    def __post_init__(self):
        self.slots = np.zeros(1 << 16, bool)
        self.slots[(self.features >> np.uint64(48)).astype(np.int64)] = True


def _evidence(data: np.ndarray, offsets: np.ndarray, model: Model):
    """Starts, ends and step of evidence (0: none) of all terms, and each text's first."""
    starts, ends, hashes, first = terms(data, offsets, PREFIXES)
    steps = np.zeros(len(starts), np.uint8)
    if len(model.features):
        for row in hashes:
            at = np.flatnonzero(model.slots[(row >> np.uint64(48)).astype(np.uint16)])
            found = np.minimum(np.searchsorted(model.features, row[at]), len(model.features) - 1)
            at, found = at[model.features[found] == row[at]], found[model.features[found] == row[at]]
            steps[at] = np.maximum(steps[at], model.steps[found])
    return starts, ends, steps, first


def marginals(steps: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """P(toxic) of each token, forward-backward over each text.

    The ratio of both states' messages contracts by a factor that only the moves decide; blocks
    start so far ahead that what they start from is below 1e-12 in the result, at their text's
    start if need be.
    """
    n = len(steps)
    if not n:
        return np.zeros(0)
    e = np.exp(model.emit)[steps]
    m = np.exp(model.move)
    on, off = math.sqrt(m[0, 0] * m[1, 1]), math.sqrt(m[0, 1] * m[1, 0])
    shrink = max(1e-6, abs(on - off) / (on + off))
    lengths = np.diff(first)
    warm = int(lengths.max())
    if shrink < 1:
        warm = min(warm, max(4, math.ceil(math.log(1e-12) / math.log(shrink))))
    blocks = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), blocks)
    begin = first[text] + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    low, high = first[text], first[text + 1] - 1
    ahead, behind = np.ones(n), np.ones(n)
    with np.errstate(over="ignore"):
        r = np.ones(len(text))
        for j in range(-warm, BLOCK):
            at = begin + j
            live = (at >= low) & (at <= high)
            if not live.any():
                continue
            x = e[np.clip(at, 0, n - 1)]
            new = np.where(at == low, math.exp(model.start), (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])) * x
            r = np.where(live, new, r)
            if j >= 0:
                ahead[at[live]] = r[live]
        s = np.ones(len(text))
        for j in range(BLOCK + warm - 1, -1, -1):
            at = begin + j
            live = (at <= high) & (at >= low)
            if not live.any():
                continue
            x = e[np.clip(at + 1, 0, n - 1)] * s
            s = np.where(live, np.where(at == high, 1.0, (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)), s)
            if j < BLOCK:
                behind[at[live]] = s[live]
    odds = ahead * behind
    return odds / (1 + odds)


def _fit_field(steps: np.ndarray, labels: np.ndarray, mask: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum likelihood (with a small quadratic penalty) by Adam over segments [n, SEGMENT]."""
    w = np.concatenate([np.linspace(-4, 2, STEPS + 1), [-3.0, -0.5, 0.0, -4.0]])  # emit, moves 01 10 11, start
    first, second = np.zeros_like(w), np.zeros_like(w)
    n, length = steps.shape
    last = mask.sum(axis=1) - 1
    for k in range(1, rounds + 1):
        emit, move, start = w[: STEPS + 1], np.array([[0.0, w[-4]], [w[-3], w[-2]]]), w[-1]
        e, m = np.exp(emit)[steps], np.exp(move)
        a = np.zeros((n, length, 2))
        b = np.ones((n, length, 2))
        a[:, 0] = np.stack([np.ones(n), math.exp(start) * e[:, 0]], 1)
        a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            a[:, t] = a[:, t - 1] @ m
            a[:, t, 1] *= e[:, t]
            a[:, t] /= a[:, t].sum(1, keepdims=True)
        grad = np.zeros_like(w)
        for t in range(length - 2, -1, -1):
            right = b[:, t + 1] * np.stack([np.ones(n), e[:, t + 1]], 1)
            back = right @ m.T
            both = a[:, t, :, None] * m[None] * right[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            live = (t + 1 <= last).astype(float)
            y, z = labels[:, t], labels[:, t + 1]
            for i, (u, v) in enumerate(((0, 1), (1, 0), (1, 1))):
                grad[STEPS + 1 + i] += (live * (((y == u) & (z == v)) - both[:, u, v])).sum()
            b[:, t] = np.where(live[:, None] > 0, back / back.sum(1, keepdims=True), 1.0)
        p = a * b
        p = p[..., 1] / p.sum(2)
        grad[: STEPS + 1] += np.bincount(steps.ravel(), ((labels - p) * mask).ravel(), STEPS + 1)
        grad[-1] += (labels[:, 0] - p[:, 0]).sum()
        grad = grad / max(1, mask.sum()) * 50 - 1e-4 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w + 0.08 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return w[: STEPS + 1], np.array([[0.0, w[-4]], [w[-3], w[-2]]]), float(w[-1])


def _document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: 1, log of the expected toxic tokens, of the largest marginal, of the tokens, and of the expected share."""
    n = len(first) - 1
    lengths = np.diff(first)
    total = np.zeros(n)
    most = np.zeros(n)
    full = np.flatnonzero(lengths)
    if len(p):
        total[full] = np.add.reduceat(p, first[:-1][full])
        most[full] = np.maximum.reduceat(p, first[:-1][full])
    size = np.log1p(lengths)
    return np.stack([np.ones(n), np.log(total + 0.01), np.log(most + 0.01), size, np.log(total + 0.01) ** 2 / 4, np.minimum(total, 6)], 1)


def _fit_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def training_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, toxic) of the labelled documents to learn from: crc32 of the id as text, modulo 4, is not 2; the first by md5 of the id, most at most. An id that is both is toxic."""
    ids = F.col(id_col).cast("string")
    rows = labels.filter((F.crc32(ids) % 4 != 2) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    return rows.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_DOCS) -> Model:
    """Learns from at most `most` labelled documents. What reaches the driver is bounded by that number: features that many of them share, and where these stand. Without labels of both kinds the score is the share of toxic labels."""
    train = training_rows(labels, id_col, label_col, most)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(train), "doc_id").select("toxic", "text")

    def features(wanted: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in cut(batches, "text"):
                _, _, hashes, first = terms(*buffers(batch.column("text")), PREFIXES)
                out = []
                for a, b in zip(first[:-1], first[1:]):
                    own = np.unique(hashes[:, a:b])
                    own = own[own != 0]
                    if wanted is not None and len(wanted):
                        own = own[wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own]
                    out.append(own)
                found, counts = np.unique(np.concatenate(out), return_counts=True) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], ["feature", "n"])

        return run

    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(n for y, n in sizes.items() if y != 1)
    base = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    empty = Model(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.full(STEPS + 1, -8.0), np.zeros((2, 2)), -8.0, np.array([base, 0, 0, 0, 0, 0]))
    if not n_toxic or not n_clean:
        return empty
    schema = "feature long, n long"
    count = lambda rows: rows.groupBy("feature").agg(F.sum("n").alias("n"))
    toxic = count(texts.filter("toxic = 1").select("text").mapInArrow(freeing(features(None)), schema)).filter(F.col("n") >= max(LEAST_DOCS, n_toxic // 200)).toPandas()
    if not len(toxic):
        return empty
    wanted = np.sort(toxic["feature"].to_numpy().view(np.uint64))
    clean = count(texts.filter("toxic <> 1").select("text").mapInArrow(freeing(features(wanted)), schema)).toPandas()
    a = dict(zip(toxic["feature"], toxic["n"]))
    c = dict(zip(clean["feature"], clean["n"]))
    a, c = np.array([a[x] for x in wanted.view(np.int64)], float), np.array([c.get(x, 0) for x in wanted.view(np.int64)], float)
    odds = np.log((a + 0.5) / (n_toxic - a + 0.5)) - np.log((c + 0.5) / (n_clean - c + 0.5)) - 2 * np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
    good = odds >= LEAST_ODDS
    model = Model(wanted[good], np.minimum(STEPS, 1 + ((odds[good] - LEAST_ODDS) / WIDTH).astype(int)).astype(np.uint8), empty.emit, empty.move, empty.start, empty.score)
    if not good.any():
        return empty

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            _, _, steps, first = _evidence(*buffers(batch.column("text")), model)
            rows = [(np.flatnonzero(steps[i:j]), steps[i:j][steps[i:j] > 0]) for i, j in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(np.diff(first), pa.int64()), pa.array([x.tolist() for x, _ in rows], pa.list_(pa.int32())), pa.array([y.tolist() for _, y in rows], pa.list_(pa.int32()))], ["toxic", "n", "at", "step"])

    known = texts.mapInArrow(freeing(places), "toxic int, n long, at array<int>, step array<int>").toPandas()
    for name in ("at", "step"):
        known[name] = [np.asarray(v, np.int64) for v in known[name]]
    known = known.assign(key=[hash((t, n, tuple(a))) for t, n, a in zip(known["toxic"], known["n"], known["at"])]).sort_values(["n", "key"], kind="stable")  # one order whatever task came first
    y = (known["toxic"].to_numpy() == 1).astype(float)
    first = np.concatenate([[0], np.cumsum(known["n"])]).astype(np.int64)
    segments = []
    for label, n, at, step in zip(y, known["n"], known["at"], known["step"]):
        for begin in (sorted({max(0, int(i) // SEGMENT * SEGMENT) for i in at}) or [0]) if n else []:
            steps = np.zeros(SEGMENT, np.int64)
            inside = (at >= begin) & (at < begin + SEGMENT)
            steps[at[inside] - begin] = step[inside]
            segments.append((steps, (steps > 0) * label, np.arange(SEGMENT) < n - begin))
    chosen = segments[:: max(1, len(segments) // SEGMENTS)]
    model.emit, model.move, model.start = _fit_field(*(np.array([s[i] for s in chosen]) for i in range(3)))
    x = []
    for i in range(0, len(known), 500):  # the score learns from whole texts
        part = known.iloc[i : i + 500]
        own = first[i : i + len(part) + 1] - first[i]
        steps = np.zeros(own[-1], np.uint8)
        for begin, at, step in zip(own, part["at"], part["step"]):
            steps[begin + at] = step
        x.append(_document_features(marginals(steps, own, model), own))
    model.score = _fit_score(np.concatenate(x), y)
    return model


def _scored(data: np.ndarray, offsets: np.ndarray, model: Model):
    """Starts and ends of the tokens, each text's first, the marginals and the texts' scores."""
    starts, ends, steps, first = _evidence(data, offsets, model)
    p = marginals(steps, first, model)
    return starts, ends, first, p, 1 / (1 + np.exp(-np.clip(_document_features(p, first) @ model.score, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, spans: bool = True) -> DataFrame:
    """Per document: doc_id, score, predicted, the expected number of toxic tokens and, if spans, the offending offsets.

    spans array<struct<start, end, p>>: code points of runs of tokens with a marginal of 0.5 or
    more, and the run's largest. Null and empty texts get the score of a text without tokens.
    Rows stand for themselves; an empty table gives an empty one; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int, expected double{', spans array<struct<start: bigint, end: bigint, p: double>>' if spans else ''}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in cut(batches, "text", 1 << 20):
            data, offsets = buffers(batch.column("text"))
            starts, ends, first, p, value = _scored(data, offsets, model)
            total = np.zeros(batch.num_rows)
            full = np.flatnonzero(np.diff(first))
            if len(p):
                total[full] = np.add.reduceat(p, first[:-1][full])
            columns = [batch.column("doc_id"), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(total)]
            if spans:
                rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                hot = np.flatnonzero(p >= 0.5)
                of = np.searchsorted(first, hot, "right") - 1
                for i, t in zip(hot.tolist(), of.tolist()):
                    if rows[t] and rows[t][-1]["last"] == i - 1:
                        rows[t][-1] |= {"last": i, "p": max(p[i], rows[t][-1]["p"])}
                    else:
                        rows[t].append({"from": i, "last": i, "p": float(p[i])})
                place = lambda t, i: len(data[offsets[t] : i].tobytes().decode())
                columns.append(pa.array([[{"start": place(t, starts[s["from"]]), "end": place(t, ends[s["last"]]), "p": float(s["p"])} for s in row] for t, row in enumerate(rows)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "expected", *(["spans"] if spans else [])])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), schema)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, but for those whose text has a score of threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, text_col, 1 << 20):
            *_, value = _scored(*buffers(batch.column(text_col)), shared.value)
            yield batch.filter(pa.array(value < threshold))

    return docs.mapInArrow(freeing(run), docs.schema)
