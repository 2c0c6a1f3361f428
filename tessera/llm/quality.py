"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its host and path are like.

A logistic model on plain statistics of the text gives each document its evidence. Hosts are
shrunk toward the corpus and paths toward their host, the more the fewer documents they have;
how much is learnt from how far hosts (and paths) differ beyond chance. The evidence is then
read against the path's rate instead of the corpus's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import buffers, cut, freed, words, written

#: At most so many labelled documents, those whose md5 of the id comes first, are learnt from.
TRAIN_DOCS = 20_000
THRESHOLD = 0.5
_CLASS = np.full(256, 4, np.int64)  # signs
_CLASS[128:] = 0
for _c, _group in ((0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, (9, 10, 11, 12, 13, 32))):
    _CLASS[list(_group)] = _c


def statistics(texts: pa.Array) -> np.ndarray:
    """Per text: shares of capitals, digits, blanks and signs, of different words, of the most frequent word, of words per line, of bars, and length."""
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    out = np.zeros((n, 10))
    kinds = _CLASS[data]
    for c in range(1, 5):
        total = np.concatenate([[0], np.cumsum(kinds == c)])
        out[:, c - 1] = (total[offsets[1:]] - total[offsets[:-1]]) / size
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    bars = np.concatenate([[0], np.cumsum(data == 124)])
    _, hashes, first = words(data, offsets)
    count = np.diff(first)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            _, times = np.unique(hashes[a:b], return_counts=True)
            out[i, 4], out[i, 5] = len(times) / (b - a), times.max() / (b - a)
    out[:, 6] = np.log1p(count / (1 + lines[offsets[1:]] - lines[offsets[:-1]]))
    out[:, 7] = np.minimum(1, 10 * (bars[offsets[1:]] - bars[offsets[:-1]]) / size)
    out[:, 8] = np.log1p(count)
    out[:, 9] = np.minimum(size / np.maximum(count, 1), 20) / 10
    return np.concatenate([np.ones((n, 1)), out, out**2, out[:, 4:6] * out[:, 8:9]], 1)


@dataclass
class Evidence:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights, -12, 12)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Evidence:
    """Logistic regression on at most `most` labelled documents whose crc32 of the id, modulo 4, is not 2. Without labels every document has even odds."""
    ids = F.col(id_col).cast("string")
    train = labels.filter((F.crc32(ids) % 4 != 2) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    train = train.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(freed(batches), "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(statistics(batch.column("text"))), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(train), "doc_id")
    known = rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    width = statistics(pa.array(["a"])).shape[1]
    if not len(known):
        return Evidence(np.zeros(width), np.ones(width), np.zeros(width))
    x, y = np.array(known["x"].tolist()), known["y"].to_numpy(float)
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    z, w = (x - mean) / scale, np.zeros(width)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag([1e-3, *[0.5] * (width - 1)])
        w = w + np.linalg.solve(h, z.T @ (y - p) - np.array([1e-3, *[0.5] * (width - 1)]) * w)
    return Evidence(mean, scale, w)


def _weight_of_prior(groups: DataFrame, rate: str, prior: str) -> float:
    """Documents that the prior is worth: expected variance within a group against what group rates vary beyond it (method of moments over all groups), between 1 and 1000."""
    row = groups.filter("n > 1").agg(
        F.sum((F.col(rate) - F.col(prior)) ** 2 * F.col("n")).alias("spread"),
        F.sum("within").alias("within"), F.sum("n").alias("n"), F.count("*").alias("groups"),
    ).first()
    if not row["groups"]:
        return 1000.0
    chance = row["within"] / row["n"]
    beyond = (row["spread"] - row["groups"] * chance) / row["n"]
    return float(min(1000.0, max(1.0, chance / beyond))) if beyond > 0 else 1000.0


def posterior(docs: DataFrame, evidence: Evidence, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, host, path, evidence (log odds), host_rate, path_rate, score, keep.

    score: logistic(evidence + logit(path_rate) - logit(corpus rate)); keep: score >= threshold.
    Both rates are those of the other documents: a document's own evidence is left out of them.
    A null host or path is a group of its own; null and empty texts have the evidence of a text
    without words. Rows stand for themselves; an empty table gives an empty one.
    Groups are summed up before anything is shuffled, and only their sums are joined back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(evidence)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(freed(batches), "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(shared.value.log_odds(statistics(batch.column("text"))))], ["doc_id", "host", "path", "evidence"])

    named = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    rows = docs.select(F.col(id_col).alias("doc_id"), named(host_col).alias("host"), named(path_col).alias("path"), F.col(text_col).alias("text"))
    rows = written(rows.mapInArrow(run, f"doc_id {kind}, host string, path string, evidence double"), "evidence")
    p = 1 / (1 + F.exp(-F.col("evidence")))
    sums = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("good"), F.sum(p * p).alias("squares"))
    paths = written(sums, "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = min(0.999, max(0.001, (total["good"] or 0) / (total["n"] or 1)))
    within = (F.col("squares") - F.col("good") * F.col("good") / F.col("n")).alias("within")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("squares").alias("squares"))
    hosts = hosts.select("host", "n", "good", within, (F.col("good") / F.col("n")).alias("rate"), F.lit(overall).alias("prior"))
    by_host = _weight_of_prior(hosts, "rate", "prior")
    rated = lambda good, n, prior, worth: (good + worth * prior) / (n + worth)
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), rated(F.col("good"), F.col("n"), overall, by_host).alias("host_rate"))
    paths = paths.join(hosts, "host").select("host", "path", "n", "good", within, (F.col("good") / F.col("n")).alias("rate"), "host_rate", "host_n", "host_good")
    by_path = _weight_of_prior(paths, "rate", "host_rate")
    paths = paths.select("host", "path", "host_n", "host_good", F.col("n").alias("path_n"), F.col("good").alias("path_good"))
    rows = rows.join(paths, ["host", "path"]).withColumn("own", p)
    rows = rows.withColumn("host_rate", rated(F.col("host_good") - F.col("own"), F.col("host_n") - 1, overall, by_host)).withColumn("path_rate", rated(F.col("path_good") - F.col("own"), F.col("path_n") - 1, F.col("host_rate"), by_path))
    clipped = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("path_rate")))
    shift = F.log(clipped / (1 - clipped)) - float(np.log(overall / (1 - overall)))
    score = 1 / (1 + F.exp(-(F.col("evidence") + shift)))
    return rows.select("doc_id", F.expr("if(host = '-', null, substring(host, 2))").alias("host"), F.expr("if(path = '-', null, substring(path, 2))").alias("path"), "evidence", "host_rate", "path_rate", score.alias("score"), (score >= threshold).alias("keep"))
