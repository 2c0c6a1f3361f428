"""Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer when the smallest of its s-mers is its first or last.
Whether it is one depends on its own bytes alone, so an edit moves no anchor outside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import buffers, cut, freed, mix

K, S, SKETCH = 16, 6, 64
_WINDOW = K - S + 1


def _words64(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places on, as numbers."""
    return np.ndarray((n,), "<u8", data, 0, (1,))


def syncmers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and text of each closed syncmer of the texts that lie in data; a text under K bytes is one anchor as a whole, an empty one has none."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(K, np.uint8)])
    at = np.zeros(0, np.int64)
    if n >= K:
        inner = (mix(_words64(padded, n - S + 1) << np.uint64(8 * (8 - S))) >> np.uint64(32)).astype(np.uint32)
        least, have = inner, 1
        while have < _WINDOW:
            step = min(have, _WINDOW - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        closed = (inner[: len(least)] == least) | (inner[_WINDOW - 1 :] == least)
        for j in range(1, K):  # not over a text's end
            ends = offsets[1:] - j
            closed[ends[(ends >= 0) & (ends < len(closed))]] = False
        at = np.flatnonzero(closed)
    of = np.searchsorted(offsets, at, "right") - 1
    low, high = _words64(padded, n + 1)[at], np.ndarray((n + 1,), "<u8", padded, 8, (1,))[at] if n else at.astype(np.uint64)
    hashes = mix(mix(low) + high)
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < K))
    if len(short):
        whole = np.array([int.from_bytes(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short], np.uint64)
        at, of, hashes = np.concatenate([at, offsets[short]]), np.concatenate([of, short]), np.concatenate([hashes, whole])
        order = np.argsort(of, kind="stable")
        at, of, hashes = at[order], of[order], hashes[order]
    return at - offsets[of], hashes, of


def sketches(texts: list[bytes], size: int = SKETCH) -> list[np.ndarray]:
    """Per text the size smallest different hashes of its syncmers."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    _, hashes, of = syncmers(np.frombuffer(b"".join(texts), np.uint8), offsets)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    return [np.unique(short[bounds[i] : bounds[i + 1]])[:size] for i in range(len(texts))]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Share of the size smallest hashes of both sketches that both have; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    twin = both[1:] == both[:-1]
    least = np.concatenate([[True], ~twin])
    cap = both[least][:size][-1]
    return float(np.count_nonzero(twin & (both[1:] <= cap)) / min(size, np.count_nonzero(least)))


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (doc_id, anchors array<struct<pos, hash>>): byte place and hash of every closed syncmer, for positional matching. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(freed(batches), "text"):
            data, offsets = buffers(batch.column("text"))
            pos, hashes, of = syncmers(data, offsets)
            inner = pa.StructArray.from_arrays([pa.array(pos, pa.int64()), pa.array(hashes.view(np.int64))], ["pos", "hash"])
            bounds = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(bounds, inner)], ["doc_id", "anchors"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, anchors array<struct<pos: bigint, hash: bigint>>")


def with_next(docs: DataFrame, rows_per_range: int = 250, most_ranges: int = 65536) -> DataFrame:
    """(doc_id, text) partitioned into ranges of descending doc_id, each followed by a row with look = 1, the first of the next range (the last range: of the first).

    Columns: range, look, doc_id, text; sorted within partitions. Null ids form the last range.
    Each text is shuffled once. One row per range (most_ranges at most: beyond 16 million documents
    ranges grow instead; a task reads its range in batches) passes the driver.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("double").alias("x"))
    n = ids.count()
    ranges = min(most_ranges, n // rows_per_range + 1)
    cuts = sorted(set(ids.approxQuantile("x", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    ranged = docs.withColumn("x", F.col("doc_id").cast("double"))
    if cuts:
        ranged = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="x", outputCol="bucket", handleInvalid="keep").transform(ranged)
    else:
        ranged = ranged.withColumn("bucket", F.lit(0))
    ranged = ranged.select(F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("bucket").cast("int")).alias("range"), "doc_id", "text")
    tops = sorted(ranged.groupBy("range").agg(F.max("doc_id").alias("top")).collect(), key=lambda r: -r["range"])
    if not tops:
        return ranged.withColumn("look", F.lit(0))
    follow = [(head["range"], head["top"], to["range"]) for to, head in zip(tops, tops[1:] + tops[:1])]
    heads = spark.createDataFrame(follow, "head int, top long, to int")
    looks = ranged.filter("doc_id is not null").join(F.broadcast(heads.filter("top is not null")), (F.col("range") == F.col("head")) & (F.col("doc_id") == F.col("top")))
    looks = looks.select(F.col("to").alias("range"), "doc_id", "text", F.lit(1).alias("look"))
    if tops[-1]["range"] == -1:
        to = next(f[2] for f in follow if f[0] == -1)
        least = ranged.filter("doc_id is null").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        looks = looks.unionByName(least.select(F.lit(to).alias("range"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("look")))
    return ranged.withColumn("look", F.lit(0)).unionByName(looks).repartition("range").sortWithinPartitions("range", "look", F.desc_nulls_last("doc_id"), F.coalesce("text", F.lit("")))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is replaced by the start of the next document by descending id.

    A null text is empty; empty texts have the fingerprint ''. Rows that repeat an id stand in
    the order of their texts. One document alone is its own next one; an empty table gives an
    empty one. Other columns are left out.
    """

    def pairs(group: list[tuple[int | None, str]]) -> Iterator[pa.RecordBatch]:
        """group: documents in order; the last is only the next one of the one before."""
        own = group[:-1]
        edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for (_, t), (_, after) in zip(own, group[1:])]
        raw = [t.encode() for t in edited]
        all_sketches = sketches([t.encode() for _, t in group] + raw)
        a, b = all_sketches[: len(group)], all_sketches[len(group) :]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in own], pa.int64()),
                pa.array([len(t) for _, t in own], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
                pa.array([text_of(x) for x in a[:-1]]),
                pa.array([text_of(x) for x in b]),
                pa.array([likeness(x, y) for x, y in zip(a, b)]),
                pa.array([likeness(x, y) for x, y in zip(a, a[1:])]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        at, ended, size = None, False, 0
        for batch in cut(freed(batches), "text", 1 << 20):
            for where, look, doc, text in zip(*(batch.column(c).to_pylist() for c in ("range", "look", "doc_id", "text"))):
                if where != at:
                    held, at, ended, size = [], where, False, 0
                if ended:
                    continue  # more rows with the next range's first id
                held.append((doc, text or ""))
                size += len(text or "")
                ended = bool(look)
                if (ended or size > 1 << 20) and len(held) > 1:
                    yield from pairs(held)
                    held, size = held[-1:], 0

    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, SCHEMA)
