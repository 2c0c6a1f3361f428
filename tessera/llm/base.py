"""What the operators share: words and their hashes, batches cut by size, and a folder that all executors see."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.folders import shared_folder, stored

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.where(_BLANK, np.uint64(0), _BYTE[_LOWER])
_STEP = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        _powers["up"] = np.cumprod(np.full(size, _STEP, np.uint64))
        _powers["down"] = np.cumprod(np.full(size, pow(_STEP, -1, 2**64), np.uint64))
    return _powers["up"], _powers["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of strings and the n + 1 offsets of its n texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    held = texts.buffers()
    offsets = np.frombuffer(held[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held[2], np.uint8)[offsets[0] : offsets[-1]] if held[2] is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_starts(data: np.ndarray, offsets: np.ndarray, blank_bytes: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of other bytes than the blank ones, and for each text the index of its first run (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = blank_bytes[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = blank[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(before & ~blank)
    return starts, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each word in data, 64-bit hash of each word (A-Z as a-z), and for each text the index of its first word (n + 1 values)."""
    n = len(data)
    starts, first = word_starts(data, offsets)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), first
    up, down = _power_tables(n)
    hashes = mix(np.add.reduceat(_VALUE[data] * up[:n], starts) * down[starts])
    return starts, hashes, first


#: Bytes that are no part of a letter, a digit or a character beyond ASCII.
_SIGN = np.ones(256, bool)
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LETTER = np.where(_SIGN, np.uint64(0), _BYTE[_LOWER])


def terms(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits: starts, ends, hashes [1 + prefixes, runs] of the whole run and of its first bytes (0 where it is no longer), index of each text's first run."""
    starts, first = word_starts(data, offsets, _SIGN)
    n = len(data)
    if not len(starts):
        return starts, starts, np.zeros((1 + len(prefixes), 0), np.uint64), first
    up, down = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[:n], out=total[1:])
    over = _SIGN[data]
    over = np.concatenate([over, [True]])
    over[offsets[1:-1]] |= True
    stops = np.flatnonzero(over)
    after = np.searchsorted(stops, starts, "right")
    ends = stops[after] if not len(offsets) > 2 else np.minimum(stops[after], offsets[np.searchsorted(offsets, starts, "right")])
    out = np.zeros((1 + len(prefixes), len(starts)), np.uint64)
    scale = down[starts]
    out[0] = mix((total[ends] - total[starts]) * scale)
    for i, length in enumerate(prefixes, 1):
        longer = np.flatnonzero(ends - starts > length)
        at = starts[longer]
        out[i, longer] = mix((total[at + length] - total[at]) * scale[longer] + np.uint64(length))
    return starts, ends, out, first


class Numbers:
    """Numbers for different byte strings, in order of arrival.

    Strings are told apart by a 64-bit hash, their length and their first 8 bytes; one that agrees
    with a known string in its hash alone gets a number of its own. size: numbers given so far.
    """

    def __init__(self):
        self.hashes, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.heads, self.lengths, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def number(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each string data[bounds[i]:bounds[i + 1]], none empty, and the indexes of the strings whose numbers are new, in the numbers' order."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        starts, lengths = bounds[:-1], np.diff(bounds)
        up, down = _power_tables(n)
        hashes = mix(np.add.reduceat(_BYTE[data] * up[:n], starts) * down[starts])
        heads = np.ndarray((n,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))[starts]
        heads = np.where(lengths < 8, heads & ((np.uint64(1) << (8 * np.minimum(lengths, 7)).astype(np.uint64)) - np.uint64(1)), heads)
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, different), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == different if len(self.hashes) else np.zeros(len(different), bool)
        new = np.flatnonzero(~known)
        codes = np.empty(len(different), np.int32)
        codes[known] = self.codes[at[known]]
        codes[new] = self.size + np.arange(len(new))
        fresh = first[new]
        spots = np.searchsorted(self.hashes, different[new])
        self.hashes, self.codes = np.insert(self.hashes, spots, different[new]), np.insert(self.codes, spots, codes[new])
        self._more(heads[fresh], lengths[fresh])
        out = codes[which]
        other = np.flatnonzero((self.heads[out] != heads) | (self.lengths[out] != lengths))
        if len(other):
            out[other] = self.size + np.arange(len(other))
            self._more(heads[other], lengths[other])
            fresh = np.concatenate([fresh, other])
        return out, fresh

    def _more(self, heads: np.ndarray, lengths: np.ndarray) -> None:
        end = self.size + len(heads)
        if end > len(self.heads):
            room = max(end, 2 * len(self.heads)) - self.size
            self.heads = np.concatenate([self.heads[: self.size], np.zeros(room, np.uint64)])
            self.lengths = np.concatenate([self.lengths[: self.size], np.zeros(room, np.int64)])
        self.heads[self.size : end], self.lengths[self.size : end] = heads, lengths
        self.size = end


def joined(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of data with these starts and lengths, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def different(values: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def whole_runs(batches: Iterator[pa.RecordBatch], starts: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole runs of rows, and the first row of each run; a run may lie across the batches that come."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        first = starts(held)
        if len(first) > 1:
            yield held.slice(0, first[-1]), first[:-1]
            held = held.slice(first[-1])
    if held is not None:
        yield held, starts(held)


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; afterwards the worker, which goes on to other tasks, gives the memory it no longer needs back."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches, whose worker gives memory back when the last batch is out and what the function held is gone."""
    return lambda batches: freed(run(batches))


def sequences(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one text; short ends give no sequence."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out[: max(0, n - j)] += hashes[j:] * np.uint64(pow(_STEP, 3 * j + 1, 2**64))
    whole = np.ones(n, bool)
    for j in range(1, k):
        ends = first[1:] - j
        whole[ends[ends >= first[:-1]]] = False
    return mix(out), whole


def cut(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of a column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


written = stored


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """The rows, stored once as a table in buckets of a column, so that a join by it shuffles the other side alone."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    table = f"tessera_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table)
    return spark.table(table)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While this lasts, what runs hands Arrow batches of fewer rows to Python, so that neither side holds many texts; afterwards the session's setting holds again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
