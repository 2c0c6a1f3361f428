"""Token ids in shards, each a wavelet matrix: bit planes with rank directories, for access, counting and search.

A shard is one row of a Parquet folder: Spark commits it, any executor can read it, and the
planes are used as they lie in the bytes.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import Numbers, buffers, cut, freeing, joined, shared_folder, small_batches

MAGIC, END_ID, SHARD_TOKENS, WORD_BITS = b"WVM1", 2, 1 << 20, 512
#: Strings whose ids a task keeps.
KNOWN = 1_500_000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: ASCII signs, which end a word.
_SIGN = ~_ALNUM & ~_BLANK
_SIGN[[*range(33), *range(127, 256)]] = False
#: First bytes of white space other than blanks, and of the special token.
_LEAD = np.zeros(256, bool)
_LEAD[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF, 0x3C]] = True
#: Other white space, which the split would join to a blank run; and the special token.
_ODD = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]|<\|")


class Encoder:
    """A byte-level tokenizers file, whose encoder sees each different string between blanks once; texts where such strings could differ go to it whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spelled = self.tokenizer.get_vocab()  # byte-level: a character of a token's name is a byte
        self.width = np.zeros(max(spelled.values()) + 1, np.int64)
        self.width[list(spelled.values())] = [len(t) for t in spelled]
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Ids of new strings. Those that start with a blank and end with none are encoded as one text and told apart by the bytes their ids stand for."""
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        plain = _BLANK[data[starts]] & ~_BLANK[data[ends - 1]]
        counts, ids, held = np.zeros(len(starts), np.int64), [], []
        some = np.flatnonzero(plain)
        for i in range(0, len(some), 4000):
            part = some[i : i + 4000]
            lengths = ends[part] - starts[part]
            got = np.array(batch([joined(data, starts[part], lengths).tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.searchsorted(np.cumsum(self.width[got]), np.cumsum(lengths), "right")
            counts[part] = np.diff(stops, prepend=0)
            ids.append(got)
            held.append(part)
        some = np.flatnonzero(~plain)
        for i in range(0, len(some), 4000):
            part = some[i : i + 4000]
            got = [e.ids for e in batch([data[a:b].tobytes().decode() for a, b in zip(starts[part].tolist(), ends[part].tolist())], add_special_tokens=False)]
            counts[part] = [len(g) for g in got]
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
            held.append(part)
        order = np.concatenate(held)
        at = np.empty(len(starts), np.int64)
        at[order] = len(self.flat) + np.cumsum(counts[order]) - counts[order]
        self.starts, self.counts, self.flat = np.concatenate([self.starts, at]), np.concatenate([self.counts, counts]), np.concatenate([self.flat, *ids])

    def encode(self, texts: pa.Array, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, each text's followed by end, and their number per text (a null text is empty)."""
        data, offsets = buffers(texts)
        n = len(data)
        odd = np.zeros(len(texts), bool)
        for t in np.unique(np.searchsorted(offsets, np.flatnonzero(_LEAD[data]), "right") - 1).tolist():
            odd[t] = bool(_ODD.search(data[offsets[t] : offsets[t + 1]].tobytes().decode()))
        if self.numbers.size > KNOWN:
            self._forget()
        # a string: a run of blanks and what follows up to the next one, or the signs that end it after a letter
        blank = _BLANK[data]
        new = np.zeros(n + 1, bool)
        new[1:n] = blank[1:] & ~blank[:-1]
        new[offsets] = True
        heads = np.flatnonzero(new)
        sign = _SIGN[data]
        letter = _ALNUM[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        turn = np.zeros(n + 1, bool)  # a sign after a letter: it starts an ending if only signs follow
        turn[1:n] = sign[1:] & letter[:-1]
        turns = np.flatnonzero(turn)
        if len(turns):
            others = np.flatnonzero(np.concatenate([~sign, [True]]) | new)
            after = others[np.searchsorted(others, turns, "right")]
            turns = turns[new[after]]
            bounds = np.sort(np.concatenate([heads, turns]), kind="stable")
        else:
            bounds = heads
        codes, fresh = self.numbers.number(data, bounds)
        if len(fresh):
            self._learn(data, bounds[fresh], bounds[fresh + 1])
        n_ids = self.counts[codes]
        firsts = np.searchsorted(bounds, offsets)
        total = np.concatenate([[0], np.cumsum(n_ids)])
        ids = joined(self.flat, self.starts[codes], n_ids)
        ends = total[firsts]
        if odd.any():
            parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
            for t in np.flatnonzero(odd).tolist():
                parts[t] = np.array(self.tokenizer.encode(data[offsets[t] : offsets[t + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return np.insert(ids, ends[1:], np.uint32(end)), np.diff(ends) + 1


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """A worker's encoder: the tasks it runs in turn share the tokenizer and the strings known so far (KNOWN and a batch's at most)."""
    return Encoder(path)


def build_matrix(ids: np.ndarray, levels: int | None = None) -> bytes:
    """The wavelet matrix of ids: per level the bits in the order the levels above leave, zeros first; and the count of ones before each 512 bits."""
    n = len(ids)
    levels = levels or max(1, int(ids.max()).bit_length() if n else 1)
    values = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    blocks = -(-n // WORD_BITS)
    parts = [MAGIC, struct.pack("<QII", n, levels, 0)]
    for level in range(levels - 1, -1, -1):
        ones = ((values >> level) & 1).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        packed = np.concatenate([packed, np.zeros(blocks * WORD_BITS // 8 - len(packed), np.uint8)])
        counts = np.bitwise_count(packed.view(np.uint64)).reshape(blocks, WORD_BITS // 64).sum(axis=1, dtype=np.uint32)
        ranks = np.zeros(blocks + 1, np.uint32)
        np.cumsum(counts, out=ranks[1:])
        parts += [struct.pack("<Q", n - int(ranks[-1])), packed.tobytes(), ranks.tobytes()]
        values = np.concatenate([values[~ones], values[ones]])
    return b"".join(parts)


class WaveletMatrix:
    """Reads a matrix where it lies: access(i), rank(id, i), count(id), select(id, k), decode()."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.n, self.levels, _ = struct.unpack_from("<QII", blob, 4)
        blocks, at = -(-self.n // WORD_BITS), 20
        self.zeros, self.bits, self.ranks = [], [], []
        for _ in range(self.levels):
            self.zeros.append(struct.unpack_from("<Q", blob, at)[0])
            self.bits.append(np.frombuffer(blob, np.uint8, blocks * WORD_BITS // 8, at + 8))
            at += 8 + blocks * WORD_BITS // 8
            self.ranks.append(np.frombuffer(blob, np.uint32, blocks + 1, at))
            at += 4 * (blocks + 1)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits."""
        block, rest = divmod(i, WORD_BITS)
        start, full = block * WORD_BITS // 8, rest // 8
        count = int(self.ranks[level][block]) + int(np.bitwise_count(self.bits[level][start : start + full]).sum())
        return count + (int(self.bits[level][start + full]) & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else count

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit = int(self.bits[level][i >> 3]) >> (i & 7) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _span(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often token stands before place i."""
        lo, hi = self._span(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _place(self, level: int, bit: int, k: int) -> int:
        """Place of the bit number k (from 0) of this value: by the directory, then within 512 bits."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * WORD_BITS, self.n) - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        own = np.unpackbits(self.bits[level][block * WORD_BITS // 8 : (block + 1) * WORD_BITS // 8], bitorder="little")
        return block * WORD_BITS + int(np.flatnonzero(own == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of occurrence number k (from 0) of token."""
        lo, hi = self._span(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._place(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, from the lowest level up: each level's bits say which of the two runs below comes next."""
        values = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            ones = np.unpackbits(self.bits[level], count=self.n, bitorder="little").view(bool)
            up, zeros = np.empty_like(values), self.zeros[level]
            up[~ones] = values[:zeros]
            up[ones] = values[zeros:] | values.dtype.type(1 << (self.levels - 1 - level))
            values = up
        return values.astype(np.uint32)


SHARD = "part int, shard int, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, matrix binary"


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, in ascending order of id, into shards of about shard_tokens ids under path.

    A null text is empty: its only id is the end id. Null ids come first; rows that repeat an
    id follow the order of their texts. A text longer than a shard makes a shard of its own size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, shard = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, docs_in, lengths, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([held], pa.int64()), pa.array([docs_in], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([build_matrix(np.concatenate(ids))], pa.binary())],
                ["part", "shard", "n_tokens", "doc_ids", "lengths", "matrix"],
            )

        for batch in cut(batches, "text", 1 << 20):
            got, counts = own.encode(batch.column("text"), end_id)
            ids.append(got)
            docs_in += batch.column("doc_id").to_pylist()
            lengths += counts.tolist()
            held += len(got)
            if held >= shard_tokens:
                yield row()
                ids, docs_in, lengths, held, shard = [], [], [], 0, shard + 1
        if held:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(freeing(run), SHARD).write.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, base): ids of all shards before each. One light row per shard (SHARD_TOKENS ids) meets in the window."""
    return shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Per document from the shards under path: doc_id, start, n_tokens, ids_crc32 and, if keep_ids, ids."""
    ids_type = ", ids array<bigint>" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, doc_ids, lengths, matrix in zip(*(batch.column(c) for c in ("part", "shard", "doc_ids", "lengths", "matrix"))):
                ids = WaveletMatrix(matrix.as_buffer().to_pybytes()).decode()
                ends = np.cumsum(lengths.values.to_numpy())
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids.astype("<u4").tobytes())
                columns = [doc_ids.values, pa.array(starts, pa.int64()), lengths.values, pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64()), pa.array(np.full(len(ends), part.as_py()), pa.int32()), pa.array(np.full(len(ends), shard.as_py()), pa.int32())]
                names = ["doc_id", "within", "n_tokens", "ids_crc32", "part", "shard"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * keep_ids)

    shards = spark.read.schema(SHARD).parquet(path)
    rows = shards.mapInArrow(freeing(run), f"doc_id long, within long, n_tokens long, ids_crc32 long, part int, shard int{ids_type}")
    return rows.join(shard_starts(shards), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def token_store(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True, **how) -> DataFrame:
    """Writes the shards into the shared folder and returns read_documents over them. An empty table gives an empty one."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_shards(docs, path, tokenizer_path, **how)
    return read_documents(docs.sparkSession, path, keep_ids)
