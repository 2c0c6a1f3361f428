"""SentencePiece encoding over a relational lattice, and decoding.

Each chunk of documents keeps its different words and the documents as numbers into them. The
different words of a block of chunks, by lots, are cut where no piece spans the place, into units.
Units are exploded into their substrings of bounded length, equi-joined to the piece table and
grouped into the edges of their lattice, and a higher-order aggregate folds the edges into ids: by
Viterbi for a unigram model, and for a BPE model by its own rule, best merge first. (The best sum
over a BPE model's scores isn't what SentencePiece returns for it.) The ids go back to the chunks
that use them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Numbers, bucketed, buffers, cut, freeing, joined, mix, small_batches, whole_runs

#: A chunk's bytes of text, chunks of a block and lots of a chunk's words.
CHUNK_BYTES, BLOCK_CHUNKS, LOTS = 12 << 20, 160, 64
BLANK, MASK_CHARS = "▁", 60


@dataclass
class Pieces:
    """The table of a model: pieces that texts can be made of, with ids and scores; id of byte 0 (or None) and of an unknown character."""

    rows: tuple[tuple[str, int, float], ...]
    byte_zero: int | None
    unknown: int
    spelled: tuple[bytes, ...]

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    @cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for p, i, s in self.rows}

    def character(self, c: str) -> list[int]:
        """The ids of one character: its piece, or its bytes, or unknown."""
        if c in self.table:
            return [self.table[c][0]]
        return [self.unknown] if self.byte_zero is None else [self.byte_zero + b for b in c.encode()]


def load_pieces(model_file: str) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rows, spelled = [], []
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            spelled.append(b" \xe2\x81\x87 " if m.is_unknown(i) else b"")
        else:
            rows.append((piece, i, float(m.get_score(i))))
            spelled.append(piece.replace(BLANK, " ").encode())
    zero = m.piece_to_id("<0x00>")
    return Pieces(tuple(rows), zero if m.is_byte(zero) else None, m.unk_id(), tuple(spelled))


def units_of(word: str, pairs: frozenset[str]) -> list[str]:
    """A word cut between each two characters that no piece has together."""
    cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


#: Rows of a chunk: itself (lot -1; packed has the lot of each different word and the words in turn as numbers) and, for each lot of its different words, these.
CHUNK = "chunk long, lot int, doc_ids array<bigint>, counts array<int>, n int, size int, packed binary"


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, their lowest bytes first: small numbers leave planes that compress to nothing."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4")[:, 0].astype(np.int64)


def _frequent_first(codes: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent: a byte each below 255, and what is beyond after them."""
    return np.minimum(codes, 255).astype(np.uint8).tobytes() + _planes(codes[codes >= 255] - 255)


def _codes(raw: bytes, at: int, n: int) -> np.ndarray:
    codes = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    more = np.flatnonzero(codes == 255)
    codes[more] += _numbers(raw, at + n, len(more))
    return codes


def _zipped(raw: bytes) -> tuple[int, bytes]:
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unzipped(size: int, packed: bytes) -> bytes:
    return pa.decompress(packed, size, codec="zstd", asbytes=True)


def chunks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) in chunks of about CHUNK_BYTES, as rows of CHUNK. A word is a run of blanks and what follows up to the next one; a blank goes before each text that isn't empty."""

    def close(key: int, numbers: Numbers, ids: list, counts: list, codes: list, texts: list) -> pa.RecordBatch:
        codes, words = np.concatenate(codes), np.concatenate(texts)
        order = np.argsort(-np.bincount(codes, minlength=numbers.size), kind="stable")
        rank = np.empty(numbers.size, np.int32)
        rank[order] = np.arange(numbers.size, dtype=np.int32)
        lengths = numbers.lengths[: numbers.size]
        starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
        lots = (mix(numbers.heads[order] + lengths.astype(np.uint64)) % np.uint64(LOTS)).astype(np.uint8)
        rows = [(-1, ids, np.concatenate(counts).tolist(), numbers.size, *_zipped(lots.tobytes() + _frequent_first(rank[codes])))]
        for lot in np.unique(lots).tolist():
            own = np.flatnonzero(lots == lot)
            rows.append((lot, None, None, len(own), *_zipped(_planes(lengths[own]) + joined(words, starts[own], lengths[own]).tobytes())))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), *columns], ["chunk", "lot", "doc_ids", "counts", "n", "size", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = TaskContext.get().partitionId() << 32, 0
        state = Numbers(), [], [], [], []
        for some in cut(batches, "text", 1 << 19):
            numbers, ids, counts, codes, texts = state
            data, offsets = buffers(some.column("text"))
            full = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
            new = np.zeros(len(data) + 1, bool)
            new[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
            new[offsets] = True
            bounds = np.flatnonzero(new)
            own, fresh = numbers.number(data, bounds)
            ids += some.column("doc_id").to_pylist()
            counts.append(np.diff(np.searchsorted(bounds, offsets)))
            codes.append(own)
            texts.append(joined(data, bounds[fresh], bounds[fresh + 1] - bounds[fresh]))
            held += len(data)
            if held >= CHUNK_BYTES:
                yield close(key, *state)
                key, held, state = key + 1, 0, (Numbers(), [], [], [], [])
        if state[1]:
            yield close(key, *state)

    return docs.mapInArrow(freeing(run), CHUNK)


def _load(lot: int, members: list[tuple], pieces: Pieces, pairs: frozenset[str], rule: str) -> tuple[bytes, list[tuple[int, str]]]:
    """What answering the chunks of a lot takes beside its units' ids, and the units to fold, with their numbers."""
    numbers, codes, words = Numbers(), [], []
    for _, n, size, packed in members:
        raw = _unzipped(size, packed)
        bounds = np.concatenate([[0], np.cumsum(_numbers(raw, 0, n))])
        own, fresh = numbers.number(np.frombuffer(raw, np.uint8, offset=4 * n), bounds)
        codes.append(own)
        words += [raw[4 * n + i : 4 * n + j].decode().replace(" ", BLANK) for i, j in zip(bounds[fresh].tolist(), bounds[fresh + 1].tolist())]
    number: dict[str, int] = {}
    parts = [[number.setdefault(u, len(number)) for u in units_of(w, pairs)] for w in words]
    long = {i: fold_unit(u, pieces, rule) for u, i in number.items() if len(u) > MASK_CHARS or len(u) < 2}
    load = (lot, [m[0] for m in members], [len(c) for c in codes], np.concatenate(codes), np.array([len(p) for p in parts]), np.fromiter(chain.from_iterable(parts), np.int64), len(number), long)
    return pickle.dumps(load), [(i, u) for u, i in number.items() if i not in long]


def units(stored: DataFrame, pieces: Pieces, rule: str) -> DataFrame:
    """(at, unit, load): the different units of a lot of a block of chunks, numbered, after a row (-1, null, load) that answers takes.

    A word is cut into units between characters that no piece has together. Blocks hold about
    BLOCK_CHUNKS chunks, so what meets in a task is bounded whatever the corpus, and a word that
    all chunks have is folded once a block. Units over MASK_CHARS and single characters are folded here.
    """
    blocks = max(1, stored.filter("lot = -1").count() // BLOCK_CHUNKS)
    asked = stored.filter("lot >= 0").select(F.pmod(F.xxhash64("chunk"), F.lit(blocks)).alias("block"), "lot", "chunk", "n", "size", "packed")
    pairs = frozenset(p[i : i + 2] for p, _, _ in pieces.rows for i in range(len(p) - 1))
    shared = stored.sparkSession.sparkContext.broadcast((pieces, pairs))
    names = ["at", "unit", "load"]

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        key = batch.column("block").to_numpy().astype(np.int64) * LOTS + batch.column("lot").to_numpy()
        return np.flatnonzero(np.diff(key, prepend=-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, pairs = shared.value
        for batch, first in whole_runs(batches, starts):
            for i, j in zip(first, np.append(first[1:], batch.num_rows)):
                own = batch.slice(i, j - i)
                load, found = _load(own.column("lot")[0].as_py(), list(zip(*(own.column(c).to_pylist() for c in ("chunk", "n", "size", "packed")))), pieces, pairs, rule)
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.string()), pa.array([load], pa.binary())], names)
                for k in range(0, len(found), 5000):
                    part = found[k : k + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int32()), pa.array([u for _, u in part], pa.string()), pa.nulls(len(part), pa.binary())], names)

    return asked.repartition("block", "lot").sortWithinPartitions("block", "lot", "chunk").mapInArrow(freeing(run), "at int, unit string, load binary")


EDGES = "edges array<struct<i: int, j: int, id: int, score: double>>, merges array<struct<ends: bigint, inside: bigint>>"


def lattice(units: DataFrame, pieces: Pieces, least: int = 1) -> DataFrame:
    """The units' rows with edges, one for each substring of least characters or more that is a piece (id null for a single character that isn't one), by place, and merges: the borders of edges of several characters, best score first. A row without a unit has neither.

    The piece table is as large as the model's vocabulary, so it is broadcast. The substrings of a
    unit are made and met where it lies, one after another, so its edges are grouped there too,
    without a shuffle or a sort; its first substring brings the unit's columns along, and edges
    that come in another order raise an error. A unit has least to MASK_CHARS characters: borders are bits.
    """
    table = F.broadcast(units.sparkSession.createDataFrame(pieces.rows, "piece string, id int, score double"))
    own = units.columns
    spans = units.withColumn("i", F.explode(F.expr(f"sequence(0, coalesce(length(unit), {least}) - {least})"))).withColumn("rest", F.expr(f"substring(unit, i + 1, {pieces.longest})"))
    spans = spans.withColumn("k", F.explode(F.expr(f"sequence({least}, coalesce(length(rest), {least}))"))).withColumn("piece", F.expr("substring(rest, 1, k)"))
    head = f"(i = 0 and k = {least})"
    joined = spans.join(table, "piece", "left").filter(f"id is not null or k = 1 or {head}")
    edges = joined.select(*(F.when(F.expr(head), F.col(c)).alias(c) for c in own), "i", (F.col("i") + F.col("k")).alias("j"), "id", "score")
    worst = min(s for _, _, s in pieces.rows) - 10.0

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        return np.flatnonzero((batch.column("i").to_numpy() == 0) & (batch.column("j").to_numpy() == least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in whole_runs(batches, starts):
            i, j = (batch.column(c).to_numpy().astype(np.int64) for c in "ij")
            unit = np.cumsum(np.isin(np.arange(len(i)), first)) - 1
            if not len(first) or first[0] or (np.diff(unit << 16 | i << 8 | j) <= 0).any():
                raise RuntimeError("edges of units came out of order")
            found = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            score = np.where(found, batch.column("score").fill_null(0.0).to_numpy(), worst)
            some = batch.column("unit").is_valid().to_numpy(zero_copy_only=False)[first][unit]
            kept = np.flatnonzero((found | (j == i + 1)) & some)
            lists = pa.StructArray.from_arrays([pa.array(i[kept], pa.int32()), pa.array(j[kept], pa.int32()), batch.column("id").take(pa.array(kept)), pa.array(score[kept])], ["i", "j", "id", "score"])
            bounds = np.searchsorted(unit[kept], np.arange(len(first) + 1))
            several = np.flatnonzero(found & (j > i + 1) & some)
            several = several[np.lexsort((i[several], -score[several], unit[several]))]
            low, high = i[several], j[several]
            one = np.int64(1)
            borders = pa.StructArray.from_arrays([pa.array((one << low) | (one << high)), pa.array(((one << high) - 1) & ~((one << (low + 1)) - 1))], ["ends", "inside"])
            ends = np.searchsorted(unit[several], np.arange(len(first) + 1))
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in own), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lists), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), borders)], [*own, "edges", "merges"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in units.schema)
    return edges.mapInArrow(freeing(run), f"{kinds}{EDGES}")


def fold_merges(lattices: DataFrame) -> DataFrame:
    """Adds borders, a bit for each place where a piece ends or starts: merges in turn; one joins the two parts it spans if just one border lies inside it."""
    return lattices.withColumn("borders", F.expr("aggregate(merges, shiftleft(1L, length(unit) + 1) - 1, (m, e) -> if((m & e.ends) = e.ends and bit_count(m & e.inside) = 1, m & ~e.inside, m))"))


def fold_viterbi(lattices: DataFrame) -> DataFrame:
    """Adds borders, as fold_merges, of the path with the largest sum of scores; of the largest bits where sums tie. It needs edges of single characters."""
    step = "array_max(transform(filter(edges, e -> e.j = j), e -> struct(a[e.i].score + e.score as score, a[e.i].borders | shiftleft(1L, j) as borders)))"
    best = f"aggregate(sequence(1, length(unit)), array(struct(0.0D as score, 1L as borders)), (a, j) -> concat(a, array({step})))"
    return lattices.withColumn("borders", F.expr(f"element_at({best}, -1).borders"))


def ids_of(batch: pa.RecordBatch, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each row (unit, edges, borders), and all ids: of the edges between borders that follow one another; of single characters without an edge, as spelled."""
    edges, masks = batch.column("edges"), batch.column("borders").to_numpy()
    row = np.repeat(np.arange(len(masks)), pc.list_value_length(edges).to_numpy())
    flat = edges.flatten()
    i, j = (flat.field(c).to_numpy().astype(np.int64) for c in "ij")
    one, borders = np.int64(1), masks[row]
    ends, inside = (one << i) | (one << j), ((one << j) - 1) & ~((one << (i + 1)) - 1)
    chosen = np.flatnonzero(((borders & ends) == ends) & ((borders & inside) == 0) & flat.field("id").is_valid().to_numpy(zero_copy_only=False))
    row, i, ids = row[chosen], i[chosen], flat.field("id").take(pa.array(chosen)).to_numpy().astype(np.int64)
    covered = np.zeros(len(masks), np.int64)  # borders where a chosen edge starts
    np.bitwise_or.at(covered, row, one << i[:])
    text = np.frombuffer("".join(batch.column("unit").to_pylist()).encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(batch.column("unit")).to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(masks)), lengths)
    place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    single = np.flatnonzero(((masks[of] >> place) & 1).astype(bool) & ((masks[of] >> (place + 1)) & 1).astype(bool) & ~((covered[of] >> place) & 1).astype(bool))
    chars, which = np.unique(text[single], return_inverse=True)
    spelled = [pieces.character(chr(c)) for c in chars.tolist()]
    n = np.array([len(x) for x in spelled], np.int64)
    starts, own = np.cumsum(n) - n, which
    more = joined(np.array(list(chain.from_iterable(spelled)), np.int64), starts[own], n[own])
    row = np.concatenate([row, np.repeat(of[single], n[own])])
    i = np.concatenate([i, np.repeat(place[single], n[own])])
    order = np.lexsort((i, row))  # stable: the bytes of a character stay in turn
    return np.bincount(row, minlength=len(masks)), np.concatenate([ids, more])[order]


def fold_unit(unit: str, pieces: Pieces, rule: str) -> list[int]:
    """The ids of one unit of a character or of more than MASK_CHARS, by the same rules over the same edges: rows of substrings would each carry so long a unit."""
    table, longest, worst = pieces.table, pieces.longest, min(s for _, _, s in pieces.rows) - 10.0

    n = len(unit)
    if rule == "merges":
        border = bytearray(b"\x01") * (n + 1)
        found = ((-table[p][1], i, j) for i in range(n) for j in range(i + 2, min(n, i + longest) + 1) if (p := unit[i:j]) in table)
        for _, i, j in sorted(found):
            if border[i] and border[j] and sum(border[i + 1 : j]) == 1:
                border[i + 1 : j] = bytes(j - i - 1)
        cuts = [i for i in range(n + 1) if border[i]]
    else:
        best, back = [0.0], [0]
        for j in range(1, n + 1):
            score, i = max((best[i] + (table[unit[i:j]][1] if unit[i:j] in table else worst), i) for i in range(max(0, j - longest), j) if unit[i:j] in table or i == j - 1)
            best.append(score)
            back.append(i)
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
    return list(chain.from_iterable([table[p][0]] if (p := unit[i:j]) in table else pieces.character(p) for i, j in zip(cuts, cuts[1:])))


def answers(folded: DataFrame, pieces: Pieces) -> DataFrame:
    """The words' ids of each chunk and lot, as rows of CHUNK, from the folded units (at, unit, load, edges, borders) in the order of units: n lengths, and the ids."""
    shared = folded.sparkSession.sparkContext.broadcast(pieces)
    names = ["chunk", "lot", "n", "size", "packed"]

    def close(load: bytes, parts: list[tuple]) -> pa.RecordBatch:
        lot, chunk, sizes, codes, per_word, unit, n_units, long = pickle.loads(load)
        at = np.concatenate([*(p[0] for p in parts), list(long)]).astype(np.int64)
        if len(at) != n_units:
            raise RuntimeError("units are missing")
        lengths = np.concatenate([*(p[1] for p in parts), [len(x) for x in long.values()]]).astype(np.int64)
        flat = np.concatenate([*(p[2] for p in parts), *long.values()]).astype(np.int64)
        n, starts = np.empty(n_units, np.int64), np.empty(n_units, np.int64)
        n[at], starts[at] = lengths, np.cumsum(lengths) - lengths
        flat = joined(flat, starts[unit], n[unit])  # words' ids in turn
        ends = np.concatenate([[0], np.cumsum(n[unit])])[np.concatenate([[0], np.cumsum(per_word)])]
        begins, n = ends[:-1], np.diff(ends)
        rows, i = [], 0
        for key, size in zip(chunk, sizes):
            own = codes[i : i + size]
            rows.append((key, lot, size, *_zipped(_planes(n[own]) + _planes(joined(flat, begins[own], n[own])))))
            i += size
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, parts = None, []
        for batch in batches:
            at = batch.column("at").to_numpy()
            heads = set(np.flatnonzero(at == -1).tolist())
            cuts = sorted({0, batch.num_rows} | heads)
            for i, j in zip(cuts, cuts[1:]):
                if i in heads:
                    if load is not None:
                        yield close(load, parts)
                    load, parts = batch.column("load")[i].as_py(), []
                    i += 1
                if j > i:
                    parts.append((at[i:j], *ids_of(batch.slice(i, j - i), shared.value)))
        if load is not None:
            yield close(load, parts)

    return folded.select("at", "unit", "load", "edges", "borders").mapInArrow(freeing(run), "chunk long, lot int, n int, size int, packed binary")


def encode(docs: DataFrame, model_file: str, rule: str = "merges", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, as the model's own encoder gives them.

    rule: merges for a BPE model, viterbi for a unigram one. Null and empty texts have no ids.
    Rows stand for themselves, whatever their ids; an empty table gives an empty one; other
    columns are left out. A long word is a longer unit, not a cut one.
    """
    pieces = load_pieces(model_file)
    with small_batches(docs.sparkSession):
        stored = bucketed(chunks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "chunks", "chunk")
    fold = {"merges": fold_merges, "viterbi": fold_viterbi}[rule]
    answered = answers(fold(lattice(units(stored, pieces, rule), pieces, 2 if rule == "merges" else 1)), pieces)
    parts = answered.groupBy("chunk").agg(F.collect_list(F.struct("lot", "n", "size", "packed")).alias("parts"))  # LOTS at most
    rows = stored.filter("lot = -1").join(parts, "chunk", "left")  # chunks lie in buckets: only the answers are shuffled

    def texts(head: tuple, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc_ids, counts, n, size, packed = head
        raw = _unzipped(size, packed)
        lots, codes = np.frombuffer(raw, np.uint8, n), _codes(raw, n, sum(counts))
        lengths, starts, flat, at = np.zeros(n, np.int64), np.zeros(n, np.int64), [np.zeros(0, np.int64)], 0
        for lot, m, size, packed in parts:
            raw = _unzipped(size, packed)
            own, of = np.flatnonzero(lots == lot), _numbers(raw, 0, m)
            lengths[own], starts[own] = of, at + np.cumsum(of) - of
            flat.append(_numbers(raw, 4 * m, int(of.sum())))
            at += len(flat[-1])
        flat = np.concatenate(flat)
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        step = 1 << 8
        for i in range(0, len(doc_ids), step):
            some = ends[i : i + step + 1]
            own = codes[some[0] : some[-1]]
            sums = np.concatenate([[0], np.cumsum(lengths[own])])
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i : i + step], pa.int64()), pa.ListArray.from_arrays(pa.array(sums[some - some[0]], pa.int32()), pa.array(joined(flat, starts[own], lengths[own]), pa.int32()))], ["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                head = tuple(batch.column(c)[row].as_py() for c in ("doc_ids", "counts", "n", "size", "packed"))
                yield from texts(head, [tuple(x.values()) for x in batch.column("parts")[row].as_py() or ()])

    return rows.select("doc_ids", "counts", "n", "size", "packed", "parts").mapInArrow(freeing(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids, text): the pieces of the ids in turn, without the blank put before a text. Ids outside the vocabulary raise an error; a null list gives the empty text. Rows stand for themselves; an empty table gives an empty one."""
    spelled = load_pieces(model_file).spelled
    lengths = np.array([len(x) for x in spelled], np.int64)
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(lengths) - lengths, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, lengths = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = part.column("ids")
                flat = ids.flatten().to_numpy()
                if len(flat) and flat.min() < 0:
                    raise IndexError(int(flat.min()))
                ends = np.concatenate([[0], np.cumsum(lengths[flat])])[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])]
                raw = joined(data, starts[flat], lengths[flat]).tobytes()
                texts = [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends.tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(freeing(run), "doc_id long, ids array<int>, text string")
