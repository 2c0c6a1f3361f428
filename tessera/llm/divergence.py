"""How the sources of a language differ in their vocabulary: exact document frequencies first, then an automaton over the kept terms counts their occurrences.

A text is bytes with every byte that belongs to no term made a blank, so a kept term padded with a
blank on either side is found exactly where it stands as a whole term, and a pattern's end is the
next one's start. The automata are built in the tasks, from blocks of the kept terms of bounded
size, one pass over the texts a block. What is counted is sparse: a row per group and term that occurs.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut, freed, small_batches, written

#: A term is kept by a language in which this many documents have it; the shown terms of a group; what is added to each count; the scale of shares.
MIN_DOCS, TOP, PRIOR, SCALE = 30, 50, 5, 1_000_000_000
#: Bytes of kept terms in a block, and so in a broadcast; numbers that a task holds before it passes them on.
BLOCK_BYTES, HELD = 4_000_000, 2_000_000

_BLANKS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
    """lang, source and text with blanks between its terms, A-Z as a-z."""
    for batch in cut(batches, "text"):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            yield lang, source, text.as_py().translate(_BLANKS)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): in how many documents of a language a term occurs. Each task sums up what it has read; docs are those of groups()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = lambda: sum(map(len, held.values()))

        def out() -> Iterator[pa.RecordBatch]:
            for lang, terms in held.items():
                names, counts = pa.array(terms.keys(), pa.binary()), pa.array(terms.values(), pa.int64())
                for at in range(0, len(names), 50_000):
                    part = names[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part.cast(pa.string()), counts[at : at + 50_000]], ["lang", "term", "docs"])
            held.clear()

        for i, (lang, _, text) in enumerate(_texts(batches)):
            held.setdefault(lang, Counter()).update(set(text.split()))
            if i % 100 == 0 and size() > HELD // 4:
                yield from out()
        yield from out()

    found = docs.mapInArrow(lambda b: freed(run(b)), "lang string, term string, docs long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def groups(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source and text, nulls as empty texts; other columns are left out."""
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The stored terms that at least min_docs documents of a language have: lang, term, and an id that ascends by language and by the term's bytes."""
    kept = written(document_frequencies(docs).filter(F.col("docs") >= min_docs).select("lang", "term"), "divergence-kept")
    return written(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").select("lang", "term", F.monotonically_increasing_id().alias("id")), "divergence-terms")


def _blocks(terms: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """terms with a block each, none of more than block_bytes unless it is one term, and how many blocks there are."""
    total = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    n = -(-total // block_bytes)
    while n > 1:
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
        sizes = dealt.groupBy("block").agg(F.sum(F.octet_length("term")).alias("bytes"), F.count("*").alias("terms"))
        if not sizes.filter(f"bytes > {block_bytes} and terms > 1").limit(1).count():
            return dealt, n
        n += 1 + n // 4
    return terms.withColumn("block", F.lit(0).cast("long")), n


#: Of a worker, the automata of the last broadcast block: language to automaton and ids.
_automata: dict[str, dict[str, tuple[ahocorasick.Automaton, np.ndarray]]] = {}


def _automaton(key: str, lang: str, shared: Broadcast) -> tuple[ahocorasick.Automaton, np.ndarray] | None:
    if key not in _automata:
        _automata.clear()
    own = _automata.setdefault(key, {})
    if lang not in own and lang in shared.value:
        names, ids = shared.value[lang]
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, name in enumerate(names):
            found.add_word(f" {name} ", i)
        found.make_automaton()
        own[lang] = found, np.array(ids, np.int64)
    return own.get(lang)


def occurrences(docs: DataFrame, terms: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The stored counts of kept_terms' terms by group: lang, source, id, n, for the terms that occur. A pass over the texts for each block of terms."""
    spark = docs.sparkSession
    dealt, blocks = _blocks(terms, block_bytes)
    parts = []
    for number in range(blocks):
        block: dict[str, tuple[list[str], list[int]]] = {}
        for row in dealt.filter(F.col("block") == number).toLocalIterator():  # one block's terms, block_bytes at most
            names, ids = block.setdefault(row["lang"], ([], []))
            names.append(row["term"])
            ids.append(row["id"])
        shared = spark.sparkContext.broadcast(block)
        parts.append(written(_counted(docs, shared, uuid.uuid4().hex), "divergence-counts"))
        shared.unpersist()
    if not parts:
        return spark.createDataFrame([], "lang string, source string, id long, n long")
    counts = parts[0]
    for more in parts[1:]:
        counts = counts.unionByName(more)
    return counts


def _counted(docs: DataFrame, shared: Broadcast, key: str) -> DataFrame:
    """Counts of a block's terms; key names the block among those that a worker sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: dict[tuple[str, str], list[np.ndarray]] = {}
        sums: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
        pending = 0

        def summed_up() -> int:
            """Puts what was hit to the sums; the sums' entries."""
            for group, found in hits.items():
                ids, counts = sums.get(group, (np.zeros(0, np.int32), np.zeros(0, np.int64)))
                more, n = np.unique(np.concatenate(found), return_counts=True)
                both, at = np.unique(np.concatenate([ids, more]), return_inverse=True)
                total = np.zeros(len(both), np.int64)
                np.add.at(total, at, np.concatenate([counts, n]))
                sums[group] = both, total
            hits.clear()
            return sum(len(ids) for ids, _ in sums.values())

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (ids, counts) in sums.items():
                same = lambda name: pa.array([name] * len(ids), pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(_automaton(key, lang, shared)[1][ids]), pa.array(counts)], ["lang", "source", "id", "n"])
            sums.clear()

        for lang, source, text in _texts(batches):
            found = _automaton(key, lang, shared)
            if not found:
                continue
            own = np.array([i for _, i in found[0].iter(f" {text.decode()} ")], np.int32)
            if len(own):
                hits.setdefault((lang, source), []).append(own)
                pending += len(own)
            if pending > HELD:
                pending = 0
                if summed_up() > HELD:
                    yield from out()
        summed_up()
        yield from out()

    found = docs.mapInArrow(lambda b: freed(run(b)), "lang string, source string, id long, n long")
    return found.groupBy("lang", "source", "id").agg(F.sum("n").alias("n"))


def _share(count: Column, out_of: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / out_of), in whole numbers of 38 digits."""
    return 1 + F.call_function("div", (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE), out_of.cast("decimal(20,0)"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_bytes: int = BLOCK_BYTES, **columns: str) -> DataFrame:
    """lang, source, part, item, value, rank: for each group (lang, source) the other sources of its language by their distance (part pair), and the kept terms that it has more often than the language, by how much, top of them (part term).

    Shares are smoothed counts in billionths. The distance of two sources is the sum over all kept terms of what their
    shares differ by, 0 without kept terms. Ranks go by value, descending, then by the item's bytes. A null text, language
    or source is an empty one. Repeated rows are documents of their own. An empty table gives an empty one.
    """
    docs = groups(docs, **columns)
    with small_batches(docs.sparkSession):
        terms = kept_terms(docs, min_docs)
        counts = occurrences(docs, terms, block_bytes)
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
    size = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    own = docs.select("lang", "source").distinct().join(size, ["lang", "source"], "left").join(kept, "lang", "left")
    total = F.coalesce("size", F.lit(0)) + PRIOR * F.col("v")
    number = F.row_number().over(W.partitionBy("lang").orderBy("source"))  # a row per source
    own = own.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), total.alias("total"), number.alias("s"), F.sum("size").over(W.partitionBy("lang")).alias("all"))
    own = written(own.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total")))), "divergence-groups")
    shares = counts.join(own, ["lang", "source"]).select("lang", "source", "s", "id", "n", "p0", _share(F.col("n"), F.col("total")).alias("p"), (F.col("all") + PRIOR * F.col("v")).alias("all_total"))
    shares = written(shares, "divergence-shares")
    return _pairs(own, shares).unionByName(_ranked_terms(shares, terms, top))


def _pairs(own: DataFrame, shares: DataFrame) -> DataFrame:
    """Distances from sparse postings.

    Over the terms of neither source both shares are the groups' least ones, p0, which lie d apart. Terms of
    one source add what they differ from d by, from the group's different shares; only for terms of both, the
    pairs of a posting, the difference of the difference is summed up.
    """
    a, b = (own.select("lang", F.col("s").alias(f"s_{x}"), F.col("p0").alias(f"p0_{x}"), F.col("source").alias(f"source_{x}"), F.col("v").alias(f"v_{x}")) for x in "ab")
    both = a.join(b, "lang").filter("s_a <> s_b").withColumn("d", F.abs(F.col("p0_a") - F.col("p0_b")))
    levels = shares.groupBy("lang", F.col("s").alias("s_a"), "p").agg(F.count("*").alias("terms"))
    one = levels.join(both, ["lang", "s_a"]).groupBy("lang", "s_a", "s_b").agg(F.sum(F.col("terms") * (F.abs(F.col("p") - F.col("p0_b")) - F.col("d"))).alias("one"))
    posting = shares.groupBy("lang", "id").agg(F.sort_array(F.collect_list(F.struct("s", "p", "p0"))).alias("x"))  # an entry a source at most
    more = "abs(a.p - b.p) - abs(a.p - b.p0) - abs(b.p - a.p0) + abs(a.p0 - b.p0)"
    pairs = posting.selectExpr("lang", f"inline(flatten(transform(x, (a, i) -> transform(slice(x, i + 2, size(x)), b -> struct(a.s as s_a, b.s as s_b, {more} as more)))))")
    pairs = pairs.groupBy("lang", "s_a", "s_b").agg(F.sum("more").alias("value"))
    swapped = lambda df, value: df.select("lang", F.col("s_b").alias("s_a"), F.col("s_a").alias("s_b"), F.col(value).alias("value"))
    least = both.select("lang", "s_a", "s_b", (F.col("v_a") * F.coalesce("d", F.lit(0))).alias("value"))
    parts = least.unionByName(one.withColumnRenamed("one", "value")).unionByName(swapped(one, "one")).unionByName(pairs).unionByName(swapped(pairs, "value"))
    sums = parts.groupBy("lang", "s_a", "s_b").agg(F.sum("value").cast("long").alias("value"))
    found = sums.join(both.select("lang", "s_a", "s_b", "source_a", "source_b"), ["lang", "s_a", "s_b"])
    rank = F.row_number().over(W.partitionBy("lang", "source_a").orderBy(F.desc("value"), "source_b"))
    return found.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value", rank.alias("rank"))


def _ranked_terms(shares: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    overall = shares.groupBy("lang", "id").agg(F.sum("n").alias("all_n"))
    both = shares.join(overall, ["lang", "id"]).select("lang", "source", "id", (F.col("p") - _share(F.col("all_n"), F.col("all_total"))).alias("value")).filter("value > 0")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "id"))  # the first of each task, then the first of those
    first = both.withColumn("rank", rank).filter(F.col("rank") <= top)
    return first.join(terms.select("id", "term"), "id").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
