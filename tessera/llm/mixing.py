"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue, repeated for some epochs. A packet, which is a
document's copy or the part of it on one side of its source's target, has a virtual finish time: the
words of its source up to its own end, divided by the source's share of the budget. The mix is the
queue of all packets in order of virtual time, cut where all that has been served reaches the
budget. A source that runs out of epochs leaves its share to the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import WORD, written

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Ranges of virtual time up to the targets.
RANGES = 4096


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Per source (skey, source_size, weight, target): weighted shares of all words, at most epochs times the source's own.

    Sources in code-point order take the weights in turn. Sorted by epochs * size / weight, the
    sources that reach their ceiling come first; the rest share what those leave.
    One row per source meets in the windows, already summed up.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy("skey")) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy(F.col("ceiling") / F.col("weight"), "skey")
    ahead = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    return (
        ranked.withColumn("weight", weight)
        .withColumn("ceiling", F.col("source_size") * epochs)
        .withColumn("left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("ceiling").over(ahead), F.lit(0)))
        .withColumn("among", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
        .withColumn("full", F.col("left") * F.col("weight") >= F.col("ceiling") * F.col("among"))
        .withColumn("rest", F.sum("source_size").over(everyone) - F.coalesce(F.sum(F.when(F.col("full"), F.col("ceiling"))).over(everyone), F.lit(0)))
        .withColumn("sharing", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone))
        .withColumn("target", F.when(F.col("full"), F.col("ceiling").cast("double")).otherwise((F.col("rest") * F.col("weight")).cast("double") / F.col("sharing").cast("double")))
        .select("skey", "source_size", "weight", "target")
    )


def _packets(queued: DataFrame, epochs: int) -> DataFrame:
    """A row per packet: skey, before, epoch, piece, words, finish."""
    at = F.col("before") + F.col("source_size") * F.col("epoch")
    first = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - at)).cast("long")
    copies = queued.filter("size > 0").select("skey", "before", "size", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    pieces = F.array(F.struct(F.lit(0).alias("piece"), first.alias("words"), (at + first).alias("end")), F.struct(F.lit(1).alias("piece"), (F.col("size") - first).alias("words"), (at + F.col("size")).alias("end")))
    rows = copies.select("skey", "before", "epoch", "target", F.explode(pieces).alias("p")).filter("p.words > 0")
    return rows.select("skey", "before", "epoch", "p.piece", "p.words", (F.col("p.end").cast("double") / F.col("target")).alias("finish"))


def _cut(packets: DataFrame, budget: DataFrame) -> DataFrame:
    """One row, or none without words: the place in the order of packets (at) where the budget is used up, and the words still taken there.

    Packets are summed up by ranges of virtual time, of which equal ones hold about equally many
    words; only the range in which the budget is reached is put in order.
    """
    ranged = packets.withColumn("range", F.least(F.floor(F.col("finish") * RANGES), F.lit(2 * RANGES)))
    sums = ranged.groupBy("range").agg(F.sum("words").alias("words"))
    reached = sums.withColumn("upto", F.sum("words").over(W.orderBy("range"))).join(F.broadcast(budget))  # 2 * RANGES rows at most
    hit = reached.filter("upto >= budget").agg(F.min(F.struct("range", F.expr("budget - (upto - words)").alias("left"))).alias("hit")).select("hit.*")
    inside = ranged.join(F.broadcast(hit), "range").withColumn("at", F.struct("finish", "skey", "epoch", "before", "piece"))
    inside = inside.withColumn("ahead", F.sum("words").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)))
    last = F.expr("coalesce(ahead, 0) < left and coalesce(ahead, 0) + words >= left")
    return inside.filter(last).select("at", F.expr("left - coalesce(ahead, 0)").alias("part"))


def fair_queue(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, weight, target, before, virtual_finish (of its first copy), taken, in order of virtual_finish.

    before: the source's words ahead of it in the shuffled queue. taken: words of its packets that
    come before the cut, over all epochs. A packet ends where its source reaches its target, so each
    source gets the whole part of its target, and the few words that are then left of the budget go
    to the next packets. A null text has size 0; a null source is a source of its own, the last. Rows
    that repeat an id and size are interchangeable. An empty table gives an empty one. Other columns
    are left out. The running sums go by slices of the shuffle key, so that no task holds a source.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("skey"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))).alias("shuffled"),
    )
    sized = written(sized, "mix-sizes").withColumn("slice", F.substring("shuffled", 1, 3))
    slices = sized.groupBy("skey", "slice").agg(F.sum("size").alias("slice_size"))
    sources = source_targets(slices.groupBy("skey").agg(F.sum("slice_size").alias("source_size")), weights, epochs)
    ahead = W.partitionBy("skey").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = slices.withColumn("offset", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0))).join(sources, "skey").drop("slice_size")
    inside = W.partitionBy("skey", "slice").orderBy("shuffled", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    queued = sized.join(offsets, ["skey", "slice"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    queued = written(queued.drop("slice", "shuffled", "offset"), "mix-queue")
    cut = _cut(_packets(queued, epochs), sized.agg(F.sum("size").alias("budget")))
    rows = queued.join(F.broadcast(cut), how="left")
    taken = F.lit(0).cast("long")
    for epoch in range(epochs):
        at = F.col("before") + F.col("source_size") * epoch
        first = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - at)).cast("long")
        for piece, words, end in ((0, first, at + first), (1, F.col("size") - first, at + F.col("size"))):
            place = F.struct(F.try_divide(end.cast("double"), F.col("target")).alias("finish"), F.col("skey"), F.lit(epoch).alias("epoch"), F.col("before"), F.lit(piece).alias("piece"))
            taken = taken + F.when(words <= 0, 0).when(place < F.col("at"), words).when(place == F.col("at"), F.col("part")).otherwise(0)
    return rows.select(
        "doc_id", "source", "size", "source_size", "weight", "target", "before",
        F.try_divide((F.col("before") + F.col("size")).cast("double"), F.col("target")).alias("virtual_finish"),
        taken.cast("long").alias("taken"),
    ).orderBy("virtual_finish", "doc_id")


def mix_sequence(queue: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """The mix as training reads it: a row (doc_id, source, epoch, take, virtual_finish) per copy of fair_queue's rows that is taken, in order of virtual time. A document's words are taken from its first copy on. Nulls, ties and repeats as in fair_queue."""
    take = F.greatest(F.lit(0), F.least(F.col("size"), F.col("taken") - F.col("size") * F.col("epoch")))
    finish = F.try_divide((F.col("before") + F.col("source_size") * F.col("epoch") + F.col("take")).cast("double"), F.col("target"))
    return (
        queue.drop("virtual_finish")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("take", take.cast("long"))
        .filter("take > 0")
        .select("doc_id", "source", "epoch", "take", finish.alias("virtual_finish"))
        .orderBy("virtual_finish", "doc_id", "epoch")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it, to the nearest whole copy.

    Documents without words are neither paid for nor kept. Rows that repeat an id, a source and
    a size all get the most copies that one of them has.
    """
    queue = fair_queue(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    copies = queue.filter("taken > 0").groupBy("doc_id", "source", "size").agg(F.max(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).cast("int").alias("copies")).filter("copies > 0")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col(id_col).alias("own_id"), F.col(source_col).alias("own_source"), size.alias("own_size"))  # so that no column's name can clash
    kept = own.join(copies, F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size")))
    return kept.select("own", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("own.*")
