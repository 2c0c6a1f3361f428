"""A training corpus from documents: toxic documents go, one of each group of near copies stays, shared passages are cut, sources are mixed to their weights, and the texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, sentencepiece_lattice, substring_dedup, toxicity
from tessera.llm.base import small_batches
from tessera.sources.folders import forget, shared_folder, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores as toxic go, by labels outside of the held-out quarter; null and empty texts stay or go by the score of a text without words. Repeated rows fare alike; an empty table stays empty."""
    with small_batches(spark):
        model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows without an id or without words stay. Repeats as in one_of_each_group."""
    with small_batches(spark):
        return ngram_join.one_of_each_group(docs)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has, too, are cut from the texts; a document of which nothing is left goes. Nulls stay; repeats as in without_passages."""
    with small_batches(spark):
        passages = stored(substring_dedup.shared_passages(docs), "passages")  # what is lazy runs later, in batches of any size
    return substring_dedup.without_passages(docs, passages)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to weights 5, 2, 1 takes it, to the nearest whole copy; without words it goes. Nulls and repeats as in mixed_documents."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of each text; null and empty texts have no ids. Repeated rows stand for themselves."""
    import public_tokenizers

    return sentencepiece_lattice.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("shared_passages", cut_shared_passages),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The labels are learnt from and the ids follow a fitted vocabulary: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents. Each stage is written to the shared folder and read again; a stage's folder goes when the next one is written. An empty table gives an empty one."""
    path, before = f"{sf_dir}/documents.parquet", None
    for name, stage in STAGES:
        out = shared_folder(spark, f"stage-{name}")
        stage(spark, spark.read.parquet(path), sf_dir).write.parquet(out)
        if before:
            forget(spark, before)
        path = before = out
    return spark.read.parquet(path)
