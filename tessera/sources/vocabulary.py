"""Token tables, and streams of token ids decoded against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lexing import token_id


def decode_ids(lines: DataFrame, vocabulary: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds token_id and bytes to lines of ids; bytes is null, and found false, where a line is no id or the table lacks it. The optimizer broadcasts a table that is small."""
    table = vocabulary.select(F.col("token_id").alias("__id"), "bytes").dropDuplicates(["__id"])
    rows = lines.withColumn("token_id", token_id(F.col(raw)))
    return rows.join(table, F.col("token_id") == F.col("__id"), "left").drop("__id").withColumn("found", F.col("bytes").isNotNull())


def byte_vocabulary(spark) -> DataFrame:
    """The table of 256 ids that stand for a byte each."""
    return spark.range(256).select(F.col("id").alias("token_id"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("bytes"))
