"""What a checker hands on: verdicts as text, traces and ledgers as JSON lines, statistics, catalogs, corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def result_text(verdicts: DataFrame, stream: str, order: str = "seq", token: str = "token", syntax: str = "syntax", semantic: str = "semantic", message: str = "message") -> DataFrame:
    """(stream, text): a stream's tokens, syntax bits and semantic bits as lines of a report, and the message of its last step if there is one. Null tokens and bits are empty. One stream's steps meet in a group."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("token", token), ("syntax", syntax), ("semantic", semantic))), F.col(message).alias("message"))))
    rows = verdicts.groupBy(stream).agg(steps.alias("steps"))
    joined = lambda part, sep: F.array_join(F.transform("steps", lambda x: x[part]), sep)
    last = F.element_at("steps", -1)["message"]
    # The labels of the report's lines.
    lines = F.concat(F.lit("token: "), joined("token", " "), F.lit("\n语法: "), joined("syntax", ", "), F.lit("\n语义: "), joined("semantic", ", "))
    return rows.select(stream, F.concat(lines, F.when(F.length(last) > 0, F.concat(F.lit("\n错误: "), last)).otherwise("")).alias("text"))


def event_lines(rows: DataFrame, event: str, *columns: str) -> DataFrame:
    """(line): each row as a JSON object, the event first, then the columns in their order; nulls are left out. event 'fire' makes traces of rejects, 'ledger' the decisions."""
    return rows.select(F.to_json(F.struct(F.lit(event).alias("event"), *columns)).alias("line"))


def with_stats(rows: DataFrame, found: str, cached: str) -> tuple[DataFrame, Observation]:
    """The same rows, and what a run over them observes on its way, without another pass: queries, witness_found and cache_hits. Nulls are false."""
    seen = Observation()
    return rows.observe(seen, F.count("*").alias("queries"), F.count_if(F.coalesce(found, F.lit(False))).alias("witness_found"), F.count_if(F.coalesce(cached, F.lit(False))).alias("cache_hits")), seen


def run_stats(rows: DataFrame, found: str, cached: str) -> DataFrame:
    """(line): the statistics of with_stats as the JSON line that ends a run; zeros for an empty table."""
    stats = rows.agg(F.lit("stats").alias("event"), F.count("*").alias("queries"), F.count_if(F.coalesce(cached, F.lit(False))).alias("cache_hits"), F.count_if(F.coalesce(found, F.lit(False))).alias("witness_found"))
    return stats.select(F.to_json(F.struct("event", "queries", "cache_hits", "witness_found")).alias("line"))


def catalog_lines(signatures: DataFrame) -> DataFrame:
    """(owner, line): the members of an owner as one JSON object with sorted names, each with its overloads in order; global functions under ''. Rows in any order give the same text."""
    overload = F.struct("overload", "type_params", "param_types", "required", "result")
    members = signatures.groupBy(F.coalesce("owner", F.lit("")).alias("owner"), "section", "name").agg(F.array_sort(F.collect_list(overload)).alias("sigs"))
    listed = F.array_sort(F.collect_list(F.struct("section", "name", "sigs")))
    return members.groupBy("owner").agg(F.to_json(F.struct(F.col("owner"), listed.alias("members"))).alias("line"))


def write_corpus(cases: DataFrame, path: str) -> None:
    """Writes cases (name, family, expected, complete, source) in folders group=valid, invalid or prefix, as file names family__name.cj with their sources. A folder that is there already is an error."""
    group = F.when(~F.col("complete"), "prefix").when(F.col("expected") == "accept", "valid").otherwise("invalid")
    file = F.concat("family", F.lit("__"), "name", F.lit(".cj"))
    cases.select(group.alias("group"), file.alias("file"), "source").write.mode("errorifexists").partitionBy("group").parquet(path)
