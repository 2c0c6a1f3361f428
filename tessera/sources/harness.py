"""What a test harness reads: programs, hexadecimal fragments, manifests, registries of errors, trace and profile lines.

Lines and documents come as text columns, so each of these is a plan over any table. Malformed
input never raises by itself: it gives a null, no row, or a row in a table of violations, as said.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def programs(spark: SparkSession, path: str, suffix: str = "cj") -> DataFrame:
    """(path, source) of the program files under a folder, a row per file, which a task reads whole; no such file, no rows."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=f"*.{suffix}", recursiveFileLookup=True)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("source"))


def hex_fragments(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """The lines with fragment (binary) and valid: pairs of hexadecimal digits, an empty line being an empty fragment. An odd length, another sign or a null line is not valid, its fragment null."""
    good = F.coalesce(F.col(raw).rlike(r"^(?:[0-9A-Fa-f]{2})*$"), F.lit(False))
    return lines.withColumn("fragment", F.when(good, F.unhex(raw))).withColumn("valid", good)


CASES = "array<struct<name: string, family: string, file: string, expected: string, complete: boolean, oracle: boolean, stage: string, safe_prefix_bytes: bigint, source_sha256: string, covers: array<string>>>"


def manifest_cases(manifests: DataFrame, json: str = "json") -> DataFrame:
    """A row per case of manifests {schema_version, case_count, cases}: manifest (a hash of its text), schema_version, case_count, place, the case's members, oracle true and stage by complete and expected where they aren't given. Malformed JSON and manifests without cases have no rows."""
    parsed = F.from_json(json, f"schema_version int, case_count bigint, cases {CASES}")
    rows = manifests.select(F.xxhash64(json).alias("manifest"), parsed.alias("m")).select("manifest", "m.schema_version", "m.case_count", F.posexplode("m.cases").alias("place", "c")).select("manifest", "schema_version", "case_count", "place", "c.*")
    stage = F.when(~F.col("complete"), "prefix").when(F.col("expected") == "accept", "accept").otherwise("semantic")
    return rows.withColumn("oracle", F.coalesce("oracle", F.lit(True))).withColumn("stage", F.coalesce("stage", stage))


def manifest_violations(cases: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(name, rule) for each rule that a case of manifest_cases breaks; none for a sound manifest.

    sources (file, source) adds the rules about the text: it must be there, with the declared SHA-256
    and the safe prefix inside it. Names and files must be unique over all rows.
    """
    bad = lambda condition: F.coalesce(condition, F.lit(True))  # noqa: E731  a null breaks the rule
    reject, accept = F.col("expected") == "reject", F.col("expected") == "accept"
    rules = {
        "schema": bad(~F.col("schema_version").isin(1, 2, 3)),
        "count": bad(F.col("case_count") < 0),
        "name": bad(F.col("name") == ""),
        "family": bad(F.col("family") == ""),
        "file": bad(~F.col("file").rlike(r"\.cj$")),
        "path": bad(F.col("file").rlike(r"^/|(^|/)\.\.(/|$)")),
        "expected": bad(~F.col("expected").isin("accept", "reject")),
        "complete": F.col("complete").isNull(),
        "stage": bad(~F.col("stage").isin("accept", "prefix", "semantic", "syntax")),
        "incomplete": F.coalesce(~F.col("complete") & (~accept | F.col("oracle") | (F.col("stage") != "prefix")), F.lit(False)),
        "accept stage": F.coalesce(F.col("complete") & accept & (F.col("stage") != "accept"), F.lit(False)),
        "reject stage": F.coalesce(F.col("complete") & reject & ~F.col("stage").isin("semantic", "syntax"), F.lit(False)),
        "safe prefix": F.coalesce(reject, F.lit(False)) & bad(F.col("safe_prefix_bytes") < 0) | F.coalesce(accept, F.lit(False)) & F.col("safe_prefix_bytes").isNotNull(),
        "declared sha256": F.coalesce(~F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
    }
    rows = cases
    if sources is not None:
        rows = rows.join(sources.select("file", F.col("source").alias("text")).dropDuplicates(["file"]), "file", "left")
        prefix = F.substring(F.encode("text", "UTF-8"), F.lit(1), F.col("safe_prefix_bytes").cast("int"))
        rules |= {
            "source": F.col("text").isNull(),
            "sha256": F.coalesce(F.sha2("text", 256) != F.col("source_sha256"), F.lit(False)),
            "prefix length": F.coalesce(reject & (F.col("safe_prefix_bytes") >= F.octet_length("text")), F.lit(False)),
            "prefix cuts a character": F.coalesce(reject & ~F.is_valid_utf8(prefix.cast("string")), F.lit(False)),
        }
    broken = F.filter(F.array(*(F.when(condition, F.lit(rule)) for rule, condition in rules.items())), lambda x: x.isNotNull())
    out = rows.select("name", F.explode(broken).alias("rule"))
    for column in ("name", "file"):
        twice = cases.groupBy(column).agg(F.count("*").alias("times"), F.min("name").alias("first")).filter("times > 1")
        out = out.unionByName(twice.select(F.col("first").alias("name"), F.lit(f"duplicate {column}").alias("rule")))
    counts = cases.groupBy("manifest", "case_count").agg(F.count("*").alias("n")).filter("n <> case_count")
    return out.unionByName(counts.select(F.lit(None).cast("string").alias("name"), F.lit("case count").alias("rule")))


def first_errors(registries: DataFrame, json: str = "json") -> DataFrame:
    """(name, first_error_token_index) of the registries' wrong_examples; valid is false where an entry lacks its index. Malformed JSON has no rows."""
    parsed = F.from_json(json, "wrong_examples array<struct<name: string, first_error_token_index: bigint>>")
    rows = registries.select(F.explode(parsed["wrong_examples"]).alias("e")).select("e.*")
    return rows.withColumn("valid", F.col("first_error_token_index").isNotNull() & F.col("name").isNotNull())


def trace_events(lines: DataFrame, line: str = "line", event: str = "fire", members: str = "event string, token bigint, message string, symbol string") -> DataFrame:
    """The lines, with the members of the JSON object that each is, of one event. Lines that don't start with '{' or don't parse are left out."""
    rows = lines.filter(F.startswith(F.col(line), F.lit("{"))).withColumn("parsed", F.from_json(line, members))
    return rows.filter(F.col("parsed.event") == event).select(*lines.columns, "parsed.*")


def profile_counters(lines: DataFrame, run: str, line: str = "line", marker: str = "PROFILE ", prefix: str = "") -> DataFrame:
    """(run, payloads, counters map<string, bigint>): the counters of the one line of a run that starts with a marker, their names after a prefix; null where a run has no such line or several, whose number payloads is. Values that are no numbers are null."""
    payload = F.when(F.startswith(F.col(line), F.lit(marker)), F.substring(F.col(line), F.lit(len(marker) + 1), F.length(line)))
    rows = lines.groupBy(run).agg(F.count(payload).alias("payloads"), F.max(payload).alias("payload"))
    counters = F.transform_keys(F.from_json("payload", "map<string,bigint>"), lambda k, _: F.concat(F.lit(prefix), k))
    return rows.select(run, "payloads", F.when(F.col("payloads") == 1, counters).alias("counters"))


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    """Once a worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Bytes of the texts that go to a tokenizer at a time; a longer text goes alone.
ENCODED_BYTES = 500_000


def encoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The ids (id, ids) of batches of (id, text), ENCODED_BYTES of texts at a time: what a tokenizer tells of a token takes many times its bytes."""
    tokenizer = _tokenizer(path)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        at = 0
        while at < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 10_000], dtype=np.int64), ENCODED_BYTES, "right")))
            part = batch.slice(at, n)
            found = tokenizer.encode_batch_fast([t or "" for t in part.column(1).to_pylist()], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([e.ids for e in found], pa.list_(pa.int32()))], ["id", "ids"])
            at += n


def token_ids(sources: DataFrame, id_col: str, text_col: str, tokenizer_path: str) -> DataFrame:
    """(id, seq, token_id): the ids of each text by a tokenizer's file, in order. A null or empty text has none. Texts go to the tokenizer by parts of Arrow batches; its file must be readable where tasks run."""
    kind = sources.schema[id_col].dataType.simpleString()
    rows = sources.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: encoded(batches, tokenizer_path), f"id {kind}, ids array<int>")
    return rows.select(F.col("id").alias(id_col), F.posexplode("ids").alias("seq", "token_id"))
