"""Queries of a checker's test harness over the tables: cases from documents, runs and traces from events, catalogs from nations and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import lexing
from tessera.operators import reports, summaries, symbols, types
from tessera.sinks import lines
from tessera.sources import context, harness, token_table
from tessera.sources.folders import shared_folder
from tessera.streaming import lexer

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Documents as cases: a family per source, named by language, size and id."""
    return _t(spark, d, "documents").selectExpr("doc_id", "source as family", "concat(lang, '-', n_chars, '-', doc_id) as name", "if(doc_id % 3 = 0, 'reject', 'accept') as expected", "doc_id % 5 <> 0 as complete", "text as source")


_CASES = "c AS (SELECT doc_id, source AS family, lang || '-' || n_chars || '-' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'reject' ELSE 'accept' END AS expected, doc_id % 5 <> 0 AS complete, text AS source FROM documents)"


@_query(f"WITH {_CASES} SELECT doc_id, family, name FROM c WHERE family IN ('src0', 'src1', 'src2', 'src3') AND family NOT IN ('src3') AND contains(name, '-1')")
def select_cases(spark, d):
    return reports.select_cases(_cases(spark, d), ("src0", "src1", "src2", "src3"), ("src3",), "-1").select("doc_id", "family", "name")


@_query(f"WITH {_CASES} SELECT doc_id, family, name FROM c ORDER BY family NULLS FIRST, name NULLS FIRST, doc_id LIMIT 200")
def first_cases(spark, d):
    return reports.first_rows(_cases(spark, d).select("doc_id", "family", "name"), 200, "family", "name", "doc_id")


@_query("SELECT event_type, json_keys(props)[1] AS counter, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) AS records FROM events WHERE props->>'$.k' IS NOT NULL GROUP BY ALL")
def counter_sums(spark, d):
    return reports.sum_counters(_t(spark, d, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("counters")), "counters", "event_type")


@_query(
    """SELECT user_id, event_type, 3::BIGINT AS planned, count(*) AS observed, count(*) FILTER (NOT value > 100) AS completed, count(*) FILTER (value > 100) AS timed_out, count(*) FILTER (value < 50) AS ok,
    greatest(0, 3 - count(*))::BIGINT AS missing, median(value) FILTER (NOT value > 100) AS median_took FROM events GROUP BY ALL"""
)
def trial_counts(spark, d):
    runs = _t(spark, d, "events").select("user_id", "event_type", (F.col("value") > 100).alias("timed_out"), (F.col("value") < 50).alias("ok"), F.col("value").alias("took"))
    return reports.trial_counts(runs, 3, ("user_id", "event_type"))


_BITS = "b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, (value >= 100)::INT AS bit, (value >= 101)::INT AS other FROM events)"


def _bits(spark, d):
    rows = _t(spark, d, "events").selectExpr("user_id", "row_number() over (partition by user_id order by ts, event_id) - 1 as seq", "cast(value >= 100 as int) as bit", "cast(value >= 101 as int) as other")
    return rows.select("user_id", F.col("seq").cast("long").alias("seq"), "bit", "other")


@_query(f"WITH {_BITS} SELECT user_id, count(*) AS n, count(*) FILTER (bit + (1 - other) <> 1) AS errors, bool_and(bit + (1 - other) = 1) AS inverted FROM b GROUP BY user_id")
def inversion_errors(spark, d):
    bits = _bits(spark, d)
    return reports.inversion_errors(bits.select("user_id", "seq", "bit"), bits.select("user_id", "seq", (1 - F.col("other")).alias("bit")), "user_id")


@_query(
    """SELECT conv_id, count(*) AS n, sha256(unhex(string_agg(lpad(to_hex(strlen(coalesce(text, ''))), 16, '0') || hex(coalesce(text, '')), '' ORDER BY turn, lpad(to_hex(strlen(coalesce(text, ''))), 16, '0') || hex(coalesce(text, ''))))) AS digest FROM conversations GROUP BY conv_id"""
)
def transcript_digests(spark, d):
    return reports.transcript_digest(_t(spark, d, "conversations"), "conv_id", "turn", "text")


@_query(
    """WITH l AS (SELECT sha256(page_id::VARCHAR) AS b, page_id::VARCHAR || chr(0) || sha256(coalesce(html, '')) || chr(0) AS line FROM pages),
    five AS (SELECT substr(b, 1, 5) AS b, substr(b, 1, 5) || sha256(string_agg(line, '' ORDER BY line)) AS line, count(*) AS n FROM l GROUP BY substr(b, 1, 5)),
    three AS (SELECT substr(b, 1, 3) AS b, substr(b, 1, 3) || sha256(string_agg(line, '' ORDER BY line)) AS line, sum(n) AS n FROM five GROUP BY substr(b, 1, 3))
    SELECT coalesce(sum(n), 0)::BIGINT AS n, sha256(coalesce(string_agg(line, '' ORDER BY line), '')) AS digest FROM three"""
)
def corpus_digest(spark, d):
    return reports.corpus_digest(_t(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), "html"), "path", "html")


@_query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def keyed_lookup(spark, d):
    return reports.lookup(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id", "quality", "toxic")


@_query(
    """WITH s AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value < 30) AS passed FROM events GROUP BY ALL)
    SELECT user_id, event_type, n, passed, passed::DOUBLE / n::DOUBLE AS ratio FROM s WHERE passed::DOUBLE / n::DOUBLE < 0.5 AND event_type <> 'error'"""
)
def below_threshold(spark, d):
    events = _t(spark, d, "events")
    return reports.below_threshold(events, ("user_id", "event_type"), F.col("value") < 30, 0.5, events.filter("event_type = 'error'").select("user_id", "event_type"))


@_query("SELECT category, count(*) AS n, starts_with(category, 'BUG_') AS fatal FROM (SELECT CASE WHEN l_discount > 0.05 THEN 'BUG_' ELSE 'EXPECTED_' END || l_shipmode_ AS category FROM (SELECT l_discount, l_returnflag AS l_shipmode_ FROM lineitem)) GROUP BY category")
def category_gate(spark, d):
    rows = _t(spark, d, "lineitem").select(F.concat(F.when(F.col("l_discount") > 0.05, "BUG_").otherwise("EXPECTED_"), "l_returnflag").alias("category"))
    return reports.gate(rows, "category")


@_query(
    """WITH p AS (SELECT user_id AS member, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' WHEN 'purchase' THEN 'C' END AS probe, value < 4 AS ok, value > 60 AS uncallable FROM events),
    g AS (SELECT member, coalesce(bool_or(ok) FILTER (probe = 'A'), false) AS a, coalesce(bool_or(ok) FILTER (probe = 'B'), false) AS b, coalesce(bool_or(ok) FILTER (probe = 'C'), false) AS c, coalesce(bool_or(uncallable) FILTER (probe = 'B'), false) AS u FROM p GROUP BY member)
    SELECT member, a, b, c, CASE WHEN a AND NOT b AND u AND NOT c THEN 'field' WHEN NOT a AND b AND c THEN 'method' WHEN a AND b THEN 'callable_field' WHEN NOT a AND NOT b AND NOT c THEN 'error' ELSE 'special' END AS kind FROM g"""
)
def probe_kinds(spark, d):
    probe = F.when(F.col("event_type") == "view", "A").when(F.col("event_type") == "click", "B").when(F.col("event_type") == "purchase", "C")
    code = F.when(F.col("value") > 60, "E_SYNTH_NOT_CALLABLE").otherwise("E_OTHER")
    rows = _t(spark, d, "events").select(F.col("user_id").alias("member"), probe.alias("probe"), F.when(F.col("value") < 4, "ACCEPT").otherwise("REJECT").alias("verdict"), code.alias("code"))
    return reports.classify_probes(rows, ("member",))


_RESULTS = "r AS (SELECT o_custkey AS case_id, o_orderpriority AS layout, o_totalprice < 300000 AS accepted, o_orderkey % 97 AS reject_byte, o_custkey % 41 AS mutation_start, o_orderkey % 2 = 0 AS expected_valid FROM orders)"


def _results(spark, d):
    return _t(spark, d, "orders").selectExpr("o_custkey as case_id", "o_orderpriority as layout", "o_totalprice < 300000 as accepted", "o_orderkey % 97 as reject_byte", "o_custkey % 41 as mutation_start", "o_orderkey % 2 = 0 as expected_valid")


@_query(f"WITH {_RESULTS} SELECT case_id, count(DISTINCT layout) AS layouts, count(DISTINCT coalesce(accepted::INT, -1)) AS verdicts, count(DISTINCT coalesce(accepted::INT, -1)) = 1 AS invariant FROM r GROUP BY case_id")
def fragmentation_invariance(spark, d):
    return reports.fragmentation_invariance(_results(spark, d), "case_id")


@_query(f"WITH {_RESULTS} SELECT * FROM r WHERE NOT expected_valid AND reject_byte <= mutation_start")
def premature_rejects(spark, d):
    return reports.premature_rejects(_results(spark, d))


@_query(
    """WITH b AS (SELECT event_type AS case_id, user_id AS run, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS seq, (value >= 150)::INT AS bit FROM events),
    n AS (SELECT case_id, count(DISTINCT run) AS runs FROM b GROUP BY case_id), g AS (SELECT case_id, seq, count(DISTINCT run) FILTER (bit = 0) AS good FROM b GROUP BY ALL),
    f AS (SELECT case_id, min(s) AS common FROM (SELECT n.case_id, s FROM n, range(0, 3000) t(s) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.case_id = n.case_id AND g.seq = s AND g.good = n.runs)) GROUP BY case_id)
    SELECT case_id, runs, common FROM n JOIN f USING (case_id)"""
)
def common_prefix(spark, d):
    rows = _t(spark, d, "events").selectExpr("event_type as case_id", "user_id as run", "cast(row_number() over (partition by event_type, user_id order by ts, event_id) - 1 as bigint) as seq", "cast(value >= 150 as int) as bit")
    return reports.common_prefix(rows, "case_id", "run")


@_query(
    """WITH p AS (SELECT c_custkey AS case_id, c_custkey % 4 AS control, c_nationkey % 3 AS candidate FROM customer),
    t AS (SELECT case_id, 'control' AS role, 0 AS k, unnest(range(1, control + 1)) AS repetition FROM p UNION ALL SELECT case_id, 'candidate', 1, unnest(range(1, candidate + 1)) FROM p)
    SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY repetition, k) - 1 AS place, role, repetition FROM t"""
)
def interleaved_schedule(spark, d):
    plan = _t(spark, d, "customer").selectExpr("c_custkey as case_id", "cast(c_custkey % 4 as int) as control", "c_nationkey % 3 as candidate")
    return reports.interleaved(plan.withColumns({"control": F.col("control"), "candidate": F.col("candidate")}), "case_id")


@_query(f"WITH {_CASES} SELECT doc_id, name FROM c WHERE NOT coalesce(try_cast(split_part(name, '-', 2) AS BIGINT) > CASE family WHEN 'src0' THEN 1500 WHEN 'src1' THEN 4000 END, false)")
def within_scale(spark, d):
    return reports.within_scale(_cases(spark, d), {"src0": (1, 1500), "src1": (1, 4000)}).select("doc_id", "name")


@_query(f"WITH {_CASES} SELECT doc_id, row_number() OVER (ORDER BY family NULLS FIRST, expected, name NULLS FIRST, doc_id) - 1 AS place FROM c")
def cases_in_order(spark, d):
    return reports.in_order(_cases(spark, d).select("doc_id", "family", "expected", "name"), "family", "expected", "name", "doc_id").select("doc_id", "place")


@_query("SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return reports.duplicates(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@_query("SELECT event_id, user_id % 2 = 0 AS fatal FROM events")
def expectation_policy(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "authoritative").otherwise("generated").alias("tier"))
    return reports.split_by_policy(rows).select("event_id", "fatal")


@_query(
    """WITH s AS (SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS tokens, round(sum(l_extendedprice::DECIMAL(30,6)), 2)::DOUBLE AS slow_ms, round(sum(l_discount::DECIMAL(30,6)), 2)::DOUBLE AS fast_ms FROM lineitem GROUP BY ALL),
    m AS (SELECT *, CASE WHEN fast_ms > 0 THEN slow_ms / fast_ms ELSE 0 END AS speedup, CASE WHEN tokens > 0 THEN fast_ms * 1000 / tokens ELSE 0 END AS us_per_token FROM s)
    SELECT *, us_per_token * 500 / 1000 AS ms_of_500, us_per_token * 500 / 1000 < 50 AS meets_goal FROM m"""
)
def derived_metrics(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_returnflag", "l_linestatus", "cast(l_quantity as bigint) as tokens", "l_extendedprice as slow_ms", "l_discount as fast_ms")
    return reports.derived_metrics(rows, "l_returnflag", "l_linestatus")


@_query(
    """WITH s(shape, template) AS (VALUES ('read', 'let x = {s_name}.{n_name}'), ('call', '{s_name}.{n_name}()'))
    SELECT s_name, n_name, shape, replace(replace(template, '{s_name}', s_name), '{n_name}', n_name) AS source FROM supplier JOIN nation ON n_nationkey = s_nationkey, s"""
)
def member_shapes(spark, d):
    members = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_name", "n_name")
    return reports.shapes_of_members(members, {"read": "let x = {s_name}.{n_name}", "call": "{s_name}.{n_name}()"})


@_query("WITH r AS (SELECT doc_id, substr(text, 1, 40 + doc_id % 7) || '}' AS rebuilt FROM documents) SELECT doc_id, rebuilt FROM r")
def spliced_witnesses(spark, d):
    rows = _t(spark, d, "documents").selectExpr("doc_id", "text as source", "cast(40 + doc_id % 7 as int) as frontier_end", "'}' as suffix")
    return reports.splice(rows).select("doc_id", "rebuilt")


@_query("SELECT CASE WHEN NOT value > 5 THEN 'no witness' WHEN event_id % 7 = 0 THEN 'unchecked' WHEN value < 40 THEN 'confirmed' ELSE 'refuted' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def witness_buckets(spark, d):
    rows = _t(spark, d, "events").selectExpr("value > 5 as found", "if(event_id % 7 = 0, null, value < 40) as accepted")
    return reports.witness_buckets(rows)


@_query(
    """WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r]'), lambda x: trim(replace(x, chr(9), ' '), ' ')), lambda x: x <> '' AND NOT (starts_with(x, 'func ') OR starts_with(x, '}') OR starts_with(x, '{') OR starts_with(x, 'main'))) AS lines FROM documents)
    SELECT doc_id, coalesce(lines[-1], '?') AS statement FROM l"""
)
def last_statements(spark, d):
    return reports.last_statement(_t(spark, d, "documents").select("doc_id", F.col("text").alias("source"))).select("doc_id", "statement")


@_query(
    """WITH h AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'f' || hex(lang) WHEN doc_id % 7 = 0 THEN 'zz' ELSE hex(lang || source) END AS raw FROM documents)
    SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND raw IS NOT NULL AS valid, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN lower(raw) END AS digits FROM h"""
)
def hex_fragments(spark, d):
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("f"), F.hex("lang"))).when(F.col("doc_id") % 7 == 0, "zz").otherwise(F.hex(F.concat("lang", "source")))
    rows = harness.hex_fragments(_t(spark, d, "documents").select("doc_id", raw.alias("raw")))
    return rows.select("doc_id", "valid", F.lower(F.hex("fragment")).alias("digits"))


def _manifest(spark, d):
    """A manifest for every 100 ids of a source, whose cases are its documents: some without a stage, some with a wrong digest or prefix."""
    one = F.struct(
        F.concat(F.lit("d"), "doc_id").alias("name"), F.col("lang").alias("family"), F.concat(F.lit("d"), "doc_id", F.lit(".cj")).alias("file"), F.when(F.col("doc_id") % 3 == 0, "reject").otherwise("accept").alias("expected"), F.lit(True).alias("complete"),
        F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") * F.when(F.col("doc_id") % 2 == 0, 0).otherwise(9)).alias("safe_prefix_bytes"), F.when(F.col("doc_id") % 4 == 0, F.sha2(F.concat("text", F.when(F.col("doc_id") % 8 == 0, "!").otherwise("")), 256)).alias("source_sha256"),
    )
    groups = _t(spark, d, "documents").filter("text is not null").groupBy("source", F.expr("doc_id div 100")).agg(F.count("*").alias("case_count"), F.sort_array(F.collect_list(one)).alias("cases"))
    return groups.select(F.to_json(F.struct(F.lit(2).alias("schema_version"), "case_count", "cases")).alias("json"))


@_query("SELECT 'd' || doc_id AS name, lang AS family, CASE WHEN doc_id % 3 = 0 THEN 'semantic' ELSE 'accept' END AS stage, true AS oracle FROM documents WHERE text IS NOT NULL")
def manifest_cases(spark, d):
    return harness.manifest_cases(_manifest(spark, d)).select("name", "family", "stage", "oracle")


@_query(
    """SELECT 'd' || doc_id AS name, 'sha256' AS rule FROM documents WHERE text IS NOT NULL AND doc_id % 8 = 0 UNION ALL
    SELECT 'd' || doc_id, 'prefix length' FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0 AND n_chars * CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 9 END >= strlen(text)"""
)
def manifest_violations(spark, d):
    sources = _t(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("d"), "doc_id", F.lit(".cj")).alias("file"), F.col("text").alias("source"))
    return harness.manifest_violations(harness.manifest_cases(_manifest(spark, d)), sources)


@_query("SELECT 'u' || user_id AS name, CASE WHEN user_id % 4 <> 0 THEN max(event_id) END AS first_error_token_index, user_id % 4 <> 0 AS valid FROM events GROUP BY user_id")
def error_registry(spark, d):
    rows = _t(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("m"))
    entries = rows.groupBy(F.expr("user_id div 100")).agg(F.collect_list(F.struct(F.concat(F.lit("u"), "user_id").alias("name"), F.when(F.col("user_id") % 4 != 0, F.col("m")).alias("first_error_token_index"))).alias("wrong_examples"))
    return harness.first_errors(entries.select(F.to_json(F.struct("wrong_examples")).alias("json")))


@_query("SELECT event_id, user_id AS token, event_type AS symbol FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 0")
def trace_events(spark, d):
    whole = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "fire").otherwise("stats").alias("event"), F.col("user_id").alias("token"), F.col("event_type").alias("symbol")))
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("log "), whole)).when(F.col("event_id") % 5 == 0, F.lit('{"event": "fi')).otherwise(whole)
    return harness.trace_events(_t(spark, d, "events").select("event_id", line.alias("line"))).select("event_id", "token", "symbol")


@_query(
    """WITH l AS (SELECT user_id, props, value > 100 AS marked FROM events)
    SELECT user_id, count(*) FILTER (marked) AS payloads, CASE WHEN count(*) FILTER (marked) = 1 THEN max((props->>'$.k')::BIGINT) FILTER (marked) END AS k FROM l GROUP BY user_id"""
)
def profile_counters(spark, d):
    line = F.concat(F.when(F.col("value") > 100, "PROFILE ").otherwise("note "), "props")
    return harness.profile_counters(_t(spark, d, "events").select("user_id", line.alias("line")), "user_id", prefix="phase_").select("user_id", "payloads", F.col("counters")["phase_k"].alias("k"))


@_query("SELECT conv_id, 'token: ' || string_agg(role, ' ' ORDER BY turn) || chr(10) || '语法: ' || string_agg('0', ', ') || chr(10) || '语义: ' || string_agg((turn % 2)::VARCHAR, ', ' ORDER BY turn) || CASE WHEN max(turn) % 2 = 1 THEN chr(10) || '错误: odd' ELSE '' END AS text FROM conversations GROUP BY conv_id")
def result_texts(spark, d):
    rows = _t(spark, d, "conversations").selectExpr("conv_id", "turn as seq", "role as token", "0 as syntax", "turn % 2 as semantic", "if(turn % 2 = 1, 'odd', null) as message")
    return lines.result_text(rows, "conv_id")


@_query("""SELECT '{"event":"fire","event_id":' || event_id || ',"symbol":"' || event_type || '"' || CASE WHEN value > 5 THEN ',"token":' || user_id ELSE '' END || '}' AS line FROM events""")
def fire_lines(spark, d):
    return lines.event_lines(_t(spark, d, "events").selectExpr("event_id", "event_type as symbol", "if(value > 5, user_id, null) as token"), "fire", "event_id", "symbol", "token")


@_query("""SELECT '{"event":"ledger","id":"d' || event_id || '","rule":"' || event_type || '","overridden":' || (value > 50)::VARCHAR || '}' AS line FROM events""")
def ledger_lines(spark, d):
    rows = _t(spark, d, "events").selectExpr("concat('d', event_id) as id", "event_type as rule", "value > 50 as overridden")
    return lines.event_lines(rows, "ledger", "id", "rule", "overridden")


@_query("""SELECT '{"event":"stats","queries":' || count(*) || ',"cache_hits":' || count(*) FILTER (value > 50) || ',"witness_found":' || count(*) FILTER (event_type = 'view') || '}' AS line FROM events""")
def run_stats(spark, d):
    return lines.run_stats(_t(spark, d, "events").selectExpr("event_type = 'view' as found", "value > 50 as cached"), "found", "cached")


@_query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'prefix' WHEN doc_id % 3 = 0 THEN 'invalid' ELSE 'valid' END AS \"group\", source || '__' || lang || '-' || n_chars || '-' || doc_id || '.cj' AS file, sha256(text) AS digest FROM documents")
def corpus_files(spark, d):
    path = shared_folder(spark, "corpus")
    lines.write_corpus(_cases(spark, d), path)
    return spark.read.parquet(path).select("group", "file", F.sha2("source", 256).alias("digest"))


def _catalog(spark, d):
    """Catalogs in JSON: one a nation, a nominal with its region as super type and a field per segment of its customers; one for every 100 suppliers of a nation, with a method each; one a brand, whose parts' types are overloads of a function."""
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    nominal = F.concat(F.lit("N"), "n_nationkey").alias("k")
    whole = lambda section, key, value: F.to_json(F.struct(F.map_from_arrays(F.array(key), F.array(value)).alias(section))).alias("json")
    fields = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct(F.lower("c_mktsegment").alias("k"), F.lit("Int64").alias("v"))))).alias("instance_fields"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(fields, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    supers = F.array(F.struct(F.concat(F.lit("R"), "r_regionkey").alias("nominal"), F.array(F.lit("Int64")).alias("args"))).alias("supers")
    nominals = rows.select(whole("nominals", nominal, F.struct(supers, "instance_fields", F.array(F.struct(F.array(F.lit("Int64")).alias("params"))).alias("inits"))))
    one = F.struct(F.array(F.concat(F.lit("x: "), F.when(F.col("s_acctbal") > 5000, "Int64").otherwise("Array<Int64>"))).alias("params"), F.lit("Bool").alias("ret"))
    methods = _t(spark, d, "supplier").groupBy("s_nationkey", F.expr("s_suppkey div 100").alias("block")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("m"), "s_suppkey").alias("k"), one.alias("v"))))).alias("instance_methods"))
    methods = methods.select(whole("nominals", F.concat(F.lit("N"), "s_nationkey"), F.struct("instance_methods")))
    overloads = _t(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set(F.struct(F.array(F.col("p_type")).alias("parameters")))).alias("v"))
    return nominals.union(methods).union(overloads.select(whole("global_functions", F.col("p_brand"), F.col("v"))))


@_query("SELECT 'N' || n_nationkey AS name, 0 AS ord, 'R' || n_regionkey || '<Int64>' AS super FROM nation")
def catalog_supers(spark, d):
    return context.supers_of(_catalog(spark, d))


@_query("SELECT DISTINCT 'N' || c_nationkey AS owner, lower(c_mktsegment) AS name, 'Int64' AS type, false AS is_static FROM customer")
def catalog_fields(spark, d):
    return context.fields_of(_catalog(spark, d))


@_query(
    """WITH o AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS overload FROM (SELECT DISTINCT p_brand, p_type FROM part))
    SELECT NULL::VARCHAR AS owner, 'function' AS section, p_brand AS name, overload::INT AS overload, p_type AS params, 1 AS required, 'Unit' AS result FROM o UNION ALL
    SELECT 'N' || s_nationkey, 'method', 'm' || s_suppkey, 0, CASE WHEN s_acctbal > 5000 THEN 'Int64' ELSE 'Array<Int64>' END, 1, 'Bool' FROM supplier UNION ALL
    SELECT 'N' || n_nationkey, 'constructor', 'N' || n_nationkey, 0, 'Int64', 1, 'N' || n_nationkey FROM nation"""
)
def catalog_signatures(spark, d):
    return context.signatures_of(_catalog(spark, d)).select("owner", "section", "name", "overload", F.array_join("param_types", ", ").alias("params"), "required", "result")


@_query(
    """SELECT '<global>' AS owner, p_brand AS member, 'function' AS kind, count(DISTINCT p_type) AS overloads FROM part GROUP BY p_brand UNION ALL SELECT 'N' || s_nationkey, 'm' || s_suppkey, 'method', 1 FROM supplier UNION ALL
    SELECT 'N' || n_nationkey, 'N' || n_nationkey, 'constructor', 1 FROM nation UNION ALL SELECT DISTINCT 'N' || c_nationkey, lower(c_mktsegment), 'field', 1 FROM customer"""
)
def catalog_members(spark, d):
    return context.members_of(_catalog(spark, d))


@_query("SELECT '' AS owner, count(DISTINCT p_brand || p_type) AS n FROM part UNION ALL SELECT 'N' || n_nationkey, 1 + count(s_suppkey) FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def catalog_dump(spark, d):
    dumped = lines.catalog_lines(context.signatures_of(_catalog(spark, d)))
    return dumped.select("owner", F.regexp_count("line", F.lit('"overload":')).cast("long").alias("n"))


@_query("SELECT doc_id, name, 'namespace:' || name AS type FROM (SELECT doc_id, unnest(list_distinct([lang, source])) AS name FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)")
def imported_namespaces(spark, d):
    text = F.concat(F.lit("import std.core."), "lang", F.lit("\nimport "), "source", F.lit("\nmain() { imports }"))
    return symbols.imports(_t(spark, d, "documents").select("doc_id", text.alias("program")), "doc_id", "program")


@_query(
    """WITH l AS (SELECT n_name AS name, n_regionkey AS value, 0 AS layer FROM nation UNION ALL SELECT 'NATION_' || c_nationkey, c_nationkey, 1 FROM customer WHERE c_acctbal > 0 UNION ALL SELECT n_name, 99, 1 FROM nation WHERE n_nationkey < 7)
    SELECT DISTINCT name, value, layer FROM l a WHERE layer = (SELECT max(layer) FROM l b WHERE b.name = a.name)"""
)
def catalog_overlay(spark, d):
    nation = _t(spark, d, "nation")
    low = nation.selectExpr("n_name as name", "n_regionkey as value")
    high = _t(spark, d, "customer").filter("c_acctbal > 0").selectExpr("concat('NATION_', c_nationkey) as name", "c_nationkey as value").unionByName(nation.filter("n_nationkey < 7").selectExpr("n_name as name", "99 as value")).distinct()
    return symbols.overlay(low, high)


@_query(
    """SELECT k, CASE WHEN a > b THEN 'left' ELSE 'right' END AS side, count(*) AS n FROM (SELECT l_linenumber AS k, unnest(range(0, abs(a - b))) AS u, a, b FROM
    (SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY l_linenumber)) GROUP BY ALL"""
)
def model_difference(spark, d):
    rows = _t(spark, d, "lineitem")
    return symbols.model_difference(rows.filter("l_returnflag = 'A'").selectExpr("l_linenumber as k"), rows.filter("l_returnflag = 'R'").selectExpr("l_linenumber as k")).groupBy("k", "side").agg(F.count("*").alias("n"))


_SPELLED = "p AS (SELECT p_partkey, 'type: ' || p_brand || ' < ' || p_type || ' ,\tInt64 >' AS kind FROM part)"


@_query(
    rf"""WITH {_SPELLED}, k AS (SELECT p_partkey, regexp_replace(regexp_replace(kind, '([A-Za-z0-9_])\s+([A-Za-z_])', '\1~\2', 'g'), '([A-Za-z0-9_])\s+([A-Za-z_])', '\1~\2', 'g') AS m FROM p),
    c AS (SELECT p_partkey, replace(regexp_replace(m, '\s+', '', 'g'), '~', ' ') AS canonical FROM k)
    SELECT p_partkey, canonical, regexp_extract(canonical, '^(?:type:)?([^<]*)', 1) AS head, len(split(regexp_extract(canonical, '<(.*)>$', 1), ','))::INT AS n_args FROM c"""
)
def type_spellings(spark, d):
    kinds = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("type: "), "p_brand", F.lit(" < "), "p_type", F.lit(" ,\tInt64 >")).alias("kind"))
    return types.type_facts(kinds, "kind").select("p_partkey", "canonical", "head", F.size("args").alias("n_args"))


_STRICT = """CASE WHEN regexp_matches(got, '^(unknown:|type:|interface-type:)') THEN false ELSE got = want OR ((NOT contains(got, '<') OR NOT contains(want, '<')) AND (split_part(got, '<', 1) = split_part(want, '<', 1)
    OR EXISTS (SELECT 1 FROM nation WHERE split_part(got, '<', 1) = 'N' || n_nationkey AND split_part(want, '<', 1) IN ('R' || n_regionkey, 'Any')))) END"""


@_query(
    f"""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'unknown:x' ELSE 'N' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '<Int64>' ELSE '' END END AS got,
    CASE WHEN c_custkey % 13 = 0 THEN 'Any' ELSE 'R' || (c_custkey % 5) || CASE WHEN c_custkey % 2 = 0 THEN '<Int64>' ELSE '' END END AS want FROM customer) SELECT c_custkey, {_STRICT} AS compatible FROM p"""
)
def strict_compatibility(spark, d):
    from tessera.plans.catalog import _edges

    pairs = _t(spark, d, "customer").selectExpr("c_custkey", "if(c_custkey % 11 = 0, 'unknown:x', concat('N', c_nationkey, if(c_custkey % 3 = 0, '<Int64>', ''))) as got", "if(c_custkey % 13 = 0, 'Any', concat('R', c_custkey % 5, if(c_custkey % 2 = 0, '<Int64>', ''))) as want")
    return types.compatible_strict(pairs, types.subtype_closure(_edges(spark, d))).select("c_custkey", "compatible")


@_query(
    """WITH u AS (SELECT event_id, user_id, CASE event_id % 6 WHEN 0 THEN 'Int64' WHEN 1 THEN 'NATION_3' WHEN 2 THEN 'zz' ELSE event_type END AS name FROM events),
    l AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60)
    SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.user_id = u.user_id AND event_type = name) THEN 'local' WHEN name = 'click' THEN 'function' WHEN name = 'view' THEN 'global' WHEN name IN (SELECT n_name FROM nation) THEN 'type' WHEN name = 'Int64' THEN 'primitive' ELSE 'unknown' END AS kind FROM u"""
)
def symbol_kinds(spark, d):
    events = _t(spark, d, "events")
    uses = events.selectExpr("event_id", "user_id", "case event_id % 6 when 0 then 'Int64' when 1 then 'NATION_3' when 2 then 'zz' else event_type end as name")
    name = lambda x: spark.createDataFrame([(x,)], "name string")
    return symbols.resolve(uses, "user_id", events.filter("value > 60").selectExpr("user_id", "event_type as name"), name("click"), name("view"), _t(spark, d, "nation").selectExpr("n_name as name")).select("event_id", "kind")


@_query(
    """WITH u AS (SELECT o_orderkey, o_custkey AS scope, CASE o_orderkey % 4 WHEN 0 THEN 'N1' WHEN 1 THEN 'x' ELSE 'g' END AS receiver, CASE o_orderkey % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'm' || (o_orderkey % 50) ELSE 'none' END AS member FROM orders),
    t AS (SELECT u.*, CASE WHEN receiver = 'x' THEN 'N' || c_nationkey WHEN receiver = 'g' THEN 'N2' END AS type FROM u LEFT JOIN customer ON c_custkey = scope),
    m AS (SELECT DISTINCT 'N' || c_nationkey AS owner, lower(c_mktsegment) AS member, 0 AS rank FROM customer UNION ALL SELECT 'N' || s_nationkey, 'm' || s_suppkey, 1 FROM supplier)
    SELECT o_orderkey, CASE WHEN rank IS NULL THEN 'unknown' WHEN type IS NULL THEN 'static' WHEN rank = 0 THEN 'field' ELSE 'method' END AS kind FROM t LEFT JOIN m ON m.owner = coalesce(type, receiver) AND m.member = t.member"""
)
def member_kinds(spark, d):
    uses = _t(spark, d, "orders").selectExpr("o_orderkey", "o_custkey as scope", "case o_orderkey % 4 when 0 then 'N1' when 1 then 'x' else 'g' end as receiver", "case o_orderkey % 3 when 0 then 'building' when 1 then concat('m', o_orderkey % 50) else 'none' end as member")
    own = _t(spark, d, "customer").selectExpr("c_custkey as scope", "'x' as name", "concat('N', c_nationkey, '<Int64>') as type")
    return symbols.resolve_members(uses, "scope", own, spark.createDataFrame([("g", "N2")], "name string, type string"), context.members_of(_catalog(spark, d))).select("o_orderkey", "kind")


@_query(
    """WITH q AS (SELECT 'N' || n_nationkey AS class, 'R' || n_regionkey AS interface, s_suppkey, 'm' || s_suppkey AS name, s_acctbal > 0 AS takes FROM nation JOIN supplier ON s_suppkey % 5 = n_regionkey)
    SELECT class, interface, name, CASE WHEN 'N' || s_nationkey = class THEN 'signature mismatch' ELSE 'not implemented' END AS problem FROM q JOIN supplier USING (s_suppkey) WHERE NOT ('N' || s_nationkey = class AND (s_acctbal > 5000) = takes)"""
)
def unmet_requirements(spark, d):
    from tessera.plans.catalog import _edges

    supplier, kind = _t(spark, d, "supplier"), "if({}, 'Int64', 'Array< Int64 >')"
    owed = supplier.selectExpr("concat('R', s_suppkey % 5) as interface", "concat('m', s_suppkey) as name", f"array({kind.format('s_acctbal > 0')}) as params", "'Bool' as result")
    own = context.signatures_of(_catalog(spark, d)).filter("section = 'method'").selectExpr("owner as class", "name", "param_types as params", "result")
    classes = _t(spark, d, "nation").selectExpr("concat('N', n_nationkey) as class")
    return symbols.unmet_requirements(symbols.requirements(classes, types.subtype_closure(_edges(spark, d)), owed), own)


@_query("SELECT o_orderkey, 'a' AS duplicated FROM orders WHERE o_orderkey % 3 = 0")
def duplicate_parameters(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.array(F.lit("a"), F.lit("b"), F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("c")).alias("param_names"))
    return symbols.duplicate_parameters(rows).select("o_orderkey", F.array_join("duplicated", ",").alias("duplicated"))


@_query(
    """WITH m AS (SELECT c_nationkey AS owner, c_mktsegment || c_custkey // 3 AS member, CASE WHEN c_acctbal > 0 THEN 'field' ELSE 'method' END AS kind FROM customer),
    g AS (SELECT owner, member, count(*) FILTER (kind = 'field') AS f, count(*) FILTER (kind = 'method') AS m FROM m GROUP BY ALL)
    SELECT owner, member, CASE WHEN f > 1 THEN 'duplicate class field' ELSE 'class member name collision' END AS problem FROM g WHERE f > 1 OR (f > 0 AND m > 0)"""
)
def member_collisions(spark, d):
    rows = _t(spark, d, "customer").selectExpr("c_nationkey as owner", "concat(c_mktsegment, c_custkey div 3) as member", "if(c_acctbal > 0, 'field', 'method') as kind")
    return symbols.member_collisions(rows)


@_query("SELECT lang, word AS target, count(*) AS n FROM (SELECT lang, unnest(string_split(lang || ',' || coalesce(source, 'none') || ',' || lang, ',')) AS word FROM documents) GROUP BY ALL")
def covered_counts(spark, d):
    rows = _t(spark, d, "documents").select("lang", F.split(F.concat("lang", F.lit(","), F.coalesce("source", F.lit("none")), F.lit(","), "lang"), ",").alias("covers"))
    return summaries.covered_counts(rows, "covers", "lang")


@_query("SELECT bool_and(n = 0) AS equal, sum(greatest(n, 0))::BIGINT AS more_left, sum(greatest(-n, 0))::BIGINT AS more_right FROM (SELECT l_linenumber, sum(CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS n FROM lineitem GROUP BY ALL)")
def multisets_equal(spark, d):
    rows = _t(spark, d, "lineitem")
    return summaries.multisets_equal(rows.filter("l_orderkey % 2 = 0").select("l_linenumber"), rows.filter("l_orderkey % 2 = 1").select("l_linenumber"))


@_query("SELECT doc_id, length(text) AS chars, text AS rebuilt FROM documents WHERE length(text) > 0")
def random_fragments(spark, d):
    parts = lexing.fragments(_t(spark, d, "documents"), "doc_id", "text", "random", 7)
    rebuilt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "fragment"))), lambda x: x["fragment"]), "")
    return parts.groupBy("doc_id").agg(F.sum(F.length("fragment")).alias("chars"), rebuilt.alias("rebuilt"))


@_query(
    r"""WITH p AS (SELECT page_id, 'let v' || page_id || ' = ' || page_id || '..' || length(html) || ' /* a /* b */ c */ "' || regexp_replace(coalesce(url, ''), '["\\]', '', 'g') || '" <: x' || chr(10) AS program FROM pages),
    t AS (SELECT page_id, unnest([{'kind': 'keyword', 'token': 'let'}, {'kind': 'name', 'token': 'v' || page_id}, {'kind': 'sign', 'token': '='}, {'kind': 'float', 'token': regexp_extract(program, '[0-9]+\.\.[0-9]+')},
      {'kind': 'text', 'token': regexp_extract(program, '"[^"]*"')}, {'kind': 'operator', 'token': '<:'}, {'kind': 'name', 'token': 'x'}, {'kind': 'newline', 'token': chr(10)}], recursive := true) FROM p WHERE program IS NOT NULL)
    SELECT page_id, kind, token FROM t"""
)
def fragment_tokens(spark, d):
    program = F.concat(F.lit("let v"), "page_id", F.lit(" = "), "page_id", F.lit(".."), F.length("html"), F.lit(' /* a /* b */ c */ "'), F.regexp_replace(F.coalesce("url", F.lit("")), r'["\\]', ""), F.lit('" <: x\n'))
    parts = lexing.fragments(_t(spark, d, "pages").select("page_id", program.alias("program")), "page_id", "program", "random", 3)
    rows = lexer.lex_batch(parts.selectExpr("page_id as stream_id", "seq", "fragment"))
    return rows.select(F.col("stream_id").cast("long").alias("page_id"), F.explode("tokens").alias("t")).select("page_id", "t.kind", "t.token")


@_query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 11 WHEN 'system' THEN 13 ELSE 10 END AS type_id FROM conversations")
def token_type_ids(spark, d):
    table = spark.createDataFrame([("name", 10), ("user", 11), ("system", 13)], "kind string, type_id int")
    return lexing.type_ids(_t(spark, d, "conversations").selectExpr("conv_id", "turn", "role as kind"), table).select("conv_id", "turn", "type_id")


@_query(
    r"""WITH w AS (SELECT DISTINCT conv_id // 100 AS t, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM conversations),
    r AS (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY word) - 1 AS r FROM w), m AS (SELECT t, max(r + r // 6) AS last FROM r GROUP BY t)
    SELECT t::VARCHAR AS vocabulary, (r + r // 6)::INT AS token_id, hex(word) AS bytes FROM r UNION ALL SELECT t::VARCHAR, i::INT, NULL FROM m, range(0, last + 1) x(i) WHERE i % 7 = 6"""
)
def token_tables(spark, d):
    """The words of every 100 conversations as a token table with gaps, written and read back by ranges of ids."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = _t(spark, d, "conversations").select(F.expr("conv_id div 100").cast("string").alias("table"), F.explode(words).alias("word")).distinct()
    rank = F.row_number().over(W.partitionBy("table").orderBy("word")) - 1
    rows = rows.withColumn("r", rank).selectExpr("table", "r + r div 6 as token_id", "cast(word as binary) as bytes")
    folder = shared_folder(spark, "token-tables")
    token_table.write_token_tables(rows, folder)
    spark.dataSource.register(token_table.TokenTables)
    return spark.read.format("token_table").option("entries", 1000).load(folder).select(F.col("table").alias("vocabulary"), "token_id", F.hex("bytes").alias("bytes"))


@_query()
def document_token_ids(spark, d):
    import public_tokenizers

    ids = harness.token_ids(_t(spark, d, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return ids.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("token_id").alias("largest"))
