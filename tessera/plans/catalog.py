"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import lexing
from tessera.operators import reports, summaries, types, verdicts
from tessera.plans import generics, harness, locks, scopes
from tessera.sources import vocabulary
from tessera.streaming import checker, lexer

_QUERIES, _SQL = {}, {}


def _query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Events as verdicts: a stream per user, in order of time, rejected above 150."""
    seq = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return _t(spark, d, "events").select("user_id", "event_id", seq.alias("seq"), (F.col("value") < 150).alias("ok"))


_V = "v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, value < 150 AS ok FROM events)"


@_query(f"WITH {_V} SELECT user_id, min(seq) FILTER (NOT coalesce(ok, false)) AS first_reject, count(*) AS n FROM v GROUP BY user_id")
def first_reject(spark, d):
    return verdicts.first_reject(_verdicts(spark, d), "user_id")


@_query(f"WITH {_V}, b AS (SELECT *, min(seq) FILTER (NOT coalesce(ok, false)) OVER (PARTITION BY user_id) AS bad FROM v) SELECT user_id, event_id, seq, ok FROM b WHERE bad IS NULL OR seq <= bad")
def stop_after_first(spark, d):
    return verdicts.stop_after_first(_verdicts(spark, d), "user_id")


@_query(f"WITH {_V} SELECT user_id, seq, (NOT coalesce(ok, false))::INT AS plain, coalesce(ok, false)::INT AS competition FROM v")
def dual_protocol(spark, d):
    ok = F.coalesce("ok", F.lit(False))
    return _verdicts(spark, d).select("user_id", "seq", verdicts.protocol_bit(ok).alias("plain"), verdicts.protocol_bit(ok, True).alias("competition"))


@_query(
    """WITH e AS (SELECT user_id, event_id % 2 AS half, CASE WHEN value < 100 THEN 0 ELSE 1 END AS bit, ts, event_id FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id, half ORDER BY ts, event_id) - 1 AS seq FROM e),
    j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.seq, b.seq) AS seq, a.bit AS x, b.bit AS y
          FROM (SELECT * FROM s WHERE half = 0) a FULL JOIN (SELECT * FROM s WHERE half = 1) b ON a.user_id = b.user_id AND a.seq = b.seq)
    SELECT user_id, min(seq) FILTER (x IS DISTINCT FROM y) AS first_diff, count(x) AS n_left, count(y) AS n_right FROM j GROUP BY user_id"""
)
def transcript_first_diff(spark, d):
    half = (F.col("event_id") % 2).alias("half")
    rows = _t(spark, d, "events").select("user_id", "event_id", "ts", half, F.when(F.col("value") < 100, 0).otherwise(1).alias("bit"))
    rows = rows.withColumn("seq", (F.row_number().over(W.partitionBy("user_id", "half").orderBy("ts", "event_id")) - 1).cast("long"))
    return verdicts.transcript_diff(rows.filter("half = 0"), rows.filter("half = 1"), "user_id")


@_query(
    f"""WITH {_V}, o AS (SELECT user_id, min(seq) FILTER (NOT ok) AS old_at FROM v GROUP BY 1),
    w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, value < 180 AS ok FROM events),
    n AS (SELECT user_id, min(seq) FILTER (NOT coalesce(ok, false)) AS new_at FROM w GROUP BY 1)
    SELECT user_id, old_at, new_at, CASE WHEN old_at IS NULL AND new_at IS NULL THEN 'clean' WHEN old_at IS NULL THEN 'new' WHEN new_at IS NULL THEN 'fixed'
      WHEN old_at = new_at THEN 'kept' WHEN new_at > old_at THEN 'deferred' ELSE 'earlier' END AS transition FROM o JOIN n USING (user_id)"""
)
def transition_classes(spark, d):
    old = _verdicts(spark, d)
    seq = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    new = _t(spark, d, "events").select("user_id", seq.alias("seq"), (F.col("value") < 180).alias("ok"))
    return verdicts.transition_classes(verdicts.first_reject(old, "user_id"), verdicts.first_reject(new, "user_id"), "user_id")


@_query(
    """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL)
    SELECT l_returnflag, max(n) AS n, min(v) FILTER (k = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95_half_even, min(v) FILTER (k = ceil(n * 0.95::DOUBLE) - 1) AS p95_ceil,
      min(v) FILTER (k = CASE WHEN floor(n * 0.95::DOUBLE) = 0 THEN n - 1 ELSE floor(n * 0.95::DOUBLE) - 1 END) AS p95_floor FROM r GROUP BY l_returnflag"""
)
def p95_three_rules(spark, d):
    return summaries.p95_rules(_t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@_query("SELECT o_orderstatus, count(o_totalprice) AS n, min(o_totalprice) AS least, median(o_totalprice) AS median, quantile_disc(o_totalprice, 0.95) AS p95, max(o_totalprice) AS most, round(sum(o_totalprice::DECIMAL(30,6)), 2)::DOUBLE AS total, round(sum(o_totalprice::DECIMAL(30,6)) / count(o_totalprice), 6)::DOUBLE AS mean FROM orders GROUP BY 1")
def median_summary(spark, d):
    return summaries.summary(_t(spark, d, "orders"), "o_orderstatus", "o_totalprice")


@_query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def family_counts(spark, d):
    return summaries.family_counts(_t(spark, d, "documents"), "lang", "source")


@_query("SELECT (1 - grouping(lang))::VARCHAR || (1 - grouping(source))::VARCHAR AS dimension, lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def multi_dim_counts(spark, d):
    return summaries.counts_by(_t(spark, d, "documents"), "lang", "source")


@_query("SELECT DISTINCT p_partkey FROM part ANTI JOIN (SELECT l_partkey AS p_partkey FROM lineitem WHERE l_quantity >= 45) USING (p_partkey)")
def coverage_missing(spark, d):
    used = _t(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return summaries.coverage_missing(_t(spark, d, "part"), used, "p_partkey")


@_query(
    """WITH c AS (SELECT c_nationkey AS nation, count(*) AS members, count(*) FILTER (c_acctbal > 0) AS positive FROM customer GROUP BY 1),
    s AS (SELECT s_nationkey AS nation, count(*) AS members, count(*) FILTER (s_acctbal > 0) AS positive FROM supplier GROUP BY 1)
    SELECT coalesce(c.nation, s.nation) AS nation, CASE WHEN s.nation IS NULL THEN 'left only' WHEN c.nation IS NULL THEN 'right only' WHEN c.members <> s.members THEN 'changed: members'
      WHEN c.positive <> s.positive THEN 'changed: positive' ELSE 'same' END AS category FROM c FULL JOIN s ON c.nation = s.nation"""
)
def catalog_diff(spark, d):
    def side(name, p):
        return _t(spark, d, name).groupBy(F.col(f"{p}_nationkey").alias("nation")).agg(F.count("*").alias("members"), F.count_if(F.col(f"{p}_acctbal") > 0).alias("positive"))

    return summaries.catalog_diff(side("customer", "c"), side("supplier", "s"), "nation", ("members", "positive"))


@_query(
    """SELECT l_returnflag, l_linestatus, l_linenumber, n - m AS surplus FROM
    (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) FILTER (l_orderkey % 2 = 0) AS n, count(*) FILTER (l_orderkey % 2 = 1) AS m FROM lineitem GROUP BY ALL) WHERE n > m"""
)
def multiset_difference(spark, d):
    rows = _t(spark, d, "lineitem")
    names = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return summaries.multiset_difference(rows.filter("l_orderkey % 2 = 0").select(*names), rows.filter("l_orderkey % 2 = 1").select(*names))


@_query("SELECT bool_and(quality IN (0, 1)) AS all_valid, bool_or(toxic = 1) AS any_toxic, count(*) FILTER (quality = 1 AND toxic = 1) AS both FROM labels")
def gates(spark, d):
    return summaries.gates(_t(spark, d, "labels"), {"all_valid": F.col("quality").isin(0, 1)}, {"any_toxic": F.col("toxic") == 1}, {"both": F.expr("quality = 1 and toxic = 1")})


@_query(
    """WITH r AS (SELECT event_type, floor(value / 50)::BIGINT AS bucket, event_id, row_number() OVER (PARTITION BY event_type, floor(value / 50) ORDER BY event_id) AS k FROM events)
    SELECT event_type, bucket, count(*) AS n, string_agg(CASE WHEN k <= 3 THEN event_id::VARCHAR END, ',' ORDER BY event_id) AS examples FROM r GROUP BY 1, 2"""
)
def cluster_top_examples(spark, d):
    rows = _t(spark, d, "events").select("event_type", F.floor(F.col("value") / 50).cast("long").alias("bucket"), "event_id")
    return summaries.clusters(rows, ("event_type", "bucket"), "event_id")


@_query("SELECT role, target, count(*) AS n FROM (SELECT role, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS target FROM conversations) GROUP BY ALL")
def explode_count(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return summaries.covered_counts(_t(spark, d, "conversations").select("role", words.alias("words")), "words", "role")


@_query(
    """WITH l AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN ' +' || (event_id % 300)::VARCHAR || ' ' WHEN event_id % 11 = 0 THEN 'x' || event_id::VARCHAR ELSE (event_id % 300)::VARCHAR END AS raw FROM events),
    n AS (SELECT event_id, try_cast(nullif(regexp_extract(trim(raw), '^\\+?(-?[0-9]+)$', 1), '') AS BIGINT) AS token_id FROM l)
    SELECT event_id, token_id, coalesce(token_id BETWEEN 0 AND 255, false) AS found, CASE WHEN token_id BETWEEN 0 AND 255 THEN lpad(upper(to_hex(token_id)), 2, '0') END AS bytes FROM n"""
)
def token_decode_join(spark, d):
    i = (F.col("event_id") % 300).cast("string")
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(" +"), i, F.lit(" "))).when(F.col("event_id") % 11 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(i)
    lines = _t(spark, d, "events").select("event_id", raw.alias("raw"))
    return vocabulary.decode_ids(lines, vocabulary.byte_vocabulary(spark)).select("event_id", "token_id", "found", F.hex("bytes").alias("bytes"))


@_query(
    """WITH p AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations)
    SELECT conv_id, turn, role, previous, coalesce((previous = 'user' AND role <> 'assistant') OR (previous = 'assistant' AND role <> 'user'), false) AS violates FROM p"""
)
def keyword_context_rule(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "role")
    return verdicts.context_rule(rows, "conv_id", "turn", "role", ("user", "assistant"), {"user": ("assistant",), "assistant": ("user",)})


@_query("SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS end_byte FROM conversations")
def byte_offsets(spark, d):
    return summaries.running_offsets(_t(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "end_byte")


@_query("SELECT ts AS at, CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS priority, CASE WHEN event_type IN ('signup', 'error') THEN event_type ELSE 'step' END AS kind, event_id AS id FROM events UNION ALL SELECT o_orderdate, 3, 'order', o_orderkey FROM orders")
def timeline(spark, d):
    events = _t(spark, d, "events").select("event_type", F.col("ts").alias("at"), F.col("event_id").alias("id"))
    orders = _t(spark, d, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    of = lambda condition: events.filter(condition).select("at", "id")
    return summaries.timeline(signup=of("event_type = 'signup'"), error=of("event_type = 'error'"), step=of("event_type not in ('signup', 'error')"), order=orders)


_EDGES = "e AS (SELECT 'N' || n_nationkey::VARCHAR AS sub, 'R' || n_regionkey::VARCHAR AS super FROM nation UNION ALL SELECT 'R' || r_regionkey::VARCHAR, 'Any' FROM region)"


def _edges(spark, d):
    nation = _t(spark, d, "nation").selectExpr("concat('N', n_nationkey) sub", "concat('R', n_regionkey) super")
    return nation.unionByName(_t(spark, d, "region").selectExpr("concat('R', r_regionkey) sub", "'Any' super"))


@_query(
    f"""WITH RECURSIVE {_EDGES}, r(sub, super, steps) AS (SELECT t, t, 0 FROM (SELECT sub AS t FROM e UNION SELECT super FROM e)
    UNION ALL SELECT r.sub, e.super, r.steps + 1 FROM r JOIN e ON e.sub = r.super) SELECT sub, super, min(steps)::INT AS steps FROM r GROUP BY 1, 2"""
)
def subtype_closure(spark, d):
    return types.subtype_closure(_edges(spark, d))


@_query(
    """WITH l AS (SELECT o_orderkey, l_linenumber, c_nationkey AS c, s_nationkey AS s, a.n_regionkey AS cr, b.n_regionkey AS sr FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey)
    SELECT o_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN c = s WHEN 1 THEN cr = sr WHEN 2 THEN cr = sr ELSE true END AS compatible FROM l"""
)
def type_compatibility(spark, d):
    """A customer's nation, for its suppliers' nation, their region, a function over both, or anything."""
    nation = _t(spark, d, "nation")
    of = lambda key: nation.selectExpr(f"n_nationkey as {key}_nation", f"concat('N', n_nationkey) as {key}", f"concat('R', n_regionkey) as {key}_region")
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(of("c"), F.col("c_nationkey") == F.col("c_nation")).join(of("s"), F.col("s_nationkey") == F.col("s_nation"))
    pairs = rows.selectExpr("o_orderkey", "l_linenumber", "if(l_linenumber % 4 = 2, concat('(', c_region, ') -> ', c), c) as got", "case l_linenumber % 4 when 0 then s when 1 then s_region when 2 then concat('(', s, ') -> ', s_region) else 'Any' end as want")
    return types.compatible(pairs, types.subtype_closure(_edges(spark, d))).select("o_orderkey", "l_linenumber", "compatible")


@_query(
    """WITH calls AS (SELECT o_orderkey AS call_id, 'f' || (o_orderkey % 2)::VARCHAR AS name, (o_orderkey % 4)::INT AS n, o_orderkey % 3 = 0 AS closed, c_nationkey AS nation, n_regionkey AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    f(name, overload, params, required) AS (VALUES ('f0', 0, ['Any'], 1), ('f0', 1, ['R1', 'N3'], 0), ('f1', 0, ['R2', 'R2', 'Any'], 2)),
    j AS (SELECT call_id, overload, n, len(params) AS n_params, closed, CASE WHEN required = 0 THEN len(params) ELSE required END AS need,
      len(list_filter(params[1:n], lambda p: p <> 'Any' AND p <> 'N' || nation AND p <> 'R' || region)) > 0 AS clash FROM calls JOIN f USING (name)),
    r AS (SELECT *, CASE WHEN n > n_params THEN 'arity exceeded' WHEN clash THEN 'argument type' WHEN closed AND n < need THEN 'arity short at close' END AS reason FROM j)
    SELECT call_id, overload::INT AS overload, CASE WHEN reason IS NOT NULL THEN 'dead' WHEN n < need THEN 'waiting' ELSE 'alive' END AS state, reason FROM r"""
)
def call_frontier(spark, d):
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    calls = rows.selectExpr("o_orderkey call_id", "concat('f', o_orderkey % 2) name", "array_repeat(concat('N', c_nationkey), cast(o_orderkey % 4 as int)) args", "o_orderkey % 3 = 0 closed")
    overloads = spark.createDataFrame([("f0", 0, ["Any"], 1), ("f0", 1, ["R1", "N3"], 0), ("f1", 0, ["R2", "R2", "Any"], 2)], "name string, overload int, params array<string>, required int")
    return verdicts.call_frontier(overloads, calls, types.subtype_closure(_edges(spark, d))).select("call_id", "overload", "state", "reason")


@_query(
    """WITH calls AS (SELECT o_orderkey AS call_id, 'f' || (o_orderkey % 2)::VARCHAR AS name, (o_orderkey % 3)::INT AS n, o_orderkey % 5 = 0 AS closed, c_nationkey AS nation, n_regionkey AS region, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'R1' WHEN 2 THEN 'Any' ELSE 'N3' END AS expected FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    f(name, overload, first, n_params, required, result) AS (VALUES ('f0', 0, 'Any', 1, 1, 'R1'), ('f0', 1, 'T', 2, 1, 'Array<T>'), ('f1', 0, 'R2', 2, 0, 'N3'), ('f1', 1, 'Box<T>', 1, 1, 'N3')),
    three AS (SELECT 'R' || n_regionkey AS r FROM nation WHERE n_nationkey = 3),
    j AS (SELECT *, CASE WHEN required = 0 THEN n_params ELSE required END AS need, n > 0 AND first = 'R2' AND region <> 2 AS clash FROM calls JOIN f USING (name)),
    r AS (SELECT *, CASE WHEN n > n_params THEN 'arity exceeded' WHEN clash THEN 'argument type' WHEN closed AND n < need THEN 'arity short at close' END AS dead,
      result <> 'Array<T>' AND expected IS NOT NULL AND expected <> 'Any' AND expected <> result AND NOT (result = 'N3' AND expected = (SELECT r FROM three)) AS other FROM j)
    SELECT call_id, overload::INT AS overload, CASE WHEN dead IS NOT NULL THEN 'dead' WHEN n < need THEN 'waiting' ELSE 'alive' END AS state, coalesce(dead, CASE WHEN other THEN 'expected return only' END) AS reason FROM r"""
)
def call_frontier_returns(spark, d):
    """Calls that expect a type, of overloads with results and type parameters."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    expected = "case o_orderkey % 4 when 0 then null when 1 then 'R1' when 2 then 'Any' else 'N3' end expected"
    calls = rows.selectExpr("o_orderkey call_id", "concat('f', o_orderkey % 2) name", "array_repeat(concat('N', c_nationkey), cast(o_orderkey % 3 as int)) args", "o_orderkey % 5 = 0 closed", expected)
    listed = [("f0", 0, ["Any"], 1, "R1", []), ("f0", 1, ["T", "Map<T, T>"], 1, "Array<T>", ["T"]), ("f1", 0, ["R2", "Any"], 0, "N3", None), ("f1", 1, ["Box<T>"], 1, "N3", ["T"])]
    overloads = spark.createDataFrame(listed, "name string, overload int, params array<string>, required int, result string, type_params array<string>")
    return verdicts.call_frontier(overloads, calls, types.subtype_closure(_edges(spark, d))).select("call_id", "overload", "state", "reason")


@_query("SELECT doc_id, 4::BIGINT AS layouts, 1::BIGINT AS verdicts, true AS invariant FROM documents WHERE length(text) > 0")
def checked_fragmentations(spark, d):
    """Whether the checker's answer is the same however a document is cut: as a whole, by lines, by words, and by pieces of any size."""
    docs, layouts = _t(spark, d, "documents"), ("whole", "line", "word", "random")
    parts = [lexing.fragments(docs, "doc_id", "text", layout, 7).select(F.concat(F.lit(f"{layout}:"), "doc_id").alias("stream_id"), "seq", "fragment") for layout in layouts]
    answers = checker.check_batch(reduce(DataFrame.unionByName, parts)).groupBy("stream_id").agg(F.bool_and("ok").alias("accepted"))
    case = F.substring_index("stream_id", ":", -1).cast("long").alias("doc_id")
    return reports.fragmentation_invariance(answers.select(case, F.substring_index("stream_id", ":", 1).alias("layout"), "accepted"), "doc_id")


@_query(
    f"""WITH p AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'fu' WHEN 1 THEN 'r' WHEN 2 THEN page_id::VARCHAR WHEN 3 THEN page_id::VARCHAR || '.5' WHEN 4 THEN '"' || page_id WHEN 5 THEN '`x' || page_id WHEN 6 THEN '<' WHEN 7 THEN 'v' || page_id ELSE '/* ' || page_id END AS partial FROM pages)
    SELECT page_id, partial, CASE page_id % 9 WHEN 0 THEN 'name,' || array_to_string(list_filter([{', '.join(f"'{k}'" for k in lexing.KEYWORDS)}], lambda k: starts_with(k, 'fu')), ',') WHEN 1 THEN 'name,rune,' || array_to_string(list_filter([{', '.join(f"'{k}'" for k in lexing.KEYWORDS)}], lambda k: starts_with(k, 'r')), ',')
      WHEN 2 THEN 'integer,float' WHEN 3 THEN 'float' WHEN 4 THEN 'text' WHEN 5 THEN 'raw' WHEN 6 THEN '<<=,<:,<=,<<,sign' WHEN 7 THEN 'name' ELSE '' END AS candidates, true AS continuable FROM p"""
)
def open_ends(spark, d):
    """What the open end of a text may become."""
    partial = F.expr("case page_id % 9 when 0 then 'fu' when 1 then 'r' when 2 then string(page_id) when 3 then concat(page_id, '.5') when 4 then concat('\"', page_id) when 5 then concat('`x', page_id) when 6 then '<' when 7 then concat('v', page_id) else concat('/* ', page_id) end")
    rows = lexer.lex_batch(_t(spark, d, "pages").select(F.col("page_id").cast("string").alias("stream_id"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("let x = "), partial).alias("fragment")))
    return rows.select(F.col("stream_id").cast("long").alias("page_id"), "partial", F.array_join("candidates", ",").alias("candidates"), "continuable")


@_query(
    """WITH p AS (SELECT conv_id, turn, role, lag(role) OVER w AS one, lag(role, 2) OVER w AS two FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role))
    SELECT conv_id, turn, role, coalesce(two = 'user' AND one = 'assistant' AND role <> 'user', false) AS violates FROM p"""
)
def context_rule_after(spark, d):
    return verdicts.context_rule_after(_t(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role", {"user": ("user",)}, "assistant")


@_query("SELECT doc_id, seq::INT AS seq, fragment FROM (SELECT doc_id, unnest(f) AS fragment, generate_subscripts(f, 1) - 1 AS seq FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+$') AS f FROM documents))")
def line_fragments(spark, d):
    return lexing.fragments(_t(spark, d, "documents"), "doc_id", "text", "line")


@_query(
    r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)[ \t\r\f\v]+|\n|//[^\n]*|"(?:[^"\\]|\\.)*"|r''(?:[^''\\\n]|\\[^\n])*''|r"(?:[^"\\\n]|\\[^\n])*"|`[^`]*`|[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_.]*|OPERATORS|[^\n]')) AS token FROM pages),
    k AS (SELECT page_id, CASE WHEN token = chr(10) THEN 'newline' WHEN regexp_matches(token, '^[ \t\r\f\v]') OR starts_with(token, '//') THEN NULL WHEN regexp_matches(token, '^"') AND len(token) > 1 THEN 'text' WHEN regexp_matches(token, '^r["'']') THEN 'rune' WHEN starts_with(token, '`') AND len(token) > 1 THEN 'raw'
      WHEN token IN (KEYWORDS) THEN 'keyword' WHEN regexp_matches(token, '^[A-Za-z_]') THEN 'name' WHEN regexp_matches(token, '^0[xX]') THEN 'integer' WHEN regexp_matches(token, '^[0-9].*[.eEf]') THEN 'float' WHEN regexp_matches(token, '^[0-9]') THEN 'integer'
      WHEN token IN (SIGNS) THEN 'operator' ELSE 'sign' END AS kind FROM t)
    SELECT page_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL""".replace("OPERATORS", "|".join("".join("\\" + c for c in op) for op in lexing.OPERATORS)).replace("KEYWORDS", ", ".join(f"'{k}'" for k in lexing.KEYWORDS)).replace("SIGNS", ", ".join(f"'{o}'" for o in lexing.OPERATORS))
)
def lex_pages(spark, d):
    return lexing.lex(_t(spark, d, "pages"), "page_id", "html").groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@_query()
def check_fragments(spark, d):
    parts = lexing.fragments(_t(spark, d, "documents"), "doc_id", "text", "line")
    return checker.check_batch(parts.selectExpr("doc_id as stream_id", "seq", "fragment"))


@_query("SELECT doc_id, sha256(text) AS digest FROM documents")
def source_digests(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


def queries() -> dict:
    return _QUERIES | harness.QUERIES | generics.QUERIES | scopes.QUERIES | locks.QUERIES


def oracle_sql() -> dict:
    return _SQL | harness.SQL | generics.SQL | scopes.SQL | locks.SQL
