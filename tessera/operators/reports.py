"""Relations of a test harness: which cases run, what their runs add up to, and what holds of them.

Every operator is a plan of joins, groupings and windows over its tables. Unless a docstring says
otherwise: a null key is a key like any other, repeated rows count as often as they stand, an empty
table gives an empty one, and columns that an operator doesn't name are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def select_cases(cases: DataFrame, families: Sequence[str] = (), skip: Sequence[str] = (), name_part: str = "", family: str = "family", name: str = "name") -> DataFrame:
    """The cases of families (all if none is given) that are in none of skip and whose name has name_part, with all their columns. A null family is in no list; a null name has no part but ''."""
    keep = F.lit(True)
    if families:
        keep = keep & F.coalesce(F.col(family).isin(*families), F.lit(False))
    if skip:
        keep = keep & ~F.coalesce(F.col(family).isin(*skip), F.lit(False))
    if name_part:
        keep = keep & F.coalesce(F.contains(F.col(name), F.lit(name_part)), F.lit(False))
    return cases.filter(keep)


def first_rows(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first `most` rows in the order of columns that tell all rows apart, nulls first."""
    return rows.orderBy(*(F.asc_nulls_first(c) for c in order)).limit(most)


def sum_counters(records: DataFrame, counters: str, *by: str) -> DataFrame:
    """(by..., counter, total, records): sums per key over a column of maps, and in how many records the key stands. Null maps have no keys, a null value counts as 0. Map-side sums come first, so a frequent key is no hot one."""
    each = records.select(*by, F.explode(counters).alias("counter", "value"))
    return each.groupBy(*by, "counter").agg(F.sum(F.coalesce("value", F.lit(0))).cast("long").alias("total"), F.count("*").alias("records"))


def trial_counts(runs: DataFrame, planned: int, by: Sequence[str], timed_out: str = "timed_out", ok: str = "ok", took: str = "took") -> DataFrame:
    """(by..., planned, observed, completed, timed_out, ok, missing, median_took): counts of a group's runs, how many of the planned ones are missing (0 at least), and the median time of completed ones. A null flag is false, a null time is not counted."""
    late, good = F.coalesce(timed_out, F.lit(False)), F.coalesce(ok, F.lit(False))
    return runs.groupBy(*by).agg(
        F.lit(planned).cast("long").alias("planned"), F.count("*").alias("observed"), F.count_if(~late).alias("completed"), F.count_if(late).alias("timed_out"), F.count_if(good).alias("ok"),
        F.greatest(F.lit(0), F.lit(planned) - F.count("*")).cast("long").alias("missing"), F.median(F.when(~late, F.col(took))).alias("median_took"),
    )


def inversion_errors(plain: DataFrame, competition: DataFrame, key: str) -> DataFrame:
    """Per key of either transcript (key, seq, bit) the places where the second is not the first with 0 and 1 exchanged, one that is missing on a side among them: (key, n, errors, inverted)."""
    a = plain.select(key, "seq", F.col("bit").alias("a"))
    b = competition.select(key, "seq", F.col("bit").alias("b"))
    wrong = ~F.coalesce(F.col("a") + F.col("b") == 1, F.lit(False))
    rows = a.join(b, [key, "seq"], "full_outer")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors"), (F.count_if(wrong) == 0).alias("inverted"))


def transcript_digest(answers: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, n, digest): SHA-256 over a transcript's answers in order, each after its length in UTF-8 as 8 bytes, highest first. A null answer is an empty one; answers of equal order follow their text. A transcript is one row of a group, as long as one stream's answers are."""
    value = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    framed = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value).cast("long")), 16, "0")), value)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), framed.alias("framed"))))
    joined = F.array_join(F.transform(parts, lambda x: F.hex(x["framed"])), "")
    return answers.groupBy(key).agg(F.count("*").alias("n"), F.sha2(F.unhex(joined), 256).alias("digest"))


def corpus_digest(files: DataFrame, path: str, source: str, digits: Sequence[int] = (5, 3, 0)) -> DataFrame:
    """(n, digest) of a corpus, whatever the order of its rows: SHA-256 over its sorted lines `path NUL sha256(source) NUL`, in levels.

    Lines are digested by the first digits of their path's SHA-256, those digests by fewer digits,
    and so on, so no task holds more than a share of 16 ** -5 of a corpus or 256 (4096) digests. A
    null path or source is an empty one; of repeated rows each counts. An empty corpus has n 0 and
    the digest of nothing.
    """
    line = F.concat(F.coalesce(path, F.lit("")), F.lit("\x00"), F.sha2(F.coalesce(source, F.lit("")), 256), F.lit("\x00"))
    rows = files.select(F.sha2(F.coalesce(path, F.lit("")), 256).alias("at"), line.alias("line"), F.lit(1).cast("long").alias("n"))
    for k in digits:
        joined = F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256)
        rows = rows.groupBy(F.substring("at", 1, k).alias("at")).agg(F.concat(F.substring(F.min("at"), 1, k), joined).alias("line"), F.sum("n").alias("n"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("line"), F.sha2(F.lit(""), 256)).alias("digest"))


def lookup(rows: DataFrame, table: DataFrame, on: str, *columns: str) -> DataFrame:
    """The rows with all their columns and those of the table's row for their key, null where it has none; of several rows of a key, the smallest by these columns. A null key finds nothing."""
    one = table.filter(F.col(on).isNotNull()).groupBy(on).agg(F.min(F.struct(*columns)).alias("found"))
    return rows.join(one, on, "left").select(*rows.columns, *(F.col(f"found.{c}").alias(c) for c in columns))


def below_threshold(rows: DataFrame, member: Sequence[str], passed: Column, least: float, exempt: DataFrame | None = None) -> DataFrame:
    """(member..., n, passed, ratio) of members whose share of passed rows is under least and that exempt (their columns) doesn't name. A null condition is a fail."""
    good = F.coalesce(passed, F.lit(False))
    stats = rows.groupBy(*member).agg(F.count("*").alias("n"), F.count_if(good).alias("passed")).withColumn("ratio", F.col("passed") / F.col("n"))
    low = stats.filter(F.col("ratio") < least)
    if exempt is None:
        return low
    free = exempt.select(*(F.col(c).alias(f"x{i}") for i, c in enumerate(member))).distinct()
    same = F.lit(True)
    for i, c in enumerate(member):
        same = same & F.col(c).eqNullSafe(F.col(f"x{i}"))
    return low.join(free, same, "left_anti")


def gate(rows: DataFrame, category: str, prefix: str = "BUG_") -> DataFrame:
    """(category, n, fatal) of each category, and whether it fails the gate by its prefix. A null category doesn't."""
    return rows.groupBy(category).agg(F.count("*").alias("n")).withColumn("fatal", F.coalesce(F.startswith(F.col(category), F.lit(prefix)), F.lit(False)))


# What reading, calling, calling as a value, and whether the call was refused as not callable (1 or 0 each) tell of a member.
PROBE_KINDS = {
    "field": ("1001",),
    "method": ("0110", "0111"),
    "callable_field": ("1100", "1101", "1110", "1111"),
    "error": ("0000", "0001"),
}


def classify_probes(probes: DataFrame, member: Sequence[str], probe: str = "probe", verdict: str = "verdict", code: str = "code") -> DataFrame:
    """Per member the kind that its probes A (read), B (call) and C (call as a value) tell by PROBE_KINDS, special where it has none; (member..., a, b, c, kind).

    A probe accepts if one of its rows does; one without rows doesn't.
    """
    accepts = lambda name: F.max((F.col(probe).eqNullSafe(name) & F.col(verdict).eqNullSafe("ACCEPT")).cast("int"))
    refused = F.max((F.col(probe).eqNullSafe("B") & F.col(code).eqNullSafe("E_SYNTH_NOT_CALLABLE")).cast("int"))
    rows = probes.groupBy(*member).agg(*(accepts(x).alias(x.lower()) for x in "ABC"), refused.alias("refused"))
    kinds = F.create_map(*(F.lit(x) for kind, bits in PROBE_KINDS.items() for b in bits for x in (b, kind)))
    told = F.coalesce(F.try_element_at(kinds, F.concat("a", "b", "c", "refused")), F.lit("special"))
    return rows.select(*member, *(F.col(x).cast("boolean").alias(x) for x in "abc"), told.alias("kind"))


def fragmentation_invariance(results: DataFrame, case: str, layout: str = "layout", accepted: str = "accepted") -> DataFrame:
    """(case, layouts, verdicts, invariant): a case's verdict must be the same however its text was cut. A null verdict is a verdict of its own."""
    verdict = F.coalesce(F.col(accepted).cast("int"), F.lit(-1))
    return results.groupBy(case).agg(F.count_distinct(layout).alias("layouts"), F.count_distinct(verdict).alias("verdicts"), (F.count_distinct(verdict) == 1).alias("invariant"))


def premature_rejects(results: DataFrame) -> DataFrame:
    """Rejects (with all columns) of mutated cases at a byte where all that was read still belongs to the valid base: reject_byte <= mutation_start, expected_valid false. Nulls are no reject, no mutation or no expectation."""
    return results.filter("not expected_valid and reject_byte <= mutation_start")


def common_prefix(runs: DataFrame, case: str, run: str, seq: str = "seq", bit: str = "bit", expected: int = 0) -> DataFrame:
    """(case, runs, common): for how many answers all of a case's runs say to go on. A run's answers are numbered from 0; the shortest run, a missing number or a null answer ends it."""
    by_seq = runs.groupBy(case, seq).agg(F.count_distinct(F.when(F.col(bit) == expected, F.col(run))).alias("good"))
    many = runs.groupBy(case).agg(F.count_distinct(run).alias("runs"), (F.max(seq) + 1).alias("longest"))
    rows = many.join(by_seq, case, "left")
    full = F.when(F.col("good") == F.col("runs"), F.col(seq))
    # the first number that isn't common: the smallest gap of the common ones, whose rank is then below their number
    rank = F.row_number().over(W.partitionBy(case).orderBy(F.asc_nulls_last(full))) - 1
    ranked = rows.withColumn("full", full).withColumn("rank", rank)
    return ranked.groupBy(case).agg(F.max("runs").alias("runs"), F.count_if(F.col("full") == F.col("rank")).alias("common"))


def interleaved(plan: DataFrame, case: str, first: str = "control", second: str = "candidate") -> DataFrame:
    """The schedule (case, place, role, repetition) of a plan (case, first's and second's repetitions): in turn from first on, then the rest of the longer one. A null or negative number of repetitions is 0."""
    turns = [plan.filter(F.col(role) > 0).select(case, F.lit(role).alias("role"), F.lit(k).alias("k"), F.explode(F.expr(f"sequence(1, {role})")).alias("repetition")) for k, role in enumerate((first, second))]
    rows = turns[0].unionByName(turns[1])
    place = F.row_number().over(W.partitionBy(case).orderBy("repetition", "k")) - 1
    return rows.select(case, place.cast("long").alias("place"), "role", F.col("repetition").cast("long").alias("repetition"))


def within_scale(cases: DataFrame, most: dict[str, tuple[int, int]], family: str = "family", name: str = "name") -> DataFrame:
    """The cases with all their columns whose scale, the number at a place of their name's parts between '-', is no more than their family's most: {family: (place, most)}. Other families stay; a name without such a number does, too."""
    keep = F.lit(True)
    for kind, (place, limit) in most.items():
        scale = F.get(F.split(name, "-"), F.lit(place)).try_cast("bigint")
        keep = keep & ~F.coalesce((F.col(family) == kind) & (scale > limit), F.lit(False))
    return cases.filter(keep)


def in_order(cases: DataFrame, *order: str) -> DataFrame:
    """The rows in one total order, nulls first, with their place from 0. The places come from ranges: no task sees all rows."""
    keys = [F.asc_nulls_first(c) for c in order]
    ranged = cases.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    from .summaries import offsets_of_parts

    starts = offsets_of_parts(ranged.groupBy("part").agg(F.count("*").alias("n")), "part", "n")
    own = F.row_number().over(W.partitionBy("part").orderBy(*keys)) - 1
    return ranged.withColumn("own", own).join(F.broadcast(starts), "part").withColumn("place", F.col("before") + F.col("own")).drop("part", "own", "before")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., times) of keys that stand more than once: none if and only if the key is unique. Nulls are equal to each other."""
    return rows.groupBy(F.struct(*key).alias("key")).agg(F.count("*").alias("times")).filter("times > 1").select("key.*", "times")


def split_by_policy(messages: DataFrame, policy: str = "authoritative", tier: str = "tier") -> DataFrame:
    """Messages with all their columns and fatal: of the authoritative tier, or of any where the policy is 'all'. A null tier is diagnostic."""
    return messages.withColumn("fatal", F.lit(True) if policy == "all" else F.coalesce(F.col(tier) == "authoritative", F.lit(False)))


def derived_metrics(timings: DataFrame, *by: str) -> DataFrame:
    """(by..., tokens, slow_ms, fast_ms, speedup, us_per_token, ms_of_500, meets_goal) from sums of tokens, slow_ms and fast_ms: 0 where nothing was measured, and the goal is 500 tokens in under 50 ms. Nulls add nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = timings.groupBy(*by).agg(total("tokens").cast("long").alias("tokens"), F.round(total(F.col("slow_ms").cast("decimal(30,6)")), 2).cast("double").alias("slow_ms"), F.round(total(F.col("fast_ms").cast("decimal(30,6)")), 2).cast("double").alias("fast_ms"))
    per_token = F.when(F.col("tokens") > 0, F.col("fast_ms") * 1000 / F.col("tokens")).otherwise(0.0)
    rows = rows.withColumn("speedup", F.when(F.col("fast_ms") > 0, F.col("slow_ms") / F.col("fast_ms")).otherwise(0.0)).withColumn("us_per_token", per_token)
    return rows.withColumn("ms_of_500", F.col("us_per_token") * 500 / 1000).withColumn("meets_goal", F.col("ms_of_500") < 50)


def shapes_of_members(members: DataFrame, shapes: dict[str, str]) -> DataFrame:
    """A program per member and shape: the members with all their columns, shape and source, in which {receiver}, {member} and the like stand for columns. The shapes are literals, so there is no join."""
    filled = []
    for name, template in shapes.items():
        text = F.lit(template)
        for c in members.columns:
            text = F.replace(text, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
        filled.append(F.struct(F.lit(name).alias("shape"), text.alias("source")))
    return members.withColumn("made", F.explode(F.array(*filled))).select(*members.columns, "made.shape", "made.source")


def splice(fires: DataFrame, source: str = "source", at: str = "frontier_end", suffix: str = "suffix") -> DataFrame:
    """The rows with rebuilt: the source up to its frontier (in characters) with the suffix after it, null where one of them is null."""
    return fires.withColumn("rebuilt", F.concat(F.substring(F.col(source), F.lit(1), F.col(at)), F.col(suffix)))


def witness_buckets(checked: DataFrame, found: str = "found", accepted: str = "accepted") -> DataFrame:
    """(bucket, n): no witness, confirmed (its program passes), refuted (it doesn't) or unchecked (null)."""
    bucket = F.when(~F.coalesce(found, F.lit(False)), "no witness").when(F.col(accepted).isNull(), "unchecked").when(F.col(accepted), "confirmed").otherwise("refuted")
    return checked.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def last_statement(records: DataFrame, source: str = "source", headers: Sequence[str] = ("func ", "}", "{", "main")) -> DataFrame:
    """The rows with statement: the last line of source, trimmed, that isn't blank and starts with none of the headers; '?' where there is none."""
    lines = F.transform(F.split(F.coalesce(source, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" "))))
    plain = F.filter(lines, lambda x: (x != "") & ~F.exists(F.array(*map(F.lit, headers)), lambda h: F.startswith(x, h)))
    return records.withColumn("statement", F.coalesce(F.try_element_at(plain, F.lit(-1)), F.lit("?")))
