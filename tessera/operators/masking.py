"""Texts of programs with all that is no code made blank, long ones in parts at once.

What a part does to a text depends only on how it begins: in code, in a comment of some depth, in a quoted text.
So every part is first reduced to the end it reaches from each beginning; those are put together
in order, which gives each part its beginning; and then the parts are masked, wherever they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.folders import stored

#: Characters of a part.
PART = 1 << 20
CODE, LINE, DOUBLE, SINGLE, MULTI, COMMENT = range(6)
#: Where a mode ends, or goes on after a mark: in code the marks that begin another one.
_MARKS = {CODE: re.compile(r"""//|/\*|\"""|["']"""), LINE: re.compile(r"[\n\r]"), DOUBLE: re.compile(r'\\|"'), SINGLE: re.compile(r"\\|'"), MULTI: re.compile(r'\\|"""'), COMMENT: re.compile(r"/\*|\*/")}
_BEGINS = {"//": LINE, "/*": COMMENT, '"""': MULTI, '"': DOUBLE, "'": SINGLE}
_SEEN = re.compile(r"[^\n\r]")
#: mode, characters at the start that belong to what came before, depth of comments.
State = tuple[int, int, int]
STATE = "struct<mode: int, skip: int, depth: bigint>"
ENDS = f"struct<plain: array<{STATE}>, commented: array<struct<adds: bigint, skip: int, exits: array<{STATE}>>>>"


def walk(text: str, n: int, state: State, spans: list[tuple[int, int]] | None = None) -> State:
    """The state after the first n characters of a text that begins in a state; spans takes what is no code. The text goes on for at least two characters after those, or ends before."""
    mode, at, depth = state
    start = 0
    if at and mode == CODE and spans is not None:
        spans.append((0, at))
    while at < n:
        mark = _MARKS[mode].search(text, at)
        if not mark or mark.start() >= n:
            at = n
            break
        at, found = mark.end(), mark[0]
        if mode == CODE:
            mode, start, depth = _BEGINS[found], mark.start(), 1
            continue
        if found == "\\":
            at += 1
            continue
        if mode == COMMENT:
            depth += 1 if found == "/*" else -1
            if depth:
                continue
        if spans is not None:
            spans.append((start, mark.start() if mode == LINE else at))
        mode = CODE
    if mode != CODE and spans is not None:
        spans.append((start, n))
    return mode, max(0, at - n), depth if mode == COMMENT else 0


def ends(text: str, n: int) -> dict:
    """The states that a part ends in: plain for each mode but comments and each count of characters to skip; commented, for a skip of 0 or 1, by how much the depth grows and the states behind each depth that it gets out of."""
    plain = [walk(text, n, (mode, skip, 0)) for mode in range(COMMENT) for skip in range(3)]
    commented = []
    for skip in range(2):
        depth = least = 0
        at, exits = skip, []
        while at < n and (mark := _MARKS[COMMENT].search(text, at)) and mark.start() < n:
            at = mark.end()
            depth += 1 if mark[0] == "/*" else -1
            if depth < least:
                least = depth
                exits.append(walk(text, n, (CODE, at, 0)) if at < n else (CODE, at - n, 0))
        commented.append((depth, max(0, at - n), exits))
    return {"plain": [_named(s) for s in plain], "commented": [{"adds": d, "skip": k, "exits": [_named(s) for s in x]} for d, k, x in commented]}


def _named(state: State) -> dict:
    return dict(zip(("mode", "skip", "depth"), state, strict=True))


def after(state: State, part: dict) -> State:
    """The state after a part, by its ends."""
    mode, skip, depth = state
    if mode != COMMENT:
        return tuple(part["plain"][3 * mode + skip].values())
    found = part["commented"][skip]
    if depth <= len(found["exits"]):
        return tuple(found["exits"][depth - 1].values())
    return COMMENT, found["skip"], depth + found["adds"]


def masked(text: str, n: int, state: State = (CODE, 0, 0)) -> str:
    """The first n characters of a text that begins in a state, blanks for all that is no code; line ends stay."""
    spans: list[tuple[int, int]] = []
    walk(text, n, state, spans)
    out, at = [], 0
    for start, end in spans:
        end = min(end, n)
        out += [text[at:start], _SEEN.sub(" ", text[start:end])]
        at = max(at, end)
    return "".join([*out, text[at:n]])


def mask_non_code(sources: DataFrame, id_col: str, text_col: str, part: int = PART) -> DataFrame:
    """(id, masked): each text with comments (they nest) and quoted texts as blanks, of the same length, line ends kept. What is open at the end is masked up to there.

    A text of more than part characters is cut into parts that go to tasks of their own. Null stays null, rows that repeat
    an id stand for themselves.
    """
    rows = sources.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(length(text) - 1) div {part}").cast("int")))
    cut = rows.select("id", "row", "text", F.explode_outer(F.when(F.col("text").isNotNull(), places)).alias("seq"))
    cut = cut.select("id", "row", "seq", (F.length("text") > F.lit(part) * (F.col("seq") + 1)).alias("more"), F.substring("text", F.col("seq") * part + 1, F.lit(part + 2)).alias("text"))
    parts = stored(cut, "parts")  # so that rows keep their numbers

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ends(t, min(len(t), part)) for t in batch.column("text").to_pylist()]
            kind = pa.struct([("mode", pa.int32()), ("skip", pa.int32()), ("depth", pa.int64())])
            whole = pa.struct([("plain", pa.list_(kind)), ("commented", pa.list_(pa.struct([("adds", pa.int64()), ("skip", pa.int32()), ("exits", pa.list_(kind))])))])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("seq"), pa.array(found, whole)], ["row", "seq", "ends"])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, listed in zip(batch.column("row").to_pylist(), batch.column("listed").to_pylist(), strict=True):
                state: State = (CODE, 0, 0)
                for one in listed:
                    state = after(state, one["ends"])
                    out.append((row, one["seq"] + 1, *state))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["row", "seq", "mode", "skip", "depth"])

    several = parts.filter("more").select("row", "seq", "text").repartition("row", "seq").mapInArrow(measured, f"row bigint, seq int, ends {ENDS}")
    listed = several.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "ends"))).alias("listed"))  # ends of parts, not the parts
    starts = listed.mapInArrow(begun, "row bigint, seq int, mode int, skip int, depth bigint")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else masked(t, min(len(t), part), (m or 0, s or 0, d or 0)) for t, m, s, d in zip(*(batch.column(c).to_pylist() for c in ("text", "mode", "skip", "depth")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), batch.column("seq"), pa.array(texts, pa.string())], ["id", "row", "seq", "masked"])

    kind = rows.schema["id"].dataType.simpleString()
    done = parts.join(starts, ["row", "seq"], "left").select("id", "row", "seq", "text", "mode", "skip", "depth").mapInArrow(written, f"id {kind}, row bigint, seq int, masked string")
    whole = done.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("seq", "masked"))).alias("parts"), F.count("masked").alias("n"))
    text = F.when(F.col("n") > 0, F.array_join(F.transform("parts", lambda p: p["masked"]), ""))
    return whole.select(F.col("id").alias(id_col), text.alias("masked"))
