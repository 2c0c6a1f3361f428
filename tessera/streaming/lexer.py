"""Tokens of many streams of fragments: a fragment gives the tokens that it makes certain, in batch and in Structured Streaming.

The state of a stream is its open end and where that begins; an open end is one name, number,
operator, text or comment. Fragments are taken by seq from 0 on; of a repeated seq the smallest
text counts in a batch, the first to arrive in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.lexing import _rows, candidates, moved, scan, viable

OUT = "stream_id string, seq long, tokens array<struct<kind: string, token: string, line: int, col: int>>, partial string, candidates array<string>, continuable boolean"
COLUMNS = ["stream_id", "seq", "tokens", "partial", "candidates", "continuable"]
STATE = "next_seq long, open string, line int, col int, held_seq array<bigint>, held array<string>"


def feed(open_: str, line: int, col: int, fragment: str) -> tuple[list[dict], str, int, int]:
    """The tokens that a fragment makes certain, the open end after it, and its line and column."""
    text = open_ + fragment
    found, cut = scan(text, last=False)
    tokens = [{"kind": k, "token": t, "line": at, "col": c} for k, t, at, c in _rows(text, found, line, col)]
    line, col = moved(text, 0, cut, line, col)
    return tokens, text[cut:], line, col


def lex_batch(fragments: DataFrame) -> DataFrame:
    """(stream_id, seq, tokens, partial, candidates, continuable) per fragment (stream_id, seq, fragment), up to the first seq that is missing. Nulls in stream_id or seq are left out; a null fragment is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, open_, line, col, next_seq = None, "", 1, 1, 0
        for pdf in batches:
            out = []
            for stream, seq, text in zip(pdf["stream_id"], pdf["seq"], pdf["fragment"]):
                if stream != at:
                    at, open_, line, col, next_seq = stream, "", 1, 1, 0
                if seq != next_seq:
                    continue
                tokens, open_, line, col = feed(open_, line, col, text if isinstance(text, str) else "")
                out.append((stream, seq, tokens, open_, candidates(open_), viable(open_)))
                next_seq += 1
            yield pd.DataFrame(out, columns=COLUMNS)

    rows = fragments.selectExpr("cast(stream_id as string) stream_id", "cast(seq as bigint) seq", "fragment").filter("stream_id is not null and seq is not null")
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq", "fragment").mapInPandas(run, OUT)


def lex_stream(fragments: DataFrame, most_waiting: int = 10_000) -> DataFrame:
    """The same over a streaming DataFrame. Fragments that come early wait in the state, most_waiting a stream; more of them raise an error, as the missing one is then not expected any more."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_seq, open_, line, col, held_seq, held = state.get if state.exists else (0, "", 1, 1, [], [])
        waiting = dict(zip(held_seq, held))
        for pdf in parts:
            for seq, text in zip(pdf["seq"], pdf["fragment"]):
                if seq >= next_seq:
                    waiting.setdefault(int(seq), text if isinstance(text, str) else "")
        out = []
        while next_seq in waiting:
            tokens, open_, line, col = feed(open_, line, col, waiting.pop(next_seq))
            out.append((key[0], next_seq, tokens, open_, candidates(open_), viable(open_)))
            next_seq += 1
        if len(waiting) > most_waiting:
            raise RuntimeError(f"stream {key[0]}: fragment {next_seq} is missing")
        state.update((next_seq, open_, line, col, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=COLUMNS)

    rows = fragments.selectExpr("cast(stream_id as string) stream_id", "cast(seq as bigint) seq", "fragment").filter("stream_id is not null and seq is not null")
    return rows.groupBy("stream_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
