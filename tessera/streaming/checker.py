"""Verdicts over many streams of fragments, in batch and in Structured Streaming, by one small step function.

A step takes what a stream has left open (brackets, a quoted text, a comment) and the next
fragment; a stream is rejected at the first fragment with a closing bracket that nothing opened,
and nothing is answered after that. Fragments are taken by seq from 0 on, and nothing is answered
after a gap; of a repeated seq the smallest text counts in a batch, the first to arrive in a stream.
Rows without a stream or a seq are left out, a null fragment is empty. Where a text is cut into fragments makes no difference to
what is accepted in the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_CLOSES = {")": "(", "]": "[", "}": "{"}
#: The characters that change what is open.
_SIGNS = re.compile(r"""[()\[\]{}"'/*\\\n]""")
STATE = "next_seq long, open string, mode string, last string, failed boolean, held_seq array<bigint>, held array<string>"
OUT = "stream_id string, seq long, ok boolean, depth int"


def step(open_: str, mode: str, last: str, fragment: str) -> tuple[bool, str, str, str]:
    """Whether the text may go on, and what is open after it. mode: '' in code, a quote in a text, / in a line comment, * (once per level) in block comments; last: a sign that may begin one."""
    end = 0
    for m in _SIGNS.finditer(fragment):
        c, at = m[0], m.start()
        if at > end:  # what lies between is no sign, and ends one that may have begun
            last = ""
        end = at + 1
        pair, last = last + c, ""
        if mode == "/":
            mode = "" if c == "\n" else mode
        elif mode.startswith("*"):
            if pair == "*/":
                mode = mode[1:]
            elif pair == "/*":
                mode += "*"
            elif c in "*/":
                last = c
        elif mode:
            if pair[0] == "\\" and len(pair) == 2:
                pass
            elif c == "\\":
                last = c
            elif c == mode or c == "\n":
                mode = ""
        elif pair == "//":
            mode = "/"
        elif pair == "/*":
            mode = "*"
        elif c in "\"'":
            mode = c
        elif c in "([{":
            open_ += c
        elif c in _CLOSES:
            if not open_ or open_[-1] != _CLOSES[c]:
                return False, open_, mode, ""
            open_ = open_[:-1]
        elif c == "/":
            last = c
    return True, open_, mode, last if end == len(fragment) else ""


def check_batch(fragments: DataFrame) -> DataFrame:
    """(stream_id, seq, ok, depth) up to each stream's first reject. A stream's fragments come sorted through its task a batch at a time; none is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_, mode, last, failed, next_seq = None, "", "", "", False, 0
        for batch in batches:
            streams, seqs = batch.columns[:2]
            kept, oks, depths = [], [], []
            for row, (stream, seq, text) in enumerate(zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True)):
                if stream != at:
                    at, open_, mode, last, failed, next_seq = stream, "", "", "", False, 0
                if failed or seq != next_seq:
                    continue
                ok, open_, mode, last = step(open_, mode, last, text or "")
                failed, next_seq = not ok, next_seq + 1
                kept.append(row)
                oks.append(ok)
                depths.append(len(open_))
            rows = pa.array(kept, pa.int32())
            yield pa.RecordBatch.from_arrays([streams.take(rows), seqs.take(rows), pa.array(oks, pa.bool_()), pa.array(depths, pa.int32())], ["stream_id", "seq", "ok", "depth"])

    rows = fragments.selectExpr("cast(stream_id as string) stream_id", "cast(seq as bigint) seq", "cast(fragment as string) fragment").filter("stream_id is not null and seq is not null")
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq", "fragment").mapInArrow(run, OUT)


def check_stream(fragments: DataFrame, most_waiting: int = 10_000) -> DataFrame:
    """The same over a streaming DataFrame: early fragments wait in the state, most_waiting a stream; more of them raise an error, as the missing one is then not expected any more."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_seq, open_, mode, last, failed, held_seq, held = state.get if state.exists else (0, "", "", "", False, [], [])
        waiting = dict(zip(held_seq, held))
        for pdf in parts:
            for seq, text in zip(pdf["seq"], pdf["fragment"]):
                if not failed and seq >= next_seq:
                    waiting.setdefault(int(seq), text if isinstance(text, str) else "")
        out = []
        while not failed and next_seq in waiting:
            ok, open_, mode, last = step(open_, mode, last, waiting.pop(next_seq))
            out.append((key[0], next_seq, ok, len(open_)))
            failed, next_seq = not ok, next_seq + 1
        if failed:
            waiting = {}
        if len(waiting) > most_waiting:
            raise RuntimeError(f"stream {key[0]}: fragment {next_seq} is missing")
        state.update((next_seq, open_, mode, last, failed, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "ok", "depth"])

    rows = fragments.selectExpr("cast(stream_id as string) stream_id", "cast(seq as bigint) seq", "fragment").filter("stream_id is not null and seq is not null")
    return rows.groupBy("stream_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
