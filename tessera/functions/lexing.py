"""Tokens of a programming language's texts: lines of ids, whole texts, fragments as they arrive, and what an open end may become."""

from __future__ import annotations

import re
from collections.abc import Generator, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The language's operators of several characters, longest first.
OPERATORS = (
    "&&=", "||=", "<<=", ">>=", "**=", "..=", "...", "==", "!=", "<:", "<=", ">=", "&&", "||", "??", "|>", "~>", "=>", "->", "<<", ">>",
    "**", "+=", "-=", "*=", "/=", "%=", "&=", "^=", "|=", "++", "--", "..",
)
# Its keywords.
KEYWORDS = (
    "func", "var", "let", "mut", "class", "struct", "enum", "interface", "extend", "import", "package", "if", "else", "for", "while", "do",
    "break", "continue", "return", "throw", "try", "catch", "finally", "match", "case", "in", "is", "as", "this", "super", "operator",
    "true", "false", "new", "spawn", "sync", "where", "type", "unsafe", "foreign", "macro", "quote", "public", "private", "static", "init",
)
KINDS = ("newline", "text", "multiline", "rune", "raw", "name", "keyword", "integer", "float", "operator", "sign")

_KEYWORDS = frozenset(KEYWORDS)
_LONGER = {op[:i] for op in OPERATORS for i in range(1, len(op))}
_STRING = r'"(?:[^"\\]|\\.)*"'
#: The tokens that a regular expression tells; block comments, which nest, are measured by hand.
_TOKEN = re.compile(
    r"(?P<blank>[ \t\r\f\v]+)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<block>/\*)"
    r'|(?P<multiline>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<text>' + _STRING + r")"
    r"|(?P<rune>r(?:'(?:[^'\\\n]|\\[^\n])*'|\"(?:[^\"\\\n]|\\[^\n])*\"))|(?P<raw>`[^`]*`)"
    r"|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>[0-9][A-Za-z0-9_.]*)|(?P<operator>" + "|".join(map(re.escape, OPERATORS)) + r")|(?P<sign>[^\n])",
    re.DOTALL,
)
_COMMENT = re.compile(r"/\*|\*/")


def token_id(raw: Column) -> Column:
    """The number that a line stands for: blanks around it, one plus, base 10, 64 bits; null for any other line."""
    number = F.regexp_extract(F.regexp_replace(raw, r"^[ \t\r]+|[ \t\r]+$", ""), r"^\+?(-?[0-9]+)$", 1)
    return F.when(number != "", number.try_cast("bigint"))


def _block_end(text: str, at: int) -> int:
    """Where the block comment that starts at a place ends, -1 if it doesn't."""
    depth = 0
    for m in _COMMENT.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return -1


def scan(text: str, last: bool = True) -> tuple[list[tuple[str, int, int]], int]:
    """The tokens (kind, start, end) of a text, and where what is not certain yet begins, as by scanned()."""
    found, out = scanned(text, last), []
    while True:
        try:
            out.append(next(found))
        except StopIteration as end:
            return out, end.value


def scanned(text: str, last: bool = True) -> Generator[tuple[str, int, int], None, int]:
    """The tokens (kind, start, end) of a text one after the other; returns where what is not certain yet begins.

    Unless this is the last of a text, a token is certain only when nothing that may follow changes
    it: a name, number or operator at the end may go on, an open text, rune, raw name or comment is
    one token to be. In the last part, what stays open is signs and names as they stand, an open
    block comment the rest of the text. A number is a run of digits, letters, _ and dots, a float
    if it has one of . e E f, so 0..10 is one float.
    """
    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "block":
            end = _block_end(text, at)
            if end < 0:
                return n if last else at
        elif not last:
            opens = kind == "text" and text.startswith('"""', at) or kind == "sign" and text[at] in '"`' or kind == "name" and text[at : at + 2] == "r" and end == n
            quote = kind == "name" and end == at + 1 and text[at] == "r" and end < n and text[end] in "'\""  # an open rune
            grows = end == n and (kind in ("name", "number", "line") or kind in ("operator", "sign") and text[at:end] in _LONGER | {"/"} or kind == "text" and text[at:end] == '""')
            if opens or grows or quote and "\n" not in text[end:]:
                return at
        if kind == "number":
            kind = "float" if any(c in ".eEf" for c in text[at + 1 : end]) and not text.startswith(("0x", "0X"), at) else "integer"
        elif kind == "name" and text[at:end] in _KEYWORDS:
            kind = "keyword"
        if kind not in ("blank", "line", "block"):
            yield kind, at, end
        at = end
    return n


def candidates(partial: str) -> list[str]:
    """What an open end may become: kinds of tokens, and the keywords that begin like it. None for blanks and comments."""
    if not partial or partial.isspace() or partial.startswith(("//", "/*")):
        return []
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", partial):
        return ["name", *(["rune"] if partial == "r" else []), *(k for k in KEYWORDS if k.startswith(partial))]
    if partial[0].isdigit():
        return ["integer", "float"] if not any(c in ".eEf" for c in partial) else ["float"]
    for start, kinds in (('"""', ["multiline"]), ('"', ["text", "multiline"] if partial in ('"', '""') else ["text"]), ("r'", ["rune"]), ('r"', ["rune"]), ("`", ["raw"])):
        if partial.startswith(start):
            return kinds
    return [op for op in OPERATORS if op.startswith(partial)] + (["sign"] if len(partial) == 1 else [])


def viable(partial: str) -> bool:
    """Whether an open end can still become a token: nothing, blanks, comments, and what has a candidate."""
    return not partial or partial.isspace() or partial.startswith(("//", "/*")) or bool(candidates(partial))


TOKENS = "pos int, kind string, token string, line int, col int"
#: Tokens that a task of lex() holds before it passes them on, and the characters that they may have.
HELD, HELD_CHARS = 20_000, 4_000_000


def _rows(text: str, tokens: Iterable[tuple[str, int, int]], line: int, col: int) -> Iterator[tuple[str, str, int, int]]:
    """Kind, text, line and column of tokens, of a text that starts at a line and column."""
    at = 0
    for kind, start, end in tokens:
        line, col = moved(text, at, start, line, col)
        yield kind, text[start:end], line, col
        at = start


def moved(text: str, start: int, end: int, line: int, col: int) -> tuple[int, int]:
    """Line and column after a part of a text."""
    lines = text.count("\n", start, end)
    return (line + lines, end - text.rfind("\n", start, end)) if lines else (line, col + end - start)


def _batch(ids: pa.Array, rows: list[tuple[int, int, str, str, int, int]]) -> pa.RecordBatch:
    at, pos, kind, token, line, col = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({
        "id": ids.take(pa.array(at, pa.int32())), "pos": pa.array(pos, pa.int32()), "kind": pa.array(kind, pa.string()), "token": pa.array(token, pa.string()), "line": pa.array(line, pa.int32()), "col": pa.array(col, pa.int32()),
    })


def lexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of batches of (id, text), HELD at most at a time, be it of many texts or of one."""
    for batch in batches:
        out, chars = [], 0
        for at, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            for pos, row in enumerate(_rows(text, scanned(text), 1, 1)):
                out.append((at, pos, *row))
                chars += len(row[1])
                if len(out) >= HELD or chars >= HELD_CHARS:
                    yield _batch(batch.column(0), out)
                    out, chars = [], 0
        if out:
            yield _batch(batch.column(0), out)


def lex(sources: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row (id, pos, kind, token, line, col) per token of each whole text, in order; blanks and comments (block comments nest) are skipped, line and column count from 1. A null text has none; rows that repeat an id stand for themselves."""
    kind = sources.schema[id_col].dataType.simpleString()
    rows = sources.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lexed, f"id {kind}, {TOKENS}")
    return rows.withColumnRenamed("id", id_col)


def type_ids(tokens: DataFrame, vocabulary: DataFrame, kind: str = "kind") -> DataFrame:
    """The tokens with type_id by a table (kind, type_id); a kind that it lacks is a name. Without a name in the table, null."""
    table = vocabulary.groupBy(F.col("kind").alias("of_kind")).agg(F.min("type_id").alias("type_id"))
    spare = vocabulary.filter("kind = 'name'").agg(F.min("type_id").alias("spare"))  # one row
    rows = tokens.join(table, F.col(kind) == F.col("of_kind"), "left").join(F.broadcast(spare))
    return rows.select(*tokens.columns, F.coalesce("type_id", "spare").alias("type_id"))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces (id, seq, fragment) of batches of (id, text, sizes), HELD at most at a time: from each start on to the next, a piece a step."""
    for batch in batches:
        ids, seqs, parts = [], [], []

        def passed(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(ids, pa.int32())), "seq": pa.array(seqs, pa.int32()), "fragment": pa.array(parts, pa.string())})

        for row, (text, sizes) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            text, sizes, at, seq = text.as_py(), sizes.values.to_numpy().tobytes(), 0, 0
            while at < len(text):
                end = at + sizes[at]
                ids.append(row)
                seqs.append(seq)
                parts.append(text[at:end])
                at, seq = end, seq + 1
                if len(ids) >= HELD:
                    yield passed()
                    ids, seqs, parts = [], [], []
        if ids:
            yield passed()


def fragments(sources: DataFrame, id_col: str, text_col: str, layout: str, seed: int = 0) -> DataFrame:
    """A text in parts (id, seq, fragment) that make it up: as a whole, by line, by word with the blanks before it, by character, or by pieces of 1 to 17 characters whose lengths follow from the id, the place and a seed. A null or empty text has no part."""
    text = F.col(text_col)
    if layout == "random":
        size = lambda k: (F.pmod(F.xxhash64(F.col(id_col), k, F.lit(seed)), F.lit(17)) + 1).cast("tinyint")
        # what a piece that starts at a character has for a length, of which only those where pieces start count
        sizes = F.transform(F.expr(f"sequence(0, length({text_col}) - 1)"), size)
        kind = sources.schema[id_col].dataType.simpleString()
        rows = sources.filter(F.length(text) > 0).select(F.col(id_col).alias("id"), text.alias("text"), sizes.alias("sizes"))
        return rows.mapInArrow(_pieces, f"id {kind}, seq int, fragment string").withColumnRenamed("id", id_col)
    pattern = {"whole": r"(?s)^.+$", "line": r"[^\n]*\n|[^\n]+$", "word": r"\s*\S+|\s+$", "character": r"(?s)."}[layout]
    return sources.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("seq", "fragment"))
