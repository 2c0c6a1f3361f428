"""Binary token tables: a data source of Spark that reads ranges of their entries, and a writer.

A table is a header (magic, count of ids, bytes of the payload), an offset and a length for each id, and the
payload; numbers are little-endian unsigned 32-bit. An id without bytes has the offset MISSING.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
MAGIC, MISSING = b"CJTK\x01\x00\x00\x00", 0xFFFFFFFF
HEAD = len(MAGIC) + 8
#: Entries that are read at once, and partitions that the ranges of so many entries are dealt out to.
ENTRIES, PARTITIONS = 100_000, 200


class TokenTableError(ValueError):
    """A token table that can't be read."""


class NoTable(TokenTableError):
    """The file can't be opened."""


class BadHeader(TokenTableError):
    """The file doesn't begin as a token table does."""


class ShortEntries(TokenTableError):
    """The file ends before its last entry."""


class ShortPayload(TokenTableError):
    """The file ends before the end of its payload."""


class BadEntry(TokenTableError):
    """An entry points outside of the payload."""


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def header(path: str) -> tuple[int, int]:
    """Count of ids and bytes of the payload of a table, after a look at the file's length."""
    system, name = _place(path)
    info = system.get_file_info(name)
    if info.type != fs.FileType.File:
        raise NoTable(f"{path} is no file that can be opened")
    with system.open_input_file(name) as file:
        head = file.read(HEAD)
    if not head.startswith(MAGIC):
        raise BadHeader(f"{path} doesn't begin with a token table's magic")
    if len(head) < HEAD:
        raise ShortEntries(f"{path} ends within its header")
    count, payload = (int(x) for x in np.frombuffer(head[len(MAGIC) :], "<u4"))
    if info.size < HEAD + 8 * count:
        raise ShortEntries(f"{path} has no room for {count} entries")
    if info.size < HEAD + 8 * count + payload:
        raise ShortPayload(f"{path} has no room for {payload} bytes after its entries")
    return count, payload


class _Range:
    def __init__(self, path: str, start: int, stop: int, count: int, payload: int):
        self.path, self.start, self.stop, self.count, self.payload = path, start, stop, count, payload


class _Ranges(InputPartition):
    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, path: str, entries: int, most: int = PARTITIONS):
        self.path, self.entries, self.most = path, entries, most

    def partitions(self) -> list[InputPartition]:
        system, name = _place(self.path)
        paths = [self.path]
        if system.get_file_info(name).type == fs.FileType.Directory:
            paths = sorted(f.path for f in system.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
            if "://" in self.path:
                paths = [f"{self.path.rstrip('/')}/{p.rpartition('/')[2]}" for p in paths]
        out: list[_Range] = []
        for path in paths:
            count, payload = header(path)
            out += [_Range(path, i, min(i + self.entries, count), count, payload) for i in range(0, max(count, 1), self.entries)]
        each = max(-(-len(out) // self.most), 1)
        return [_Ranges(out[i : i + each]) for i in range(0, len(out), each)]

    def read(self, part: _Ranges) -> Iterator[pa.RecordBatch]:
        for entries in part.ranges:
            yield self._batch(entries)

    def _batch(self, part: _Range) -> pa.RecordBatch:
        system, name = _place(part.path)
        with system.open_input_file(name) as file:
            file.seek(HEAD + 8 * part.start)
            entries = np.frombuffer(file.read(8 * (part.stop - part.start)), "<u4").reshape(-1, 2).astype(np.int64)
            there = entries[:, 0] != MISSING
            ends = entries.sum(1)
            if (ends[there] > part.payload).any():
                bad = part.start + int(np.flatnonzero(there & (ends > part.payload))[0])
                raise BadEntry(f"{part.path}: the bytes of id {bad} lie outside of the payload")
            first, last = (int(entries[there, 0].min()), int(ends[there].max())) if there.any() else (0, 0)
            file.seek(HEAD + 8 * part.count + first)
            data = file.read(last - first)
        values = [data[a - first : a - first + n] if ok else None for (a, n), ok in zip(entries.tolist(), there.tolist(), strict=True)]
        table = part.path.rpartition("/")[2]
        return pa.RecordBatch.from_arrays([pa.array([table] * len(values), pa.string()), pa.array(np.arange(part.start, part.stop, dtype=np.int32)), pa.array(values, pa.binary())], ["table", "token_id", "bytes"])


class TokenTables(DataSource):
    """spark.dataSource.register(TokenTables); spark.read.format("token_table").load(path of a table or of a folder of them): table (the file's name), token_id, bytes (null for an id without).

    A range of entries (option entries) is read at once, with its part of the payload alone; a partition reads one range after another, so that there
    are as many partitions as ranges, but no more than the option partitions says. The path must be one that the driver and
    the tasks can open. A file that is no sound table raises NoTable, BadHeader, ShortEntries, ShortPayload or BadEntry.
    """

    @classmethod
    def name(cls) -> str:
        return "token_table"

    def schema(self) -> str:
        return "table string, token_id int, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("entries", ENTRIES)), int(self.options.get("partitions", PARTITIONS)))


def table_bytes(ids: list[int], values: list[bytes]) -> bytes:
    """A table that has these ids, those between them being missing; of an id that stands twice, the last one counts."""
    entries = np.full((max(ids, default=-1) + 1, 2), MISSING, np.uint32)
    entries[:, 1] = 0
    ends = np.cumsum([0] + [len(v) for v in values])
    for i, a, v in zip(ids, ends.tolist(), values, strict=False):
        entries[i] = a, len(v)
    return b"".join([MAGIC, np.array([len(entries), ends[-1]], "<u4").tobytes(), entries.astype("<u4").tobytes(), *values])


def write_token_tables(tokens: DataFrame, folder: str) -> None:
    """Writes a file a table of tokens (table, token_id, bytes) into a folder that tasks can write to; each is whole before it gets its name, so a task that runs again does no harm. A table is one task's, as it is one file; rows with a null are left out."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        system, name = _place(folder)
        system.create_dir(name, recursive=True)
        rows = rows.sort_by([("token_id", "ascending"), ("bytes", "ascending")])
        path = f"{name}/{key[0].as_py()}"
        with system.open_output_stream(f"{name}/_{key[0].as_py()}.{id(rows)}") as file:
            file.write(table_bytes(rows.column("token_id").to_pylist(), rows.column("bytes").to_pylist()))
        system.move(f"{name}/_{key[0].as_py()}.{id(rows)}", path)
        return pa.table({"table": [key[0].as_py()], "ids": [rows.num_rows]})

    kept = tokens.select(F.col("table").cast("string").alias("table"), F.col("token_id").cast("int").alias("token_id"), "bytes").dropna()
    kept.groupBy("table").applyInArrow(run, "table string, ids long").write.format("noop").mode("overwrite").save()
