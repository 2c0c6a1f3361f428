"""Token tables are read as they were written, and each way in which one is broken has its own error."""

import numpy as np
import pytest

from tessera.sources import token_table as tt


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(tt.TokenTables)
    return lambda path, **options: spark.read.format("token_table").options(**options).load(str(path))


def test_round_trip(spark, source, tmp_path):
    rows = [("a", i, bytes([i % 256]) * (i % 5)) for i in range(0, 500) if i % 7] + [("b", 3, b"x"), ("b", 0, "é".encode()), ("c", None, b"no"), ("d", 1, None)]
    tt.write_token_tables(spark.createDataFrame(rows, "table string, token_id int, bytes binary"), f"file://{tmp_path}/t")
    for options in ({}, {"entries": "7"}):
        got = {(r["table"], r["token_id"]): r["bytes"] and bytes(r["bytes"]) if r["bytes"] is not None else None for r in source(f"file://{tmp_path}/t", **options).collect()}
        assert {k: v for k, v in got.items() if v is not None} == {(t, i): v for t, i, v in rows if i is not None and v is not None}
        assert len(got) == 500 + 4 and got["a", 7] is None and got["b", 1] is None
    assert source(f"{tmp_path}/t/a", entries="100").rdd.getNumPartitions() == 5


def test_each_corruption_has_its_error(source, tmp_path):
    whole = tt.table_bytes([0, 2], [b"abc", b"de"])
    broken = {
        tt.BadHeader: [b"", b"CJTK\x02\x00\x00\x00" + whole[8:], whole[:5]], tt.ShortEntries: [whole[:8], whole[:14], whole[:20], whole[:39]], tt.ShortPayload: [whole[:-1]],
        tt.BadEntry: [whole[:16] + np.array([4, 2], "<u4").tobytes() + whole[24:], whole[:16] + np.array([6, 0], "<u4").tobytes() + whole[24:]],
    }
    with pytest.raises(tt.NoTable):
        tt.header(str(tmp_path / "none"))
    for error, files in broken.items():
        for i, data in enumerate(files):
            path = tmp_path / f"{error.__name__}{i}"
            path.write_bytes(data)
            with pytest.raises(error):
                reader = tt._Reader(str(path), 10)
                for part in reader.partitions():
                    list(reader.read(part))
            with pytest.raises(Exception, match="lie outside|magic|no room|within its header"):
                source(path).collect()
    (tmp_path / "ok").write_bytes(whole)
    assert [(r["token_id"], r["bytes"]) for r in source(tmp_path / "ok").collect()] == [(0, b"abc"), (1, None), (2, b"de")]
    (tmp_path / "empty").write_bytes(tt.table_bytes([], []))
    assert source(tmp_path / "empty").collect() == []
