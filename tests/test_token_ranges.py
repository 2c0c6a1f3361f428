"""Many ranges of a token table share partitions, and each is read whole."""

from tessera.sources import token_table as tt


def test_ranges_share_partitions(tmp_path):
    for name, n in (("a", 1000), ("b", 37), ("c", 0)):
        (tmp_path / name).write_bytes(tt.table_bytes([2 * i for i in range(n)], [b"x" * (i % 4) for i in range(n)]))
    reader = tt._Reader(str(tmp_path), 7)
    parts = reader.partitions()
    assert 100 < len(parts) <= 200
    batches = [b for p in parts for b in reader.read(p)]
    assert max(b.num_rows for b in batches) == 7
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    assert rows == [(name, i, None if i % 2 else b"x" * (i // 2 % 4)) for name, n in (("a", 1000), ("b", 37)) for i in range(2 * n - 1)]
