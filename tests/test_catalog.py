"""Every query of the catalog with SQL gives the same rows as DuckDB, over the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, db, name):
    ours = catalog.queries()[name](spark, DIR)
    theirs = db.sql(catalog.oracle_sql()[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    assert plain(tuple(r[n] for n in names) for r in ours.collect()) == plain(theirs.select(*[f'"{n}"' for n in names]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0
