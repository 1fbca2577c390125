"""Every registered query against its SQL; queries without SQL give rows twice alike."""

import duckdb
import pytest

from textloom.plans import registry as R

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(names, rows):
    at = [names.index(c) for c in sorted(names)]
    return sorted(repr(tuple(r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(R.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, name):
    got = R.QUERIES[name](spark, sf)
    want = duck.sql(R.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of(list(want.columns), want.fetchall())


@pytest.mark.parametrize("name", sorted(set(R.QUERIES) - set(R.SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert R.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(R.QUERIES) <= set(entry.queries())
