"""Every registered query with SQL against DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from docloom.operators import catalogue

DATA = Path("/root/testdata/sf0.001")
NAMES = sorted(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    df = catalogue.queries()[name](spark, str(DATA))
    got = rows([tuple(r) for r in df.collect()], df.columns)
    found = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(found.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
