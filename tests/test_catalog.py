"""Every catalog query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tally.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if x != x else round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, oracle, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    if name in ORACLE:
        cols = sorted(df.columns)
        want = oracle.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
        assert plain([[r[c] for c in cols] for r in rows]) == plain(want)
    else:
        assert rows


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)
