"""The queries that have SQL against DuckDB."""

import duckdb
import pytest

from tally.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_oracle(spark, name, at):
    sf = f"/root/testdata/{at}"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(want, key=str)
