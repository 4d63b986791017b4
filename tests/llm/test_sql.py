"""Queries of the operators with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from docloom.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    mine = sorted(tuple(r[c] for c in cols) for r in df.collect())
    res = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert mine == sorted(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())
