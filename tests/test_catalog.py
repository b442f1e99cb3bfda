"""Each registered query against its SQL in DuckDB, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    asked = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in asked.description]
    want = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in asked.fetchall()), key=str)
    assert sorted(names) == cols and got == want
