"""Every registered query of the engine against its SQL in DuckDB: rows, column names and types."""

import glob
import os

import duckdb
import pytest

from chunkvault.plans import catalog

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value if isinstance(value, int | bool | str | type(None)) else str(value)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([repr(plain(r[i])) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = rows_of(df.collect(), df.columns)
    if name not in catalog.oracle_sql():
        assert got
        return
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    kinds = {c[0]: str(c[1]) for c in found.description}
    assert sorted(columns) == sorted(df.columns)
    assert {c: TYPES[t] for c, t in df.dtypes if t in TYPES} == {c: kinds[c] for c, t in df.dtypes if t in TYPES}
    assert got == rows_of(found.fetchall(), columns)
