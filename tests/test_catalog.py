"""Every query with SQL gives the same rows, types and columns as DuckDB on the smallest tables; the others run."""

import math

import duckdb
import pytest

from rainfold import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted(([value(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(name, spark, sf_dir, duck):
    got = catalog.queries()[name](spark, sf_dir)
    rows = plain(got.collect(), got.columns)
    text = catalog.oracle_sql().get(name)
    if text:
        want = duck.sql(text)
        assert {c: KINDS[t] for c, t in got.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
        assert rows == plain(want.fetchall(), want.columns)
