"""Every query that has SQL, against DuckDB on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from tallyforge.plans import catalog

SMALL = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for p in SMALL.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, str(SMALL))
    columns = sorted(found.columns)
    got = sorted("|".join(map(plain, r)) for r in found.select(*(f"`{c}`" for c in columns)).collect())
    result = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    catalog.QUERIES[name](spark, str(SMALL)).count()
