"""Every query of the star-schema tables against its SQL, run by DuckDB on the same files."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from gustline import plans

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    yield con
    con.close()


def plain(value):
    """One form for what both engines return: numbers to 9 significant digits, times without a zone."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 1 << 53 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return str(value)


def as_rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF_DIR)
    want = duck.execute(plans.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    expected = as_rows(columns, want.fetchall())
    assert expected, "the query shows nothing on these tables"
    assert as_rows(got.columns, [tuple(r) for r in got.collect()]) == expected


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF_DIR).limit(1).count() == 1
