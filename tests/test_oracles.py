"""Every registered query with SQL gives the rows of that SQL, at the smallest size."""

import datetime
import decimal
import math

import duckdb
import pytest

from driftloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    rows = duck.sql(registry.oracle_sql()[name])
    assert sorted(rows.columns) == columns
    at = [rows.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in rows.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    # The smallest tables have no bin of ten rows in both, which a line fit needs.
    assert any(v is not None for r in rows for v in r) or name == "stat22_line_fit"
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)
