"""Every registered query of the engine against its DuckDB SQL on small tables, and the registry's contract."""

import math
import os

import pytest

import __spark_entry__ as entry
from loomfield.plans import catalog

SF = os.environ.get("LOOMFIELD_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "is_finite"):
        return round(float(v), 5)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(norm(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["year", "count", "growth_rate", "cumulative"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) > 130
