"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tidemark import catalog
from tidemark.operators import models
from tidemark.plans import series

DATA = Path("/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(([plain(x) for x in r] for r in df.select(*columns).collect()), key=str)
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == columns
        names = ", ".join(f'"{c}"' for c in columns)
        want = sorted(([plain(x) for x in r] for r in duck.sql(f"SELECT {names} FROM ({SQL[name]})").fetchall()), key=str)
        assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_trends_begin_at_every_row(spark):
    want = series.px(spark, str(DATA)).where("price > 0").select("key", "idx").collect()
    got = catalog.queries()["trend_scanning"](spark, str(DATA)).select("key", "entry").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_least_orders_are_of_filters_to_the_default_cutoff(spark, monkeypatch):
    walk = np.cumsum(np.random.default_rng(5).normal(size=1500)) + 500
    bars = spark.createDataFrame([("k", i, float(p)) for i, p in enumerate(walk)], "key string, idx long, close double")
    monkeypatch.setattr(series, "bars", lambda *_: bars)
    d = [models.find_min_d(bars.withColumnRenamed("close", "price"), cutoff).first().d for cutoff in (1e-3, 0.05)]
    assert d[0] != d[1] and abs(catalog.queries()["min_frac_diff"](spark, "").first().d - d[0]) < 1e-5
