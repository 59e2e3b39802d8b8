"""Queries over events with prices of 0 give what their SQL gives."""

import math

import duckdb
import numpy as np
import pytest

from tidemark import catalog


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """A folder with 170 events of each of five types, some of value 0: 20 rows before a rebalancing, one after another, and just behind entries."""
    at = tmp_path_factory.mktemp("tables")
    values = np.random.default_rng(7).exponential(50, (5, 170)).round(2) + 0.01
    values[0, [1, 22, 42, 77]] = values[1, [1, 64, 83]] = values[2, [60, 61, 85]] = 0.0
    rows = ", ".join(f"({5 * i + k}, TIMESTAMP '2024-01-01' + INTERVAL {5 * i + k} MINUTE, 'k{k}', CAST({float(v)!r} AS DOUBLE))" for k, s in enumerate(values) for i, v in enumerate(s))
    duckdb.connect().execute(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, ts, event_type, value)) TO '{at}/events.parquet'")
    return str(at)


def plain(rows):
    return sorted((["nan" if isinstance(x, float) and math.isnan(x) else x for x in r] for r in rows), key=str)


def both(spark, events, name):
    """The rows of the query, and of its SQL."""
    df = catalog.queries()[name](spark, events)
    names = ", ".join(f'"{c}"' for c in df.columns)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet'")
    return plain(df.collect()), plain(duck.execute(f"SELECT {names} FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_momentum_from_a_price_of_0(spark, events):
    got, want = both(spark, events, "momentum")
    assert got == want
    assert ["k0", 21, math.inf, 1] in got and ["k0", 42, "nan", 1] in got


def test_walk_forward_over_prices_of_0(spark, events):
    got, want = both(spark, events, "walk_forward_backtest")
    assert got == want and len(got) == 25


def test_composed_backtest_looks_past_prices_of_0(spark, events):
    got, want = both(spark, events, "composed_backtest")
    assert got == want and len(got) == 5
