"""The library's queries over the driver's tables, with the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is there twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    from tidemark.plans import more_queries as _  # noqa: F401  registers
    from tidemark.plans import queries as _  # noqa: F401, F811
    from tidemark.plans import strategy_queries as _  # noqa: F401, F811


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity of a moving-average crossover on each series of bars."""
    return queries()["sma_backtest_equity"](spark, sf_dir)
