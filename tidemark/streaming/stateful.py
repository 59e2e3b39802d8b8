"""Bars, exponential variances, alarms and drawdowns of streams (key, ts, value), with state by key."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.microstructure import REPLAYED, Book, execute


def tumbling_bars(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """key, begin, open, high, low, close, volume of each window, once the watermark has passed it."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "key")
    b = g.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"))
    return b.select("key", F.col("window.start").alias("begin"), "open", "high", "low", "close", "volume")


def sliding_stats(stream: DataFrame, size: str = "1 hour", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "key")
    return g.agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n")).select("key", F.col("window.start").alias("begin"), "mean", "std", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "key")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("key", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n", "total")


def order_book(stream: DataFrame, tick: int = 1) -> DataFrame:
    """microstructure.replay of a stream of commands: each key's book is kept between batches; commands of a batch run in order of seq."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        book = pickle.loads(held.get[0]) if held.exists else Book(tick)
        out = execute(book, key[0], pd.concat(list(batches)))
        held.update((pickle.dumps(book),))
        yield out

    return stream.groupBy("key").applyInPandasWithState(run, REPLAYED, "book binary", "append", "NoTimeout")


def _folded(stream: DataFrame, start: tuple, step, out: str, state: str) -> DataFrame:
    """Folds each key's rows in order of time (then seq, where there is one) within a batch: step(state, x) gives the next state and an output or None."""
    order = ["ts", "seq" if "seq" in stream.columns else "value"]
    names = [c.split()[0] for c in out.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        rows = []
        for r in pd.concat(list(batches)).sort_values(order).itertuples(index=False):
            now, value = step(now, float(r.value))
            if value is not None:
                rows.append((key[0], r.ts, *value))
        held.update(now)
        yield pd.DataFrame(rows, columns=names)

    return stream.groupBy("key").applyInPandasWithState(run, out, state, "append", "NoTimeout")


def ewma_variance(stream: DataFrame, decay: float = 0.94) -> DataFrame:
    """key, ts, variance: the exponential mean of the squares before each row."""

    def step(s, x):
        n, v, last = s
        v = x * x if n == 0 else decay * v + (1 - decay) * last * last
        return (n + 1, v, x), (v,)

    return _folded(stream, (0, 0.0, 0.0), step, "key string, ts timestamp, variance double", "n long, v double, last double")


def cusum_alarms(stream: DataFrame, threshold: float, drift: float = 0.0) -> DataFrame:
    def step(s, x):
        high, low = max(s[0] + x - drift, 0.0), max(s[1] - x - drift, 0.0)
        if high > threshold or low > threshold:
            return (0.0, 0.0), ("up" if high > threshold else "down",)
        return (high, low), None

    return _folded(stream, (0.0, 0.0), step, "key string, ts timestamp, direction string", "high double, low double")


def running_drawdown(stream: DataFrame) -> DataFrame:
    def step(s, x):
        peak = max(s[0], x)
        return (peak,), ((x - peak) / peak if peak else 0.0,)

    return _folded(stream, (float("-inf"),), step, "key string, ts timestamp, drawdown double", "peak double")
