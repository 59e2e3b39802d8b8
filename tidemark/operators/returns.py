"""Returns, drawdowns and rolling statistics of keyed, ordered series (key, idx, price or r)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.functions.rows import ratio


def by(key: str = "key", idx: str = "idx"):
    return W.Window.partitionBy(key).orderBy(idx)


def trailing(n: int, key: str = "key", idx: str = "idx"):
    return by(key, idx).rowsBetween(-(n - 1), 0)


def so_far(key: str = "key", idx: str = "idx"):
    return by(key, idx).rowsBetween(W.Window.unboundedPreceding, 0)


def simple_returns(df: DataFrame, price: str = "price") -> DataFrame:
    """Adds r, (p - before) / before; 0 where before is 0. The first row of each series goes."""
    return df.withColumn("_b", F.lag(price).over(by())).where("_b is not null").withColumn("r", ratio(F.col(price) - F.col("_b"), "_b")).drop("_b")


def log_returns(df: DataFrame, price: str = "price") -> DataFrame:
    """Adds r, ln(p / before); 0 where either isn't positive. The first row of each series goes."""
    good = (F.col(price) > 0) & (F.col("_b") > 0)
    return df.withColumn("_b", F.lag(price).over(by())).where("_b is not null").withColumn("r", F.when(good, F.ln(F.col(price) / F.when(good, F.col("_b")))).otherwise(0.0)).drop("_b")


def cumulative_returns(df: DataFrame, r: str = "r") -> DataFrame:
    return df.withColumn("cumulative", F.product(1 + F.col(r)).over(so_far()) - 1)


def drawdown(df: DataFrame, price: str = "price") -> DataFrame:
    """Adds peak and drawdown, (p - peak) / peak, which isn't positive; 0 where the peak is 0."""
    return df.withColumn("peak", F.max(price).over(so_far())).withColumn("drawdown", ratio(F.col(price) - F.col("peak"), "peak"))


def drawdown_stats(df: DataFrame, price: str = "price") -> DataFrame:
    """For each key: max_drawdown, duration (the longest run below a peak), recovery (rows from the trough to the next peak; null: none), average and share below."""
    d = drawdown(df, price).withColumn("below", (F.col("drawdown") < 0).cast("long"))
    d = d.withColumn("run", F.sum(1 - F.col("below")).over(so_far()))
    runs = d.groupBy("key", "run").agg(F.sum("below").alias("length"))
    longest = runs.groupBy("key").agg(F.max("length").alias("duration"))
    worst = d.groupBy("key").agg(
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.min_by("idx", F.struct("drawdown", "idx")).alias("trough"),
        F.coalesce(F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))), F.lit(0.0)).alias("average_drawdown"),
        F.avg("below").alias("share_below"),
    )
    back = d.join(worst.select("key", "trough"), "key").where("idx > trough and drawdown = 0").groupBy("key").agg(F.min(F.col("idx") - F.col("trough")).alias("recovery"))
    return worst.join(longest, "key").join(back, "key", "left").drop("trough").withColumn("recovery", F.when(F.col("max_drawdown") < 0, F.col("recovery")))


def rolling(df: DataFrame, value: str, window: int, f, name: str = "rolling") -> DataFrame:
    """Adds f(column) over each full window of rows; rows before the first full one go. f makes an aggregate of a column."""
    if window < 1:
        raise ValueError("window must be positive")
    return df.withColumn(name, f(F.col(value)).over(trailing(window))).withColumn("_n", F.row_number().over(by())).where(F.col("_n") >= window).drop("_n")


def sma(df: DataFrame, period: int, price: str = "price") -> DataFrame:
    return rolling(df, price, period, F.avg, "sma")


def rolling_std(df: DataFrame, window: int, value: str = "r") -> DataFrame:
    if window < 2:
        raise ValueError("a deviation needs two rows")
    return rolling(df, value, window, F.stddev_samp, "std")


def rolling_volatility(df: DataFrame, window: int, r: str = "r") -> DataFrame:
    """The sample deviation of each full window; a window of one row has 0."""
    return rolling(df, r, window, F.stddev_samp, "volatility").withColumn("volatility", F.coalesce("volatility", F.lit(0.0)))


def rolling_sharpe(df: DataFrame, window: int = 63, periods: float = 252, r: str = "r") -> DataFrame:
    d = rolling(df.withColumn("_s", F.stddev_samp(r).over(trailing(window))), r, window, F.avg, "_m")
    return d.withColumn("sharpe", ratio("_m", "_s") * math.sqrt(periods)).drop("_m", "_s")


def bollinger(df: DataFrame, period: int = 20, width: float = 2.0, price: str = "price") -> DataFrame:
    d = sma(df.withColumn("_s", F.stddev_samp(price).over(trailing(period))), period, price)
    return d.withColumn("upper", F.col("sma") + width * F.col("_s")).withColumn("lower", F.col("sma") - width * F.col("_s")).drop("_s")


def volume_spike(df: DataFrame, period: int = 20, times: float = 2.0) -> DataFrame:
    return rolling(df, "volume", period, F.avg, "_a").withColumn("spike", F.col("volume") > times * F.col("_a")).drop("_a")


def ema(df: DataFrame, period: int, price: str = "price", name: str = "ema") -> DataFrame:
    """Adds the exponential mean with weight 2 / (period + 1), begun by the first price. period 0: no rows."""
    if period < 1:
        return df.where("false").withColumn(name, F.lit(0.0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pdf.assign(**{name: pdf[price].astype(float).ewm(alpha=2 / (period + 1), adjust=False).mean()})

    return df.groupBy("key").applyInPandas(run, df.withColumn(name, F.lit(0.0)).schema)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "price") -> DataFrame:
    """Adds macd, its signal line, and buy where macd crosses it upwards."""
    d = ema(ema(df, fast, price, "_f"), slow, price, "_s").withColumn("macd", F.col("_f") - F.col("_s")).drop("_f", "_s")
    d = ema(d, signal, "macd", "signal")
    before = F.lag(F.col("macd") - F.col("signal")).over(by())
    return d.withColumn("buy", F.coalesce((before <= 0) & (F.col("macd") > F.col("signal")), F.lit(False)))


def acf(df: DataFrame, most_lag: int, value: str = "price") -> DataFrame:
    """key, lag, rho for lags 0 to most_lag; a constant series has 1 and then 0. A lag beyond the series: null."""
    mean = df.groupBy("key").agg(F.avg(value).alias("_m"), F.count("*").alias("_n"))
    d = df.join(mean, "key").withColumn("_d", F.col(value) - F.col("_m"))
    lags = d.select("key", "_d", "_n", *[F.lag("_d", k).over(by()).alias(f"_l{k}") for k in range(1, most_lag + 1)])
    sums = lags.groupBy("key").agg(F.max("_n").alias("_n"), F.sum(F.col("_d") * F.col("_d")).alias("s0"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"s{k}") for k in range(1, most_lag + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s")) for k in range(most_lag + 1)])
    x = sums.select("key", "s0", "_n", F.explode(rows).alias("x"))
    rho = F.when(F.col("x.lag") >= F.col("_n"), F.lit(None)).when(F.col("s0") == 0, (F.col("x.lag") == 0).cast("double")).otherwise(F.try_divide(F.col("x.s"), F.col("s0")))
    return x.select("key", F.col("x.lag").alias("lag"), rho.alias("rho"))


def ffd_weights(d: float, threshold: float, most: int = 10_000) -> list[float]:
    """Weights of fractional differences, up to the first below threshold, which stays out."""
    if not 0 <= d <= 2 or threshold <= 0:
        raise ValueError("d must be in 0..2 and threshold positive")
    out = [1.0]
    while len(out) < most:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < threshold:
            break
        out.append(w)
    return out


def frac_diff(df: DataFrame, d: float, threshold: float = 1e-3, value: str = "price") -> DataFrame:
    """Adds fd, the fractional difference of order d; rows without the whole window go."""
    w = ffd_weights(d, threshold)
    total: Column = F.lit(0.0)
    if len(w) <= 64:
        for k, x in enumerate(w):
            total = total + x * F.lag(value, k).over(by())
        return df.withColumn("fd", total).where("fd is not null")
    held = F.collect_list(value).over(trailing(len(w)))
    dot = F.aggregate(F.zip_with(F.reverse(F.col("_h")), F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("_h", held).where(F.size("_h") == len(w)).withColumn("fd", dot).drop("_h")


def expanding_frac_diff(df: DataFrame, d: float, threshold: float = 1e-3, value: str = "price") -> DataFrame:
    """frac_diff for every row: one with fewer rows before it than there are weights uses as many weights as it has rows."""
    w = ffd_weights(d, threshold)
    held = F.reverse(F.collect_list(value).over(trailing(len(w))))
    n = F.size("_h")
    dot = F.aggregate(F.zip_with("_h", F.slice(F.array(*map(F.lit, w)), F.lit(1), n), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("_h", held).withColumn("fd", dot).drop("_h")


def horizon_sums(df: DataFrame, size: int, r: str = "r") -> DataFrame:
    """key, chunk, r: sums of so many returns in a row; the last may have fewer."""
    return df.withColumn("chunk", F.floor((F.row_number().over(by()) - 1) / size)).groupBy("key", "chunk").agg(F.sum(r).alias("r"))


def quadratic_variation(df: DataFrame, value: str = "price") -> DataFrame:
    step = F.col(value) - F.lag(value).over(by())
    return df.withColumn("_q", step * step).groupBy("key").agg(F.coalesce(F.sum("_q"), F.lit(0.0)).alias("quadratic_variation"))
