"""Whole-series statistics as aggregates: every function gives a Column for agg, so that any grouping works."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.functions.rows import ratio


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def summary(x) -> list[Column]:
    """mean, std (sample; 0 for one row), min and max; NaN for no rows."""
    nan = F.lit(float("nan"))
    return [F.coalesce(F.avg(x), nan).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.coalesce(F.min(x), nan).alias("min"), F.coalesce(F.max(x), nan).alias("max")]


def mean(x) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def moments(x) -> list[Column]:
    """Sample variance, and population skewness and excess kurtosis; null where they aren't defined."""
    x = _c(x)
    return [F.var_samp(x).alias("variance"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("excess_kurtosis")]


def volatility(r, periods: float = 1.0) -> Column:
    return F.coalesce(F.stddev_samp(r), F.lit(0.0)) * math.sqrt(max(periods, 0.0))


def sharpe(r, risk_free: float = 0.0, periods: float = 1.0) -> Column:
    """Mean above risk_free by the sample deviation; 0 without deviation."""
    sd = F.coalesce(F.stddev_samp(r), F.lit(0.0))
    return ratio(F.avg(r) - risk_free, sd) * math.sqrt(max(periods, 0.0))


def sortino(r, risk_free: float = 0.0) -> Column:
    gap = risk_free - _c(r)
    down = F.sqrt(F.avg(F.pow(F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0))), F.lit(2.0))))
    return F.coalesce(ratio(F.avg(r) - risk_free, down), F.lit(0.0))


def omega(r, threshold: float = 0.0) -> Column:
    """Gains above threshold by losses below; infinite without losses, null without rows."""
    up, down = (F.sum(F.greatest(s * (_c(r) - threshold), F.lit(0.0))) for s in (1, -1))
    return F.when(down == 0, F.lit(float("inf"))).otherwise(up / F.nullif(down, F.lit(0.0)))


def information_ratio(r, benchmark) -> Column:
    gap = _c(r) - _c(benchmark)
    sd = F.stddev_samp(gap)
    return F.when(sd == 0, F.lit(float("inf"))).otherwise(F.avg(gap) / F.nullif(sd, F.lit(0.0)))


def quantile(x, p: float) -> Column:
    """With linear interpolation between neighbours."""
    return F.percentile(_c(x), F.lit(p))


def var(r, confidence: float = 0.95) -> Column:
    if not 0 < confidence < 1:
        raise ValueError("confidence must be within 0 and 1")
    return -quantile(r, 1 - confidence)


def cvar(df: DataFrame, keys: list[str], r: str = "r", confidence: float = 0.95) -> DataFrame:
    """keys, var and cvar: the mean loss at or beyond the quantile, from the sorted rows of each group (one shuffle, sorts that spill)."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must be within 0 and 1")
    whole = W.Window.partitionBy(*keys)
    d = df.where(F.col(r).isNotNull()).withColumn("_k", F.row_number().over(whole.orderBy(r)) - 1).withColumn("_at", (F.count("*").over(whole) - 1) * F.lit(1 - confidence))
    low = F.floor("_at")
    near = lambda k: F.max(F.when(F.col("_k") == k, F.col(r))).over(whole)
    d = d.withColumn("_a", near(low)).withColumn("_b", near(low + 1))
    q = F.col("_a") + F.coalesce(F.col("_b") - F.col("_a"), F.lit(0.0)) * (F.col("_at") - low)
    return d.withColumn("_q", q).groupBy(*keys).agg((-F.max("_q")).alias("var"), (-F.avg(F.when(F.col(r) <= F.col("_q") + 1e-12, F.col(r)))).alias("cvar"))


def ulcer(drawdown="drawdown") -> Column:
    return F.sqrt(F.avg(F.pow(100 * _c(drawdown), F.lit(2.0))))


def price_change(price="close", idx="idx") -> Column:
    first = F.min_by(price, idx)
    return F.when(F.count(price) < 2, 0.0).otherwise(F.try_divide(F.max_by(price, idx) - first, first))


def bar_summary() -> list[Column]:
    """average_volume, highest_high, lowest_low and average_daily_range of bars; 0 for no bars."""
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return [zero(F.avg("volume"), "average_volume"), zero(F.max("high"), "highest_high"), zero(F.min("low"), "lowest_low"), zero(F.avg(F.col("high") - F.col("low")), "average_daily_range")]


def vwap(price="price", quantity="quantity") -> Column:
    return F.coalesce(ratio(F.sum(_c(price) * _c(quantity)), F.sum(quantity)), F.lit(0.0))


def trade_imbalance(quantity="quantity", is_buy="is_buy") -> Column:
    signed = F.when(_c(is_buy), _c(quantity)).otherwise(-_c(quantity))
    return F.coalesce(ratio(F.sum(signed), F.sum(quantity)), F.lit(0.0))


def kelly(r) -> Column:
    """Full Kelly share from returns: wins over all rows, mean win over mean loss; 0 without wins or losses."""
    r = _c(r)
    p = F.count_if(r > 0) / F.nullif(F.count(r), F.lit(0))
    b = F.avg(F.when(r > 0, r)) / F.nullif(F.avg(F.when(r < 0, -r)), F.lit(0.0))
    return F.coalesce(p - (1 - p) / b, F.lit(0.0))


def position_size(r) -> Column:
    r = _c(r)
    b = F.coalesce(F.avg(F.when(r > 0, r)) / F.nullif(F.avg(F.when(r < 0, -r)), F.lit(0.0)), F.lit(0.0))
    p = F.coalesce(F.count_if(r > 0) / F.nullif(F.count(r), F.lit(0)), F.lit(0.0))
    return F.struct(kelly(r).alias("full"), (kelly(r) / 2).alias("half"), p.alias("win_prob"), b.alias("win_loss_ratio"))


def confusion(actual, predicted) -> list[Column]:
    a, p = _c(actual).cast("boolean"), _c(predicted).cast("boolean")
    return [F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"), F.count_if(a & ~p).alias("fn")]


def precision_recall(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, tn and fn; 0 where undefined."""
    d = df.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
    return d.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def beta(asset, market) -> Column:
    return F.try_divide(F.covar_samp(asset, market), F.var_samp(market))


def alpha(asset, market, risk_free: float = 0.0) -> Column:
    return F.avg(asset) - (risk_free + beta(asset, market) * (F.avg(market) - risk_free))


def gaussian_likelihood(x) -> Column:
    """The log-likelihood of standardised residuals under a standard normal."""
    x = _c(x)
    return F.sum(-0.5 * math.log(2 * math.pi) - x * x / 2)


def student_likelihood(x, freedom: float) -> Column:
    """The log-likelihood of standardised residuals under Student's t, whose constant is known before any row is read."""
    if freedom <= 0:
        raise ValueError("freedom must be positive")
    x, half = _c(x), (freedom + 1) / 2
    const = math.lgamma(half) - math.lgamma(freedom / 2) - math.log(freedom * math.pi) / 2
    return F.sum(const - half * F.log1p(x * x / freedom))


def gjr_gamma(r, before) -> Column:
    """The mean square after a fall less that after no fall; before is the return of the row before, and rows without one don't count."""
    r, before = _c(r), _c(before)
    return F.coalesce(F.avg(F.when(before < 0, r * r)), F.lit(0.0)) - F.coalesce(F.avg(F.when(before >= 0, r * r)), F.lit(0.0))
