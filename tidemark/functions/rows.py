"""Bars, credit features, ratios, sizing and impact as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def ratio(a, b, otherwise: float = 0.0) -> Column:
    """a / b, or otherwise where b is 0."""
    return F.when(_c(b) == 0, F.lit(otherwise)).otherwise(_c(a) / F.nullif(_c(b), F.lit(0.0)))


# --- bars -----------------------------------------------------------------------------------------------------------


def daily_range() -> Column:
    return F.col("high") - F.col("low")


def body() -> Column:
    return F.col("close") - F.col("open")


def upper_shadow() -> Column:
    return F.col("high") - F.greatest("open", "close")


def lower_shadow() -> Column:
    return F.least("open", "close") - F.col("low")


def is_bullish() -> Column:
    return F.col("close") > F.col("open")


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def is_doji(share: float = 0.001) -> Column:
    return F.abs(body()) < share * daily_range()


def is_hammer() -> Column:
    return (F.abs(body()) < 0.3 * daily_range()) & (lower_shadow() > 2 * F.abs(body()))


def valid_bar() -> Column:
    """high >= low, and open and close within them."""
    return (F.col("high") >= F.col("low")) & F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high"))


def valid_price(p="price") -> Column:
    return _c(p).isNotNull() & ~F.isnan(_c(p)) & (_c(p) > 0) & (_c(p) < F.lit(float("inf")))


# --- credit ---------------------------------------------------------------------------------------------------------


def debt_to_income(income, debt) -> Column:
    return ratio(debt, income)


def loan_to_income(loan, income) -> Column:
    return ratio(loan, income)


def grade_to_score(grade) -> Column:
    """Grades 1 to 7 to 0..1; others to the nearer end."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_c(grade) - 1) / F.lit(6.0)))


def one_hot(value, domain: tuple[str, ...] = ("RENT", "OWN", "MORTGAGE")) -> Column:
    return F.array(*[F.coalesce((_c(value) == d).cast("double"), F.lit(0.0)) for d in domain])


def normalize(x, low, high) -> Column:
    return ratio(_c(x) - _c(low), _c(high) - _c(low))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def linear_score(features, weights: list[float], bias: float = 0.0) -> Column:
    """Dot product over as many entries as both have, plus bias."""
    f, w = _c(features), F.array(*map(F.lit, weights))
    n = F.least(F.size(f), F.lit(len(weights)))
    return F.aggregate(F.zip_with(F.slice(f, 1, n), F.slice(w, F.lit(1), n), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + bias


def predict_proba(features, weights: list[float], bias: float = 0.0) -> Column:
    return sigmoid(linear_score(features, weights, bias))


def predict(features, weights: list[float], bias: float = 0.0, threshold: float = 0.5) -> Column:
    """Whether the probability is above threshold."""
    return predict_proba(features, weights, bias) > threshold


# --- positions and sides --------------------------------------------------------------------------------------------


def is_exposed(position="position") -> Column:
    """Whether a position (1 long, -1 short, 0 flat) is long or short."""
    return _c(position) != 0


def is_flat(position="position") -> Column:
    return _c(position) == 0


def opposite(side="side") -> Column:
    return F.when(_c(side) == "bid", "ask").when(_c(side) == "ask", "bid")


def side_name(side="side") -> Column:
    return F.initcap(_c(side))


# --- ratios over aggregates -----------------------------------------------------------------------------------------


def calmar_ratio(annual_return, max_drawdown) -> Column:
    return F.when(_c(max_drawdown) == 0, F.lit(float("inf"))).otherwise(_c(annual_return) / F.nullif(F.abs(_c(max_drawdown)), F.lit(0.0)))


#: Coefficients of the normal distribution function's approximation 26.2.17 (fixed values).
_P26 = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)


def standard_normal_cdf(x) -> Column:
    """The polynomial approximation 26.2.17, to seven digits."""
    x = _c(x)
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.lit(0.0)
    for c in reversed(_P26):
        tail = t * (F.lit(c) + tail)
    tail = 0.3989423 * F.exp(-x * x / 2) * tail
    return F.when(x > 0, 1 - tail).otherwise(tail)


def probabilistic_sharpe(sharpe, n, skew, excess_kurtosis, benchmark=0.0) -> Column:
    """The probability that the Sharpe ratio is above the benchmark's; the moments' term is divided by n - 1 and added to one."""
    sr, n = _c(sharpe), _c(n).cast("double")
    term = (1 - _c(skew) * sr + (_c(excess_kurtosis) - 1) / 4 * sr * sr) / F.nullif(n - 1, F.lit(0.0))
    se = F.sqrt(F.greatest(1 + F.coalesce(term, F.lit(-1.0)), F.lit(0.0)))
    gap = sr - _c(benchmark)
    step = F.when(gap > 0, 1.0).otherwise(0.0)
    return F.when(n <= 0, 0.0).when(se == 0, step).otherwise(standard_normal_cdf(gap * F.sqrt(n) / F.nullif(se, F.lit(0.0))))


def deflated_sharpe(sharpe, n, skew, excess_kurtosis, trials: int, var_sharpes: float) -> Column:
    """probabilistic_sharpe against the largest Sharpe ratio that so many trials give by chance."""
    import math

    if trials == 0:
        return F.lit(0.0)
    best = 0.0
    if trials > 1:
        root = math.sqrt(2 * math.log(trials))
        best = max(root - (0.5 * math.log(math.log(trials)) + 0.5772156649) / root, 0.0) * math.sqrt(var_sharpes)
    return probabilistic_sharpe(sharpe, n, skew, excess_kurtosis, best)


def walk_forward_efficiency(in_sample, out_of_sample) -> Column:
    return ratio(out_of_sample, in_sample)


# --- sizing and impact ----------------------------------------------------------------------------------------------


def kelly_fraction(win_prob, win_loss_ratio) -> Column:
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(win_prob)))
    return F.when(_c(win_loss_ratio) <= 0, 0.0).otherwise(p - (1 - p) / F.nullif(_c(win_loss_ratio), F.lit(0.0)))


def fractional_kelly(win_prob, win_loss_ratio, fraction: float) -> Column:
    return fraction * kelly_fraction(win_prob, win_loss_ratio)


def sqrt_impact(volatility, size, daily_volume) -> Column:
    return F.when(_c(daily_volume) <= 0, 0.0).otherwise(_c(volatility) * F.sqrt(F.abs(_c(size) / F.nullif(_c(daily_volume), F.lit(0.0)))))


def linear_impact(eta, size, daily_volume) -> Column:
    return F.when(_c(daily_volume) <= 0, 0.0).otherwise(_c(eta) * _c(size) / F.nullif(_c(daily_volume), F.lit(0.0)))


def execution_cost(size, daily_volume, volatility, spread) -> Column:
    half, impact = _c(spread) / 2, sqrt_impact(volatility, size, daily_volume)
    return F.struct(half.alias("half_spread"), impact.alias("impact"), (half + impact).alias("total"))
