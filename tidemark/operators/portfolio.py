"""Portfolios and factor models: moments are aggregated from the data, small dense algebra is done on the result."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import optimize, simulation, stats
from tidemark.operators.models import solve

#: Assets that a dense covariance on the driver may have.
MOST_ASSETS = 2000


def covariance(returns: DataFrame) -> DataFrame:
    """i, j, cov, n: sample covariances of assets (idx, asset, r) over the times that both have.

    The assets of a time are one sorted array; each pair is made once, and turned round after the sums.
    """
    times = returns.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct(F.col("asset").alias("i"), F.col("r").alias("x")))).alias("all"))
    first = times.select("all", F.posexplode("all").alias("at", "a"))
    pairs = first.select(F.col("a.i").alias("i"), F.col("a.x").alias("x"), F.explode(F.slice("all", F.col("at") + 1, F.size("all"))).alias("b"))
    half = pairs.select("i", F.col("b.i").alias("j"), "x", F.col("b.x").alias("y")).groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"), F.count("*").alias("n"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select(F.explode(both).alias("p"), "cov", "n").select("p.*", "cov", "n")


class RiskModel(Protocol):
    """A risk of returns as an aggregate of a column, such as stats.var."""

    def __call__(self, r: Column | str, confidence: float) -> Column: ...


class Allocator(Protocol):
    """Weights from means and covariances, such as min_variance behind a lambda."""

    def __call__(self, mean: np.ndarray, cov: np.ndarray) -> np.ndarray: ...


@dataclass
class Universe:
    assets: list[str]
    mean: np.ndarray
    cov: np.ndarray

    @classmethod
    def of(cls, returns: DataFrame) -> Universe:
        means = {r.asset: r.m for r in returns.groupBy("asset").agg(F.avg("r").alias("m")).limit(MOST_ASSETS + 1).collect()}
        if len(means) > MOST_ASSETS:
            raise ValueError(f"more than {MOST_ASSETS} assets")
        names = sorted(means)
        at = {a: k for k, a in enumerate(names)}
        cov = np.zeros((len(names),) * 2)
        for r in covariance(returns).collect():
            cov[at[r.i], at[r.j]] = r.cov
        return cls(names, np.array([means[a] for a in names]), cov)


def min_variance(cov: np.ndarray) -> np.ndarray:
    w = solve(cov, np.ones(len(cov)))
    return w / w.sum()


def frontier_point(mean: np.ndarray, cov: np.ndarray, target: float) -> np.ndarray:
    """The least variance with a mean of target; two constraints by multipliers."""
    one, m = solve(cov, np.ones(len(mean))), solve(cov, mean)
    a, b, c = one.sum(), m.sum(), float(mean @ m)
    det = a * c - b * b
    if abs(det) < 1e-15:
        raise ValueError("the target can't be met")
    return one * (c - b * target) / det + m * (a * target - b) / det


def tangency(mean: np.ndarray, cov: np.ndarray, risk_free: float) -> np.ndarray:
    excess = np.asarray(mean) - risk_free
    if np.linalg.norm(excess) < 1e-12:
        raise ValueError("no excess return")
    w = solve(cov, excess)
    if abs(w.sum()) < 1e-15:
        raise ValueError("weights don't sum")
    return w / w.sum()


def describe(w: np.ndarray, mean: np.ndarray, cov: np.ndarray, risk_free: float = 0.0) -> dict[str, float]:
    m, v = float(w @ mean), float(w @ cov @ w)
    return {"mean": m, "variance": v, "volatility": v**0.5, "sharpe": (m - risk_free) / v**0.5 if v > 0 else 0.0}


def inverse(a: np.ndarray) -> np.ndarray:
    """By elimination, with its limit of singularity."""
    return solve(a, np.eye(len(a)))


def quadratic_form(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """One row, value: weights (asset, weight) on both sides of a covariance (i, j, cov), as joins."""
    w = lambda c: weights.select(F.col("asset").alias(c), F.col("weight").alias(f"_{c}"))
    return cov.join(w("i"), "i").join(w("j"), "j").agg(F.coalesce(F.sum(F.col("_i") * F.col("cov") * F.col("_j")), F.lit(0.0)).alias("value"))


def marginal_risk(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """i, marginal: covariance times weights, as a join (weights: asset, weight)."""
    return cov.join(weights.select(F.col("asset").alias("j"), "weight"), "j").groupBy("i").agg(F.sum(F.col("cov") * F.col("weight")).alias("marginal"))


def inverse_variance(returns: DataFrame) -> DataFrame:
    """asset, weight: risk parity without correlations."""
    v = returns.groupBy("asset").agg((1 / F.nullif(F.var_samp("r"), F.lit(0.0))).alias("iv"))
    return v.crossJoin(F.broadcast(v.agg(F.sum("iv").alias("t")))).select("asset", (F.col("iv") / F.col("t")).alias("weight"))


def two_asset_min_weight(var_a, var_b, cov) -> Column:
    a, b, c = (F.col(x) if isinstance(x, str) else x for x in (var_a, var_b, cov))
    under = a + b - 2 * c
    return F.when(F.abs(under) < 1e-15, 0.5).otherwise((b - c) / F.nullif(under, F.lit(0.0)))


def two_asset_point(w, mean_a, mean_b, var_a, var_b, cov) -> Column:
    """A struct of mean and volatility of a share w of one asset and the rest of another."""
    w, a, b, va, vb, c = (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x)) for x in (w, mean_a, mean_b, var_a, var_b, cov))
    variance = w * w * va + (1 - w) * (1 - w) * vb + 2 * w * (1 - w) * c
    return F.struct((w * a + (1 - w) * b).alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("volatility"))


def two_fund_share(target_volatility, tangency_volatility) -> Column:
    """The share of the tangency portfolio, the rest without risk, that has the volatility wanted; 0 if the portfolio has none."""
    t, v = (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x)) for x in (target_volatility, tangency_volatility))
    return F.when(F.abs(v) < 1e-300, 0.0).otherwise(t / F.nullif(v, F.lit(0.0)))


def cost_adjusted_tangency(mean: np.ndarray, cov: np.ndarray, risk_free: float, cost: float) -> np.ndarray:
    """The tangency portfolio of means from which the cost of trading is taken."""
    return tangency(np.asarray(mean) - cost, cov, risk_free)


def long_only(mean: np.ndarray, cov: np.ndarray, aversion: float = 0.5, rate: float = 0.5, rounds: int = 200) -> np.ndarray:
    """Weights that aren't negative: projected steps up the mean less aversion times the variance, from equal weights."""
    return optimize.projected_gradient(lambda w: 2 * aversion * cov @ w - mean, simplex, np.full(len(mean), 1 / len(mean)), rate, rounds)


def cvar_grid(spark: SparkSession, mean: tuple[float, float], sd: tuple[float, float], confidence: float = 0.95, points: int = 101, samples: int = 2000, seed: int = 42) -> DataFrame:
    """w, cvar: the tail loss of a share w of one normal asset and the rest of another, over the same draws for each w of a grid.

    A sample takes two normals of one stream: the first asset's, then the second's.
    """
    z = simulation.normal_draws(spark, 2, samples, seed)
    r = [F.lit(mean[k]) + sd[k] * F.col("z")[k] for k in range(2)]
    grid = F.explode(F.array(*[F.lit(k / (points - 1)) for k in range(points)]))
    return stats.cvar(z.select(grid.alias("w"), "z").select("w", (F.col("w") * r[0] + (1 - F.col("w")) * r[1]).alias("r")), ["w"], "r", confidence).select("w", "cvar")


def neutrality(df: DataFrame, long: str, short: str, factor: str, short_weight: float) -> DataFrame:
    """key, beta, systematic, idiosyncratic, idiosyncratic_share of long plus short_weight times short against a factor, in population variances."""
    d = df.withColumn("_r", F.col(long) + short_weight * F.col(short))
    g = d.groupBy("key").agg(stats.beta("_r", factor).alias("beta"), F.var_pop("_r").alias("_v"), F.var_pop(factor).alias("_f"))
    systematic = F.col("beta") * F.col("beta") * F.col("_f")
    own = F.greatest(F.col("_v") - systematic, F.lit(0.0))
    return g.select("key", "beta", systematic.alias("systematic"), own.alias("idiosyncratic"), F.try_divide(own, F.col("_v")).alias("idiosyncratic_share"))


def capital_market_line(risk_free: float, sharpe: float, sigma: float) -> float:
    return risk_free + sharpe * sigma


def security_market_line(beta, market_mean, risk_free: float) -> Column:
    return risk_free + F.col(beta) * (F.col(market_mean) - risk_free)


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest weights that aren't negative and sum to 1."""
    u = np.sort(v)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(v - over[np.flatnonzero(u > over)[-1]], 0)


def black_litterman(prior: np.ndarray, cov: np.ndarray, views: np.ndarray, expected: np.ndarray, doubt: np.ndarray, tau: float = 0.05) -> np.ndarray:
    a = np.linalg.inv(tau * cov)
    b = np.linalg.inv(doubt)
    return solve(a + views.T @ b @ views, a @ prior + views.T @ b @ expected)


@dataclass
class Pca:
    assets: list[str]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @classmethod
    def fit(cls, returns: DataFrame, k: int) -> Pca:
        u = Universe.of(returns)
        if not 0 < k <= len(u.assets) or np.trace(u.cov) <= 0:
            raise ValueError("components out of range, or no variance")
        values, vectors = np.linalg.eigh(u.cov)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k].T
        for v in vectors:  # the first weight that isn't 0 is positive
            big = np.flatnonzero(np.abs(v) > 1e-12)
            if len(big) and v[big[0]] < 0:
                v *= -1
        return cls(u.assets, u.mean, values, vectors, values / np.trace(u.cov))

    def _loadings(self, spark) -> DataFrame:
        rows = [(a, float(self.mean[i]), k, float(v[i])) for k, v in enumerate(self.vectors) for i, a in enumerate(self.assets)]
        return F.broadcast(spark.createDataFrame(rows, "asset string, mean double, component int, loading double"))

    def transform(self, returns: DataFrame) -> DataFrame:
        """idx, component, score. Loadings (assets times components) are broadcast."""
        d = returns.join(self._loadings(returns.sparkSession), "asset")
        return d.groupBy("idx", "component").agg(F.sum((F.col("r") - F.col("mean")) * F.col("loading")).alias("score"))

    def reconstruct(self, scores: DataFrame) -> DataFrame:
        """idx, asset, r from scores."""
        d = scores.join(self._loadings(scores.sparkSession), "component")
        return d.groupBy("idx", "asset").agg((F.max("mean") + F.sum(F.col("score") * F.col("loading"))).alias("r"))


def risk_attribution(weights: np.ndarray, loadings: np.ndarray, factor_cov: np.ndarray, residual: np.ndarray) -> dict:
    """total, systematic, idiosyncratic, and contributions of each factor alone (their covariances are in no contribution)."""
    f = loadings.T @ weights
    systematic, own = float(f @ factor_cov @ f), float((weights**2) @ residual)
    return {"total": systematic + own, "systematic": systematic, "idiosyncratic": own, "contributions": (f**2 * np.diag(factor_cov)).tolist()}
