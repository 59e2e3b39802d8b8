"""What the parts of the library look like to one another, and the parts that are objects: impacts, processes and factor models."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rows
from tidemark.operators import models, simulation


class Scorer(Protocol):
    """A score of features, such as rows.linear_score."""

    def __call__(self, features, weights: list[float], bias: float = 0.0) -> Column: ...


class Strategy(Protocol):
    """Adds signal (1, 0 or -1) to bars, such as backtest.buy_and_hold."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


class Labeler(Protocol):
    """Events of the rows that entry picks, such as labels.fixed_horizon with its settings bound."""

    def __call__(self, df: DataFrame, entry: Column) -> DataFrame: ...


class SampleWeighter(Protocol):
    """Events with a weight, such as labels.uniqueness."""

    def __call__(self, events: DataFrame, bars: DataFrame) -> DataFrame: ...


class BreakDetector(Protocol):
    """key, idx, direction and confidence of breaks, such as models.cusum."""

    def __call__(self, df: DataFrame, threshold: float, drift: float = 0.0) -> DataFrame: ...


class AnomalyDetector(Protocol):
    """Rows with anomaly, such as scoring.zscore_predict."""

    def __call__(self, df: DataFrame, fit: DataFrame, threshold: float = 3.0) -> DataFrame: ...


class ImpactModel(Protocol):
    def impact(self, size, daily_volume) -> Column: ...


class StochasticProcess(Protocol):
    def simulate(self, spark: SparkSession, s0: float, t: float, n_steps: int, n_paths: int, seed: int) -> DataFrame: ...

    def terminal(self, spark: SparkSession, s0: float, t: float, n_paths: int, seed: int) -> DataFrame: ...


@dataclass(frozen=True)
class SqrtImpact:
    volatility: float

    def impact(self, size, daily_volume) -> Column:
        return rows.sqrt_impact(self.volatility, size, daily_volume)


@dataclass(frozen=True)
class LinearImpact:
    eta: float

    def impact(self, size, daily_volume) -> Column:
        return rows.linear_impact(self.eta, size, daily_volume)


@dataclass(frozen=True)
class Gbm:
    mu: float
    sigma: float

    def simulate(self, spark, s0, t, n_steps, n_paths, seed):
        return simulation.gbm_paths(spark, s0, self.mu, self.sigma, t, n_steps, n_paths, seed)

    def terminal(self, spark, s0, t, n_paths, seed):
        return simulation.terminal(spark, s0, self.mu, self.sigma, t, n_paths, seed)


@dataclass(frozen=True)
class Poisson:
    """Counts of arrivals; s0 doesn't matter."""

    rate: float

    def simulate(self, spark, s0, t, n_steps, n_paths, seed):
        return simulation.poisson_grid(spark, self.rate, t, n_steps, n_paths, seed)

    def terminal(self, spark, s0, t, n_paths, seed):
        return simulation.poisson_counts(spark, self.rate, t, n_paths, seed)


@dataclass(frozen=True)
class JumpDiffusion:
    mu: float
    sigma: float
    jump_rate: float
    jump_mean: float

    def simulate(self, spark, s0, t, n_steps, n_paths, seed):
        return simulation.jump_diffusion(spark, s0, self.mu, self.sigma, self.jump_rate, self.jump_mean, t, n_steps, n_paths, seed)

    def terminal(self, spark, s0, t, n_paths, seed):
        return simulation.jump_terminal(spark, s0, self.mu, self.sigma, self.jump_rate, self.jump_mean, t, n_paths, seed)


@dataclass
class FactorRegression:
    """Exposures of each key's returns to factors that stand beside them; fit before the rest is asked for."""

    factors: list[str] = field(default_factory=lambda: ["market", "size", "value"])
    returns: str = "r"
    fitted: DataFrame | None = None

    def fit(self, df: DataFrame) -> FactorRegression:
        """Five rows at least, or a status."""
        fit = models.ols(df, self.returns, self.factors)
        few = F.col("n") < len(self.factors) + 2
        self.fitted = fit.withColumn("status", F.when(few, "too few rows").otherwise(F.col("status"))).withColumn("coefficients", F.when(~few, F.col("coefficients")))
        return self

    def _known(self) -> DataFrame:
        if self.fitted is None:
            raise ValueError("not fitted")
        return self.fitted

    def exposures(self) -> DataFrame:
        """key and a column for each factor."""
        return self._known().select("key", *[F.get("coefficients", F.lit(k)).alias(x) for k, x in enumerate(self.factors, 1)])

    def decompose(self, df: DataFrame) -> DataFrame:
        """df with systematic, the constant included, and idiosyncratic."""
        c = self._known().select("key", F.col("coefficients").alias("_c"))
        part = F.get("_c", F.lit(0))
        for k, x in enumerate(self.factors, 1):
            part = part + F.get("_c", F.lit(k)) * F.col(x)
        return df.join(c, "key", "left").withColumn("systematic", part).withColumn("idiosyncratic", F.col(self.returns) - part).drop("_c")
