"""Long-only backtests as window expressions over keyed bars, and sizing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import labels, stats
from tidemark.operators.returns import by, drawdown, so_far, trailing


@dataclass(frozen=True)
class Config:
    capital: float = 10_000.0
    cost: float = 0.001

    def __post_init__(self):
        if self.capital <= 0 or not 0 <= self.cost < 1:
            raise ValueError("capital must be positive and cost within 0 and 1")


def buy_and_hold(df: DataFrame) -> DataFrame:
    return df.withColumn("signal", (F.row_number().over(by()) == 1).cast("int"))


def sma_crossover(df: DataFrame, short: int, long: int, price: str = "close") -> DataFrame:
    """Adds signal: 1 where the short mean crosses above the long one, -1 below, else 0."""
    if not 1 <= short < long:
        raise ValueError("short must be below long")
    d = df.withColumn("_n", F.row_number().over(by())).withColumn("_s", F.avg(price).over(trailing(short))).withColumn("_l", F.avg(price).over(trailing(long)))
    d = d.withColumn("_ps", F.lag("_s").over(by())).withColumn("_pl", F.lag("_l").over(by()))
    up, down = (F.col("_ps") <= F.col("_pl")) & (F.col("_s") > F.col("_l")), (F.col("_ps") >= F.col("_pl")) & (F.col("_s") < F.col("_l"))
    return d.withColumn("signal", F.when(F.col("_n") <= long, 0).when(up, 1).when(down, -1).otherwise(0)).drop("_n", "_s", "_l", "_ps", "_pl")


def run(df: DataFrame, config: Config = Config(), price: str = "close") -> DataFrame:  # noqa: B008
    """df (with signal) with position, entry_price and equity.

    The engine holds or doesn't: it buys with all its cash on 1, sells all on -1, and pays cost on either's worth. Whether it holds
    is the last signal that isn't 0; equity is a product over closed trades, times the open one's gain.
    """
    p, keep = F.col(price), 1 - config.cost
    d = df.withColumn("position", F.coalesce((F.last(F.when(F.col("signal") != 0, F.col("signal")), ignorenulls=True).over(so_far()) == 1).cast("int"), F.lit(0)))
    d = d.withColumn("_b", F.coalesce(F.lag("position").over(by()), F.lit(0)))
    d = d.withColumn("_e", F.when((F.col("position") == 1) & (F.col("_b") == 0), p))
    d = d.withColumn("entry_price", F.last("_e", ignorenulls=True).over(so_far()))
    closed = F.when((F.col("position") == 0) & (F.col("_b") == 1), keep * keep * p / F.col("entry_price")).otherwise(1.0)
    d = d.withColumn("_c", closed).withColumn("_c", F.product("_c").over(so_far()))
    d = d.withColumn("equity", config.capital * F.col("_c") * F.when(F.col("position") == 1, keep * p / F.col("entry_price")).otherwise(1.0))
    return d.withColumn("entry_price", F.when(F.col("position") == 1, F.col("entry_price"))).drop("_b", "_e", "_c")


def trades(equity: DataFrame, price: str = "close") -> DataFrame:
    """key, entry, exit, entry_price, exit_price, return_pct of each trade; one that is open at the end closes on the last row."""
    p = F.col("position")
    d = equity.withColumn("_b", F.coalesce(F.lag("position").over(by()), F.lit(0))).withColumn("trade", F.sum(F.when((p == 1) & (F.col("_b") == 0), 1).otherwise(0)).over(so_far()))
    d = d.where((p == 1) | (F.col("_b") == 1))
    g = d.groupBy("key", "trade").agg(F.min("idx").alias("entry"), F.max("idx").alias("exit"), F.min_by(price, "idx").alias("entry_price"), F.max_by(price, "idx").alias("exit_price"))
    return g.withColumn("return_pct", F.col("exit_price") / F.col("entry_price") - 1)


def summary(equity: DataFrame, config: Config = Config(), price: str = "close") -> DataFrame:  # noqa: B008
    """key, final_capital (after a closing cost), total_return, sharpe, sortino, volatility (annual) and max_drawdown.

    Daily returns and drawdown are of the equity before the closing cost.
    """
    d = drawdown(equity.withColumn("r", F.col("equity") / F.lag("equity").over(by()) - 1), "equity")
    end = F.max_by(F.struct("equity", "position"), "idx")
    g = d.groupBy("key").agg(end.alias("e"), stats.sharpe("r", 0.0, 252).alias("sharpe"), stats.sortino("r").alias("sortino"), stats.volatility("r", 252).alias("volatility"), F.min("drawdown").alias("max_drawdown"))
    final = F.col("e.equity") * F.when(F.col("e.position") == 1, 1 - config.cost).otherwise(1.0)
    return g.select("key", final.alias("final_capital"), (final / config.capital - 1).alias("total_return"), "sharpe", "sortino", "volatility", "max_drawdown")


def turnover_backtest(df: DataFrame, cost: float = 0.001, r: str = "r") -> DataFrame:
    """Adds net and growth: the position of the row before earns r, and each change of position costs."""
    held = F.coalesce(F.lag("position").over(by()), F.lit(0))
    d = df.withColumn("net", held * F.col(r) - cost * F.abs(F.col("position") - held))
    return d.withColumn("growth", F.product(1 + F.col("net")).over(so_far()))


def clamp(size: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), size))


def event_backtest(px: DataFrame, barrier: labels.TripleBarrier, step: int = 5, n_folds: int = 4, embargo: int = 5, kelly_share: float = 0.5) -> DataFrame:
    """key, n_events, size, total_return, max_drawdown, sharpe, mean_fold_sharpe: barrier labels, purged folds, Kelly size, and the equity in event order.

    Entries are every step-th row but the last of a series. Sample weights are not used for the Sharpe ratios.
    """
    ends = px.groupBy("key").agg(F.max("idx").alias("_max"))
    d = px.join(ends, "key")
    events = labels.triple_barrier(d, barrier, (F.col("idx") % step == 0) & (F.col("idx") < F.col("_max")))
    size = events.groupBy("key").agg(F.count("*").alias("n_events"), clamp(kelly_share * stats.kelly("return_pct")).alias("size"), stats.sharpe("return_pct").alias("sharpe"))
    e = events.join(size, "key").withColumn("idx", F.col("entry")).withColumn("equity", F.product(1 + F.col("size") * F.col("return_pct")).over(so_far()))
    dd = drawdown(e, "equity").groupBy("key").agg((F.max_by("equity", "idx") - 1).alias("total_return"), F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"))
    fold = F.least(F.floor(F.col("entry") * n_folds / (F.col("_max") + 1)), F.lit(n_folds - 1))
    by_fold = events.join(ends, "key").withColumn("fold", fold).groupBy("key", "fold").agg(stats.sharpe("return_pct").alias("s")).groupBy("key").agg(F.avg("s").alias("mean_fold_sharpe"))
    return size.join(dd, "key").join(by_fold, "key")


def momentum(df: DataFrame, lookback: int = 20, hold: int = 21, n: int = 2, price: str = "price") -> DataFrame:
    """key, idx, momentum, side: every hold-th row, the n keys with the largest past return are held (1), the n with the least sold (-1).

    From a price of 0 the return is infinite, or NaN to another 0; NaN counts as the largest.
    """
    from pyspark.sql import window as W

    past = F.lag(price, lookback).over(by())
    ratio = F.when(past == 0, F.col(price) * F.lit(float("inf"))).otherwise(F.try_divide(F.col(price), past))
    d = df.withColumn("momentum", ratio - 1).where((F.col("idx") % hold == 0) & F.col("momentum").isNotNull())
    at = W.Window.partitionBy("idx")
    up, low = F.row_number().over(at.orderBy(F.col("momentum").desc(), "key")), F.row_number().over(at.orderBy("momentum", "key"))
    return d.withColumn("_u", up).withColumn("_l", low).withColumn("side", F.when(F.col("_l") <= n, -1).when(F.col("_u") <= n, 1).otherwise(0)).select("key", "idx", "momentum", "side")
