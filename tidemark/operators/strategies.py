"""Strategies composed of other operators: backtests from parts, pairs, meta-labels, scaled sizes and hedges."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.functions import options
from tidemark.functions.rows import deflated_sharpe, grade_to_score, loan_to_income, normalize, one_hot, predict_proba, ratio, walk_forward_efficiency
from tidemark.operators import labels, models, scoring, stats
from tidemark.operators.backtest import clamp
from tidemark.operators.returns import acf, by, ema, frac_diff, log_returns, so_far, trailing

Labeler = Callable[[DataFrame, Column], DataFrame]
Splitter = Callable[[SparkSession, int], DataFrame]


def kelly_sizer(share: float = 0.5) -> Column:
    """An aggregate of r: a share of full Kelly, within 0 and 1."""
    return clamp(share * stats.kelly("r"))


def fixed_sizer(share: float) -> Column:
    return F.max(F.lit(min(max(share, 0.0), 1.0)))


def equal_sizer(n: int) -> Column:
    if n < 1:
        raise ValueError("at least one position")
    return F.max(F.lit(1.0 / n))


@dataclass(frozen=True)
class Composed:
    """A backtest from a labeler (rows, entry condition -> events), a splitter (session, rows -> ranges) and a sizer (aggregate of r).

    Each with_ method gives a new one; run needs all three parts.
    """

    labeler: Labeler | None = None
    splitter: Splitter | None = None
    sizer: Column | None = None
    step: int = 1

    def with_labeler(self, labeler: Labeler) -> Composed:
        return replace(self, labeler=labeler)

    def with_splitter(self, splitter: Splitter) -> Composed:
        return replace(self, splitter=splitter)

    def with_sizer(self, sizer: Column) -> Composed:
        return replace(self, sizer=sizer)

    def with_step(self, step: int) -> Composed:
        return replace(self, step=step)

    def run(self, df: DataFrame) -> DataFrame:
        """key, split, its four bounds, size, n_trades, total_return, sharpe, max_drawdown (not negative) from key, idx (from 0), price, r.

        Entries are every step-th training row. A test row is traded only if it is an entry as well and its label isn't 0, so
        splits whose ranges don't overlap, such as those of a walk forward, have no trades. A split that ends beyond a key's rows
        has no row for the key. The Sharpe ratio has the population deviation over trades.
        """
        for name in ("labeler", "splitter", "sizer"):
            if getattr(self, name) is None:
                raise ValueError(f"{name} is missing")
        if self.step < 1:
            raise ValueError("step must be positive")
        ends = df.groupBy("key").agg((F.max("idx") + 1).alias("_n"))
        most = ends.agg(F.max("_n")).first()[0] or 0
        bounds = ["train_start", "train_end", "test_start", "test_end"]
        splits = self.splitter(df.sparkSession, most).select("split", *bounds)
        whole = ends.join(splits, F.col("test_end") <= F.col("_n")).select("key", "split", *bounds)
        # rows of a range by an equality: each range as its row numbers
        train = splits.withColumn("idx", F.explode(F.sequence("train_start", F.col("train_end") - 1)))
        fitted = df.select("key", "idx", "r").join(train, "idx")
        size = fitted.groupBy("key", "split").agg(self.sizer.alias("size"))
        both = F.col("idx").between(F.col("test_start"), F.col("test_end") - 1) & ((F.col("idx") - F.col("train_start")) % self.step == 0)
        side = self.labeler(df, F.lit(True)).select("key", F.col("entry").alias("idx"), labels.to_ternary().alias("_side")).where("_side <> 0")
        taken = fitted.where(both).select("key", "split", "idx", "r").join(side, ["key", "idx"]).join(size, ["key", "split"])
        taken = taken.withColumn("_g", F.col("size") * F.col("_side") * F.coalesce("r", F.lit(0.0)))
        at = W.Window.partitionBy("key", "split").orderBy("idx").rowsBetween(W.Window.unboundedPreceding, 0)
        e = taken.withColumn("_e", F.product(1 + F.col("_g")).over(at)).withColumn("_p", F.greatest(F.max("_e").over(at), F.lit(1.0)))
        sd = F.stddev_pop("_g")
        g = e.groupBy("key", "split").agg(
            F.count("*").alias("n_trades"),
            (F.max_by("_e", "idx") - 1).alias("total_return"),
            F.when(sd > 1e-10, F.avg("_g") / sd).otherwise(0.0).alias("sharpe"),
            F.max((F.col("_p") - F.col("_e")) / F.col("_p")).alias("max_drawdown"),
        )
        d = whole.join(size, ["key", "split"]).join(g, ["key", "split"], "left")
        return d.select("key", "split", *bounds, "size", F.coalesce("n_trades", F.lit(0).cast("long")).alias("n_trades"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total_return", "sharpe", "max_drawdown")])


def pairs(df: DataFrame, window: int = 60, enter: float = 2.0, leave: float = 0.5) -> DataFrame:
    """key, idx, residual, z, position, pnl, trade: the spread of a over b (key, idx, a, b), traded by its rolling z-score.

    The hedge is one least-squares fit over the whole series. A flat book sells the spread above enter and buys it below -enter, then
    holds until z is within leave. The position of the row before earns the change from this row to the next one; the first has none.
    """
    if window < 2 or not 0 <= leave < enter:
        raise ValueError("window must be 2 at least, and leave below enter")
    fit = df.groupBy("key").agg(F.regr_slope("a", "b").alias("_b"), F.regr_intercept("a", "b").alias("_a"))
    d = df.join(fit, "key").withColumn("residual", F.col("a") - F.col("_a") - F.col("_b") * F.col("b"))
    d = d.withColumn("_d", F.coalesce(F.lead("a").over(by()) - F.col("a") - F.col("_b") * (F.lead("b").over(by()) - F.col("b")), F.lit(0.0)))
    mean, sd = F.avg("residual").over(trailing(window)), F.stddev_samp("residual").over(trailing(window))
    d = d.withColumn("z", F.when(sd > 1e-12, (F.col("residual") - mean) / sd).otherwise(0.0)).withColumn("_n", F.row_number().over(by())).where(F.col("_n") >= window)
    # a trade begins at the first entry after a row within leave: rows are cut there, and each run has one trade at most
    d = d.withColumn("trade", F.sum((F.abs("z") < leave).cast("int")).over(so_far()).cast("long"))
    run = W.Window.partitionBy("key", "trade").orderBy("idx").rowsBetween(W.Window.unboundedPreceding, 0)
    side = F.when(F.col("z") > enter, -1).when(F.col("z") < -enter, 1)
    d = d.withColumn("position", F.coalesce(F.first(side, ignorenulls=True).over(run), F.lit(0)))
    held, opened = F.lag("position").over(by()), F.lag("trade").over(by())
    d = d.withColumn("_o", opened).withColumn("pnl", held * F.col("_d"))
    return d.select("key", "idx", "residual", "z", "position", "pnl", F.when(F.col("position") != 0, F.col("trade")).when(held != 0, F.col("_o")).alias("trade"))


def pairs_summary(traded: DataFrame) -> DataFrame:
    """key, n_trades (with one open at the end), hit_rate, total_pnl, sharpe (annual) of the rows of pairs."""
    one = traded.where("trade is not null").groupBy("key", "trade").agg(F.sum("pnl").alias("p"))
    n = one.groupBy("key").agg(F.count("*").alias("n_trades"), F.avg((F.col("p") > 0).cast("double")).alias("hit_rate"))
    all_rows = traded.groupBy("key").agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"), F.coalesce(stats.sharpe("pnl", 0.0, 252), F.lit(0.0)).alias("sharpe"))
    return all_rows.join(n, "key", "left").select("key", F.coalesce("n_trades", F.lit(0).cast("long")).alias("n_trades"), F.coalesce("hit_rate", F.lit(0.0)).alias("hit_rate"), "total_pnl", "sharpe")


def fit_logistic(x: np.ndarray, y: np.ndarray, rate: float = 0.5, epochs: int = 200) -> np.ndarray:
    """The bias and weights after whole-batch gradient steps from zero."""
    x, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(epochs):
        w -= rate * x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -700, 700))) - y) / max(1, len(x))
    return w


def logistic(df: DataFrame, features: list[str], label: str, rate: float = 0.5, epochs: int = 200) -> DataFrame:
    """key, n, bias, weights of a logistic model for each key, by fit_logistic over the key's rows in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = fit_logistic(pdf[features].to_numpy(float), pdf[label].to_numpy(float), rate, epochs)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": [len(pdf)], "bias": [w[0]], "weights": [w[1:].tolist()]})

    return df.select("key", label, *features).groupBy("key").applyInPandas(run, "key string, n long, bias double, weights array<double>")


def meta_labels(df: DataFrame, barrier: labels.TripleBarrier, fast: int = 5, slow: int = 20, rate: float = 0.5, epochs: int = 200) -> DataFrame:
    """key, idx, label (0 or 1), probability, kept of each entry, where the fast mean of price lay above the slow one on the row before.

    The first and the last slow rows of a series are no entries. The label is that of the barriers. A logistic model for each key (in
    one task, over its entries' three numbers only) takes the change over ten rows, the population deviation of the last slow log
    returns, and 1; an entry is kept above a probability of a half.
    """
    lr = F.ln(F.col("price") / F.lag("price").over(by()))
    d = df.select("key", "idx", "price").withColumn("_r", lr).withColumn("_n", F.row_number().over(by()))
    d = d.withColumn("_f", F.avg("price").over(by().rowsBetween(-fast, -1))).withColumn("_s", F.avg("price").over(by().rowsBetween(-slow, -1)))
    d = d.withColumn("x1", F.col("price") - F.lag("price", 10).over(by())).withColumn("x2", F.stddev_pop("_r").over(trailing(slow)))
    d = d.join(df.groupBy("key").agg(F.count("*").alias("_m")), "key")
    entry = (F.col("_n") > slow) & (F.col("_n") <= F.col("_m") - slow) & (F.col("_f") > F.col("_s"))
    events = labels.triple_barrier(d, barrier, entry).select("key", F.col("entry").alias("idx"), labels.to_binary().cast("int").alias("label"))
    x = d.select("key", "idx", "x1", "x2").join(events, ["key", "idx"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        a = np.c_[pdf[["x1", "x2"]].fillna(0.0).to_numpy(float), np.ones(len(pdf))]
        w = fit_logistic(a, pdf["label"].to_numpy(float), rate, epochs)
        p = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(a)), a] @ w, -700, 700)))
        return pd.DataFrame({"key": pdf["key"], "idx": pdf["idx"], "label": pdf["label"], "probability": p, "kept": p > 0.5})

    return x.groupBy("key").applyInPandas(run, "key string, idx long, label int, probability double, kept boolean")


def scaled_kelly(df: DataFrame, window: int = 20, r: str = "r") -> DataFrame:
    """Adds share and wealth: half Kelly (0 to 1) by the series' scale over that of the window rows before; the first window rows aren't scaled.

    The series' scale is the root of its summed squares by the number of rows.
    """
    fit = df.groupBy("key").agg((0.5 * F.greatest(F.lit(0.0), F.least(F.lit(2.0), stats.kelly(r)))).alias("_k"), (F.sqrt(F.sum(F.col(r) * F.col(r))) / F.count(r)).alias("_bar"))
    d = df.join(fit, "key").withColumn("_n", F.row_number().over(by()))
    before = F.sqrt(F.avg(F.col(r) * F.col(r)).over(by().rowsBetween(-window, -1)))
    now = F.when(F.col("_n") > window, before).otherwise(F.col("_bar"))
    d = d.withColumn("share", F.col("_k") * F.when(now > 1e-9, F.col("_bar") / now).otherwise(1.0))
    return d.withColumn("wealth", F.product(1 + F.col("share") * F.col(r)).over(so_far())).drop("_k", "_bar", "_n")


def delta_hedge(df: DataFrame, strike, rate: float, sigma: float, days: float = 252.0, price: str = "price") -> DataFrame:
    """key, idx, delta, cost, pnl: a sold call, hedged anew on each row with its delta, to expiry on the last row.

    cost is the cash spent on shares so far, pnl the first row's premium less the option's value and cost, plus the shares' worth.
    """
    rows = W.Window.partitionBy("key")
    d = df.select("key", "idx", F.col(price).cast("double").alias("s"), (strike if isinstance(strike, Column) else F.lit(float(strike))).alias("k"))
    d = d.withColumn("t", (F.max("idx").over(rows) - F.col("idx")) / days)
    left = F.col("t") > 1e-9
    t = F.greatest(F.col("t"), F.lit(1e-9))
    d = d.withColumn("delta", F.when(left, options.delta(F.col("s"), F.col("k"), rate, sigma, t, True)).otherwise((F.col("s") > F.col("k")).cast("double")))
    d = d.withColumn("_v", F.when(left, options.call_price(F.col("s"), F.col("k"), rate, sigma, t)).otherwise(F.greatest(F.col("s") - F.col("k"), F.lit(0.0))))
    d = d.withColumn("_c", (F.col("delta") - F.coalesce(F.lag("delta").over(by()), F.lit(0.0))) * F.col("s")).withColumn("cost", F.sum("_c").over(so_far()))
    return d.select("key", "idx", "delta", "cost", (F.first("_v").over(so_far()) - F.col("_v") + F.col("delta") * F.col("s") - F.col("cost")).alias("pnl"))


def rolling_beta(df: DataFrame, window: int = 60, r: str = "r", market: str = "m") -> DataFrame:
    """key, idx, beta of each full window that has a row after it: the last window is left out."""
    beta = ratio(F.covar_samp(r, market).over(trailing(window)), F.var_samp(market).over(trailing(window)))
    d = df.withColumn("beta", beta).withColumn("_n", F.row_number().over(by())).withColumn("_next", F.lead("idx").over(by()))
    return d.where((F.col("_n") >= window) & F.col("_next").isNotNull()).select("key", "idx", "beta")


def embargo_lag(df: DataFrame, most_lag: int = 10, value: str = "price") -> DataFrame:
    """key, embargo: the first lag whose autocorrelation is within 1.96 deviations of none; 0 if there is none up to most_lag."""
    n = df.groupBy("key").agg(F.count("*").alias("_n"))
    a = acf(df, most_lag, value).where("lag > 0").join(n, "key")
    near = F.when(F.abs("rho") < 1.96 / F.sqrt("_n"), F.col("lag"))
    return a.groupBy("key").agg(F.coalesce(F.min(near), F.lit(0)).alias("embargo"))


def crossover_grid(df: DataFrame, shorts: list[int], longs: list[int], price: str = "close", periods: float = 252) -> DataFrame:
    """key, short, long, sharpe, best: the annual Sharpe ratio of holding while the short mean lies above the long one, for each pair of lengths.

    A row's return, from the row before, counts if the means cross over on the row itself; rows before the long mean's first
    full window and the row that ends it are flat. best marks the largest ratio above 0 of a key, the first of equal ones.
    """
    pairs = [(s, n) for s in shorts for n in longs if 1 <= s < n]
    if not pairs:
        raise ValueError("no pair of lengths")
    d = df.select("key", "idx", (F.col(price) / F.lag(price).over(by()) - 1).alias("_r"), (F.row_number().over(by()) - 1).alias("_n"), *[F.avg(price).over(trailing(k)).alias(f"_m{k}") for k in sorted({k for p in pairs for k in p})])
    d = d.where("_r is not null")
    earned = lambda s, n: F.when((F.col("_n") >= n) & (F.col(f"_m{s}") > F.col(f"_m{n}")), F.col("_r")).otherwise(0.0)
    g = d.groupBy("key").agg(*[F.coalesce(stats.sharpe(earned(s, n), 0.0, periods), F.lit(0.0)).alias(f"s{k}") for k, (s, n) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("short"), F.lit(n).alias("long"), F.col(f"s{k}").alias("sharpe")) for k, (s, n) in enumerate(pairs)])
    top = F.array_max(F.transform(rows, lambda x: F.struct(x["sharpe"], -x["k"])))
    d = g.select("key", top.alias("_t"), F.explode(rows).alias("x"))
    best = (F.col("_t.sharpe") > 0) & (F.col("x.k") == -F.col("_t.col2"))
    return d.select("key", "x.short", "x.long", "x.sharpe", best.alias("best"))


def ema_crossover(df: DataFrame, short: int, long: int, price: str = "close") -> DataFrame:
    """Adds position: 1 while the short exponential mean lies above the long one, else 0."""
    if not 1 <= short < long:
        raise ValueError("short must be below long")
    d = ema(ema(df, short, price, "_s"), long, price, "_l")
    return d.withColumn("position", (F.col("_s") > F.col("_l")).cast("int")).drop("_s", "_l")


def turnover(df: DataFrame, cost: float = 0.0, price: str = "close") -> DataFrame:
    """key, n_trades, total_return of rows with a position: what was held on the row before earns, and each change costs a share of equity."""
    held = F.coalesce(F.lag("position").over(by()), F.lit(0))
    d = df.withColumn("_h", held).withColumn("_n", F.row_number().over(by()))
    r = F.when(F.col("_n") > 1, F.col(price) / F.lag(price).over(by()) - 1).otherwise(0.0)
    # The first row's position isn't traded.
    changed = ((F.col("_n") > 1) & (F.col("position") != F.when(F.col("_n") == 2, 0).otherwise(F.col("_h")))).cast("int")
    d = d.withColumn("_c", changed).withColumn("_r", F.when((F.col("_n") > 2) & (F.col("_h") == 1), r).otherwise(0.0))
    grown = F.product((1 + F.col("_r")) * F.pow(F.lit(1 - cost), F.col("_c")))
    return d.groupBy("key").agg(F.sum("_c").alias("n_trades"), (grown - 1).alias("total_return"))


def learning(px: DataFrame, barrier: labels.TripleBarrier, d: float = 0.4, threshold: float = 1e-4, step: int = 5, splits: tuple[int, int, int] = (120, 30, 30), trials: int = 5, var_sharpes: float = 0.05, in_sample: float = 1.2, out_of_sample: float = 0.6) -> DataFrame:
    """The pipeline of labels and sizes, a row for each key (key, idx from 0, price).

    statistic and stationary are of the fractionally differenced log returns; n_events, n_upper, n_lower and n_time of the barriers,
    entered every step-th row; n_folds of a walk forward; kelly and half_kelly of the events' returns; efficiency of the Sharpe ratios
    in and out of sample, which are given; sharpe, skew, kurtosis and deflated_sharpe of the events.
    """
    r = log_returns(px).select("key", "idx", F.col("r").alias("price"))
    tested = models.adf(frac_diff(r, d, threshold).select("key", "idx", F.col("fd").alias("price")), 1).select("key", "statistic", "stationary")
    events = labels.triple_barrier(px, barrier, F.col("idx") % step == 0)
    count = lambda kind: F.count_if(F.col("label") == kind)
    g = events.groupBy("key").agg(
        F.count("*").alias("n_events"),
        *[count(k).alias(f"n_{k.lower()}") for k in ("Upper", "Lower", "Time")],
        stats.kelly("return_pct").alias("kelly"),
        stats.sharpe("return_pct").alias("sharpe"),
        F.coalesce(F.skewness("return_pct"), F.lit(0.0)).alias("skew"),
        F.coalesce(F.kurtosis("return_pct"), F.lit(0.0)).alias("kurtosis"),
    )
    train, test, stride = splits
    n = px.groupBy("key").agg(F.greatest(F.floor((F.max("idx") + 1 - train - test) / stride) + 1, F.lit(0)).alias("n_folds"))
    out = g.join(n, "key").join(tested, "key", "left")
    deflated = deflated_sharpe("sharpe", "n_events", "skew", "kurtosis", trials, var_sharpes)
    return out.withColumns({"half_kelly": 0.5 * F.col("kelly"), "efficiency": walk_forward_efficiency(F.lit(in_sample), F.lit(out_of_sample)), "deflated_sharpe": deflated})


#: Weights of the loan score: loan to income, interest rate, debt to income, grade, and homes rented, owned and mortgaged (fixed values).
LOAN_WEIGHTS, LOAN_BIAS = (0.8, 0.5, 0.7, 1.0, 0.2, -0.3, 0.0), -1.5


def loan_scores(loans: DataFrame) -> DataFrame:
    """loans (row_id, income, loan_amount, interest_rate, dti, grade, home_ownership, defaulted) with score, the probability of default.

    The first four features are scaled to 0..1 by their least and largest values over all loans.
    """
    plain = [loan_to_income("loan_amount", "income"), F.col("interest_rate"), F.col("dti"), grade_to_score("grade")]
    d = loans.withColumns({f"_f{k}": f for k, f in enumerate(plain)})
    d = d.crossJoin(F.broadcast(scoring.range_fit(d, [f"_f{k}" for k in range(4)])))  # one row
    scaled = [normalize(f"_f{k}", f"min__f{k}", f"max__f{k}") for k in range(4)]
    features = F.concat(F.array(*scaled), one_hot("home_ownership"))
    return d.select(*loans.columns, predict_proba(features, list(LOAN_WEIGHTS), LOAN_BIAS).alias("score"))


def loan_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: n, default_rate, auc, best_place, best_fpr and best_tpr (scoring.youden), and tp, fp, tn, fn, precision, recall and f1 at threshold."""
    d = scored.withColumn("label", F.col("defaulted"))
    base = d.agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("default_rate"))
    best = scoring.youden(d).select(F.col("place").alias("best_place"), F.col("fpr").alias("best_fpr"), F.col("tpr").alias("best_tpr"))
    at = scoring.threshold_sweep(d, [threshold]).drop("threshold")
    return base.crossJoin(scoring.auc(d)).crossJoin(best).crossJoin(at)  # one row each


def smile(df: DataFrame, spot: float) -> DataFrame:
    """models.ols of iv on log-moneyness and its square (key, k, iv): level, skew and curvature are the coefficients."""
    m = F.ln(F.col("k") / spot)
    return models.ols(df.select("key", "iv", m.alias("m"), (m * m).alias("m2")), "iv", ["m", "m2"])


def local_vol_call(s0: float, k: float, r: float, t: float, vol: Callable[[np.ndarray], np.ndarray], low: float, high: float, n_s: int = 120) -> float:
    """The price of a call under a volatility that depends on the price: explicit steps back over a grid, small enough to be stable."""
    if not 0 < low < s0 < high or t <= 0 or n_s < 2:
        raise ValueError("bad grid")
    s = np.linspace(low, high, n_s + 1)
    ds, inner = s[1] - s[0], s[1:-1]
    var = (np.asarray(vol(inner), float) * inner) ** 2
    n_t = max(1, math.ceil(t * float((var / ds**2 + abs(r)).max()) * 1.05))
    dt, v = t / n_t, np.maximum(s - k, 0.0)
    for step in range(1, n_t + 1):
        mid = v[1:-1]
        slope, bend = (v[2:] - v[:-2]) / (2 * ds), (v[2:] - 2 * mid + v[:-2]) / ds**2
        v[1:-1] = mid + dt * (var * bend / 2 + r * inner * slope - r * mid)
        v[0], v[-1] = 0.0, high - k * math.exp(-r * step * dt)
    return float(np.interp(s0, s, v))
