"""Regressions, stationarity tests and volatility models, fitted for each key at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import optimize, stats
from tidemark.operators.returns import acf, by, ffd_weights

SINGULAR = 1e-12


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gaussian elimination with partial pivoting; a pivot below 1e-12 is a ValueError."""
    m = np.c_[np.array(a, float), np.array(b, float)]
    n = len(m)
    for k in range(n):
        p = k + int(np.abs(m[k:, k]).argmax())
        if abs(m[p, k]) < SINGULAR:
            raise ValueError("singular")
        m[[k, p]] = m[[p, k]]
        m[k + 1 :] -= np.outer(m[k + 1 :, k] / m[k, k], m[k])
    x = np.zeros((n, m.shape[1] - n))
    for k in range(n - 1, -1, -1):
        x[k] = (m[k, n:] - m[k, k + 1 : n] @ x[k + 1 :]) / m[k, k]
    return x if np.ndim(b) > 1 else x[:, 0]


OLS = "key string, n long, coefficients array<double>, std_errors array<double>, t_stats array<double>, r_squared double, sse double, status string"


def ols(df: DataFrame, y: str, xs: list[str], intercept: bool = True) -> DataFrame:
    """One fit for each key: moments in one aggregation, then a small system for each key.

    With an intercept the moments are those about the means, which lose no digits where regressors lie far from 0. Rows with a
    null among y and xs don't count. status says why there is no fit: too few rows, or singular.
    """
    cols, y_col, k = [F.col(x).cast("double") for x in xs], F.col(y).cast("double"), len(xs)
    both = (lambda a, b: F.covar_pop(a, b)) if intercept else (lambda a, b: F.avg(a * b))
    sums = [both(cols[i], cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [both(c, y_col).alias(f"b{i}") for i, c in enumerate(cols)]
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    agg = df.dropna(subset=[y, *xs]).groupBy("key").agg(F.count("*").alias("n"), F.avg(y_col).alias("my"), both(y_col, y_col).alias("vy"), F.var_pop(y_col).alias("sy"), *means, *sums)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                n = int(r["n"])
                a = n * np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]).reshape(k, k)
                b = n * np.array([r[f"b{i}"] for i in range(k)])
                size = k + intercept
                try:
                    if n < size:
                        raise ValueError("too few rows")
                    beta, inverse = solve(a, b), solve(a, np.eye(k))
                except ValueError as e:
                    rows.append((r["key"], n, None, None, None, None, None, str(e)))
                    continue
                sse = max(float(n * r["vy"] - 2 * beta @ b + beta @ a @ beta), 0.0)
                sst = float(n * r["sy"])
                spread = np.diag(inverse)
                if intercept:
                    m = np.array([r[f"m{i}"] for i in range(k)])
                    beta, spread = np.r_[r["my"] - beta @ m, beta], np.r_[1 / n + m @ inverse @ m, spread]
                se = np.sqrt(np.abs(spread * (sse / (n - size) if n > size else 0.0)))
                t = np.divide(beta, se, out=np.zeros(size), where=se > 0)
                rows.append((r["key"], n, beta.tolist(), se.tolist(), t.tolist(), 1 - sse / sst if sst > 0 else 0.0, sse, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OLS.split(", ")])

    return agg.mapInPandas(run, OLS)


def adf(df: DataFrame, lags: int = 1, value: str = "price") -> DataFrame:
    """key, n, statistic, stationary: the t statistic of the level in a regression of changes on it and lagged changes, held against -2.86."""
    d = df.withColumn("_level", F.lag(value).over(by())).withColumn("_d", F.col(value) - F.col("_level"))
    names = [f"_d{k}" for k in range(1, lags + 1)]
    d = d.withColumns({n: F.lag("_d", k).over(by()) for k, n in enumerate(names, 1)}) if names else d
    fit = ols(d.select("key", "_d", "_level", *names), "_d", ["_level", *names])
    return fit.select("key", "n", F.get("t_stats", F.lit(1)).alias("statistic"), (F.get("t_stats", F.lit(1)) < -2.86).alias("stationary"), "status")


def adf_by_aic(df: DataFrame, most_lag: int = 10, value: str = "price") -> DataFrame:
    """key, lags, aic, statistic, stationary: adf with the number of lags of the least AIC, the smallest of equal ones."""
    n = df.groupBy("key").agg(F.count("*").alias("_rows"))
    d = df.withColumn("_level", F.lag(value).over(by())).withColumn("_d", F.col(value) - F.col("_level"))
    d = d.select("key", "_d", "_level", *[F.lag("_d", k).over(by()).alias(f"_d{k}") for k in range(1, most_lag + 1)])
    fits = None
    for k in range(most_lag + 1):
        fit = ols(d, "_d", ["_level", *[f"_d{j}" for j in range(1, k + 1)]]).where("status is null and sse > 0")
        fit = fit.select("key", F.lit(k).alias("lags"), (F.ln(F.col("sse") / F.col("n"))).alias("_s"), F.get("t_stats", F.lit(1)).alias("statistic"))
        fits = fit if fits is None else fits.unionByName(fit)
    scored = fits.join(n, "key").withColumn("aic", F.col("_rows") * F.col("_s") + 2.0 * (F.col("lags") + 2))
    best = scored.groupBy("key").agg(F.min_by(F.struct("lags", "aic", "statistic"), F.struct("aic", "lags")).alias("b"))
    return best.select("key", "b.lags", "b.aic", "b.statistic", (F.col("b.statistic") < -2.86).alias("stationary"))


def pacf(df: DataFrame, most_lag: int, value: str = "price") -> DataFrame:
    """key, lag, phi for lags 1 to most_lag, by Levinson's recursion over the autocorrelations; none beyond the series."""
    lags = acf(df, most_lag, value).where("rho is not null").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lag", "rho"))).alias("a"))

    def run(batches):
        for pdf in batches:
            out = []
            for key, a in zip(pdf["key"], pdf["a"], strict=True):
                rho, phi = np.array([x["rho"] for x in a]), np.zeros(0)
                for k in range(1, len(rho)):
                    rest = 1 - phi @ rho[1:k]
                    last = (rho[k] - phi @ rho[k - 1 : 0 : -1]) / rest if abs(rest) > SINGULAR else 0.0
                    phi = np.r_[phi - last * phi[::-1], last]
                    out.append((key, k, float(last)))
            yield pd.DataFrame(out, columns=["key", "lag", "phi"])

    return lags.mapInPandas(run, "key string, lag int, phi double")


def _np_adf(x: np.ndarray, lags: int = 1) -> float:
    d = np.diff(x)
    if len(x) < lags + 3:
        return 0.0
    design = np.stack([np.ones(len(d) - lags), x[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]], 1)
    y = d[lags:]
    try:
        inverse = solve(design.T @ design, np.eye(design.shape[1]))
    except ValueError:
        return 0.0
    beta = inverse @ design.T @ y
    s2 = ((y - design @ beta) ** 2).sum() / max(1, len(y) - design.shape[1])
    se = np.sqrt(abs(inverse[1, 1] * s2))
    return float(beta[1] / se) if se > 0 else 0.0


def find_min_d(df: DataFrame, threshold: float = 1e-3, tolerance: float = 0.01, value: str = "price") -> DataFrame:
    """key, d: the least order of fractional differences within 0 and 1 (by bisection) whose series is stationary; null if none is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")[value].to_numpy(float)

        def good(d: float) -> bool:
            w = np.array(ffd_weights(d, threshold))
            if len(x) < len(w) + 3:
                return False
            return _np_adf(np.convolve(x, w, "valid")) < -2.86

        if good(0.0):
            d = 0.0
        elif not good(1.0):
            d = None
        else:
            low, d = 0.0, 1.0
            while d - low > tolerance:
                mid = (low + d) / 2
                low, d = (low, mid) if good(mid) else (mid, d)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "d": [d]}).astype({"d": "float64"})

    return df.groupBy("key").applyInPandas(run, "key string, d double")


def cusum(df: DataFrame, threshold: float, drift: float = 0.0, value: str = "price") -> DataFrame:
    """key, idx, direction, confidence of each break: sums above drift, upwards or downwards, that pass threshold; either resets both."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        high = low = 0.0
        out = []
        for i, x in zip(pdf["idx"], pdf[value].astype(float), strict=True):
            high, low = max(high + x - drift, 0.0), max(low - x - drift, 0.0)
            if high > threshold or low > threshold:
                out.append((pdf["key"].iloc[0], i, "up" if high > threshold else "down", 0.95))
                high = low = 0.0
        return pd.DataFrame(out, columns=["key", "idx", "direction", "confidence"])

    return df.groupBy("key").applyInPandas(run, "key string, idx long, direction string, confidence double")


def ewma_variance(r: np.ndarray, decay: float) -> np.ndarray:
    out = np.empty(len(r))
    if len(r):
        out[0] = r[0] ** 2
        if len(r) > 1:
            out[1:] = pd.Series(np.r_[r[0] ** 2, r[:-1] ** 2]).ewm(alpha=1 - decay, adjust=False).mean().to_numpy()[1:]
    return out


def ewma_vol(df: DataFrame, decay: float = 0.94, r: str = "r") -> DataFrame:
    """Adds variance: the exponential mean of squared returns before each row, begun by the first one's square."""
    if not 0 <= decay <= 1:
        raise ValueError("decay must be within 0 and 1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pdf.assign(variance=ewma_variance(pdf[r].to_numpy(float), decay))

    return df.groupBy("key").applyInPandas(run, df.withColumn("variance", F.lit(0.0)).schema)


def leverage(df: DataFrame, decay: float = 0.94, r: str = "r") -> DataFrame:
    """key, egarch, gjr: the correlation of returns with the relative change of the EWMA variance after them, and stats.gjr_gamma."""
    d = ewma_vol(df.select("key", "idx", r), decay, r).withColumn("_n", F.row_number().over(by())).withColumn("_b", F.lag(r).over(by()))
    change = (F.lead("variance").over(by()) - F.col("variance")) / F.greatest("variance", F.lit(1e-12))
    d = d.withColumn("_c", F.when(F.col("_n") > 1, change))
    corr = F.corr(F.when(F.col("_c").isNotNull(), F.col(r)), F.col("_c"))
    return d.groupBy("key").agg(F.coalesce(F.nanvl(corr, F.lit(0.0)), F.lit(0.0)).alias("egarch"), stats.gjr_gamma(r, "_b").alias("gjr"))


def arch_variances(df: DataFrame, omega: float, alphas: list[float], r: str = "r") -> DataFrame:
    """Adds variance: omega and weighted squares of the last returns, without any recursion."""
    v = F.lit(omega)
    for k, a in enumerate(alphas, 1):
        v = v + a * F.coalesce(F.pow(F.lag(r, k).over(by()), F.lit(2.0)), F.lit(0.0))
    return df.withColumn("variance", F.greatest(v, F.lit(1e-300)))


def arch_parameters(z: np.ndarray) -> tuple[float, np.ndarray]:
    """Free numbers to omega and alphas, which aren't negative and sum to less than 1."""
    e = np.exp(np.clip(z, -30, 30))
    return float(e[0]), e[1:] / (1 + e[1:].sum())


def arch_variance_path(r: np.ndarray, omega: float, alpha: np.ndarray) -> np.ndarray:
    """The variance of each row: omega and the weighted squares of the rows before, as far as there are any."""
    return np.maximum(omega + np.convolve(r * r, np.r_[0.0, alpha])[: len(r)], 1e-300)


def arch_likelihood(r: np.ndarray, omega: float, alpha: np.ndarray) -> float:
    """The Gaussian log-likelihood of all rows."""
    return _likelihood(r, arch_variance_path(r, omega, alpha))


def long_run_variance(omega: float, persistence: float) -> float:
    return omega / (1 - persistence) if persistence < 1 else float("inf")


def arch_ahead(omega: float, alpha: np.ndarray, horizon: int, last: np.ndarray | None = None) -> list[float]:
    """Variances of the next rows: from the long-run variance, or from last, the squares of the last rows, newest first.

    The first alpha meets the oldest of the squares that are at hand; each forecast then becomes the newest of them.
    """
    level = long_run_variance(omega, float(alpha.sum()))
    window, out = list(np.full(len(alpha), level) if last is None else last), []
    for _ in range(horizon):
        out.append(float(omega + alpha @ window[::-1]))
        window = [*window[1:], out[-1]]
    return out


ARCH = "key string, omega double, alpha array<double>, log_likelihood double, long_run_variance double, forecast array<double>, forecast_from array<double>, converged boolean, status string"


def arch(df: DataFrame, q: int = 1, horizon: int = 5, r: str = "r") -> DataFrame:
    """One ARCH(q) fit for each key by maximum likelihood, with forecasts from the long-run variance and from the last rows.

    Fewer than q + 3 rows, or none that vary: a status.
    """
    if q < 1:
        raise ValueError("q must be 1 at least")
    names = [c.split()[0] for c in ARCH.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, key = pdf.sort_values("idx")[r].to_numpy(float), pdf["key"].iloc[0]
        if len(x) < q + 3 or not np.var(x) > 0:
            return pd.DataFrame([(key, *[None] * 7, "too few rows")], columns=names)
        share = 0.5 / (q + 1)
        start = [np.log(0.5 * max(float(np.var(x, ddof=1)), 1e-10)), *[np.log(share / (1 - share))] * q]
        best = optimize.multistart(lambda z: arch_likelihood(x, *arch_parameters(z)), start)
        omega, alpha = arch_parameters(best.x)
        ahead = arch_ahead(omega, alpha, horizon), arch_ahead(omega, alpha, horizon, x[::-1][:q] ** 2)
        return pd.DataFrame([(key, omega, alpha.tolist(), best.value, long_run_variance(omega, float(alpha.sum())), *ahead, best.converged, None)], columns=names)

    return df.groupBy("key").applyInPandas(run, ARCH)


def decompose(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """df (key, y and xs) with fitted, what the fit of ols gives (its constant included), and residual; null where there is no fit."""
    fit = ols(df, y, xs).select("key", F.col("coefficients").alias("_c"))
    fitted = F.get("_c", F.lit(0))
    for k, x in enumerate(xs, 1):
        fitted = fitted + F.get("_c", F.lit(k)) * F.col(x)
    return df.join(fit, "key", "left").withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted")).drop("_c")


def garch_variances(r: np.ndarray, omega: float, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    most = max(len(alpha), len(beta))
    v = np.full(len(r), max(float(np.var(r, ddof=1)) if len(r) > 1 else 1e-300, 1e-300))
    sq = r * r
    for t in range(most, len(r)):
        v[t] = min(max(omega + sum(a * sq[t - 1 - i] for i, a in enumerate(alpha)) + sum(b * v[t - 1 - j] for j, b in enumerate(beta)), 1e-300), 1e15)
    return v


def _likelihood(r: np.ndarray, v: np.ndarray) -> float:
    return float(-0.5 * (np.log(2 * np.pi) + np.log(v) + r * r / v).sum())


def climb(f, x0, step: float = 0.3, rounds: int = 400, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Coordinate steps that halve when none helps, from several starts; the best end wins."""
    best, top = None, -np.inf
    for shift in (0.0, 0.1, -0.1, 0.3, -0.3, 0.5):
        x = np.array(x0, float) + shift
        now, s = f(x), step
        for _ in range(rounds):
            better = False
            for k in range(len(x)):
                for d in (s, -s):
                    y = x.copy()
                    y[k] += d
                    v = f(y)
                    if v > now:
                        x, now, better = y, v, True
                        break
            if not better:
                s /= 2
                if s < tolerance:
                    break
        if now > top:
            best, top = x, now
    return best, top


def garch_parameters(z: np.ndarray, p: int, q: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Free numbers to omega, alphas (0.49 in all at most) and betas (less than 1 with them)."""
    z = np.clip(z, -30, 30)
    s = 1 / (1 + np.exp(-z[1:]))
    alpha = s[:q] * 0.49 / q
    return float(np.exp(z[0])), alpha, s[q:] * (0.998 - alpha.sum()) / p


GARCH = "key string, omega double, alpha array<double>, beta array<double>, log_likelihood double, persistence double, long_run_variance double, half_life double, forecast array<double>, status string"


def garch(df: DataFrame, p: int = 1, q: int = 1, horizon: int = 5, r: str = "r") -> DataFrame:
    """One fit for each key by maximum likelihood, and forecasts from the last variance. p = 0 gives an ARCH model. Too few rows: a status."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")[r].to_numpy(float)
        key, most = pdf["key"].iloc[0], max(p, q)
        if q < 1 or len(x) < p + q + 3 or np.var(x) == 0:
            return pd.DataFrame([(key, None, None, None, None, None, None, None, None, "too few rows")], columns=[c.split()[0] for c in GARCH.split(", ")])
        score = lambda z: _likelihood(x[most:], garch_variances(x, *garch_parameters(z, max(p, 1), q))[most:])
        z, top = climb(score, [np.log(0.05 * np.var(x, ddof=1)), *[-2.18] * q, *[2.93] * p])
        omega, alpha, beta = garch_parameters(z, max(p, 1), q)
        hold = float(alpha.sum() + beta.sum())
        long = omega / (1 - hold) if hold < 1 else np.inf
        v = garch_variances(x, omega, alpha, beta)[-1]
        ahead = []
        for _ in range(horizon):
            v = omega + hold * v
            ahead.append(float(v))
        half = np.log(0.5) / np.log(hold) if 0 < hold < 1 else np.inf
        return pd.DataFrame([(key, omega, alpha.tolist(), beta.tolist(), top, hold, long, half, ahead, None)], columns=[c.split()[0] for c in GARCH.split(", ")])

    return df.groupBy("key").applyInPandas(run, GARCH)
