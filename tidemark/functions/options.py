"""Option prices, Greeks and implied volatility as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rows import _c

#: Coefficients of the error function's approximation 7.1.26 (fixed values).
_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_T = 0.3275911


def erf(x) -> Column:
    x = _c(x)
    t = 1 / (1 + _T * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(_A):
        poly = t * (F.lit(a) + poly)
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x) -> Column:
    return 0.5 * (1 + erf(_c(x) / float(np.sqrt(2))))


def normal_pdf(x) -> Column:
    return F.exp(-_c(x) * _c(x) / 2) / float(np.sqrt(2 * np.pi))


def d1(s, k, r, sigma, t) -> Column:
    s, k, r, sigma, t = map(_c, (s, k, r, sigma, t))
    return F.try_divide(F.ln(s / k) + (r + sigma * sigma / 2) * t, sigma * F.sqrt(t))


def d2(s, k, r, sigma, t) -> Column:
    return d1(s, k, r, sigma, t) - _c(sigma) * F.sqrt(_c(t))


def call_price(s, k, r, sigma, t) -> Column:
    return _c(s) * normal_cdf(d1(s, k, r, sigma, t)) - _c(k) * F.exp(-_c(r) * _c(t)) * normal_cdf(d2(s, k, r, sigma, t))


def put_price(s, k, r, sigma, t) -> Column:
    return _c(k) * F.exp(-_c(r) * _c(t)) * normal_cdf(-d2(s, k, r, sigma, t)) - _c(s) * normal_cdf(-d1(s, k, r, sigma, t))


def price(s, k, r, sigma, t, is_call) -> Column:
    """The price; at t = 0 what exercise gives. No volatility and time left: null."""
    now = F.when(_c(is_call), F.greatest(_c(s) - _c(k), F.lit(0.0))).otherwise(F.greatest(_c(k) - _c(s), F.lit(0.0)))
    return F.when(_c(t) == 0, now).otherwise(F.when(_c(is_call), call_price(s, k, r, sigma, t)).otherwise(put_price(s, k, r, sigma, t)))


def status(s, k, sigma, t) -> Column:
    """Null if the inputs are good, else what is wrong."""
    return F.when(~(_c(s) > 0), "spot").when(~(_c(k) > 0), "strike").when(~(_c(t) >= 0), "time").when(~(_c(sigma) >= 0), "volatility")


def delta(s, k, r, sigma, t, is_call) -> Column:
    n = normal_cdf(d1(s, k, r, sigma, t))
    now = F.when(_c(is_call) & (_c(s) > _c(k)), 1.0).when(~_c(is_call) & (_c(s) < _c(k)), -1.0).otherwise(0.0)
    return F.when(_c(t) == 0, now).otherwise(F.when(_c(is_call), n).otherwise(n - 1))


def gamma(s, k, r, sigma, t) -> Column:
    return F.when(_c(t) == 0, 0.0).otherwise(F.try_divide(normal_pdf(d1(s, k, r, sigma, t)), _c(s) * _c(sigma) * F.sqrt(_c(t))))


def vega(s, k, r, sigma, t) -> Column:
    return F.when(_c(t) == 0, 0.0).otherwise(_c(s) * normal_pdf(d1(s, k, r, sigma, t)) * F.sqrt(_c(t)))


def theta(s, k, r, sigma, t, is_call) -> Column:
    decay = F.try_divide(-_c(s) * normal_pdf(d1(s, k, r, sigma, t)) * _c(sigma), 2 * F.sqrt(_c(t)))
    carry, x = _c(r) * _c(k) * F.exp(-_c(r) * _c(t)), d2(s, k, r, sigma, t)
    return F.when(_c(t) == 0, 0.0).otherwise(F.when(_c(is_call), decay - carry * normal_cdf(x)).otherwise(decay + carry * normal_cdf(-x)))


def rho(s, k, r, sigma, t, is_call) -> Column:
    worth, x = _c(k) * _c(t) * F.exp(-_c(r) * _c(t)), d2(s, k, r, sigma, t)
    return F.when(_c(t) == 0, 0.0).otherwise(F.when(_c(is_call), worth * normal_cdf(x)).otherwise(-worth * normal_cdf(-x)))


def delta_fd(s, k, r, sigma, t, is_call, h: float = 1e-4) -> Column:
    return (price(_c(s) + h, k, r, sigma, t, is_call) - price(_c(s) - h, k, r, sigma, t, is_call)) / (2 * h)


def gamma_fd(s, k, r, sigma, t, h: float = 1e-3) -> Column:
    return (call_price(_c(s) + h, k, r, sigma, t) - 2 * call_price(s, k, r, sigma, t) + call_price(_c(s) - h, k, r, sigma, t)) / (h * h)


def vega_fd(s, k, r, sigma, t, h: float = 1e-4) -> Column:
    return (call_price(s, k, r, _c(sigma) + h, t) - call_price(s, k, r, _c(sigma) - h, t)) / (2 * h)


def theta_fd(s, k, r, sigma, t, is_call, h: float = 1e-4) -> Column:
    return (price(s, k, r, sigma, _c(t) - h, is_call) - price(s, k, r, sigma, t, is_call)) / h


def dividend_call(s, k, r, q, sigma, t) -> Column:
    return call_price(_c(s) * F.exp(-_c(q) * _c(t)), k, r, sigma, t)


def _np_cdf(x: np.ndarray) -> np.ndarray:
    z = x / np.sqrt(2)
    u = 1 / (1 + _T * np.abs(z))
    poly = sum(a * u ** (i + 1) for i, a in enumerate(_A))
    return 0.5 * (1 + np.sign(z) * (1 - poly * np.exp(-z * z)))


def clipped_vol(market_price, s, k, r, t, is_call, least_vega: float = 1e-6) -> Column:
    """A struct of iv and clipped: 1e-6 where the price is the call's worth without volatility, vega (at 0.2) is below least_vega, or there is no iv."""
    worth = F.greatest(_c(s) - _c(k) * F.exp(-_c(r) * _c(t)), F.lit(0.0))
    found = implied_vol(market_price, s, k, r, t, is_call)
    clipped = (F.abs(_c(market_price) - worth) < 1e-8) | (F.abs(vega(s, k, r, 0.2, t)) < least_vega) | found["status"].isNotNull()
    return F.struct(F.when(clipped, 1e-6).otherwise(found["iv"]).alias("iv"), clipped.alias("clipped"))


def counted_vol(market_price, s, k, r, t, is_call) -> Column:
    """A struct of iv and rounds: Newton steps from the price's own scale within a bracket, halved where they leave it, and how many there were."""

    @F.pandas_udf("iv double, rounds int")
    def solve(m: pd.Series, s: pd.Series, k: pd.Series, r: pd.Series, t: pd.Series, c: pd.Series) -> pd.DataFrame:
        m, s, k, r, t = (x.astype(float).to_numpy() for x in (m, s, k, r, t))
        with np.errstate(all="ignore"):
            worth, root = k * np.exp(-r * t), np.sqrt(t)
            m = np.where(c.to_numpy(bool), m, m + s - worth)
            flat = np.abs(m - np.maximum(s - worth, 0)) < 1e-10
            v = np.sqrt(2 * np.pi / t) * m / s
            v = np.where(np.isfinite(v) & (v > 1e-6) & (v < 5), v, 0.2)
            low, high, rounds = np.full(len(m), 1e-6), np.full(len(m), 5.0), np.where(flat, 1, 0)
            v, open_rows = np.where(flat, 1e-6, v), ~flat
            for _ in range(200):
                if not open_rows.any():
                    break
                rounds = rounds + open_rows
                x = (np.log(s / k) + (r + v * v / 2) * t) / (v * root)
                gap = s * _np_cdf(x) - worth * _np_cdf(x - v * root) - m
                open_rows = open_rows & ~(np.abs(gap) < 1e-10)
                high, low = np.where(open_rows & (gap > 0), v, high), np.where(open_rows & ~(gap > 0), v, low)
                slope = s * np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * root
                newton, middle = v - gap / slope, (low + high) / 2
                near = np.where((np.abs(slope) > 1e-6) & (newton > low) & (newton < high), newton, middle)
                shut = open_rows & (np.abs(high - low) < 1e-10)
                v = np.where(shut, middle, np.where(open_rows, near, v))
                open_rows = open_rows & ~shut
        return pd.DataFrame({"iv": v, "rounds": rounds.astype(np.int32)})

    return solve(_c(market_price), _c(s), _c(k), _c(r), _c(t), _c(is_call))


def implied_vol(market_price, s, k, r, t, is_call) -> Column:
    """A struct of iv and status: volatility by Newton steps kept within a bracket of 1e-6 to 5; status is null if it was found.

    A put is turned into a call by parity. Prices outside the bounds of arbitrage have no volatility.
    """

    @F.pandas_udf("iv double, status string")
    def solve(m: pd.Series, s: pd.Series, k: pd.Series, r: pd.Series, t: pd.Series, c: pd.Series) -> pd.DataFrame:
        m, s, k, r, t = (x.astype(float).to_numpy() for x in (m, s, k, r, t))
        with np.errstate(all="ignore"):
            worth = k * np.exp(-r * t)
            m = np.where(c.fillna(True).to_numpy(bool), m, m + s - worth)
            status = np.where(~((s > 0) & (k > 0) & (t > 0) & np.isfinite(m) & np.isfinite(r)), "input", np.where((m < np.maximum(s - worth, 0) - 1e-12) | (m >= s), "bounds", "")).astype(object)
            low, high = np.full(len(m), 1e-6), np.full(len(m), 5.0)
            v = np.clip(np.sqrt(2 * np.pi / t) * m / s, 0.01, 5.0)
            done = status != ""
            for _ in range(200):
                x = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
                gap = s * _np_cdf(x) - worth * _np_cdf(x - v * np.sqrt(t)) - m
                done |= np.abs(gap) < 1e-8
                if done.all():
                    break
                high, low = np.where(gap > 0, v, high), np.where(gap > 0, low, v)
                step = v - gap / np.maximum(s * np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * np.sqrt(t), 1e-300)
                v = np.where(done, v, np.where((step > low) & (step < high), step, (low + high) / 2))
            status[(~done) & (status == "") & (high - low > 1e-10)] = "not converged"
        return pd.DataFrame({"iv": np.where(status == "", v, np.nan), "status": [x or None for x in status]})

    return solve(_c(market_price), _c(s), _c(k), _c(r), _c(t), _c(is_call))
