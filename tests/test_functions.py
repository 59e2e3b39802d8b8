"""Published figures of the formulas, and their edges."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import options, rows
from tidemark.operators import portfolio

import numpy as np


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_call_and_greeks(spark):
    a = (F.lit(100.0), 100.0, 0.05, 0.2, 1.0)
    call = F.lit(True)
    r = one(spark, price=options.price(*a, call), delta=options.delta(*a, call), gamma=options.gamma(*a), vega=options.vega(*a), theta=options.theta(*a, call), rho=options.rho(*a, call))
    assert [round(x, 6) for x in r[1:]] == [0.636831, 0.018762, 37.524035, -6.414028, 53.232483]
    assert abs(r.price - 10.4506) < 1e-4


def test_finite_differences_agree(spark):
    a = (F.lit(100.0), 110.0, 0.05, 0.2, 0.5)
    r = one(spark, a=options.delta(*a, F.lit(False)) - options.delta_fd(*a, F.lit(False)), b=options.gamma(*a) - options.gamma_fd(*a), c=options.vega(*a) - options.vega_fd(*a), d=options.theta(*a, F.lit(True)) - options.theta_fd(*a, F.lit(True)))
    assert abs(r.a) < 1e-3 and abs(r.b) < 0.05 and abs(r.c) < 1e-2 and abs(r.d) < 1e-2


def test_option_at_expiry_and_without_volatility(spark):
    r = one(spark, now=options.price(F.lit(90.0), 100.0, 0.05, 0.2, F.lit(0.0), F.lit(False)), none=options.price(F.lit(90.0), 100.0, 0.05, F.lit(0.0), F.lit(1.0), F.lit(True)), d=options.delta(F.lit(90.0), 100.0, 0.05, 0.2, F.lit(0.0), F.lit(False)))
    assert r.now == 10.0 and r.none is None and r.d == -1.0


@pytest.mark.parametrize(("price", "status"), [(10.450575, None), (200.0, "bounds"), (1e-9, "bounds")])
def test_implied_vol(spark, price, status):
    r = one(spark, x=options.implied_vol(F.lit(price), F.lit(100.0), F.lit(100.0), F.lit(0.05), F.lit(1.0), F.lit(True))).x
    assert r.status == status
    assert status or abs(r.iv - 0.2) < 1e-5


def test_credit_and_ratios(spark):
    r = one(spark, a=rows.debt_to_income(F.lit(0.0), F.lit(5.0)), b=rows.grade_to_score(F.lit(9)), c=rows.one_hot(F.lit("OWN")), d=rows.linear_score(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), [1.0, 1.0], 0.5), e=rows.calmar_ratio(F.lit(0.1), F.lit(0.0)), f=rows.kelly_fraction(F.lit(0.6), F.lit(1.0)), g=rows.sqrt_impact(F.lit(0.02), F.lit(2000.0), F.lit(1e6)))
    assert r.a == 0.0 and r.b == 1.0 and r.c == [0.0, 1.0, 0.0] and r.d == 3.5 and math.isinf(r.e)
    assert abs(r.f - 0.2) < 1e-12 and abs(r.g * 1e4 - 8.944) < 1e-3


def test_probabilistic_sharpe_edges(spark):
    r = one(spark, a=rows.probabilistic_sharpe(F.lit(0.5), F.lit(0), F.lit(0.0), F.lit(0.0)), b=rows.probabilistic_sharpe(F.lit(0.5), F.lit(1), F.lit(0.0), F.lit(0.0)), c=rows.deflated_sharpe(F.lit(0.5), F.lit(10), F.lit(0.0), F.lit(0.0), 0, 1.0))
    assert (r.a, r.b, r.c) == (0.0, 1.0, 0.0)


def test_portfolios():
    mean, cov = np.array([0.10, 0.05]), np.diag([0.04, 0.09])
    assert abs(portfolio.min_variance(cov)[0] - 0.6923) < 1e-4
    w = portfolio.tangency(mean, cov, 0.02)
    d = portfolio.describe(w, mean, cov, 0.02)
    assert abs(w[0] - 0.8571) < 1e-4 and abs(d["mean"] - 0.092857) < 1e-6 and abs(d["volatility"] - 0.176705) < 1e-6 and abs(d["sharpe"] - 0.412311) < 1e-6
    assert np.allclose(portfolio.frontier_point(mean, cov, 0.05), [0.0, 1.0])
    with pytest.raises(ValueError):
        portfolio.min_variance(np.zeros((2, 2)))
    assert np.allclose(portfolio.simplex(np.array([2.0, 0.0])), [1.0, 0.0])
