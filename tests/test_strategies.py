"""Composed strategies, simulations and model checks that SQL can't express, against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels, models, simulation, stats, strategies
from tidemark.functions import options


def keyed(spark, values, name="price", key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], f"key string, idx long, {name} double")


@pytest.fixture(scope="module")
def walk():
    return 100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 300)))


def test_composed_needs_its_parts(spark):
    with pytest.raises(ValueError, match="labeler"):
        strategies.Composed().run(keyed(spark, [1.0]))
    with pytest.raises(ValueError, match="sizer"):
        strategies.Composed().with_labeler(labels.fixed_horizon).with_splitter(labels.walk_forward).run(keyed(spark, [1.0]))
    with pytest.raises(ValueError, match="position"):
        strategies.equal_sizer(0)


def test_composed_against_a_loop(spark, walk):
    r = np.r_[0.0, np.diff(walk) / walk[:-1]]
    df = spark.createDataFrame([("a", i, float(p), float(x)) for i, (p, x) in enumerate(zip(walk, r, strict=True))], "key string, idx long, price double, r double")
    splits = [(0, 0, 120, 60, 180), (1, 100, 250, 90, 240)]
    parts = strategies.Composed(lambda d, e: labels.fixed_horizon(d, 5, 0.005, e), lambda s, n: s.createDataFrame(splits, "split int, train_start long, train_end long, test_start long, test_end long"), strategies.kelly_sizer(), 3)
    got = {x["split"]: x for x in parts.run(df).collect()}
    for split, a, b, c, d in splits:
        t = r[a:b]
        p, ratio = (t > 0).mean(), t[t > 0].mean() / -t[t < 0].mean()
        size = min(max(0.5 * (p - (1 - p) / ratio), 0), 1)
        equity = [1.0]
        for i in range(c, d):
            if i in range(a, b, 3):
                x = walk[min(i + 5, 299)] / walk[i] - 1
                side = 1 if x >= 0.005 else -1 if x < -0.005 else 0
                if side:
                    equity.append(equity[-1] * (1 + size * side * r[i]))
        e = np.array(equity)
        peak = np.maximum.accumulate(e)
        assert got[split]["n_trades"] == len(e) - 1 > 5
        assert got[split]["total_return"] == pytest.approx(e[-1] - 1)
        assert got[split]["max_drawdown"] == pytest.approx(((peak - e) / peak).max())
        g = e[1:] / e[:-1] - 1
        assert got[split]["sharpe"] == pytest.approx(g.mean() / g.std() if g.std() > 1e-10 else 0.0)


def test_composed_on_an_empty_table(spark):
    parts = strategies.Composed(lambda d, e: labels.fixed_horizon(d, 5, 0.0, e), lambda s, n: labels.walk_forward(s, n, 5, 5, 5), strategies.fixed_sizer(2.0))
    assert parts.run(spark.createDataFrame([], "key string, idx long, price double, r double")).count() == 0


def test_pairs_against_a_loop(spark):
    g = np.random.default_rng(5)
    b = 50 + np.cumsum(g.normal(0, 1, 400))
    noise = np.zeros(400)
    for i in range(1, 400):
        noise[i] = 0.8 * noise[i - 1] + g.normal()
    a = 10 + 2 * b + noise
    df = spark.createDataFrame([("p", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "key string, idx long, a double, b double")
    beta, alpha = np.polyfit(b, a, 1)
    res = pd.Series(a - alpha - beta * b)
    z = ((res - res.rolling(60).mean()) / res.rolling(60).std()).to_numpy()[59:]
    position, positions, pnl, opened, runs = 0, [], [], None, []
    for t, zt in enumerate(z):
        i = t + 59
        move = (a[i + 1] - a[i] - beta * (b[i + 1] - b[i])) if i < 399 else 0.0
        if t:
            pnl.append(position * move)
        new = (-1 if zt > 2 else 1 if zt < -2 else 0) if position == 0 else 0 if abs(zt) < 0.5 else position
        if position and not new:
            runs.append(sum(pnl) - opened)
        if new and not position:
            opened = sum(pnl)
        position = new
        positions.append(position)
    if position:
        runs.append(sum(pnl) - opened)
    traded = strategies.pairs(df)
    assert [x["position"] for x in traded.orderBy("idx").collect()] == positions
    got = strategies.pairs_summary(traded).first()
    assert got["n_trades"] == len(runs) > 2
    assert got["hit_rate"] == pytest.approx(np.mean([x > 0 for x in runs]))
    assert got["total_pnl"] == pytest.approx(sum(pnl))
    assert got["sharpe"] == pytest.approx(np.mean(pnl) / np.std(pnl, ddof=1) * math.sqrt(252))


def test_meta_labels_against_a_loop(spark, walk):
    got = strategies.meta_labels(keyed(spark, walk), labels.TripleBarrier(0.01, -0.01, 10)).orderBy("idx").collect()
    entries = [t for t in range(20, 280) if walk[t - 5 : t].mean() > walk[t - 20 : t].mean()]
    assert [x["idx"] for x in got] == entries
    lr = np.diff(np.log(walk))
    x = np.array([[walk[t] - walk[t - 10], lr[t - 20 : t].std(), 1.0] for t in entries])
    w, b, y = np.zeros(3), 0.0, np.array([r["label"] for r in got])
    for _ in range(200):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.5 * x.T @ e / len(x), b - 0.5 * e.mean()
    assert np.allclose([r["probability"] for r in got], 1 / (1 + np.exp(-(x @ w + b))))
    for r in got[:40]:
        path = walk[r["idx"] + 1 : r["idx"] + 11] / walk[r["idx"]] - 1
        hit = next((v for v in path if abs(v) >= 0.01), path[-1])
        assert r["label"] == int(hit >= 0)


def test_delta_hedge_ends_near_nothing(spark):
    d = simulation.gbm_paths(spark, 100.0, 0.05, 0.2, 0.25, 252, 20, 3).select(F.col("path_id").cast("string").alias("key"), F.col("step").alias("idx"), F.col("value").alias("price"))
    got = strategies.delta_hedge(d, 100.0, 0.0, 0.2, days=252 * 4).toPandas().sort_values(["key", "idx"])
    assert np.allclose(got.groupby("key")["pnl"].first(), 0)
    assert got.groupby("key")["pnl"].last().abs().max() < 2
    assert set(got.groupby("key")["delta"].last()) <= {0.0, 1.0}


def test_smile_and_rolling_beta(spark):
    rows = [("a", k, 0.2 + 0.1 * math.log(k / 100) + 0.5 * math.log(k / 100) ** 2) for k in (70.0, 85.0, 100.0, 120.0, 130.0)]
    fit = strategies.smile(spark.createDataFrame(rows, "key string, k double, iv double"), 100.0).first()
    assert fit["coefficients"] == pytest.approx([0.2, 0.1, 0.5])
    d = spark.createDataFrame([("a", i, 1.5 * (i % 3), float(i % 3)) for i in range(10)], "key string, idx long, r double, m double")
    got = strategies.rolling_beta(d, 4).orderBy("idx").collect()
    assert [x["idx"] for x in got] == list(range(3, 9)) and all(x["beta"] == pytest.approx(1.5) for x in got)


def test_local_vol_with_a_constant_is_black_scholes(spark):
    flat = strategies.local_vol_call(100.0, 100.0, 0.05, 1.0, lambda s: 0.2 + 0 * s, 20.0, 250.0, 230)
    want = spark.range(1).select(options.call_price(F.lit(100.0), F.lit(100.0), 0.05, 0.2, F.lit(1.0))).first()[0]
    assert flat == pytest.approx(want, abs=0.02)
    assert strategies.local_vol_call(100.0, 100.0, 0.05, 1.0, lambda s: np.minimum(0.2 + 0.0005 * (s - 100) ** 2, 1.0), 20.0, 250.0) > flat
    with pytest.raises(ValueError):
        strategies.local_vol_call(100.0, 100.0, 0.05, 1.0, np.sqrt, 120.0, 250.0)


def test_heston_without_variance_of_variance_is_black_scholes(spark):
    got = simulation.heston_calls(spark, 100.0, 0.05, 0.04, 1.0, 0.04, 0.0, 0.0, 1.0, [90.0, 100.0, 110.0], 4, 20_000, 5).orderBy("strike").collect()
    for x in got:
        want = spark.range(1).select(options.call_price(F.lit(100.0), F.lit(x["strike"]), 0.05, 0.2, F.lit(1.0))).first()[0]
        assert abs(x["price"] - want) < 4 * x["std_error"] and x["n"] == 20_000
    with pytest.raises(ValueError):
        simulation.heston_calls(spark, 100.0, 0.05, 0.04, 1.0, 0.04, 0.3, 1.5, 1.0, [100.0], 4, 10, 5)


def test_control_variate_narrows(spark):
    plain, controlled = simulation.mc_price(spark, 100.0, 100.0, 0.05, 0.2, 1.0, 5000, 7).first(), simulation.mc_call_control(spark, 100.0, 100.0, 0.05, 0.2, 1.0, 5000, 7).first()
    assert controlled["std_error"] < plain["std_error"] / 2
    assert controlled["price"] == pytest.approx(10.4506, abs=4 * controlled["std_error"])
    values = np.array([x["value"] for x in simulation.terminal(spark, 100.0, 0.05, 0.2, 1.0, 5000, 7).collect()])
    pay, keep = np.maximum(values - 100, 0), math.exp(-0.05)
    beta = np.cov(pay, values, ddof=0)[0, 1] / values.var()
    rest = pay - beta * (values - 100 * math.exp(0.05))
    assert controlled["price"] == pytest.approx(keep * rest.mean()) and controlled["std_error"] == pytest.approx(keep * rest.std() / math.sqrt(5000))


def test_pacf_solves_yule_walker(spark, walk):
    got = {x["lag"]: x["phi"] for x in models.pacf(keyed(spark, walk), 4).collect()}
    d = walk - walk.mean()
    rho = np.array([1.0, *[(d[k:] * d[:-k]).sum() / (d * d).sum() for k in range(1, 5)]])
    for k in range(1, 5):
        toeplitz = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k] == pytest.approx(np.linalg.solve(toeplitz, rho[1 : k + 1])[-1])


def test_adf_by_aic_takes_the_least(spark, walk):
    got = models.adf_by_aic(keyed(spark, walk), 4).first()
    dy, best = np.diff(walk), None
    for k in range(5):
        x = np.array([[1.0, walk[t - 1], *[dy[t - 1 - i] for i in range(1, k + 1)]] for t in range(k + 1, 300)])
        y = dy[k:]
        sse = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).mean()
        aic = 300 * math.log(sse) + 2 * (k + 2)
        best = min(best or (aic, k), (aic, k))
    assert got["lags"] == best[1] and got["aic"] == pytest.approx(best[0], rel=1e-6)


def test_likelihoods(spark):
    d = keyed(spark, [0.5, -1.0, 2.0], "x")
    got = d.agg(stats.gaussian_likelihood("x").alias("g"), stats.student_likelihood("x", 1.0).alias("t")).first()
    assert got["g"] == pytest.approx(sum(-0.5 * math.log(2 * math.pi) - x * x / 2 for x in (0.5, -1.0, 2.0)))
    assert got["t"] == pytest.approx(sum(-math.log(math.pi * (1 + x * x)) for x in (0.5, -1.0, 2.0)))
    with pytest.raises(ValueError):
        stats.student_likelihood("x", 0.0)
