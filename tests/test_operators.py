"""Small series with known answers, and plain loops to hold the window forms against."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, labels, microstructure, models, returns, scoring, simulation, stats
from tidemark.sources import files
from tidemark.streaming import stateful


def px(spark, *series):
    return spark.createDataFrame([(f"k{k}", i, float(p)) for k, s in enumerate(series) for i, p in enumerate(s)], "key string, idx long, price double")


def values(df, column, key="k0"):
    return [r[0] for r in df.where(F.col("key") == key).orderBy("idx").select(column).collect()]


def test_returns_and_zero_prices(spark):
    d = px(spark, [100, 102, 0, 105], [1])
    assert [round(x, 9) for x in values(returns.simple_returns(d), "r")] == [0.02, -1.0, 0.0]
    assert values(returns.log_returns(d), "r")[1:] == [0.0, 0.0]
    assert values(returns.simple_returns(d), "r", "k1") == []


def test_drawdown_stats(spark):
    r = returns.drawdown_stats(px(spark, [100, 95, 90, 95, 100], [1, 2, 3])).orderBy("key").collect()
    assert (round(r[0].max_drawdown, 9), r[0].duration, r[0].recovery) == (-0.1, 3, 2)
    assert (r[1].max_drawdown, r[1].duration, r[1].recovery) == (0.0, 0, None)


def test_rolling_edges(spark):
    d = px(spark, [1, 2, 3, 4])
    assert values(returns.sma(d, 2), "sma") == [1.5, 2.5, 3.5]
    assert values(returns.sma(d, 9), "sma") == []
    assert values(returns.rolling_volatility(d, 1, "price"), "volatility") == [0.0] * 4
    with pytest.raises(ValueError):
        returns.rolling_std(d, 1, "price")
    assert values(returns.ema(d, 3), "ema") == [1.0, 1.5, 2.25, 3.125]


def test_acf_of_a_constant(spark):
    assert [r.rho for r in returns.acf(px(spark, [2, 2, 2]), 2).orderBy("lag").collect()] == [1.0, 0.0, 0.0]


def test_fractional_difference_of_order_one(spark):
    assert returns.ffd_weights(1.0, 1e-4) == [1.0, -1.0]
    assert values(returns.frac_diff(px(spark, [1, 3, 6]), 1.0), "fd") == [2.0, 3.0]


def test_var_and_cvar(spark):
    d = px(spark, [(i - 4.5) * 0.01 for i in range(10)])
    r = stats.cvar(d, ["key"], "price").first()
    assert abs(r["var"] - 0.0405) < 1e-9 and abs(r.cvar - 0.0450) < 1e-9


def test_confusion_and_published_scores(spark):
    d = spark.createDataFrame([(312, 1847, 282468, 180)], "tp long, fp long, tn long, fn long")
    r = stats.precision_recall(d).first()
    assert [round(x, 4) for x in (r.precision, r.recall, r.f1)] == [0.1445, 0.6341, 0.2354]


def test_auc_by_parts(spark):
    random.seed(3)
    rows = [(i, random.random(), random.random() < 0.4) for i in range(400)]
    d = spark.createDataFrame(rows, "row_id long, score double, label boolean")
    pairs = [(a[1] > b[1]) for a in rows if a[2] for b in rows if not b[2]]
    assert abs(scoring.auc(d).first().auc - sum(pairs) / len(pairs)) < 1e-9
    assert scoring.auc(d.where("label")).first().auc == 0.5
    assert scoring.roc_curve(d).count() == 401


def test_zscores_with_a_constant_feature(spark):
    d = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([30.0, 5.0],)], "features array<double>")
    got = scoring.zscore_predict(d, scoring.zscore_fit(d), 1.0).collect()
    assert [r.anomaly for r in got] == [False, False, True] and got[2].triggers == [0]
    assert scoring.zscore_predict(d, scoring.zscore_fit(d, size=2), 1.0, size=2).collect() == got


def engine(prices, signals, cost, cash=10_000.0):
    shares, out = 0.0, []
    for p, s in zip(prices, signals, strict=True):
        if s == 1 and not shares:
            shares, cash = cash * (1 - cost) / p, 0.0
        elif s == -1 and shares:
            cash, shares = shares * p * (1 - cost), 0.0
        out.append(cash + shares * p)
    return out


def test_backtest_equals_a_loop(spark):
    random.seed(5)
    p, s = [100 + random.random() * 10 for _ in range(200)], [random.choice([0, 0, 0, 1, -1]) for _ in range(200)]
    d = spark.createDataFrame([("k0", i, a, b) for i, (a, b) in enumerate(zip(p, s, strict=True))], "key string, idx long, close double, signal int")
    assert np.allclose(values(backtest.run(d), "equity"), engine(p, s, 0.001))


def barrier_loop(p, up, low, t):
    for i in range(len(p)):
        last = min(i + t, len(p) - 1)
        hit = next((j for j in range(i + 1, last + 1) if p[j] / p[i] - 1 >= up or p[j] / p[i] - 1 <= low), None)
        yield i, (hit if hit is not None else last), ("Time" if hit is None else "Upper" if p[hit] / p[i] - 1 >= up else "Lower")


def test_triple_barrier_equals_a_loop(spark):
    random.seed(7)
    p = list(np.exp(np.cumsum([random.gauss(0, 0.02) for _ in range(300)])) * 100)
    got = labels.triple_barrier(px(spark, p), labels.TripleBarrier(0.03, -0.02, 9)).orderBy("entry").collect()
    assert [(r.entry, r.exit, r.label) for r in got] == list(barrier_loop(p, 0.03, -0.02, 9))
    with pytest.raises(ValueError):
        labels.TripleBarrier(0.0, -0.1, 3)


def test_fixed_horizon_without_threshold_never_says_time(spark):
    got = labels.fixed_horizon(px(spark, [1, 2, 1, 1]), 1).orderBy("entry").collect()
    assert [r.label for r in got] == ["Upper", "Lower", "Upper", "Upper"]


@pytest.mark.parametrize("columns", [40, 0])
def test_trend_scanning_equals_fits(spark, monkeypatch, columns):
    monkeypatch.setattr(labels, "MOST_COLUMNS", columns)
    random.seed(11)
    p = [100 + random.gauss(0, 1) + 0.2 * i for i in range(40)]
    got = {r.entry: r for r in labels.trend_scanning(px(spark, p), 3, 6).collect()}
    for i in (0, 10, 30):
        best = (0.0, None)
        for h in range(3, 7):
            y = np.array(p[i : i + h + 1])
            x = np.arange(len(y))
            b, a = np.polyfit(x, y, 1)
            e = y - a - b * x
            t = b / math.sqrt((e @ e) / (len(y) - 2) / ((x - x.mean()) ** 2).sum())
            if abs(t) > abs(best[0]):
                best = (t, i + h)
        assert got[i].exit == best[1] and abs(got[i].t_stat - best[0]) < 1e-6
    flat = labels.trend_scanning(px(spark, [1, 2, 3, 4, 5, 6, 7, 8]), 3, 5, entry=F.col("idx") == 0).first()
    assert flat.t_stat == 0.0 and flat.exit == 3
    ends = {r.entry: (r.exit, r.t_stat) for r in labels.trend_scanning(px(spark, [5, 1, 2, 4]), 3, 5).collect()}
    assert ends[3] == (3, 0.0) and ends[2] == (3, 0.0) and ends[1][0] == 3 and ends[0][0] == 3


def test_purged_folds(spark):
    e = spark.createDataFrame([("k0", i * 5, i * 5 + 4) for i in range(20)], "key string, entry long, exit long")
    roles = labels.purged_kfold(e, 100, 4, 5).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in roles} == {"test": 20, "embargoed": 3, "train": 57}


def test_uniqueness(spark):
    e = spark.createDataFrame([("k0", 0, 5), ("k0", 3, 8), ("k0", 7, 10)], "key string, entry long, exit long")
    bars = spark.createDataFrame([("k0", i) for i in range(12)], "key string, idx long")
    n = [r.n for r in labels.concurrent_events(e, bars).orderBy("idx").collect()]
    assert n == [1, 1, 1, 2, 2, 2, 1, 2, 2, 1, 1, 0]
    got = labels.uniqueness(e, bars).orderBy("entry").collect()
    assert [round(r.uniqueness, 9) for r in got] == [0.75, round(3.5 / 6, 9), 0.75] and abs(sum(r.weight for r in got) - 1) < 1e-12


def test_walk_forward(spark):
    assert labels.walk_forward(spark, 50, 20, 10, 10).count() == 3
    assert labels.walk_forward(spark, 10, 20, 10, 10).count() == 0


def test_ols_and_its_errors(spark):
    d = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", 3.0, 7.0), ("b", 1.0, 1.0), ("c", 2.0, 1.0), ("c", 2.0, 2.0), ("c", 2.0, 3.0)], "key string, x double, y double")
    got = {r.key: r for r in models.ols(d, "y", ["x"]).collect()}
    assert np.allclose(got["a"].coefficients, [1.0, 2.0]) and abs(got["a"].r_squared - 1) < 1e-9
    assert got["b"].status == "too few rows" and got["c"].status == "singular"


def test_adf_tells_noise_from_a_walk(spark):
    rng = np.random.default_rng(1)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    got = {r.key: r for r in models.adf(px(spark, noise, walk)).collect()}
    assert got["k0"].stationary and not got["k1"].stationary
    assert abs(got["k1"].statistic - models._np_adf(walk)) < 1e-6


def test_cusum_resets(spark):
    got = models.cusum(px(spark, [0] * 5 + [1] * 6), 2.5).collect()
    assert [(r.idx, r.direction) for r in got] == [(7, "up"), (10, "up")]


def test_garch_recovers(spark):
    rng = np.random.default_rng(4)
    v, r = 0.02, []
    for _ in range(1500):
        r.append(rng.normal() * v**0.5)
        v = 0.01 + 0.08 * r[-1] ** 2 + 0.90 * v
    got = models.garch(px(spark, r, [1.0, 2.0]), r="price").orderBy("key").collect()
    assert 0.9 < got[0].persistence < 1 and got[1].status == "too few rows"


def test_jump_ahead_and_published_moments(spark):
    x, step = simulation.state_after(7, 0), []
    for _ in range(1000):
        x = simulation._step(x)
    assert x == simulation.state_after(7, 1000)
    z = simulation.normals(np.array([7], np.uint64), 10_000)[0]
    m = z - z.mean()
    assert round((m**3).mean() / (m**2).mean() ** 1.5, 4) == 0.0267 and round((m**4).mean() / (m**2).mean() ** 2 - 3, 4) == 0.0323
    assert step == []


def test_monte_carlo_is_near_the_formula(spark):
    r = simulation.mc_price(spark, 100.0, 100.0, 0.05, 0.2, 1.0, 20_000, 7, antithetic=True).first()
    assert abs(r.price - 10.4506) < 4 * r.std_error and r.n == 40_000
    assert simulation.gbm_paths(spark, 100.0, 0.0, 0.2, 1.0, 0, 3, 1).count() == 3
    with pytest.raises(ValueError):
        simulation.mc_price(spark, -1.0, 100.0, 0.05, 0.2, 1.0, 10, 7)


def test_order_book(spark):
    b = microstructure.Book()
    assert b.add(1, "ask", 101, 30) == "" and b.add(2, "ask", 102, 50) == "" and b.add(1, "ask", 103, 1) == "duplicate" and b.add(3, "bid", 99, 0) == "quantity"
    assert b.market("bid", 75) == [(101, 30, 1), (102, 45, 2)] and b.best("ask") == (102, 5)
    assert b.cancel(2) == 5 and b.cancel(2) is None and b.best("ask") is None
    rows = [("k", 1, "add", 1, "ask", 101, 30), ("k", 2, "add", 2, "ask", 102, 50), ("k", 3, "market", 9, "bid", 0, 75), ("k", 4, "cancel", 7, "ask", 0, 0)]
    got = microstructure.replay(spark.createDataFrame(rows, "key string, seq long, cmd string, id long, side string, price long, quantity long")).orderBy("seq").collect()
    assert (got[2].filled, got[2].notional, got[2].ask_quantity) == (75, 30 * 101 + 45 * 102, 5) and got[3].status == "not found"


def test_order_flow(spark):
    d = spark.createDataFrame([("k", i, b, a) for i, (b, a) in enumerate([(10, 10), (25, 10), (25, None)])], "key string, idx long, bid_quantity long, ask_quantity long")
    assert [r.ofi for r in microstructure.order_flow_imbalance(d).orderBy("idx").collect()] == [15, 10]


def test_loaders(spark, tmp_path):
    p = tmp_path / "bars.csv"
    p.write_text("date,open,high,low,close,volume,adj_close\n2024-01-02,10,12,9,11,100,\n2024-01-03,10,9,8,11,100,11\n")
    assert [r.valid for r in files.ohlcv(spark, str(p), strict=False).collect()] == [True, False]
    with pytest.raises(Exception):
        files.ohlcv(spark, str(p)).collect()
    q = tmp_path / "loans.csv"
    q.write_text("income,loan_amount,interest_rate,dti,grade,home_ownership,defaulted\n1,2,3,4,5,RENT,true\n1,2,x,4,5,RENT,true\n1,2,3,4,5,TENT,true\n")
    assert files.loans(spark, str(q)).count() == 1
    t = tmp_path / "tx.csv"
    t.write_text("Time,V1,V2,Amount,Class\n0,1.5,2.5,9.0,1\n")
    r = files.transactions(spark, str(t), 2).first()
    assert (list(r.features), r.amount, r["class"]) == ([1.5, 2.5], 9.0, 1)
    assert files.series_status(px(spark, [1, -1], [1, 2])).orderBy("key").collect()[0].status == "1 bad prices"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"2024-01-0{1 + i // 2} 0{i}:00:00", float(v)) for i, v in enumerate([100, 102, 99, 105])], "key string, t string, value double")
    rows.select("key", F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    for name, df in {"dd": stateful.running_drawdown(stream), "ew": stateful.ewma_variance(stream), "cu": stateful.cusum_alarms(stream, 150.0)}.items():
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [round(r.drawdown, 6) for r in spark.table("dd").orderBy("ts").collect()] == [0.0, 0.0, round(-3 / 102, 6), 0.0]
    assert spark.table("ew").orderBy("ts").first().variance == 10_000.0
    assert spark.table("cu").count() == 2
