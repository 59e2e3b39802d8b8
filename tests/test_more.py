"""Queries without SQL, and operators with edges, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import options, rows
from tidemark.operators import interfaces, joins, labels, models, optimize, portfolio, returns, scoring, simulation, stats, strategies
from tidemark.plans import series
from tidemark.streaming import stateful

DATA = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def run(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


def keyed(spark, values, name="price", key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], f"key string, idx long, {name} double")


def panel_returns(spark):
    out = {}
    for r in series.panel(spark, DATA).orderBy("idx").collect():
        out.setdefault(r.asset, []).append(r.r)
    return {k: np.array(v) for k, v in out.items()}


# --- queries without SQL --------------------------------------------------------------------------------------------


def test_book_replay_equals_plain_lists(spark):
    got, want = {}, {}
    for r in run(spark, "book_replay"):
        got.setdefault(r.key, []).append(r)
    orders = sorted(spark.read.parquet(f"{DATA}/lineitem.parquet").collect(), key=lambda r: (r.l_suppkey, r.l_orderkey * 10 + r.l_linenumber, "bid" if r.l_returnflag == "A" else "ask", r.l_extendedprice // 1000, r.l_quantity))
    books = {}
    for r in orders:
        key, seq, price, quantity = str(r.l_suppkey), r.l_orderkey * 10 + r.l_linenumber, int(r.l_extendedprice // 1000), int(r.l_quantity)
        side, book = "bid" if r.l_returnflag == "A" else "ask", books.setdefault(str(r.l_suppkey), [])
        status, filled, paid = "", 0, 0
        if seq % 10 == 7:
            other = sorted((o for o in book if o[1] != side), key=lambda o: (o[2] if side == "bid" else -o[2]))
            for o in other:
                took = min(o[3], quantity - filled)
                filled, paid, o[3] = filled + took, paid + took * o[2], o[3] - took
            book[:] = [o for o in book if o[3]]
        elif seq % 10 == 6:
            status = "" if any(o[0] == seq - 1 for o in book) else "not found"
            book[:] = [o for o in book if o[0] != seq - 1]
        elif quantity <= 0 or any(o[0] == seq for o in book):
            status = "quantity" if quantity <= 0 else "duplicate"
        else:
            book.append([seq, side, price, quantity])
        bids, asks = ([o for o in book if o[1] == s] for s in ("bid", "ask"))
        bid, ask = max((o[2] for o in bids), default=None), min((o[2] for o in asks), default=None)
        want.setdefault(key, []).append((seq, status, filled, paid, bid, sum(o[3] for o in bids if o[2] == bid) if bids else None, ask, sum(o[3] for o in asks if o[2] == ask) if asks else None, len(book)))
    order = lambda rows_: sorted(rows_, key=str)
    assert {k: order(tuple(r)[1:] for r in v) for k, v in got.items()} == {k: order(v) for k, v in want.items()}


def test_volatility_fits_can_t_be_bettered_nearby(spark):
    r = panel_returns(spark)
    for x in run(spark, "garch_fit"):
        assert x.status is None and 0 <= x.persistence < 1 and math.isfinite(x.log_likelihood)
    for x in run(spark, "arch_fit"):
        a = np.array(x.alpha)
        assert x.status is None and (a >= 0).all() and a.sum() < 1 and x.long_run_variance == pytest.approx(x.omega / (1 - a.sum()))

        def plain(omega, alpha, series=r[x.key]):
            out = 0.0
            for t, v in enumerate(series):
                s = max(omega + sum(b * series[t - 1 - i] ** 2 for i, b in enumerate(alpha) if t > i), 1e-300)
                out -= 0.5 * (math.log(2 * math.pi) + math.log(s) + v * v / s)
            return out

        top = plain(x.omega, a)
        assert x.log_likelihood == pytest.approx(top)
        # A fit whose alphas run to a sum of 1 doesn't converge.
        assert all(plain(x.omega * f, a) <= top + 1e-7 for f in (0.99, 1.01)) and (a.sum() > 0.999 if not x.converged else all(plain(x.omega, a * f) <= top + 1e-6 for f in (0.99, 1.01)))
        last, ahead = r[x.key][::-1][:2] ** 2, []
        for _ in range(5):
            ahead.append(x.omega + a[0] * last[1] + a[1] * last[0])
            last = np.array([last[1], ahead[-1]])
        assert x.forecast_from == pytest.approx(ahead)


def test_arch_forecasts_stay_at_the_long_run():
    assert models.arch_ahead(0.1, np.array([0.3, 0.2]), 3) == pytest.approx([0.2] * 3)
    assert models.arch_ahead(0.1, np.array([0.7, 0.5]), 1) == [math.inf]


def test_garch_beats_a_constant_variance(spark):
    rng = np.random.default_rng(42)
    v, r = 0.1, []
    for _ in range(1000):
        r.append(rng.normal() * v**0.5)
        v = 0.01 + 0.10 * r[-1] ** 2 + 0.85 * v
    got = models.garch(keyed(spark, r, "r"), horizon=200).first()
    flat = float(-0.5 * (np.log(2 * np.pi * np.var(r, ddof=1)) + np.array(r[1:]) ** 2 / np.var(r, ddof=1)).sum())
    assert got.log_likelihood > flat and 0 < got.long_run_variance < math.inf
    assert got.forecast[-1] == pytest.approx(got.long_run_variance, rel=0.1)


def test_least_order_by_trying_all(spark):
    for r in run(spark, "min_frac_diff"):
        x = np.array([b.close for b in series.bars(spark, DATA).where(F.col("key") == r.key).orderBy("idx").collect()])

        def stationary(d, x=x):
            w = np.array(returns.ffd_weights(d, 1e-3))
            return len(x) >= len(w) + 3 and models._np_adf(np.convolve(x, w, "valid")) < -2.86

        if r.d is None:
            assert not stationary(0.0) and not stationary(1.0)
        else:
            assert stationary(r.d) and (r.d == 0 or not stationary(max(0.0, r.d - 0.011)))


class Plain:
    """The generator, one number after another."""

    def __init__(self, seed):
        self.x = seed & MASK or simulation.ZERO_SEED

    def u(self):
        a, b, c = simulation.SHIFTS
        self.x ^= self.x >> a
        self.x ^= self.x << b & MASK
        self.x ^= self.x >> c
        return ((self.x * simulation.MULTIPLIER & MASK) >> 11) / (1 << 53)

    def z(self):
        a, b = self.u(), self.u()
        return math.sqrt(-2 * math.log(max(a, 2.220446049250313e-16))) * math.cos(2 * math.pi * b)


def test_random_jumps_equal_a_loop(spark):
    got = {(r.path_id, r.step): r.value for r in run(spark, "random_jump_paths")}
    for i in range(30):
        g, s = Plain(9 + 0x9E3779B97F4A7C15 * (i + 1)), 100.0
        for k in range(13):
            if k:
                s *= math.exp(0.03 / 12 + 0.2 * math.sqrt(1 / 12) * g.z())
                u, mean, n = g.u(), 5.0 / 12, 0
                while u > sum(math.exp(-mean) * mean**j / math.factorial(j) for j in range(n + 1)):
                    n += 1
                for _ in range(n):
                    s *= math.exp(0.1 * g.z())
            assert got[i, k] == pytest.approx(s, abs=1e-5)


def test_heston_equals_a_loop(spark):
    got = {r.strike: r for r in simulation.heston_calls(spark, 100.0, 0.05, 0.04, 2.0, 0.04, 0.3, -0.7, 1.0, [90.0, 110.0], 5, 40, 11).collect()}
    g, ends = Plain(11), []
    for _ in range(40):
        x, v = 0.0, 0.04
        for _ in range(5):
            a, e = g.z(), g.z()
            v = max(v + 2.0 * (0.04 - v) * 0.2 + 0.3 * math.sqrt(v * 0.2) * a, 0.0)
            x += (0.05 - v / 2) * 0.2 + math.sqrt(v * 0.2) * (-0.7 * a + math.sqrt(1 - 0.49) * e)
        ends.append(100 * math.exp(x))
    for k, r in got.items():
        pay = np.maximum(np.array(ends) - k, 0) * math.exp(-0.05)
        assert (r.price, r.std_error, r.n) == (pytest.approx(pay.mean()), pytest.approx(pay.std(ddof=1) / math.sqrt(40)), 40)


def test_portfolios_without_sql(spark):
    r = panel_returns(spark)
    names = sorted(r)
    x = np.stack([r[a] for a in names])
    mean, cov = x.mean(1), np.cov(x)
    w = np.array([{q.asset: q.weight for q in run(spark, "long_only_weights")}[a] for a in names])
    value = lambda w: w @ mean - 0.5 * w @ cov @ w
    assert w.sum() == pytest.approx(1, abs=1e-5) and (w >= -1e-9).all()
    for i in range(5):
        for j in range(5):
            if w[i] > 0.01:
                v = w.copy()
                v[i], v[j] = v[i] - 0.01, v[j] + 0.01
                assert value(v) <= value(w) + 1e-6
    got = np.array([{q.asset: q.mean for q in run(spark, "posterior_means")}[a] for a in names])
    prior, p = cov @ np.full(5, 0.2), np.eye(1, 5)
    gain = 0.05 * cov @ p.T @ np.linalg.inv(p @ (0.05 * cov) @ p.T + 1e-4)
    assert got == pytest.approx(prior + gain @ (np.array([0.02]) - p @ prior), abs=1e-8)


def test_local_volatility_query(spark):
    got = run(spark, "local_volatility_calls")
    for r in got:
        exact = spark.range(1).select(options.call_price(F.lit(100.0), F.lit(r.strike), 0.05, 0.2, F.lit(1.0))).first()[0]
        assert r.flat == pytest.approx(exact, abs=0.08) and r.local > 0


# --- searches -------------------------------------------------------------------------------------------------------


def test_searches_find_the_top():
    top = lambda x: -((x[0] - 1) ** 2) - 10 * (x[1] - x[0] ** 2) ** 2
    for search in (optimize.nelder_mead, optimize.coordinate_ascent, optimize.multistart):
        got = search(top, [0.0, 0.0])
        assert got.x == pytest.approx([1, 1], abs=1e-4) and got.converged
    short = optimize.nelder_mead(top, [0.0, 0.0], rounds=3)
    assert not short.converged and short.rounds == 3
    assert optimize.nelder_mead(lambda x: 2.0, []).value == 2.0
    walled = optimize.nelder_mead(lambda x: -math.inf if x[0] < 0 else -x[0], [1.0], rounds=500)
    assert walled.x[0] == pytest.approx(0, abs=1e-6)


def test_eigenvalues_agree():
    a = np.array([[4, 1, 2, 0, 1], [1, 3, 0, 1, 0], [2, 0, 5, 1, 0], [0, 1, 1, 2, 1], [1, 0, 0, 1, 3]], float)
    values, vectors = optimize.jacobi(a)
    assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1]) and np.allclose(vectors.T @ np.diag(values) @ vectors, a)
    powers, v = optimize.top_eigen(a, 5)
    assert powers == pytest.approx(values, abs=1e-3) and np.allclose(a @ v[0], powers[0] * v[0], atol=1e-4)
    with pytest.raises(ValueError):
        optimize.top_eigen(a, 6)
    with pytest.raises(ValueError):
        optimize.power_method(np.zeros((2, 2)))


def test_projection_and_long_only():
    assert portfolio.simplex(np.array([0.5, 0.8, -1.0])) == pytest.approx([0.35, 0.65, 0.0])
    assert portfolio.long_only(np.array([0.10, 0.05]), np.diag([0.04, 0.0225]))[0] > 0.95


# --- joins, ranks and scores ----------------------------------------------------------------------------------------


def test_alignment_and_asof(spark):
    a, b = keyed(spark, [1, 2, 3, 4]), keyed(spark, [10, 20])
    assert [tuple(r)[1:] for r in joins.align_head(a, b).orderBy("idx").collect()] == [(0, 1.0, 10.0), (1, 2.0, 20.0)]
    assert [tuple(r)[1:] for r in joins.align_tail(a, b).orderBy("idx").collect()] == [(-1, 3.0, 10.0), (0, 4.0, 20.0)]
    assert joins.align_tail(a, b, 1).count() == 1 and joins.align_head(a, b.limit(0)).count() == 0
    left = spark.createDataFrame([("k", 5, 0), ("k", 1, 0), ("k", 7, 2), (None, 9, 0)], "key string, ts long, seq long")
    right = spark.createDataFrame([("k", 3, 0, "x"), ("k", 7, 2, "y"), ("k", 7, 3, "z"), ("j", 0, 0, "j"), (None, 1, 0, None)], "key string, ts long, seq long, v string")
    got = {(r.key, r.ts): r.match and r.match.v for r in joins.asof(left, right).collect()}
    assert got == {("k", 1): None, ("k", 5): "x", ("k", 7): "y", (None, 9): None}
    assert joins.without(left, right, ["key"]).count() == 1


def test_ranks_of_one_hot_score(spark):
    rng = random.Random(2)
    rows_ = [(i, 0.5 if i % 3 else rng.random(), rng.random() < 0.3) for i in range(3000)]
    d = spark.createDataFrame(rows_, "row_id long, score double, label boolean")
    parts = scoring._ranges(d, "score", "row_id", 16).groupBy("_part", "_sub").count().collect()
    assert max(r["count"] for r in parts) < 600
    order = sorted(rows_, key=lambda r: (-r[1], r[0]))
    got = {r.row_id: (r.tp, r.fp) for r in scoring._running(d, "score", "label", "row_id", 16).collect()}
    tp = 0
    for k, r in enumerate(order, 1):
        tp += r[2]
        assert got[r[0]] == (tp, k - tp)
    assert [r.row_id for r in scoring.ordinal(d, "score", "row_id").orderBy("nth").collect()] == [r[0] for r in sorted(rows_, key=lambda r: (r[1], r[0]))]
    train = scoring.chronological(d, "row_id", "row_id").where("is_train")
    assert train.count() == 2400 and train.agg(F.max("row_id")).first()[0] == 2399


def test_tail_loss_of_few_rows(spark):
    d = spark.createDataFrame([("one", -0.5), ("two", -0.1), ("two", 0.3), ("two", None)], "key string, price double")
    got = {r.key: r for r in stats.cvar(d, ["key"], "price", 0.9).collect()}
    assert (got["one"]["var"], got["one"].cvar) == (0.5, 0.5) and got["two"]["var"] == pytest.approx(0.06) and got["two"].cvar == pytest.approx(0.1)


def test_downside_leaves_missing_returns_out(spark):
    d = spark.createDataFrame([(None,), (-0.1,), (0.3,)], "r double")
    assert d.agg(stats.sortino("r")).first()[0] == pytest.approx(0.1 / math.sqrt(0.01 / 2))


# --- series and options ---------------------------------------------------------------------------------------------


def test_expanding_differences_equal_a_loop(spark):
    x = np.cumsum(np.random.default_rng(8).normal(size=120)) + 50
    w = returns.ffd_weights(0.4, 1e-3)
    got = [r.fd for r in returns.expanding_frac_diff(keyed(spark, x), 0.4, 1e-3).orderBy("idx").collect()]
    assert got == pytest.approx([sum(w[k] * x[t - k] for k in range(min(len(w), t + 1))) for t in range(120)])


def test_test_rows_equal_ranges(spark):
    d = keyed(spark, range(57)).unionByName(keyed(spark, range(9), key="short"))
    got = sorted((r.key, r.split, r.idx) for r in labels.test_rows(d, 20, 15, 5).collect())
    want = [("a", k, i) for k, (_, _, _, s, e) in enumerate(labels.walk_forward(spark, 57, 20, 15, 5).orderBy("split").collect()) for i in range(s, e)]
    assert got == sorted(want) and len(got) == 5 * 15


def test_turnover_equals_a_loop(spark):
    rng = random.Random(4)
    p, held = [100 + rng.random() * 9 for _ in range(60)], [rng.randint(0, 1) for _ in range(60)]
    d = spark.createDataFrame([("a", i, a, b) for i, (a, b) in enumerate(zip(p, held, strict=True))], "key string, idx long, close double, position int")
    equity, position, n = 1.0, 0, 0
    for i in range(1, 60):
        equity *= p[i] / p[i - 1] if position else 1
        if held[i] != position:
            equity, position, n = equity * 0.99, held[i], n + 1
    got = strategies.turnover(d, 0.01).first()
    assert (got.n_trades, got.total_return) == (n, pytest.approx(equity - 1))


def test_counted_volatility_equals_a_loop(spark):
    cells = [(100.0, k, t, sigma, call) for k in (80.0, 100.0, 125.0) for t in (0.25, 1.0) for sigma in (0.1, 0.4) for call in (True, False)]
    d = spark.createDataFrame(cells, "s double, k double, t double, sigma double, c boolean").withColumn("p", options.price("s", "k", 0.05, "sigma", "t", "c"))
    for r in d.withColumn("x", options.counted_vol("p", "s", "k", 0.05, "t", "c")).withColumn("y", options.clipped_vol("p", "s", "k", 0.05, "t", "c")).collect():
        worth = r.k * math.exp(-0.05 * r.t)
        target = r.p if r.c else r.p + r.s - worth
        v = math.sqrt(2 * math.pi / r.t) * target / r.s
        v, low, high, rounds = v if 1e-6 < v < 5 else 0.2, 1e-6, 5.0, 0
        while rounds < 200:
            rounds += 1
            x = (math.log(r.s / r.k) + (0.05 + v * v / 2) * r.t) / (v * math.sqrt(r.t))
            gap = r.s * options._np_cdf(np.array(x)) - worth * options._np_cdf(np.array(x - v * math.sqrt(r.t))) - target
            if abs(gap) < 1e-10:
                break
            low, high = (low, v) if gap > 0 else (v, high)
            slope = r.s * math.exp(-x * x / 2) / math.sqrt(2 * math.pi) * math.sqrt(r.t)
            new = v - gap / slope if slope > 1e-6 and low < v - gap / slope < high else (low + high) / 2
            if high - low < 1e-10:
                v = (low + high) / 2
                break
            v = new
        assert r.x.rounds == rounds and r.x.iv == pytest.approx(v, abs=1e-9)
        assert r.y.clipped or r.y.iv == pytest.approx(r.sigma, abs=2e-3)


def test_interfaces(spark):
    d = spark.createDataFrame([("a", i, 0.1 + 2.0 * m - s + 0.5 * v + (i % 2) * 1e-3, m, s, v) for i, (m, s, v) in enumerate(np.random.default_rng(3).normal(size=(30, 3)).tolist())], "key string, idx long, r double, market double, size double, value double")
    model = interfaces.FactorRegression()
    with pytest.raises(ValueError):
        model.exposures()
    e = model.fit(d).exposures().first()
    assert (e.market, e["size"], e.value) == (pytest.approx(2, abs=1e-3), pytest.approx(-1, abs=1e-3), pytest.approx(0.5, abs=1e-3))
    for r in model.decompose(d).collect():
        assert r.systematic + r.idiosyncratic == pytest.approx(r.r) and abs(r.idiosyncratic) < 2e-3
    assert model.fit(d.limit(4)).exposures().first().market is None and model.fitted.first().status == "too few rows"
    got = spark.range(1).select(interfaces.SqrtImpact(0.02).impact(F.lit(400.0), F.lit(10_000.0)), interfaces.LinearImpact(0.1).impact(F.lit(-400.0), F.lit(10_000.0))).first()
    assert tuple(got) == (pytest.approx(0.004), pytest.approx(-0.004))
    for p in (interfaces.Gbm(0.05, 0.2), interfaces.Poisson(3.0), interfaces.JumpDiffusion(0.05, 0.2, 3.0, -0.1)):
        assert p.simulate(spark, 100.0, 1.0, 4, 3, 7).count() == 15 and p.terminal(spark, 100.0, 1.0, 3, 7).count() == 3
    cov = spark.createDataFrame([("a", "a", 4.0), ("a", "b", 1.0), ("b", "a", 1.0), ("b", "b", 9.0)], "i string, j string, cov double")
    assert portfolio.quadratic_form(spark.createDataFrame([("a", 0.5), ("b", 0.5)], "asset string, weight double"), cov).first().value == pytest.approx(3.75)
    assert np.allclose(portfolio.inverse(np.array([[4.0, 1.0], [1.0, 9.0]])) @ np.array([[4.0, 1.0], [1.0, 9.0]]), np.eye(2))


def test_rows_of_positions_and_sides(spark):
    d = spark.createDataFrame([(1, "bid"), (0, "ask"), (-1, None)], "position int, side string")
    got = d.select(rows.is_exposed(), rows.is_flat(), rows.opposite(), rows.side_name(), rows.predict(F.array(F.lit(1.0)), [2.0], -1.0)).collect()
    assert [tuple(r) for r in got] == [(True, False, "ask", "Bid", True), (False, True, "bid", "Ask", True), (True, False, None, None, True)]


# --- streams --------------------------------------------------------------------------------------------------------


def test_windows_of_a_stream(spark, tmp_path):
    ticks = [("a", "2024-01-01 00:05:00", 1.0), ("a", "2024-01-01 00:10:00", 3.0), ("a", "2024-01-01 01:20:00", 2.0), ("a", "2024-01-03 00:00:00", 9.0)]
    late = [("a", "2024-01-01 00:06:00", 50.0), ("a", "2024-01-03 00:30:00", 8.0), ("a", "2024-01-09 00:00:00", 0.0)]
    got = {}
    for name, make in {"tumbling": stateful.tumbling_bars, "sliding": stateful.sliding_stats, "sessions": stateful.sessions}.items():
        (tmp_path / name).mkdir()
        stream = spark.readStream.schema("key string, ts timestamp, value double").option("recursiveFileLookup", True).parquet(str(tmp_path / name))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
        for k, part in enumerate((ticks, late)):
            spark.createDataFrame(part, "key string, t string, value double").select("key", F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.parquet(str(tmp_path / f"{name}/{k}"))
            q.processAllAvailable()
        q.stop()
        got[name] = spark.table(name).collect()
    bars = {str(r.begin)[:10]: (r.open, r.high, r.low, r.close, r.volume) for r in got["tumbling"]}
    assert bars["2024-01-01"] == (1.0, 3.0, 1.0, 2.0, 3) and bars["2024-01-03"] == (9.0, 9.0, 8.0, 8.0, 2)  # the late 50 doesn't count
    ten = next(r for r in got["sliding"] if str(r.begin) == "2024-01-01 00:00:00")
    assert (ten.mean, ten.n) == (2.0, 2)
    assert sorted((str(r.begin)[:16], r.n, r.total) for r in got["sessions"])[:2] == [("2024-01-01 00:05", 2, 4.0), ("2024-01-01 01:20", 1, 2.0)]


def test_order_book_of_a_stream(spark, tmp_path):
    rows_ = [("k", 1, "add", 1, "ask", 101, 30), ("k", 2, "add", 2, "ask", 102, 50), ("k", 3, "market", 9, "bid", 0, 75), ("k", 4, "cancel", 7, "ask", 0, 0)]
    schema = "key string, seq long, cmd string, id long, side string, price long, quantity long"
    for k, part in enumerate((rows_[:2], rows_[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.order_book(stream).writeStream.format("memory").queryName("book").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("book").orderBy("seq").collect()
    assert (got[2].filled, got[2].notional, got[2].ask_quantity) == (75, 30 * 101 + 45 * 102, 5) and got[3].status == "not found"
