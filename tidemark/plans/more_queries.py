"""Queries of joins, reports, grids and generators, registered like those of the queries module."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.functions import options, rows
from tidemark.operators import backtest, joins, labels, microstructure, models, portfolio, returns, scoring, simulation, stats, strategies
from tidemark.plans import series, sql_parts
from tidemark.plans.queries import _CONF, _FACTORS, _FEATURES, _FLOW, _GRID, _MARKET, _PRF, _SMA, _WEIGHTS, _cdf, _psr, chance_sharpe, flow, keyed_panel, option_grid, r6, rounded, sma_equity, tb_sql, with_market
from tidemark.plans.series import BARS, PANEL, PX, table

# --- joins ----------------------------------------------------------------------------------------------------------


def _two(spark, sf_dir):
    """px of clicks and of views under one key."""
    p = series.px(spark, sf_dir)
    return [p.where(F.col("key") == name).withColumn("key", F.lit("both")) for name in ("click", "view")]


@register("aligned_heads", f"WITH {PX} SELECT 'both' AS key, a.idx, {r6('a.price', 'a')}, {r6('b.price', 'b')} FROM px a JOIN px b ON a.idx = b.idx WHERE a.key = 'click' AND b.key = 'view'")
def aligned_heads(spark, sf_dir):
    return rounded(joins.align_head(*_two(spark, sf_dir)))


@register("aligned_tails", f"WITH {PX}, t AS (SELECT *, CAST(1 - row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS BIGINT) AS back FROM px) SELECT 'both' AS key, a.back AS idx, {r6('a.price', 'a')}, {r6('b.price', 'b')} FROM t a JOIN t b ON a.back = b.back WHERE a.key = 'click' AND b.key = 'view' AND a.back > -252")
def aligned_tails(spark, sf_dir):
    return rounded(joins.align_tail(*_two(spark, sf_dir), 252))


@register(
    "asof_join",
    f"""WITH e AS (SELECT event_id, ts, user_id, event_type, value FROM events), m AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen,
    last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen_id FROM e) SELECT event_id, {r6('value', 'value')}, seen_id, {r6('seen', 'seen')} FROM m WHERE event_type = 'click'""",
)
def asof_join(spark, sf_dir):
    """Each click with the user's last view at or before it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), "event_type", "value")
    clicks = e.where("event_type = 'click'").drop("event_type")
    views = e.where("event_type = 'view'").select("key", "ts", "seq", F.col("seq").alias("seen_id"), F.col("value").alias("seen"))
    d = joins.asof(clicks, views)
    return rounded(d.select(F.col("seq").alias("event_id"), "value", "match.seen_id", "match.seen"))


@register("unmatched_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def unmatched_customers(spark, sf_dir):
    return joins.without(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


# --- bars, positions and sizes --------------------------------------------------------------------------------------


@register("bar_summary", f"WITH {BARS} SELECT key, {r6('avg(volume)', 'average_volume')}, {r6('max(high)', 'highest_high', 4)}, {r6('min(low)', 'lowest_low', 4)}, {r6('avg(high - low)', 'average_daily_range', 4)}, {r6('arg_max(close, idx) / arg_min(close, idx) - 1', 'price_change')} FROM bars GROUP BY key")
def bar_summary(spark, sf_dir):
    d = series.bars(spark, sf_dir).groupBy("key").agg(*stats.bar_summary(), stats.price_change().alias("price_change"))
    return rounded(d).select("key", "average_volume", *[(F.round(c, 4) + 0.0).alias(c) for c in ("highest_high", "lowest_low", "average_daily_range")], "price_change")


@register("hammers", f"WITH {BARS} SELECT key, idx, abs(close - open) < 0.3 * (high - low) AND least(open, close) - low > 2 * abs(close - open) AS is_hammer FROM bars")
def hammers(spark, sf_dir):
    return series.bars(spark, sf_dir).select("key", "idx", rows.is_hammer().alias("is_hammer"))


@register("exposure", f"WITH RECURSIVE {BARS}, {_SMA} SELECT key, count(*) FILTER (position <> 0) AS n_exposed, count(*) FILTER (position = 0) AS n_flat FROM e GROUP BY key")
def exposure(spark, sf_dir):
    return sma_equity(spark, sf_dir).groupBy("key").agg(F.count_if(rows.is_exposed()).alias("n_exposed"), F.count_if(rows.is_flat()).alias("n_flat"))


@register("order_sides", f"WITH {_FLOW} SELECT key, CASE side WHEN 'bid' THEN 'Bid' ELSE 'Ask' END AS side, CASE side WHEN 'bid' THEN 'ask' ELSE 'bid' END AS opposite, count(*) AS n FROM f GROUP BY 1, 2, 3")
def order_sides(spark, sf_dir):
    return flow(spark, sf_dir).groupBy("key", rows.side_name().alias("side"), rows.opposite().alias("opposite")).agg(F.count("*").alias("n"))


@register(
    "position_sizes",
    f"""WITH {PANEL}, k AS (SELECT asset AS key, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN r > 0 THEN r END) / avg(CASE WHEN r < 0 THEN -r END) AS b FROM panel GROUP BY asset)
    SELECT key, {r6('p - (1 - p) / b', 'full')}, {r6('(p - (1 - p) / b) / 2', 'half')}, {r6('p', 'win_prob')}, {r6('b', 'win_loss_ratio')}, {r6('0.25 * (p - (1 - p) / b)', 'quarter')} FROM k""",
)
def position_sizes(spark, sf_dir):
    d = keyed_panel(spark, sf_dir).groupBy("key").agg(stats.position_size("r").alias("s")).select("key", "s.*")
    return rounded(d.withColumn("quarter", rows.fractional_kelly("win_prob", "win_loss_ratio", 0.25)))


@register(
    "performance_ratios",
    f"""WITH {PANEL}, n AS (SELECT asset AS key, r, product(1 + r) OVER (PARTITION BY asset ORDER BY idx) AS e, row_number() OVER (PARTITION BY asset ORDER BY idx) AS k, count(*) OVER (PARTITION BY asset) AS n FROM panel),
    d AS (SELECT *, e / max(e) OVER (PARTITION BY key ORDER BY k) - 1 AS dd FROM n), g AS (SELECT key, avg(r) * 12 AS a, min(dd) AS dd, avg(r) FILTER (2 * k <= n) / stddev_samp(r) FILTER (2 * k <= n) AS i, avg(r) FILTER (2 * k > n) / stddev_samp(r) FILTER (2 * k > n) AS o FROM d GROUP BY key)
    SELECT key, {r6('a / abs(dd)', 'calmar')}, {r6('o / i', 'efficiency')} FROM g""",
)
def performance_ratios(spark, sf_dir):
    """The Calmar ratio, and the walk-forward efficiency of the later half of a series by the earlier one."""
    from pyspark.sql import window as W

    whole = W.Window.partitionBy("key")
    d = returns.cumulative_returns(keyed_panel(spark, sf_dir)).withColumn("e", 1 + F.col("cumulative"))
    d = returns.drawdown(d, "e").withColumn("late", 2 * F.row_number().over(returns.by()) > F.count("*").over(whole))
    half = lambda late: stats.sharpe(F.when(F.col("late") == late, F.col("r")))
    g = d.groupBy("key").agg((F.avg("r") * 12).alias("a"), F.min("drawdown").alias("dd"), half(False).alias("i"), half(True).alias("o"))
    return rounded(g.select("key", rows.calmar_ratio("a", "dd").alias("calmar"), rows.walk_forward_efficiency("i", "o").alias("efficiency")))


@register("linear_impact", f"SELECT l_orderkey, l_linenumber, {r6('0.1 * l_quantity / 1000', 'impact')} FROM lineitem")
def linear_impact(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rows.linear_impact(0.1, "l_quantity", 1000.0).alias("impact")))


# --- loans and scores -----------------------------------------------------------------------------------------------


def loans(spark, sf_dir):
    """Customers as loan applications: the balance is the income, the segment the home."""
    home = F.when(F.col("c_custkey") % 3 == 0, "OWN").when(F.col("c_custkey") % 3 == 1, "RENT").otherwise("MORTGAGE")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("income"), (100.0 * F.col("c_nationkey")).alias("loan_amount"), (4.0 + F.col("c_custkey") % 17).alias("interest_rate"),
        ((F.col("c_custkey") * 7) % 50 / 100).alias("dti"), (F.col("c_nationkey") % 7 + 1).alias("grade"), home.alias("home_ownership"), ((F.col("c_custkey") * 31) % 100 < F.col("c_nationkey") * 4).alias("defaulted"),
    )


_LOANS = """l AS (SELECT c_custkey AS row_id, greatest(c_acctbal, 0.0) AS income, 100.0 * c_nationkey AS loan, 4.0 + c_custkey % 17 AS rate, (c_custkey * 7) % 50 / 100 AS dti, c_nationkey % 7 + 1 AS grade, c_custkey % 3 AS home, (c_custkey * 31) % 100 < c_nationkey * 4 AS y FROM customer),
f AS (SELECT row_id, home, y, CAST(CASE WHEN income = 0 THEN 0.0 ELSE loan / income END AS DOUBLE) AS f0, CAST(rate AS DOUBLE) AS f1, CAST(dti AS DOUBLE) AS f2, least(1.0, greatest(0.0, CAST(grade - 1 AS DOUBLE) / 6)) AS f3 FROM l)"""
_SCALED = ", ".join(f"CASE WHEN max(f{k}) OVER () = min(f{k}) OVER () THEN 0.0 ELSE (f{k} - min(f{k}) OVER ()) / (max(f{k}) OVER () - min(f{k}) OVER ()) END AS n{k}" for k in range(4))
_SCORES = f"{_LOANS}, n AS (SELECT row_id, home, y, {_SCALED} FROM f), s AS (SELECT row_id, y, 1 / (1 + exp(-(-1.5 + 0.8 * n0 + 0.5 * n1 + 0.7 * n2 + 1.0 * n3 + CASE home WHEN 1 THEN 0.2 WHEN 0 THEN -0.3 ELSE 0.0 END))) AS score FROM n)"


@register(
    "loan_features",
    f"WITH {_LOANS} SELECT row_id, {r6('f0', 'loan_to_income')}, {r6('f3', 'grade_score')}, CASE home WHEN 1 THEN 1.0 ELSE 0.0 END AS rent, CASE home WHEN 0 THEN 1.0 ELSE 0.0 END AS own, CASE home WHEN 2 THEN 1.0 ELSE 0.0 END AS mortgage, {r6('(f1 - 4) / 16', 'scaled_rate')} FROM f",
)
def loan_features(spark, sf_dir):
    d = loans(spark, sf_dir)
    one = rows.one_hot("home_ownership")
    return rounded(d.select("row_id", rows.loan_to_income("loan_amount", "income").alias("loan_to_income"), rows.grade_to_score("grade").alias("grade_score"), *[one[k].alias(n) for k, n in enumerate(("rent", "own", "mortgage"))], rows.normalize("interest_rate", 4.0, 20.0).alias("scaled_rate")))


@register("loan_predictions", f"WITH {_SCORES} SELECT row_id, {r6('score', 'score')}, score > 0.5 AS predicted FROM s")
def loan_predictions(spark, sf_dir):
    d = strategies.loan_scores(loans(spark, sf_dir))
    return rounded(d.select("row_id", "score", (F.col("score") > 0.5).alias("predicted")))


_POINTS = "o AS (SELECT y, row_number() OVER w AS place, sum(CASE WHEN y THEN 1 ELSE 0 END) OVER w AS tp FROM s WINDOW w AS (ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING)), t AS (SELECT count(*) AS n, count(*) FILTER (y) AS pos FROM s), pt AS (SELECT place, (place - tp) / (n - pos) AS fpr, tp / pos AS tpr FROM o, t)"


@register(
    "loan_report",
    f"""WITH {_SCORES}, {_POINTS}, a AS (SELECT sum(CASE WHEN NOT y THEN tp ELSE 0 END) / max(pos * (n - pos)) AS auc FROM o, t), b AS (SELECT place, fpr, tpr FROM pt ORDER BY round(tpr - fpr, 12) DESC, place LIMIT 1),
    c AS (SELECT {_CONF} FROM (SELECT y, score > 0.5 AS p FROM s)) SELECT n, {r6('pos / n', 'default_rate')}, {r6('auc', 'auc')}, place AS best_place, {r6('fpr', 'best_fpr')}, {r6('tpr', 'best_tpr')}, tp, fp, tn, fn, {_PRF} FROM t, a, b, c""",
)
def loan_report(spark, sf_dir):
    return rounded(strategies.loan_report(strategies.loan_scores(loans(spark, sf_dir))))


_APPLICANTS = f"""{sql_parts.uniforms([42], 3000)}, w AS (SELECT k // 6 AS row_id, {', '.join(f'max(u) FILTER (k % 6 = {j}) AS u{j}' for j in range(6))} FROM u GROUP BY 1),
v AS (SELECT row_id, 300 + 500 * u0 AS credit, 0.05 + 0.45 * u1 AS dti, 20000 + 80000 * u2 AS income, sqrt(-2 * ln(greatest(u3, 2.220446049250313e-16))) * cos(2 * pi() * u4) AS z, u5 FROM w),
x AS (SELECT row_id, (credit - 600) / 100 AS f0, (dti - 0.25) / 0.15 AS f1, (income - 50000) / 30000 AS f2, u5 < 1 / (1 + exp(-(-3 + 0.004 * (600 - credit) + 6 * (dti - 0.2) + 0.1 * z))) AS y FROM v),
s AS (SELECT row_id, y, 1 / (1 + exp(-(-0.5 + 0.8 * f0 + 1.2 * f1 + 0.3 * f2))) AS score FROM x)"""


def applicants(spark):
    return simulation.applicants(spark, 500, 42).withColumn("score", rows.predict_proba("features", [0.8, 1.2, 0.3], -0.5)).withColumn("label", F.col("defaulted"))


@register("loan_applicants", f"WITH RECURSIVE {_APPLICANTS} SELECT x.row_id, {r6('f0', 'credit')}, {r6('f1', 'debt')}, {r6('f2', 'income')}, x.y AS defaulted, {r6('score', 'score')} FROM x JOIN s ON s.row_id = x.row_id")
def loan_applicants(spark, sf_dir):
    return rounded(applicants(spark).select("row_id", *[F.col("features")[k].alias(n) for k, n in enumerate(("credit", "debt", "income"))], "defaulted", "score"))


@register(
    "fold_auc",
    f"""WITH RECURSIVE {_APPLICANTS}, f AS (SELECT *, least(row_id // 100, 4) AS fold FROM s), o AS (SELECT *, coalesce(sum(CASE WHEN y THEN 0 ELSE 1 END) OVER (PARTITION BY fold ORDER BY score, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM f)
    SELECT CAST(fold AS INT) AS fold, count(*) AS n, {r6('sum(below) FILTER (y) / (count(*) FILTER (y) * count(*) FILTER (NOT y))', 'auc')} FROM o GROUP BY 1""",
)
def fold_auc(spark, sf_dir):
    return rounded(scoring.fold_auc(applicants(spark)))


_RATES = ", ".join(f"max(w{k}) - 0.5 * avg((p - y) * f{k}) AS w{k}" for k in range(3))


@register(
    "logistic_weights",
    f"""WITH RECURSIVE {_APPLICANTS}, d AS (SELECT f0, f1, f2, CASE WHEN y THEN 1 ELSE 0 END AS y FROM x), lw(t, b, w0, w1, w2) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
    UNION ALL SELECT t + 1, max(b) - 0.5 * avg(p - y) AS b, {_RATES} FROM (SELECT *, 1 / (1 + exp(-(b + w0 * f0 + w1 * f1 + w2 * f2))) AS p FROM lw, d WHERE t < 100) GROUP BY t)
    SELECT 'all' AS key, CAST(500 AS BIGINT) AS n, {r6('b', 'bias')}, {r6('w0', 'credit')}, {r6('w1', 'debt')}, {r6('w2', 'income')} FROM lw WHERE t = 100""",
)
def logistic_weights(spark, sf_dir):
    d = applicants(spark).select(F.lit("all").alias("key"), F.col("defaulted").cast("int").alias("y"), *[F.col("features")[k].alias(f"f{k}") for k in range(3)])
    fit = strategies.logistic(d, ["f0", "f1", "f2"], "y", epochs=100)
    return rounded(fit.select("key", "n", "bias", *[F.col("weights")[k].alias(c) for k, c in enumerate(("credit", "debt", "income"))]))


_GRID_OF_THRESHOLDS = [round(0.01 + 0.02 * k, 2) for k in range(50)]


@register("best_threshold", f"WITH RECURSIVE {_APPLICANTS}, c AS (SELECT t AS threshold, {_CONF} FROM (SELECT y, t, score >= t AS p FROM s, (SELECT CAST(0.01 + 0.02 * range AS DECIMAL(4, 2))::DOUBLE AS t FROM range(50))) GROUP BY t), f AS (SELECT threshold, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM c) SELECT threshold, {r6('f1', 'f1')} FROM f ORDER BY round(f1, 12) DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return rounded(scoring.best_threshold(applicants(spark), _GRID_OF_THRESHOLDS))


_Z = ", ".join(f"abs({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem) AS z{k}" for k, c in enumerate(_FEATURES))


@register("discriminative_feature", f"WITH z AS (SELECT {_Z} FROM lineitem WHERE l_returnflag = 'R'), m AS ({' UNION ALL '.join(f'SELECT {k} AS place, avg(z{k}) AS mean_z FROM z' for k in range(4))}) SELECT place, {r6('mean_z', 'mean_z')} FROM m ORDER BY m.mean_z DESC, place DESC LIMIT 1")
def discriminative_feature(spark, sf_dir):
    x = series.features(spark, sf_dir)
    return rounded(scoring.discriminative(x, scoring.zscore_fit(x)))


@register("triggering_features", f"WITH z AS (SELECT l_orderkey, l_linenumber, {_Z} FROM lineitem) SELECT l_orderkey, l_linenumber, concat_ws(',', {', '.join(f'CASE WHEN z{k} > 1.7 THEN {str(k)!r} END' for k in range(4))}) AS triggers FROM z WHERE greatest(z0, z1, z2, z3) > 1.7")
def triggering_features(spark, sf_dir):
    x = series.features(spark, sf_dir)
    d = scoring.zscore_predict(x, scoring.zscore_fit(x), 1.7).where("anomaly")
    return d.select("l_orderkey", "l_linenumber", F.concat_ws(",", F.transform("triggers", lambda k: k.cast("string"))).alias("triggers"))


_TEST_Z = " OR ".join(f"abs({c} - (SELECT avg({c}) FROM o WHERE n <= m)) / (SELECT stddev_pop({c}) FROM o WHERE n <= m) > 1.7" for c in _FEATURES)


@register("chronological_test", f"WITH o AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n, floor(count(*) OVER () * 0.8) AS m FROM lineitem), c AS (SELECT {_CONF} FROM (SELECT l_returnflag = 'R' AS y, {_TEST_Z} AS p FROM o WHERE n > m)) SELECT *, {_PRF} FROM c")
def chronological_test(spark, sf_dir):
    """Anomalies of the last fifth of the line items by the means and deviations of those before."""
    x = scoring.chronological(series.features(spark, sf_dir).withColumn("place", 10 * F.col("l_orderkey") + F.col("l_linenumber")), "place", "place")
    d = scoring.zscore_predict(x.where("not is_train"), scoring.zscore_fit(x.where("is_train")), 1.7)
    return rounded(stats.precision_recall(d.agg(*stats.confusion("class", "anomaly"))))


# --- options --------------------------------------------------------------------------------------------------------


def _price(s: str = "s", sigma: str = "sigma", t: str = "t", call: str = "is_call", k: str = "k") -> str:
    d1 = f"((ln({s} / {k}) + (0.05 + ({sigma}) * ({sigma}) / 2) * ({t})) / (({sigma}) * sqrt({t})))"
    d2, w = f"({d1} - ({sigma}) * sqrt({t}))", f"({k} * exp(-0.05 * ({t})))"
    return f"(CASE WHEN {call} THEN {s} * {_cdf(d1)} - {w} * {_cdf(d2)} ELSE {w} * {_cdf('-' + d2)} - {s} * {_cdf('-' + d1)} END)"


@register(
    "finite_differences",
    f"""WITH {_GRID} SELECT p_partkey, CAST(m AS DOUBLE) AS m, {r6(f"({_price('(s + 0.1)')} - {_price('(s - 0.1)')}) / 0.2", 'delta', 5)}, {r6(f"({_price('(s + 1)', call='true')} - 2 * {_price(call='true')} + {_price('(s - 1)', call='true')})", 'gamma', 5)},
    {r6(f"({_price(sigma='(sigma + 0.001)', call='true')} - {_price(sigma='(sigma - 0.001)', call='true')}) / 0.002", 'vega', 3)}, {r6(f"({_price(t='(t - 0.001)')} - {_price()}) / 0.001", 'theta', 3)} FROM q""",
)
def finite_differences(spark, sf_dir):
    a = ("s", "k", 0.05, "sigma", "t")
    g = option_grid(spark, sf_dir).select("p_partkey", "m", options.delta_fd(*a, "is_call", 0.1).alias("delta"), options.gamma_fd(*a, 1.0).alias("gamma"), options.vega_fd(*a, 1e-3).alias("vega"), options.theta_fd(*a, "is_call", 1e-3).alias("theta"))
    return g.select("p_partkey", "m", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("delta", 5), ("gamma", 5), ("vega", 3), ("theta", 3))])


@register("dividend_calls", f"WITH {_GRID} SELECT p_partkey, CAST(m AS DOUBLE) AS m, {r6(_price('(s * exp(-0.03 * t))', call='true'), 'price', 4)}, CAST(CASE WHEN p_partkey % 11 = 0 THEN 'volatility' END AS VARCHAR) AS status FROM q")
def dividend_calls(spark, sf_dir):
    sigma = F.when(F.col("p_partkey") % 11 == 0, -F.col("sigma")).otherwise(F.col("sigma"))
    return rounded(option_grid(spark, sf_dir).select("p_partkey", "m", options.dividend_call("s", "k", 0.05, 0.03, "sigma", "t").alias("price"), options.status("s", "k", sigma, "t").alias("status")), 4)


@register("clipped_volatility", f"WITH {_GRID} SELECT p_partkey, {r6('sigma', 'iv', 4)}, false AS clipped FROM q WHERE m = 1.0")
def clipped_volatility(spark, sf_dir):
    d = option_grid(spark, sf_dir).where("m = 1.0").withColumn("p", options.price("s", "k", 0.05, "sigma", "t", "is_call"))
    return rounded(d.select("p_partkey", options.clipped_vol("p", "s", "k", 0.05, "t", "is_call").alias("x")).select("p_partkey", "x.iv", "x.clipped"), 4)


@register("counted_volatility", f"WITH {_GRID} SELECT p_partkey, {r6('sigma', 'iv', 4)}, true AS few FROM q WHERE m = 1.0")
def counted_volatility(spark, sf_dir):
    """At the money the steps come to the volatility within a dozen rounds."""
    d = option_grid(spark, sf_dir).where("m = 1.0").withColumn("p", options.price("s", "k", 0.05, "sigma", "t", "is_call"))
    d = d.select("p_partkey", options.counted_vol("p", "s", "k", 0.05, "t", "is_call").alias("x"))
    return rounded(d.select("p_partkey", "x.iv", F.col("x.rounds").between(1, 12).alias("few")), 4)


# --- generators and Monte Carlo -------------------------------------------------------------------------------------


@register(
    "monte_carlo_puts",
    f"""WITH RECURSIVE {sql_parts.normals([11], 5000)}, p AS (SELECT 100 * exp(0.03 + 0.2 * z) AS v, 100 * exp(0.03 - 0.2 * z) AS a FROM z), g AS (SELECT 'put' AS kind, greatest(105 - v, 0.0) * exp(-0.05) AS g FROM p
    UNION ALL SELECT 'antithetic', greatest(v - 105, 0.0) * exp(-0.05) FROM p UNION ALL SELECT 'antithetic', greatest(a - 105, 0.0) * exp(-0.05) FROM p)
    SELECT kind, {r6('avg(g)', 'price')}, {r6('stddev_samp(g) / sqrt(count(*))', 'std_error')}, count(*) AS n, {r6('1.96 * stddev_samp(g) / sqrt(count(*))', 'half_width')} FROM g GROUP BY kind""",
)
def monte_carlo_puts(spark, sf_dir):
    put = simulation.mc_price(spark, 100.0, 105.0, 0.05, 0.2, 1.0, 5000, 11, is_call=False).withColumn("kind", F.lit("put"))
    call = simulation.mc_price(spark, 100.0, 105.0, 0.05, 0.2, 1.0, 5000, 11, antithetic=True).withColumn("kind", F.lit("antithetic"))
    return rounded(put.unionByName(call).withColumn("half_width", simulation.ci_half_width()).select("kind", "price", "std_error", "n", "half_width"))


@register("brownian_paths", f"WITH RECURSIVE {sql_parts.normals([3], 400)}, s AS (SELECT i // 20 AS path_id, i % 20 + 1 AS step, sqrt(0.05) * z AS x FROM z) SELECT path_id, step, {r6('sum(x) OVER (PARTITION BY path_id ORDER BY step)', 'value')} FROM s UNION ALL SELECT range, 0, 0.0 FROM range(20)")
def brownian_paths(spark, sf_dir):
    return rounded(simulation.brownian(spark, 20, 0.05, 20, 3))


def _own_seeds(seed: int, n: int) -> list[int]:
    return [seed + 0x9E3779B97F4A7C15 * (i + 1) for i in range(n)]


def _arrivals(seed: int, n: int, rate: float, t: float, most: int) -> str:
    """a(path_id, arrival): the arrivals below t, among most numbers of each path's stream."""
    return f"""{sql_parts.uniforms(_own_seeds(seed, n), most)}, w AS (SELECT s, sum(-ln(1 - least(greatest(u, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) / {rate!r}) OVER (PARTITION BY s ORDER BY k) AS t FROM u), a AS (SELECT s AS path_id, t AS arrival FROM w WHERE t < {t!r})"""


@register("poisson_arrivals", f"WITH RECURSIVE {_arrivals(5, 20, 8.0, 2.0, 80)} SELECT path_id, {r6('arrival', 'arrival')} FROM a")
def poisson_arrivals(spark, sf_dir):
    return rounded(simulation.poisson_paths(spark, 8.0, 2.0, 20, 5))


@register("poisson_counts", f"WITH RECURSIVE {_arrivals(6, 50, 0.7, 1.0, 20)} SELECT range AS path_id, count(arrival) AS n FROM range(50) LEFT JOIN a ON path_id = range GROUP BY 1")
def poisson_counts(spark, sf_dir):
    return simulation.poisson_counts(spark, 0.7, 1.0, 50, 6)


@register("poisson_grid", f"WITH RECURSIVE {_arrivals(5, 20, 8.0, 2.0, 80)} SELECT p.range AS path_id, g.range AS step, count(arrival) AS n FROM range(20) p, range(11) g LEFT JOIN a ON path_id = p.range AND arrival <= g.range * 0.2 GROUP BY 1, 2")
def poisson_grid(spark, sf_dir):
    return simulation.poisson_grid(spark, 8.0, 2.0, 10, 20, 5)


def _jumps(n_steps: int) -> str:
    arrivals = _arrivals(9, 30, 5.0, 1.0, 40)
    arrivals = re.sub(r"(\bst(?=\()|(?<=FROM )(st|u)\b|\bu(?= AS \())", r"\1j", arrivals)  # two sets of streams in one statement
    return f"{sql_parts.gbm(9, 100.0, 0.05, 0.2, 1.0, n_steps, 30)}, {arrivals}, j AS (SELECT g.path_id, step, value * exp(-0.02 * count(arrival)) AS value FROM g LEFT JOIN a ON a.path_id = g.path_id AND least(ceil(arrival / {1.0 / n_steps!r}), {n_steps}) <= step GROUP BY g.path_id, step, value)"


@register("jump_paths", f"WITH RECURSIVE {_jumps(12)} SELECT path_id, step, {r6('value', 'value')} FROM j")
def jump_paths(spark, sf_dir):
    return rounded(simulation.jump_diffusion(spark, 100.0, 0.05, 0.2, 5.0, -0.02, 1.0, 12, 30, 9))


@register("jump_ends", f"WITH RECURSIVE {_jumps(1)} SELECT path_id, {r6('value', 'value')} FROM j WHERE step = 1")
def jump_ends(spark, sf_dir):
    return rounded(simulation.jump_terminal(spark, 100.0, 0.05, 0.2, 5.0, -0.02, 1.0, 30, 9))


@register("random_jump_paths")
def random_jump_paths(spark, sf_dir):
    return rounded(simulation.random_jumps(spark, 100.0, 0.05, 0.2, 5.0, 0.1, 1.0, 12, 30, 9))


@register(
    "ar2_paths",
    f"""WITH RECURSIVE {sql_parts.normals([13], 300)}, e AS (SELECT i // 60 AS path_id, i % 60 AS idx, z FROM z), x AS (SELECT path_id, CAST(1 AS BIGINT) AS idx, max(z) FILTER (idx = 0) AS b, max(z) FILTER (idx = 1) AS v FROM e GROUP BY 1
    UNION ALL SELECT x.path_id, e.idx, x.v, 0.5 * x.v + 0.3 * x.b + e.z FROM x JOIN e ON e.path_id = x.path_id AND e.idx = x.idx + 1) SELECT path_id, idx, {r6('v', 'value')} FROM x UNION ALL SELECT path_id, 0, {r6('b', 'value')} FROM x WHERE idx = 1""",
)
def ar2_paths(spark, sf_dir):
    return rounded(simulation.ar2(spark, 0.5, 0.3, 60, 5, 13))


@register(
    "euler_bias",
    f"""WITH RECURSIVE {sql_parts.normals([17], 12000)}, e AS (SELECT i // 12 AS p, 100 * product(1 + 0.1 / 12 + 0.2 * sqrt(1.0 / 12) * z) AS v FROM z GROUP BY 1), x AS (SELECT 100 * exp(0.08 + 0.2 * z) AS v FROM z WHERE i < 1000)
    SELECT {r6('(SELECT avg(v) FROM e)', 'euler')}, {r6('(SELECT avg(v) FROM x)', 'exact')}""",
)
def euler_bias(spark, sf_dir):
    euler = simulation.euler_terminal(spark, 100.0, 0.1, 0.2, 1.0, 12, 1000, 17).agg(F.avg("value").alias("euler"))
    return rounded(euler.crossJoin(simulation.terminal(spark, 100.0, 0.1, 0.2, 1.0, 1000, 17).agg(F.avg("value").alias("exact"))))


@register(
    "interval_coverage",
    f"""WITH RECURSIVE {sql_parts.normals(list(range(1, 101)), 500)}, g AS (SELECT s, avg(greatest(100 * exp(0.03 + 0.2 * z) - 100, 0.0) * exp(-0.05)) AS p, stddev_samp(greatest(100 * exp(0.03 + 0.2 * z) - 100, 0.0) * exp(-0.05)) / sqrt(500) AS e FROM z GROUP BY s)
    SELECT s + 1 AS seed, {r6('p', 'price')}, {r6('e', 'std_error')}, abs(p - {_price('100.0', '0.2', '1.0', 'true', '100.0')}) <= 1.96 * e AS covered FROM g""",
)
def interval_coverage(spark, sf_dir):
    return rounded(simulation.coverage(spark, 100.0, 100.0, 0.05, 0.2, 1.0, 500, list(range(1, 101))))


@register("asian_call", f"WITH RECURSIVE {sql_parts.gbm(19, 100.0, 0.05, 0.2, 1.0, 12, 1000)}, m AS (SELECT greatest(avg(value) - 100, 0.0) * exp(-0.05) AS g FROM g WHERE step > 0 GROUP BY path_id) SELECT {r6('avg(g)', 'price')}, {r6('stddev_samp(g) / sqrt(count(*))', 'std_error')}, count(*) AS n FROM m")
def asian_call(spark, sf_dir):
    return rounded(simulation.asian_call(spark, 100.0, 100.0, 0.05, 0.2, 1.0, 12, 1000, 19))


# --- series and strategies ------------------------------------------------------------------------------------------

_E = returns.ffd_weights(0.4, 0.02)


@register("expanding_frac_diff", f"WITH {PX} SELECT key, idx, {r6(' + '.join(f'({w!r}) * coalesce(lag(price, {k}) OVER w, 0.0)' for k, w in enumerate(_E)), 'fd', 5)} FROM px WINDOW w AS (PARTITION BY key ORDER BY idx)")
def expanding_frac_diff(spark, sf_dir):
    return rounded(returns.expanding_frac_diff(series.px(spark, sf_dir), 0.4, 0.02).select("key", "idx", "fd"), 5)


_PAIRS_OF_LENGTHS = [(s, n) for s in (5, 10, 20) for n in (30, 50, 100)]
_MEANS = ", ".join(f"avg(close) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS m{k}" for k in (5, 10, 20, 30, 50, 100))
_EARNED = " UNION ALL ".join(f"SELECT key, {k} AS k, {s} AS short, {n} AS long, CASE WHEN idx >= {n} AND m{s} > m{n} THEN r ELSE 0.0 END AS g FROM x WHERE r IS NOT NULL" for k, (s, n) in enumerate(_PAIRS_OF_LENGTHS))


@register(
    "crossover_grid",
    f"""WITH {BARS}, x AS (SELECT key, idx, close / lag(close) OVER (PARTITION BY key ORDER BY idx) - 1 AS r, {_MEANS} FROM bars), g AS (SELECT key, k, short, long, CASE WHEN coalesce(stddev_samp(g), 0) = 0 THEN 0.0 ELSE avg(g) / stddev_samp(g) * sqrt(252) END AS s FROM ({_EARNED}) GROUP BY 1, 2, 3, 4)
    SELECT key, short, long, {r6('s', 'sharpe')}, s > 0 AND row_number() OVER (PARTITION BY key ORDER BY s DESC, k) = 1 AS best FROM g""",
)
def crossover_grid(spark, sf_dir):
    return rounded(strategies.crossover_grid(series.bars(spark, sf_dir), [5, 10, 20], [30, 50, 100]))


@register(
    "ema_turnover",
    f"""WITH RECURSIVE {BARS}, e AS (SELECT key, idx, close, close AS s, close AS l, 0 AS held, CAST(0 AS BIGINT) AS n, CAST(1 AS DOUBLE) AS w FROM bars WHERE idx = 0
    UNION ALL SELECT key, idx, close, s, l, CASE WHEN s > l THEN 1 ELSE 0 END, n + CASE WHEN (CASE WHEN s > l THEN 1 ELSE 0 END) <> held THEN 1 ELSE 0 END, w * CASE WHEN held = 1 THEN close / before ELSE 1 END * CASE WHEN (CASE WHEN s > l THEN 1 ELSE 0 END) <> held THEN 0.999 ELSE 1 END
    FROM (SELECT b.key, b.idx, b.close, e.close AS before, b.close * (2.0 / 11) + e.s * (1 - 2.0 / 11) AS s, b.close * (2.0 / 31) + e.l * (1 - 2.0 / 31) AS l, held, n, w FROM e JOIN bars b ON b.key = e.key AND b.idx = e.idx + 1))
    SELECT key, max(n) AS n_trades, {r6('arg_max(w, idx) - 1', 'total_return')} FROM e GROUP BY key""",
)
def ema_turnover(spark, sf_dir):
    return rounded(strategies.turnover(strategies.ema_crossover(series.bars(spark, sf_dir), 10, 30), 0.001))


@register(
    "turnover_backtest",
    f"""WITH RECURSIVE {BARS}, {_SMA}, p AS (SELECT key, idx, position, close / lag(close) OVER w - 1 AS r, lag(position, 1, 0) OVER w AS held FROM e WINDOW w AS (PARTITION BY key ORDER BY idx)),
    n AS (SELECT key, idx, held * coalesce(r, 0.0) - 0.001 * abs(position - held) AS net FROM p) SELECT key, idx, {r6('net', 'net')}, {r6('product(1 + net) OVER (PARTITION BY key ORDER BY idx)', 'growth')} FROM n""",
)
def turnover_backtest(spark, sf_dir):
    d = sma_equity(spark, sf_dir).withColumn("r", F.coalesce(F.col("close") / F.lag("close").over(returns.by()) - 1, F.lit(0.0)))
    return rounded(backtest.turnover_backtest(d).select("key", "idx", "net", "growth"))


_LEARN = returns.ffd_weights(0.4, 1e-2)
_LEARN_FD = " + ".join(f"({w!r}) * lag(r, {k}) OVER w" for k, w in enumerate(_LEARN))


@register(
    "learning_pipeline",
    f"""WITH {tb_sql(0.3, -0.3, 10, 'a.idx % 5 = 0')}, lr AS (SELECT key, idx, CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price / lag(price) OVER w) ELSE 0.0 END AS r FROM px WINDOW w AS (PARTITION BY key ORDER BY idx) QUALIFY lag(price) OVER w IS NOT NULL),
    fd AS (SELECT key, idx, {_LEARN_FD} AS x FROM lr WINDOW w AS (PARTITION BY key ORDER BY idx)), fe AS (SELECT key, idx, lag(x) OVER w AS l, x - lag(x) OVER w AS d FROM fd WHERE x IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY idx)),
    ff AS (SELECT *, lag(d) OVER (PARTITION BY key ORDER BY idx) AS d1 FROM fe), {sql_parts.partial_slope('q', 'ff', 'd', ['l', 'd1'], 'l')}, t AS (SELECT key, b / sqrt(sse / (n - 3) / tt) AS t FROM q),
    e AS (SELECT *, return_pct - avg(return_pct) OVER (PARTITION BY key) AS d FROM tb),
    g AS (SELECT key, count(*) AS n, count(*) FILTER (label = 'Upper') AS u, count(*) FILTER (label = 'Lower') AS w, count(*) FILTER (label = 'Time') AS i, avg(return_pct) / stddev_samp(return_pct) AS sr, avg(d * d * d) / pow(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS kurt,
      avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN return_pct > 0 THEN return_pct END) / avg(CASE WHEN return_pct < 0 THEN -return_pct END) AS b FROM e GROUP BY key)
    SELECT g.key, n AS n_events, u AS n_upper, w AS n_lower, i AS n_time, {r6('p - (1 - p) / b', 'kelly')}, {r6('sr', 'sharpe')}, {r6('skew', 'skew', 5)}, {r6('kurt', 'kurtosis', 4)}, (m + 1 - 150) // 30 + 1 AS n_folds,
    {r6('t', 'statistic', 4)}, t < -2.86 AS stationary, {r6('(p - (1 - p) / b) / 2', 'half_kelly')}, 0.5 AS efficiency, {r6(_psr(repr(chance_sharpe(5, 0.05))), 'deflated_sharpe')} FROM g JOIN z ON z.key = g.key JOIN t ON t.key = g.key""",
)
def learning_pipeline(spark, sf_dir):
    d = rounded(strategies.learning(series.px(spark, sf_dir), labels.TripleBarrier(0.3, -0.3, 10), threshold=1e-2))
    d = d.withColumn("skew", F.round("skew", 5)).withColumn("kurtosis", F.round("kurtosis", 4)).withColumn("statistic", F.round("statistic", 4))
    return d.select("key", "n_events", "n_upper", "n_lower", "n_time", "kelly", "sharpe", "skew", "kurtosis", "n_folds", "statistic", "stationary", "half_kelly", "efficiency", "deflated_sharpe")


@register("flow_correlation", f"WITH {PX}, o AS (SELECT key, idx, price - lag(price) OVER w + coalesce(CASE WHEN (idx - 1) % 7 <> 0 THEN lag(price) OVER w / 2 END, 0) - coalesce(CASE WHEN idx % 7 <> 0 THEN price / 2 END, 0) AS f, sin(price) - sin(lag(price) OVER w) AS m FROM px WINDOW w AS (PARTITION BY key ORDER BY idx)) SELECT key, count(m) AS n, {r6('corr(f, m)', 'correlation')} FROM o WHERE m IS NOT NULL GROUP BY key")
def flow_correlation(spark, sf_dir):
    d = series.px(spark, sf_dir).select("key", "idx", F.col("price").alias("bid_quantity"), F.when(F.col("idx") % 7 != 0, F.col("price") / 2).alias("ask_quantity"), F.sin("price").alias("mid"))
    return rounded(microstructure.flow_correlation(d))


# --- portfolios and factors -----------------------------------------------------------------------------------------


@register(
    "portfolio_stats",
    f"WITH {PANEL}, c AS (SELECT covar_samp(a.r, b.r) AS c FROM panel a JOIN panel b ON a.idx = b.idx GROUP BY a.asset, b.asset), s AS (SELECT (SELECT sum(c) / 25 FROM c) AS v, (SELECT avg(m) FROM (SELECT avg(r) AS m FROM panel GROUP BY asset)) AS m) SELECT {r6('m', 'mean', 9)}, {r6('v', 'variance', 9)}, {r6('sqrt(v)', 'volatility', 9)}, {r6('(m + 0.01) / sqrt(v)', 'sharpe')} FROM s",
)
def portfolio_stats(spark, sf_dir):
    u = portfolio.Universe.of(series.panel(spark, sf_dir))
    d = portfolio.describe(np.full(5, 0.2), u.mean, u.cov, -0.01)
    return spark.createDataFrame([tuple(round(v, 6 if k == "sharpe" else 9) + 0.0 for k, v in d.items())], "mean double, variance double, volatility double, sharpe double")


_TWO = f"WITH {PANEL}, {sql_parts.wide()}, s AS (SELECT avg(a1) AS ma, avg(a2) AS mb, var_samp(a1) AS va, var_samp(a2) AS vb, covar_samp(a1, a2) AS c FROM wide)"


@register("two_asset_frontier", f"{_TWO}, g AS (SELECT range / 10 AS w FROM range(11)) SELECT CAST(w AS DOUBLE) AS w, {r6('w * ma + (1 - w) * mb', 'mean', 9)}, {r6('sqrt(w * w * va + (1 - w) * (1 - w) * vb + 2 * w * (1 - w) * c)', 'volatility', 9)}, {r6('(vb - c) / (va + vb - 2 * c)', 'least_weight')} FROM g, s")
def two_asset_frontier(spark, sf_dir):
    w = series.panel(spark, sf_dir).groupBy("idx").pivot("asset", ["1-URGENT", "2-HIGH"]).agg(F.first("r")).toDF("idx", "a", "b")
    s = w.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.covar_samp("a", "b").alias("c"))
    d = s.withColumn("w", F.explode(F.array(*[F.lit(k / 10) for k in range(11)])))
    d = d.select("w", portfolio.two_asset_point("w", "ma", "mb", "va", "vb", "c").alias("p"), portfolio.two_asset_min_weight("va", "vb", "c").alias("least_weight"))
    return d.select("w", (F.round("p.mean", 9) + 0.0).alias("mean"), (F.round("p.volatility", 9) + 0.0).alias("volatility"), (F.round("least_weight", 6) + 0.0).alias("least_weight"))


def _tangency(cost: float) -> str:
    """t(k, v) and u(m, v): the tangency weights after a cost, and the portfolio's mean and variance."""
    e = ", ".join(f"a{k} + {0.05 - cost!r} AS e{k}" for k in range(1, 6))
    slopes = ", ".join(sql_parts.partial_slope(f"t{k}", "x", "y", [f"e{j}" for j in range(1, 6)], f"e{k}", constant=False) for k in range(1, 6))
    held = " + ".join(f"(SELECT v FROM t WHERE k = {k}) * a{k}" for k in range(1, 6))
    return f"{PANEL}, {sql_parts.wide()}, x AS (SELECT idx, key, 1.0 AS y, {e} FROM wide), {slopes}, t AS (SELECT k, b / sum(b) OVER () AS v FROM ({' UNION ALL '.join(f'SELECT {k} AS k, b FROM t{k}' for k in range(1, 6))})), u AS (SELECT avg(p) AS m, var_samp(p) AS v FROM (SELECT {held} AS p FROM wide))"


@register("cost_tangency", f"WITH {_tangency(0.005)} SELECT asset, {r6('max(t.v)', 'weight', 5)} FROM t JOIN named ON named.k = t.k GROUP BY asset")
def cost_tangency(spark, sf_dir):
    u = portfolio.Universe.of(series.panel(spark, sf_dir))
    w = portfolio.cost_adjusted_tangency(u.mean, u.cov, -0.05, 0.005)
    return rounded(spark.createDataFrame([(a, float(x)) for a, x in zip(u.assets, w, strict=True)], "asset string, weight double"), 5)


@register("capital_line", f"WITH {_tangency(0.0)} SELECT {r6('m', 'mean')}, {r6('sqrt(v)', 'volatility')}, {r6('(m + 0.05) / sqrt(v)', 'sharpe')}, {r6('-0.05 + (m + 0.05) / sqrt(v) * 0.03', 'line')}, {r6('0.03 / sqrt(v)', 'share')} FROM u")
def capital_line(spark, sf_dir):
    """The tangency portfolio, what its line gives for a volatility of 0.03, and the share of the portfolio that has it."""
    u = portfolio.Universe.of(series.panel(spark, sf_dir))
    d = portfolio.describe(portfolio.tangency(u.mean, u.cov, -0.05), u.mean, u.cov, -0.05)
    one = spark.createDataFrame([(d["mean"], d["volatility"], d["sharpe"], portfolio.capital_market_line(-0.05, d["sharpe"], 0.03))], "mean double, volatility double, sharpe double, line double")
    return rounded(one.withColumn("share", portfolio.two_fund_share(0.03, "volatility")))


@register("security_line", f"WITH {_MARKET} SELECT asset AS key, {r6('0.001 + covar_samp(r, m) / var_samp(m) * (avg(m) - 0.001)', 'expected')} FROM b GROUP BY asset")
def security_line(spark, sf_dir):
    d = with_market(spark, sf_dir).groupBy("key").agg(stats.beta("r", "m").alias("beta"), F.avg("m").alias("market"))
    return rounded(d.select("key", portfolio.security_market_line("beta", "market", 0.001).alias("expected")))


@register(
    "tail_weights",
    f"""WITH RECURSIVE {sql_parts.normals([42], 1000)}, d AS (SELECT i // 2 AS n, max(z) FILTER (i % 2 = 0) AS a, max(z) FILTER (i % 2 = 1) AS b FROM z GROUP BY 1), r AS (SELECT range / 100 AS w, (range / 100) * (0.1 + 0.2 * a) + (1 - range / 100) * (0.05 + 0.15 * b) AS r FROM d, range(101)),
    q AS (SELECT w, quantile_cont(r, 0.05) AS q FROM r GROUP BY w) SELECT CAST(r.w AS DOUBLE) AS w, {r6('-avg(CASE WHEN r <= q + 1e-12 THEN r END)', 'cvar')} FROM r JOIN q ON q.w = r.w GROUP BY r.w""",
)
def tail_weights(spark, sf_dir):
    return rounded(portfolio.cvar_grid(spark, (0.1, 0.05), (0.2, 0.15), samples=500))


@register("factor_residuals", f"WITH {_FACTORS}, {sql_parts.least_squares('q', 'f', 'r', ['m', 'f2', 'f3'])} SELECT f.key, idx, {r6('a + b_m * m + b_f2 * f2 + b_f3 * f3', 'fitted')}, {r6('r - (a + b_m * m + b_f2 * f2 + b_f3 * f3)', 'residual')} FROM f JOIN q ON q.key = f.key")
def factor_residuals(spark, sf_dir):
    d = with_market(spark, sf_dir).withColumn("f2", F.sin(F.col("idx").cast("double")) / 100).withColumn("f3", F.cos(F.col("idx").cast("double") * 2) / 100)
    return rounded(models.decompose(d, "r", ["m", "f2", "f3"]).select("key", "idx", "fitted", "residual"))


_FIVE = f"{_MARKET}, f AS (SELECT asset AS key, r, m, sin(idx) / 100 AS f2, cos(idx * 2) / 100 AS f3, sin(idx * 3) / 100 AS f4, cos(idx * 5) / 100 AS f5 FROM b)"


@register("five_factors", f"WITH {_FIVE}, {sql_parts.least_squares('q', 'f', 'r', ['m', 'f2', 'f3', 'f4', 'f5'])} SELECT key, {r6('a', 'alpha')}, {r6('b_m', 'market')}, {r6('b_f2', 'size')}, {r6('b_f3', 'value')}, {r6('b_f4', 'momentum')}, {r6('b_f5', 'quality')}, {r6('1 - sse / sst', 'r_squared')} FROM q")
def five_factors(spark, sf_dir):
    t = F.col("idx").cast("double")
    d = with_market(spark, sf_dir).withColumns({"f2": F.sin(t) / 100, "f3": F.cos(t * 2) / 100, "f4": F.sin(t * 3) / 100, "f5": F.cos(t * 5) / 100})
    fit = models.ols(d, "r", ["m", "f2", "f3", "f4", "f5"])
    return rounded(fit.select("key", *[F.col("coefficients")[k].alias(n) for k, n in enumerate(("alpha", "market", "size", "value", "momentum", "quality"))], "r_squared"))


@register(
    "risk_attribution",
    f"""WITH {_MARKET}, g AS (SELECT asset, regr_slope(r, m) AS b, (var_samp(r) - regr_slope(r, m) * regr_slope(r, m) * var_samp(m)) AS d, var_samp(m) AS f FROM b GROUP BY asset), s AS (SELECT pow(sum(0.2 * b), 2) * max(f) AS c, sum(0.04 * d) AS i FROM g)
    SELECT {r6('c + i', 'total', 9)}, {r6('c', 'systematic', 9)}, {r6('i', 'idiosyncratic', 9)}, {r6('c', 'market', 9)} FROM s""",
)
def risk_attribution(spark, sf_dir):
    """Equal weights of the panel's assets against their market."""
    g = with_market(spark, sf_dir).groupBy("key").agg(stats.beta("r", "m").alias("b"), F.var_samp("r").alias("v"), F.var_samp("m").alias("f")).orderBy("key").collect()
    b, f = np.array([[x.b] for x in g]), g[0].f
    out = portfolio.risk_attribution(np.full(len(g), 0.2), b, np.array([[f]]), np.array([x.v for x in g]) - b[:, 0] ** 2 * f)
    return rounded(spark.createDataFrame([(out["total"], out["systematic"], out["idiosyncratic"], out["contributions"][0])], "total double, systematic double, idiosyncratic double, market double"), 9)


@register(
    "long_short",
    f"""WITH {PANEL}, {sql_parts.wide()}, l AS (SELECT a1 - 0.8 * a2 AS r, (a1 + a2 + a3 + a4 + a5) / 5 AS m FROM wide), s AS (SELECT regr_slope(r, m) AS b, var_pop(r) AS v, var_pop(m) AS f FROM l)
    SELECT 'all' AS key, {r6('b', 'beta')}, {r6('b * b * f', 'systematic', 9)}, {r6('greatest(v - b * b * f, 0.0)', 'idiosyncratic', 9)}, {r6('greatest(v - b * b * f, 0.0) / v', 'idiosyncratic_share')} FROM s""",
)
def long_short(spark, sf_dir):
    d = series.panel(spark, sf_dir).groupBy("idx").agg(F.avg("r").alias("m"), F.max(F.when(F.col("asset") == "1-URGENT", F.col("r"))).alias("a"), F.max(F.when(F.col("asset") == "2-HIGH", F.col("r"))).alias("b"))
    d = portfolio.neutrality(d.withColumn("key", F.lit("all")), "a", "b", "m", -0.8)
    return d.select("key", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("beta", 6), ("systematic", 9), ("idiosyncratic", 9), ("idiosyncratic_share", 6))])


@register(
    "risk_parity",
    f"""WITH {_WEIGHTS}, iv AS (SELECT k, 1 / var_samp(r) / sum(1 / var_samp(r)) OVER () AS v FROM named GROUP BY k), pw AS (SELECT 'equal' AS portfolio, k, 0.2 AS v FROM am UNION ALL SELECT 'inverse_variance', k, v FROM iv UNION ALL SELECT 'min_variance', k, v FROM w),
    ps AS (SELECT portfolio, idx, sum(v * r) AS r FROM pw JOIN named ON named.k = pw.k GROUP BY 1, 2) SELECT portfolio, {r6('stddev_samp(r) * sqrt(12)', 'volatility')} FROM ps GROUP BY 1""",
)
def risk_parity(spark, sf_dir):
    """Annual volatility of equal weights, of inverse variances and of the least variance."""
    p = series.panel(spark, sf_dir)
    u, cov = portfolio.Universe.of(p), portfolio.covariance(p)
    least = spark.createDataFrame([(a, float(w)) for a, w in zip(u.assets, portfolio.min_variance(u.cov), strict=True)], "asset string, weight double")
    equal = p.select("asset").distinct().withColumn("weight", F.lit(0.2))
    out = None
    for name, w in {"equal": equal, "inverse_variance": portfolio.inverse_variance(p), "min_variance": least}.items():
        one = portfolio.quadratic_form(w, cov).select(F.lit(name).alias("portfolio"), (F.sqrt("value") * (12**0.5)).alias("volatility"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@register("long_only_weights")
def long_only_weights(spark, sf_dir):
    u = portfolio.Universe.of(series.panel(spark, sf_dir))
    return rounded(spark.createDataFrame([(a, float(x)) for a, x in zip(u.assets, portfolio.long_only(u.mean, u.cov), strict=True)], "asset string, weight double"))


@register("posterior_means")
def posterior_means(spark, sf_dir):
    """Black-Litterman means of the panel's assets: a prior of equal weights, and the view that the first asset gains 0.02."""
    u = portfolio.Universe.of(series.panel(spark, sf_dir))
    views, expected, doubt = np.eye(1, 5), np.array([0.02]), np.array([[1e-4]])
    m = portfolio.black_litterman(u.cov @ np.full(5, 0.2), u.cov, views, expected, doubt)
    return rounded(spark.createDataFrame([(a, float(x)) for a, x in zip(u.assets, m, strict=True)], "asset string, mean double"), 9)


@register("arch_fit")
def arch_fit(spark, sf_dir):
    return models.arch(keyed_panel(spark, sf_dir), 2).select("key", "omega", "alpha", "log_likelihood", "long_run_variance", "forecast_from", "converged", "status")


@register("local_volatility_calls")
def local_volatility_calls(spark, sf_dir):
    """Calls under a volatility that falls with the price, and under a flat one."""
    falling = lambda s: np.clip(0.2 - 0.001 * (s - 100), 0.05, 0.5)
    out = [(float(k), strategies.local_vol_call(100.0, k, 0.05, 1.0, falling, 20.0, 300.0, 140), strategies.local_vol_call(100.0, k, 0.05, 1.0, lambda s: np.full(len(s), 0.2), 20.0, 300.0, 140)) for k in (90.0, 100.0, 110.0)]
    return rounded(spark.createDataFrame(out, "strike double, local double, flat double"), 4)


