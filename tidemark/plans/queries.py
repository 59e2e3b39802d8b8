"""Queries over the driver's tables, one for each operator, registered with the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.catalog import register
from tidemark.functions import options, rows
from tidemark.operators import backtest, labels, microstructure, models, portfolio, returns, scoring, simulation, stats
from tidemark.plans import series, sql_parts
from tidemark.plans.series import BARS, PANEL, PX, table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, and without negative zeros."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def keyed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.panel(spark, sf_dir).withColumnRenamed("asset", "key")


# --- returns and windows --------------------------------------------------------------------------------------------


@register("returns_simple", f"WITH {PX} SELECT key, idx, {r6('CASE WHEN b = 0 THEN 0.0 ELSE (price - b) / b END', 'r')} FROM (SELECT *, lag(price) OVER (PARTITION BY key ORDER BY idx) AS b FROM px) WHERE b IS NOT NULL")
def returns_simple(spark, sf_dir):
    return rounded(returns.simple_returns(series.px(spark, sf_dir)).select("key", "idx", "r"))


@register("returns_log", f"WITH {PX} SELECT key, idx, {r6('CASE WHEN price > 0 AND b > 0 THEN ln(price / b) ELSE 0.0 END', 'r')} FROM (SELECT *, lag(price) OVER (PARTITION BY key ORDER BY idx) AS b FROM px) WHERE b IS NOT NULL")
def returns_log(spark, sf_dir):
    return rounded(returns.log_returns(series.px(spark, sf_dir)).select("key", "idx", "r"))


@register("returns_cumulative", f"WITH {PANEL} SELECT asset AS key, idx, {r6('product(1 + r) OVER (PARTITION BY asset ORDER BY idx) - 1', 'cumulative')} FROM panel")
def returns_cumulative(spark, sf_dir):
    return rounded(returns.cumulative_returns(keyed_panel(spark, sf_dir)).select("key", "idx", "cumulative"))


_DD = f"WITH {PX}, p AS (SELECT *, max(price) OVER (PARTITION BY key ORDER BY idx) AS peak FROM px), d AS (SELECT key, idx, price, CASE WHEN peak = 0 THEN 0.0 ELSE (price - peak) / peak END AS drawdown FROM p)"


@register("drawdown", f"{_DD} SELECT key, idx, {r6('drawdown', 'drawdown')} FROM d")
def drawdown(spark, sf_dir):
    return rounded(returns.drawdown(series.px(spark, sf_dir)).select("key", "idx", "drawdown"))


@register(
    "drawdown_stats",
    f"""{_DD}, g AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY idx) AS run FROM d),
    l AS (SELECT key, max(n) AS duration FROM (SELECT key, run, sum(CASE WHEN drawdown < 0 THEN 1 ELSE 0 END) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
    w AS (SELECT key, least(min(drawdown), 0.0) AS max_drawdown, avg(CASE WHEN drawdown < 0 THEN drawdown END) AS a, avg(CASE WHEN drawdown < 0 THEN 1.0 ELSE 0.0 END) AS s FROM d GROUP BY 1),
    t AS (SELECT d.key, min(idx) AS trough FROM d JOIN w ON d.key = w.key AND d.drawdown = w.max_drawdown GROUP BY 1),
    b AS (SELECT d.key, min(idx - trough) AS recovery FROM d JOIN t ON d.key = t.key WHERE idx > trough AND drawdown = 0 GROUP BY 1)
    SELECT w.key, {r6('max_drawdown', 'max_drawdown')}, CAST(duration AS BIGINT) AS duration, CASE WHEN max_drawdown < 0 THEN recovery END AS recovery,
    {r6('coalesce(a, 0.0)', 'average_drawdown')}, {r6('s', 'share_below')}
    FROM w JOIN l ON w.key = l.key LEFT JOIN b ON w.key = b.key""",
)
def drawdown_stats(spark, sf_dir):
    return rounded(returns.drawdown_stats(series.px(spark, sf_dir)))


_ROWS = "OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@register("sma", f"WITH {PX} SELECT key, idx, {r6('s', 'sma')} FROM (SELECT key, idx, avg(price) {_ROWS.format(19)} AS s FROM px) WHERE idx >= 19")
def sma(spark, sf_dir):
    return rounded(returns.sma(series.px(spark, sf_dir), 20).select("key", "idx", "sma"))


@register("rolling_std", f"WITH {PX} SELECT key, idx, {r6('s', 'std', 5)} FROM (SELECT key, idx, stddev_samp(price) {_ROWS.format(9)} AS s FROM px) WHERE idx >= 9")
def rolling_std(spark, sf_dir):
    return rounded(returns.rolling_std(series.px(spark, sf_dir), 10, "price").select("key", "idx", "std"), 5)


@register("rolling_volatility", f"WITH {PANEL}, k AS (SELECT asset AS key, idx, r, row_number() OVER (PARTITION BY asset ORDER BY idx) AS n FROM panel) SELECT key, idx, {r6('s', 'volatility')} FROM (SELECT key, idx, n, stddev_samp(r) {_ROWS.format(5)} AS s FROM k) WHERE n >= 6")
def rolling_volatility(spark, sf_dir):
    return rounded(returns.rolling_volatility(keyed_panel(spark, sf_dir), 6).select("key", "idx", "volatility"))


@register("bollinger", f"WITH {PX} SELECT key, idx, {r6('m', 'sma', 5)}, {r6('m + 2 * s', 'upper', 5)}, {r6('m - 2 * s', 'lower', 5)} FROM (SELECT key, idx, avg(price) {_ROWS.format(19)} AS m, stddev_samp(price) {_ROWS.format(19)} AS s FROM px) WHERE idx >= 19")
def bollinger(spark, sf_dir):
    return rounded(returns.bollinger(series.px(spark, sf_dir)).select("key", "idx", "sma", "upper", "lower"), 5)


@register("ema", f"WITH RECURSIVE {BARS}, e AS (SELECT key, idx, close AS e FROM bars WHERE idx = 0 UNION ALL SELECT b.key, b.idx, b.close * (2.0 / 11) + e.e * (1 - 2.0 / 11) FROM e JOIN bars b ON b.key = e.key AND b.idx = e.idx + 1) SELECT key, idx, {r6('e', 'ema', 4)} FROM e")
def ema(spark, sf_dir):
    return rounded(returns.ema(series.bars(spark, sf_dir).select("key", "idx", "close"), 10, "close").select("key", "idx", "ema"), 4)


@register(
    "macd_buys",
    f"""WITH RECURSIVE {BARS}, e AS (SELECT key, idx, close AS f, close AS s, CAST(0 AS DOUBLE) AS signal FROM bars WHERE idx = 0 UNION ALL
    SELECT key, idx, f, s, (f - s) * 0.2 + signal * 0.8 FROM (SELECT b.key, b.idx, b.close * (2.0 / 13) + e.f * (1 - 2.0 / 13) AS f, b.close * (2.0 / 27) + e.s * (1 - 2.0 / 27) AS s, signal FROM e JOIN bars b ON b.key = e.key AND b.idx = e.idx + 1)),
    m AS (SELECT *, lag(f - s - signal) OVER (PARTITION BY key ORDER BY idx) AS before FROM e) SELECT key, idx, {r6('f - s', 'macd', 4)}, {r6('signal', 'signal', 4)} FROM m WHERE before <= 0 AND f - s > signal""",
)
def macd_buys(spark, sf_dir):
    return rounded(returns.macd(series.bars(spark, sf_dir).select("key", "idx", "close"), price="close").where("buy").select("key", "idx", "macd", "signal"), 4)


_LAGS = ", ".join(f"lag(d, {k}) OVER (PARTITION BY key ORDER BY idx) AS l{k}" for k in range(1, 6))
_ACF = " UNION ALL ".join(f"SELECT key, {k} AS lag, {r6(f'sum(d * {"d" if k == 0 else f"l{k}"}) / sum(d * d)', 'rho')} FROM l GROUP BY key" for k in range(6))


@register("acf", f"WITH {PX}, c AS (SELECT key, idx, price - avg(price) OVER (PARTITION BY key) AS d FROM px), l AS (SELECT key, d, {_LAGS} FROM c) {_ACF}")
def acf(spark, sf_dir):
    return rounded(returns.acf(series.px(spark, sf_dir), 5))


_W = returns.ffd_weights(0.4, 0.02)
_FD = " + ".join(f"({w!r}) * lag(price, {k}) OVER (PARTITION BY key ORDER BY idx)" for k, w in enumerate(_W))


@register("frac_diff", f"WITH {PX} SELECT key, idx, {r6('fd', 'fd', 5)} FROM (SELECT key, idx, {_FD} AS fd FROM px) WHERE fd IS NOT NULL")
def frac_diff(spark, sf_dir):
    return rounded(returns.frac_diff(series.px(spark, sf_dir), 0.4, 0.02).select("key", "idx", "fd"), 5)


@register("horizon_sums", f"WITH {PANEL}, k AS (SELECT asset AS key, r, row_number() OVER (PARTITION BY asset ORDER BY idx) - 1 AS n FROM panel) SELECT key, CAST(floor(n / 3) AS BIGINT) AS chunk, {r6('sum(r)', 'r')} FROM k GROUP BY 1, 2")
def horizon_sums(spark, sf_dir):
    return rounded(returns.horizon_sums(keyed_panel(spark, sf_dir), 3))


@register("quadratic_variation", f"WITH {PX} SELECT key, {r6('sum(d * d)', 'quadratic_variation', 2)} FROM (SELECT key, price - lag(price) OVER (PARTITION BY key ORDER BY idx) AS d FROM px) GROUP BY key")
def quadratic_variation(spark, sf_dir):
    return rounded(returns.quadratic_variation(series.px(spark, sf_dir)), 2)


# --- aggregates -----------------------------------------------------------------------------------------------------


@register("summary_stats", f"WITH {PX} SELECT key, {r6('avg(price)', 'mean')}, {r6('stddev_samp(price)', 'std')}, {r6('min(price)', 'min')}, {r6('max(price)', 'max')} FROM px GROUP BY key")
def summary_stats(spark, sf_dir):
    return rounded(series.px(spark, sf_dir).groupBy("key").agg(*stats.summary("price")))


@register(
    "moments",
    f"""WITH {PX}, m AS (SELECT key, price - avg(price) OVER (PARTITION BY key) AS d FROM px)
    SELECT key, {r6('sum(d * d) / (count(*) - 1)', 'variance', 4)}, {r6('avg(d * d * d) / pow(avg(d * d), 1.5)', 'skewness')}, {r6('avg(d * d * d * d) / pow(avg(d * d), 2) - 3', 'excess_kurtosis')} FROM m GROUP BY key""",
)
def moments(spark, sf_dir):
    d = series.px(spark, sf_dir).groupBy("key").agg(*stats.moments("price"))
    return rounded(d.withColumn("variance", F.round("variance", 4)))


@register(
    "risk_ratios",
    f"""WITH {PANEL} SELECT asset AS key, {r6('avg(r) / stddev_samp(r) * sqrt(12)', 'sharpe')}, {r6('avg(r) / sqrt(avg(pow(greatest(-r, 0), 2)))', 'sortino')},
    {r6('stddev_samp(r) * sqrt(12)', 'volatility')}, {r6('sum(greatest(r, 0)) / sum(greatest(-r, 0))', 'omega')} FROM panel GROUP BY asset""",
)
def risk_ratios(spark, sf_dir):
    d = keyed_panel(spark, sf_dir).groupBy("key")
    return rounded(d.agg(stats.sharpe("r", 0.0, 12).alias("sharpe"), stats.sortino("r").alias("sortino"), stats.volatility("r", 12).alias("volatility"), stats.omega("r").alias("omega")))


@register(
    "var_cvar",
    f"""WITH {PANEL}, q AS (SELECT asset, quantile_cont(r, 0.1) AS q FROM panel GROUP BY asset)
    SELECT p.asset AS key, {r6('-max(q)', 'var')}, {r6('-avg(CASE WHEN r <= q + 1e-12 THEN r END)', 'cvar')} FROM panel p JOIN q ON p.asset = q.asset GROUP BY p.asset""",
)
def var_cvar(spark, sf_dir):
    return rounded(stats.cvar(keyed_panel(spark, sf_dir), ["key"], "r", 0.9))


_MARKET = f"{PANEL}, b AS (SELECT *, avg(r) OVER (PARTITION BY idx) AS m FROM panel)"


def with_market(spark, sf_dir):
    return keyed_panel(spark, sf_dir).withColumn("m", F.avg("r").over(W.Window.partitionBy("idx")))


@register("information_ratio", f"WITH {_MARKET} SELECT asset AS key, {r6('avg(r - m) / stddev_samp(r - m)', 'information_ratio')} FROM b GROUP BY asset")
def information_ratio(spark, sf_dir):
    return rounded(with_market(spark, sf_dir).groupBy("key").agg(stats.information_ratio("r", "m").alias("information_ratio")))


@register("capm", f"WITH {_MARKET} SELECT asset AS key, {r6('covar_samp(r, m) / var_samp(m)', 'beta')}, {r6('avg(r) - (0.001 + covar_samp(r, m) / var_samp(m) * (avg(m) - 0.001))', 'alpha')} FROM b GROUP BY asset")
def capm(spark, sf_dir):
    return rounded(with_market(spark, sf_dir).groupBy("key").agg(stats.beta("r", "m").alias("beta"), stats.alpha("r", "m", 0.001).alias("alpha")))


@register("ulcer_index", f"{_DD} SELECT key, {r6('sqrt(avg(pow(100 * drawdown, 2)))', 'ulcer')} FROM d GROUP BY key")
def ulcer_index(spark, sf_dir):
    return rounded(returns.drawdown(series.px(spark, sf_dir)).groupBy("key").agg(stats.ulcer().alias("ulcer")))


def _cdf26(x: str) -> str:
    """The normal distribution function by the polynomial 26.2.17."""
    t, tail = f"(1 / (1 + 0.2316419 * abs({x})))", "0.0"
    for c in reversed(rows._P26):
        tail = f"({t} * ({c!r} + {tail}))"
    tail = f"(0.3989423 * exp(-({x}) * ({x}) / 2) * {tail})"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def _psr(benchmark: str) -> str:
    """The probabilistic Sharpe ratio from columns sr, n, skew and kurt."""
    return _cdf26(f"((sr - {benchmark}) * sqrt(n) / sqrt(greatest(1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1), 0)))")


def chance_sharpe(trials: int, var_sharpes: float) -> float:
    """The largest Sharpe ratio that so many trials give by chance."""
    import math

    root = math.sqrt(2 * math.log(trials))
    return max(root - (0.5 * math.log(math.log(trials)) + 0.5772156649) / root, 0.0) * math.sqrt(var_sharpes)


@register(
    "probabilistic_sharpe",
    f"""WITH {PANEL}, d AS (SELECT asset AS key, r, r - avg(r) OVER (PARTITION BY asset) AS d FROM panel),
    g AS (SELECT key, avg(r) / stddev_samp(r) AS sr, count(*) AS n, avg(d * d * d) / pow(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS kurt FROM d GROUP BY key)
    SELECT key, {r6(_psr('0.0'), 'psr')}, {r6(_psr(repr(chance_sharpe(10, 0.01))), 'dsr')} FROM g""",
)
def probabilistic_sharpe(spark, sf_dir):
    g = keyed_panel(spark, sf_dir).groupBy("key").agg(stats.sharpe("r").alias("sr"), F.count("r").alias("n"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"))
    return rounded(g.select("key", rows.probabilistic_sharpe("sr", "n", "skew", "kurt").alias("psr"), rows.deflated_sharpe("sr", "n", "skew", "kurt", 10, 0.01).alias("dsr")))


@register("kelly_size", f"WITH {PANEL}, k AS (SELECT asset, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN r > 0 THEN r END) / avg(CASE WHEN r < 0 THEN -r END) AS b FROM panel GROUP BY asset) SELECT asset AS key, {r6('p - (1 - p) / b', 'kelly')}, {r6('greatest(0, least(1, 0.5 * (p - (1 - p) / b)))', 'size')} FROM k")
def kelly_size(spark, sf_dir):
    return rounded(keyed_panel(spark, sf_dir).groupBy("key").agg(stats.kelly("r").alias("kelly")).withColumn("size", backtest.clamp(0.5 * F.col("kelly"))))


# --- scoring --------------------------------------------------------------------------------------------------------

_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_ZS = ", ".join(f"abs({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{k}" for k, c in enumerate(_FEATURES))


@register("zscore_fit", " UNION ALL ".join(f"SELECT {k} AS place, {r6(f'avg({c})', 'mean', 4)}, {r6(f'stddev_pop({c})', 'std', 4)} FROM lineitem" for k, c in enumerate(_FEATURES)))
def zscore_fit(spark, sf_dir):
    fit = scoring.zscore_fit(series.features(spark, sf_dir), size=4)
    return rounded(fit.select(F.posexplode(F.arrays_zip("means", "stds")).alias("place", "x")).select("place", F.col("x.means").alias("mean"), F.col("x.stds").alias("std")), 4)


_CONF = "count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE NOT y AND NOT p) AS tn, count(*) FILTER (WHERE y AND NOT p) AS fn"
_PRF = "round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1"


@register("zscore_confusion", f"WITH z AS (SELECT l_returnflag = 'R' AS y, {_ZS} FROM lineitem), c AS (SELECT {_CONF} FROM (SELECT y, z0 > 2 OR z1 > 2 OR z2 > 2 OR z3 > 2 AS p FROM z)) SELECT *, {_PRF} FROM c")
def zscore_confusion(spark, sf_dir):
    x = series.features(spark, sf_dir)
    d = scoring.zscore_predict(x, scoring.zscore_fit(x, size=4), 2.0, size=4)
    return rounded(stats.precision_recall(d.agg(*stats.confusion("class", "anomaly"))))


def scored(spark, sf_dir):
    docs, lab = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), table(spark, sf_dir, "labels")
    return docs.join(lab, "doc_id").select(F.col("doc_id").alias("row_id"), "score", (F.col("quality") == 1).alias("label"))


_SCORED = "s AS (SELECT d.doc_id AS row_id, CAST(n_chars AS DOUBLE) AS score, quality = 1 AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@register("threshold_sweep", f"WITH {_SCORED}, c AS (SELECT t AS threshold, {_CONF} FROM (SELECT y, t, score > t AS p FROM s, (VALUES (500.0), (1000.0), (2000.0), (4000.0)) v(t)) GROUP BY t) SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, tn, fn, {_PRF} FROM c")
def threshold_sweep(spark, sf_dir):
    return rounded(scoring.threshold_sweep(scored(spark, sf_dir), [500.0, 1000.0, 2000.0, 4000.0]))


_ROC = f"WITH {_SCORED}, o AS (SELECT y, row_number() OVER w AS n, sum(CASE WHEN y THEN 1 ELSE 0 END) OVER w AS tp FROM s WINDOW w AS (ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING)), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE y) AS pos FROM s)"


@register("roc_curve", f"{_ROC} SELECT CAST(o.n AS BIGINT) AS place, round((o.n - tp) / (t.n - pos), 6) AS fpr, round(tp / pos, 6) AS tpr FROM o, t UNION ALL SELECT 0, 0.0, 0.0")
def roc_curve(spark, sf_dir):
    return rounded(scoring.roc_curve(scored(spark, sf_dir)))


@register("roc_auc", f"{_ROC} SELECT round(sum(CASE WHEN NOT y THEN tp ELSE 0 END) / max(pos * (t.n - pos)), 6) AS auc FROM o, t")
def roc_auc(spark, sf_dir):
    return rounded(scoring.auc(scored(spark, sf_dir)))


@register("calibration", f"WITH {_SCORED}, o AS (SELECT *, row_number() OVER (ORDER BY score, row_id) AS r, count(*) OVER () AS n FROM s) SELECT CAST(least((r - 1) // (n // 10), 9) AS BIGINT) AS bin, count(*) AS n, {r6('avg(score)', 'mean_score')}, {r6('avg(CASE WHEN y THEN 1.0 ELSE 0.0 END)', 'rate')} FROM o GROUP BY 1")
def calibration(spark, sf_dir):
    return rounded(scoring.calibration(scored(spark, sf_dir)))


@register(
    "credit_features",
    f"""WITH x AS (SELECT c_custkey, greatest(c_acctbal, 0) AS income, 100.0 * c_nationkey AS debt, c_nationkey % 9 AS grade FROM customer), y AS (
    SELECT c_custkey, CASE WHEN income = 0 THEN 0.0 ELSE debt / income END AS dti, least(1.0, greatest(0.0, (grade - 1) / 6.0)) AS grade_score FROM x)
    SELECT c_custkey, {r6('dti', 'dti')}, {r6('grade_score', 'grade_score')}, {r6('1 / (1 + exp(-(-1.5 + 0.01 * least(dti, 100) + 2 * grade_score)))', 'proba')} FROM y""",
)
def credit_features(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("income"), (100.0 * F.col("c_nationkey")).alias("debt"), (F.col("c_nationkey") % 9).alias("grade"))
    y = x.select("c_custkey", rows.debt_to_income("income", "debt").alias("dti"), rows.grade_to_score("grade").alias("grade_score"))
    return rounded(y.withColumn("proba", rows.predict_proba(F.array(F.least("dti", F.lit(100.0)), "grade_score"), [0.01, 2.0], -1.5)))


# --- bars -----------------------------------------------------------------------------------------------------------


@register(
    "candles",
    f"""WITH {BARS} SELECT key, idx, {r6('high - low', 'daily_range', 4)}, {r6('close - open', 'body', 4)}, {r6('high - greatest(open, close)', 'upper_shadow', 4)}, {r6('least(open, close) - low', 'lower_shadow', 4)},
    {r6('(high + low + close) / 3', 'typical_price', 4)}, close > open AS is_bullish, abs(close - open) < 0.001 * (high - low) AS is_doji FROM bars""",
)
def candles(spark, sf_dir):
    b = series.bars(spark, sf_dir)
    return rounded(b.select("key", "idx", rows.daily_range().alias("daily_range"), rows.body().alias("body"), rows.upper_shadow().alias("upper_shadow"), rows.lower_shadow().alias("lower_shadow"), rows.typical_price().alias("typical_price"), rows.is_bullish().alias("is_bullish"), rows.is_doji().alias("is_doji")), 4)


@register("volume_spikes", f"WITH {BARS} SELECT key, idx, volume FROM (SELECT key, idx, volume, avg(volume) {_ROWS.format(19)} AS a FROM bars) WHERE idx >= 19 AND volume > 2 * a")
def volume_spikes(spark, sf_dir):
    return returns.volume_spike(series.bars(spark, sf_dir)).where("spike").select("key", "idx", "volume")


_SMA = """x AS (SELECT key, idx, close, avg(close) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s, avg(close) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM bars),
y AS (SELECT *, lag(s) OVER (PARTITION BY key ORDER BY idx) AS ps, lag(l) OVER (PARTITION BY key ORDER BY idx) AS pl FROM x),
g AS (SELECT key, idx, close, CASE WHEN idx < 20 THEN 0 WHEN ps <= pl AND s > l THEN 1 WHEN ps >= pl AND s < l THEN -1 ELSE 0 END AS signal FROM y),
e AS (SELECT key, idx, close, CASE WHEN signal = 1 THEN 1 ELSE 0 END AS position, CAST(CASE WHEN signal = 1 THEN 0 ELSE 10000 END AS DOUBLE) AS cash, CASE WHEN signal = 1 THEN 10000 * CAST(0.999 AS DOUBLE) / close ELSE CAST(0 AS DOUBLE) END AS shares FROM g WHERE idx = 0
  UNION ALL SELECT g.key, g.idx, g.close, CASE WHEN g.signal = 1 THEN 1 WHEN g.signal = -1 THEN 0 ELSE e.position END,
  CASE WHEN g.signal = 1 AND e.position = 0 THEN 0.0 WHEN g.signal = -1 AND e.position = 1 THEN e.shares * g.close * 0.999 ELSE e.cash END,
  CASE WHEN g.signal = 1 AND e.position = 0 THEN e.cash * 0.999 / g.close WHEN g.signal = -1 AND e.position = 1 THEN 0.0 ELSE e.shares END
  FROM e JOIN g ON g.key = e.key AND g.idx = e.idx + 1)"""


def sma_equity(spark, sf_dir):
    return backtest.run(backtest.sma_crossover(series.bars(spark, sf_dir), 5, 20))


@register("sma_backtest_equity", f"WITH RECURSIVE {BARS}, {_SMA} SELECT key, idx, position, {r6('cash + shares * close', 'equity', 3)} FROM e")
def sma_backtest_equity(spark, sf_dir):
    return rounded(sma_equity(spark, sf_dir).select("key", "idx", "position", "equity"), 3)


_SUMMARY = """q AS (SELECT key, idx, position, cash + shares * close AS equity FROM e), r AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, max(equity) OVER w AS peak FROM q WINDOW w AS (PARTITION BY key ORDER BY idx)),
s AS (SELECT key, arg_max(equity * CASE WHEN position = 1 THEN 0.999 ELSE 1.0 END, idx) AS final, avg(r) AS m, stddev_samp(r) AS sd, sqrt(avg(CASE WHEN r IS NOT NULL THEN pow(greatest(-r, 0.0), 2) END)) AS down, min((equity - peak) / peak) AS dd FROM r GROUP BY key)"""


@register(
    "sma_backtest_summary",
    f"""WITH RECURSIVE {BARS}, {_SMA}, {_SUMMARY} SELECT key, {r6('final', 'final_capital', 5)}, {r6('final / 10000 - 1', 'total_return', 5)}, {r6('CASE WHEN coalesce(sd, 0) = 0 THEN 0.0 ELSE m / sd * sqrt(252) END', 'sharpe', 5)},
    {r6('CASE WHEN coalesce(down, 0) = 0 THEN 0.0 ELSE m / down END', 'sortino', 5)}, {r6('coalesce(sd, 0) * sqrt(252)', 'volatility', 5)}, {r6('dd', 'max_drawdown', 5)} FROM s""",
)
def sma_backtest_summary(spark, sf_dir):
    return rounded(backtest.summary(sma_equity(spark, sf_dir)), 5)


@register(
    "sma_backtest_trades",
    f"""WITH RECURSIVE {BARS}, {_SMA}, q AS (SELECT *, lag(position, 1, 0) OVER (PARTITION BY key ORDER BY idx) AS b FROM e),
    t AS (SELECT *, sum(CASE WHEN position = 1 AND b = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY idx) AS trade FROM q),
    gt AS (SELECT key, CAST(trade AS BIGINT) AS trade, min(idx) AS entry, max(idx) AS exit, arg_min(close, idx) AS entry_price, arg_max(close, idx) AS exit_price FROM t WHERE position = 1 OR b = 1 GROUP BY 1, 2)
    SELECT key, trade, entry, exit, {r6('entry_price', 'entry_price')}, {r6('exit_price', 'exit_price')}, {r6('exit_price / entry_price - 1', 'return_pct')} FROM gt""",
)
def sma_backtest_trades(spark, sf_dir):
    return rounded(backtest.trades(sma_equity(spark, sf_dir)))


@register("buy_and_hold", f"WITH {BARS}, f AS (SELECT key, arg_min(close, idx) AS a, arg_max(close, idx) AS z FROM bars GROUP BY key) SELECT key, {r6('10000.0 * 0.999 * 0.999 * z / a', 'final_capital', 3)} FROM f")
def buy_and_hold(spark, sf_dir):
    e = backtest.run(backtest.buy_and_hold(series.bars(spark, sf_dir)))
    return rounded(backtest.summary(e).select("key", "final_capital"), 3)


def tb_sql(upper: float, lower: float, horizon: int, entry: str, px: str = PX) -> str:
    """z (the last row of each key) and tb: the events of the barriers for the rows a that entry picks."""
    out = f"(b.price / a.price - 1 >= {upper} OR b.price / a.price - 1 <= {lower})"
    return f"""{px}, z AS (SELECT key, max(idx) AS m FROM px GROUP BY key),
h AS (SELECT a.key, a.idx, min(b.idx) AS hit FROM px a JOIN z ON z.key = a.key JOIN px b ON a.key = b.key AND b.idx > a.idx AND b.idx <= a.idx + {horizon} AND {out} WHERE {entry} AND a.price > 0 GROUP BY 1, 2),
ev AS (SELECT a.key, a.idx AS entry, coalesce(h.hit, least(a.idx + {horizon}, z.m)) AS exit, h.hit IS NULL AS late, a.price AS p0 FROM px a JOIN z ON a.key = z.key LEFT JOIN h ON h.key = a.key AND h.idx = a.idx WHERE {entry} AND a.price > 0),
tb AS (SELECT ev.key, entry, exit, CASE WHEN late THEN 'Time' WHEN x.price / p0 - 1 >= {upper} THEN 'Upper' ELSE 'Lower' END AS label, x.price / p0 - 1 AS return_pct, exit - entry AS holding FROM ev JOIN px x ON x.key = ev.key AND x.idx = ev.exit)"""


@register("momentum", f"WITH {PX}, m AS (SELECT key, idx, price / lag(price, 20) OVER (PARTITION BY key ORDER BY idx) - 1 AS m FROM px), n AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY m DESC, key) AS u, row_number() OVER (PARTITION BY idx ORDER BY m, key) AS l FROM m WHERE idx % 21 = 0 AND m IS NOT NULL) SELECT key, idx, {r6('m', 'momentum')}, CASE WHEN l <= 2 THEN -1 WHEN u <= 2 THEN 1 ELSE 0 END AS side FROM n")
def momentum(spark, sf_dir):
    return rounded(backtest.momentum(series.px(spark, sf_dir)))


@register(
    "event_backtest",
    f"""WITH {tb_sql(0.3, -0.3, 10, 'a.idx % 5 = 0 AND a.idx < z.m')}, s AS (SELECT key, count(*) AS n_events, avg(return_pct) AS m, stddev_samp(return_pct) AS sd,
      avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN return_pct > 0 THEN return_pct END) / nullif(avg(CASE WHEN return_pct < 0 THEN -return_pct END), 0) AS b FROM tb GROUP BY key),
    k AS (SELECT *, greatest(0.0, least(1.0, 0.5 * coalesce(p - (1 - p) / b, 0.0))) AS size FROM s),
    e AS (SELECT tb.key, entry, product(1 + size * return_pct) OVER (PARTITION BY tb.key ORDER BY entry) AS equity FROM tb JOIN k ON k.key = tb.key),
    d AS (SELECT *, max(equity) OVER (PARTITION BY key ORDER BY entry) AS peak FROM e), dd AS (SELECT key, arg_max(equity, entry) - 1 AS total_return, least(min((equity - peak) / peak), 0.0) AS max_drawdown FROM d GROUP BY key),
    f AS (SELECT tb.key, least(entry * 4 // (m + 1), 3) AS fold, CASE WHEN coalesce(stddev_samp(return_pct), 0) = 0 THEN 0.0 ELSE avg(return_pct) / stddev_samp(return_pct) END AS s FROM tb JOIN z ON z.key = tb.key GROUP BY 1, 2),
    v AS (SELECT key, avg(s) AS s FROM f GROUP BY key)
    SELECT k.key, n_events, {r6('size', 'size')}, {r6('CASE WHEN coalesce(sd, 0) = 0 THEN 0.0 ELSE m / sd END', 'sharpe')}, {r6('ln(1 + total_return)', 'log_growth')}, {r6('max_drawdown', 'max_drawdown')}, {r6('v.s', 'mean_fold_sharpe')}
    FROM k JOIN dd ON dd.key = k.key JOIN v ON v.key = k.key""",
)
def event_backtest(spark, sf_dir):
    """The growth is given as a logarithm: these prices jump by factors."""
    d = backtest.event_backtest(series.px(spark, sf_dir), labels.TripleBarrier(0.3, -0.3, 10))
    return rounded(d.withColumn("total_return", F.log1p("total_return")).withColumnRenamed("total_return", "log_growth"))


# --- labels ---------------------------------------------------------------------------------------------------------

_TB = tb_sql(0.3, -0.3, 10, "true")


def events(spark, sf_dir):
    return labels.triple_barrier(series.px(spark, sf_dir), labels.TripleBarrier(0.3, -0.3, 10))


@register("triple_barrier", f"WITH {_TB} SELECT key, entry, exit, label, {r6('return_pct', 'return_pct')}, holding FROM tb")
def triple_barrier(spark, sf_dir):
    return rounded(events(spark, sf_dir))


@register("binary_labels", f"WITH {_TB} SELECT key, entry, CASE label WHEN 'Upper' THEN 1 WHEN 'Lower' THEN 0 ELSE CASE WHEN return_pct >= 0 THEN 1 ELSE 0 END END AS y, CASE label WHEN 'Upper' THEN 1 WHEN 'Lower' THEN -1 ELSE 0 END AS y3 FROM tb")
def binary_labels(spark, sf_dir):
    return events(spark, sf_dir).select("key", "entry", labels.to_binary().alias("y"), labels.to_ternary().alias("y3"))


@register("fixed_horizon", f"WITH {PX}, z AS (SELECT key, max(idx) AS m FROM px GROUP BY key) SELECT a.key, a.idx AS entry, b.idx AS exit, CASE WHEN b.price / a.price - 1 >= 0.1 THEN 'Upper' WHEN b.price / a.price - 1 < -0.1 THEN 'Lower' ELSE 'Time' END AS label, {r6('b.price / a.price - 1', 'return_pct')}, b.idx - a.idx AS holding FROM px a JOIN z ON a.key = z.key JOIN px b ON b.key = a.key AND b.idx = least(a.idx + 7, z.m) WHERE a.price > 0")
def fixed_horizon(spark, sf_dir):
    return rounded(labels.fixed_horizon(series.px(spark, sf_dir), 7, 0.1))


@register(
    "dynamic_barrier",
    f"""WITH {PX}, z AS (SELECT key, max(idx) AS m FROM px GROUP BY key), lr AS (SELECT *, CASE WHEN idx > 0 THEN CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price / lag(price) OVER w) ELSE 0.0 END END AS r FROM px WINDOW w AS (PARTITION BY key ORDER BY idx)),
    v AS (SELECT key, idx, price, CASE count(r) OVER w WHEN 0 THEN 0.01 WHEN 1 THEN NULL ELSE stddev_samp(r) OVER w END AS v FROM lr WINDOW w AS (PARTITION BY key ORDER BY idx ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)),
    h AS (SELECT a.key, a.idx, min(b.idx) AS hit FROM v a JOIN px b ON a.key = b.key AND b.idx > a.idx AND b.idx <= a.idx + 10 AND (b.price / a.price - 1 >= v OR b.price / a.price - 1 <= -v) WHERE a.price > 0 GROUP BY 1, 2),
    e AS (SELECT v.key, v.idx AS entry, coalesce(hit, least(v.idx + 10, m)) AS exit, hit IS NULL AS late, price AS p0, v FROM v JOIN z ON z.key = v.key LEFT JOIN h ON h.key = v.key AND h.idx = v.idx WHERE price > 0)
    SELECT e.key, entry, exit, CASE WHEN late THEN 'Time' WHEN x.price / p0 - 1 >= v THEN 'Upper' ELSE 'Lower' END AS label, {r6('x.price / p0 - 1', 'return_pct')}, exit - entry AS holding FROM e JOIN px x ON x.key = e.key AND x.idx = e.exit""",
)
def dynamic_barrier(spark, sf_dir):
    return rounded(labels.dynamic_barrier(series.px(spark, sf_dir), 1.0, 20, 10))


@register(
    "trend_scanning",
    f"""WITH {PX}, z AS (SELECT key, max(idx) AS m FROM px GROUP BY key), s AS (SELECT a.key, a.idx, a.price, CAST(h AS BIGINT) AS h, least(a.idx + h, m) AS stop FROM px a JOIN z ON z.key = a.key, range(3, 13) t(h) WHERE a.price > 0),
    g AS (SELECT s.key, s.idx, s.price, h, stop, count(*) AS n, regr_sxx(b.price, b.idx) AS sxx, regr_syy(b.price - s.price, b.idx) AS syy, regr_sxy(b.price - s.price, b.idx) AS sxy FROM s JOIN px b ON b.key = s.key AND b.idx BETWEEN s.idx AND s.stop GROUP BY ALL),
    t AS (SELECT *, CASE WHEN n < 3 OR syy - sxy * sxy / sxx <= 1e-9 * greatest(syy, 1e-300) THEN 0.0 ELSE sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) END AS t FROM g),
    c AS (SELECT * EXCLUDE (b), b.stop AS exit, b.t AS t FROM (SELECT key, idx, price, max_by({{'stop': stop, 't': t}}, {{'a': round(abs(t), 9), 'h': -h}}) AS b FROM t GROUP BY 1, 2, 3))
    SELECT c.key, c.idx AS entry, exit, CASE WHEN x.price / c.price - 1 >= 0 THEN 'Upper' ELSE 'Lower' END AS label, {r6('x.price / c.price - 1', 'return_pct', 4)}, exit - c.idx AS holding, {r6('t', 't_stat', 4)} FROM c JOIN px x ON x.key = c.key AND x.idx = c.exit""",
)
def trend_scanning(spark, sf_dir):
    return rounded(labels.trend_scanning(series.px(spark, sf_dir), 3, 12), 4)


@register("concurrent_events", f"WITH {_TB} SELECT p.key, p.idx, count(tb.entry) AS n FROM px p LEFT JOIN tb ON tb.key = p.key AND p.idx BETWEEN tb.entry AND tb.exit GROUP BY 1, 2")
def concurrent_events(spark, sf_dir):
    return labels.concurrent_events(events(spark, sf_dir), series.px(spark, sf_dir))


@register(
    "sample_weights",
    f"""WITH {_TB}, c AS (SELECT p.key, p.idx, count(*) AS n FROM px p JOIN tb ON tb.key = p.key AND p.idx BETWEEN tb.entry AND tb.exit GROUP BY 1, 2),
    u AS (SELECT tb.key, tb.entry, avg(1.0 / n) AS u, 1.0 / avg(n) AS w FROM tb JOIN c ON c.key = tb.key AND c.idx BETWEEN tb.entry AND tb.exit GROUP BY 1, 2)
    SELECT key, entry, {r6('u', 'uniqueness')}, {r6('w / sum(w) OVER (PARTITION BY key)', 'weight', 9)} FROM u""",
)
def sample_weights(spark, sf_dir):
    d = labels.uniqueness(events(spark, sf_dir), series.px(spark, sf_dir))
    return d.select("key", "entry", (F.round("uniqueness", 6) + 0.0).alias("uniqueness"), (F.round("weight", 9) + 0.0).alias("weight"))


@register(
    "purged_kfold",
    f"""WITH {_TB}, f AS (SELECT key, fold, fold * ((m + 1) // 4) AS s, CASE WHEN fold = 3 THEN m + 1 ELSE (fold + 1) * ((m + 1) // 4) END AS e FROM z, (VALUES (0), (1), (2), (3)) v(fold)),
    r AS (SELECT tb.key, fold, CASE WHEN entry >= s AND entry < e THEN 'test' WHEN entry < e AND exit > s THEN 'purged' WHEN entry >= e AND entry < e + 20 THEN 'embargoed' ELSE 'train' END AS role FROM tb JOIN f ON f.key = tb.key)
    SELECT key, fold, role, count(*) AS n FROM r GROUP BY 1, 2, 3""",
)
def purged_kfold(spark, sf_dir):
    n = series.px(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))
    return labels.purged_kfold(events(spark, sf_dir), n, 4, 20).groupBy("key", "fold", "role").agg(F.count("*").alias("n"))


@register(
    "walk_forward",
    f"""WITH {PX}, n AS (SELECT key, count(*) AS n FROM px GROUP BY key), w AS (SELECT key, CAST(k AS INT) AS split, k * 100 + 400 AS s, k * 100 + 500 AS e FROM n, (SELECT unnest(range(1000000)) AS k) WHERE k * 100 + 500 <= n)
    SELECT px.key, split, count(*) AS n, {r6('avg(price)', 'mean')} FROM px JOIN w ON w.key = px.key AND idx >= s AND idx < e GROUP BY 1, 2""",
)
def walk_forward(spark, sf_dir):
    return rounded(labels.test_rows(series.px(spark, sf_dir), 400, 100, 100).groupBy("key", "split").agg(F.count("*").alias("n"), F.avg("price").alias("mean")))


# --- options --------------------------------------------------------------------------------------------------------


def option_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("s"), (0.1 + 0.005 * F.col("p_size")).alias("sigma"), (0.25 + 0.05 * (F.col("p_size") % 10)).alias("t"))
    return p.withColumn("m", F.explode(F.array(*map(F.lit, (0.8, 1.0, 1.2))))).withColumn("k", F.col("s") * F.col("m")).withColumn("is_call", F.col("p_partkey") % 2 == 0)


def _erf(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x})))"
    poly = f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"


def _cdf(x: str) -> str:
    return f"(0.5 * (1 + {_erf(f'(({x}) / sqrt(2.0))')}))"


_GRID = """g AS (SELECT p_partkey, p_retailprice AS s, 0.1 + 0.005 * p_size AS sigma, 0.25 + 0.05 * (p_size % 10) AS t, m, p_retailprice * m AS k, p_partkey % 2 = 0 AS is_call FROM part, (VALUES (0.8), (1.0), (1.2)) v(m)),
d AS (SELECT *, (ln(s / k) + (0.05 + sigma * sigma / 2) * t) / (sigma * sqrt(t)) AS d1, k * exp(-0.05 * t) AS w FROM g), q AS (SELECT *, d1 - sigma * sqrt(t) AS d2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS n FROM d)"""


@register("option_prices", f"WITH {_GRID} SELECT p_partkey, CAST(m AS DOUBLE) AS m, {r6(f'CASE WHEN is_call THEN s * {_cdf("d1")} - w * {_cdf("d2")} ELSE w * {_cdf("-d2")} - s * {_cdf("-d1")} END', 'price', 4)} FROM q")
def option_prices(spark, sf_dir):
    return rounded(option_grid(spark, sf_dir).select("p_partkey", "m", options.price("s", "k", 0.05, "sigma", "t", "is_call").alias("price")), 4)


@register(
    "option_greeks",
    f"""WITH {_GRID} SELECT p_partkey, CAST(m AS DOUBLE) AS m, {r6(f'{_cdf("d1")} - CASE WHEN is_call THEN 0 ELSE 1 END', 'delta')}, {r6('n / (s * sigma * sqrt(t))', 'gamma')}, {r6('s * n * sqrt(t)', 'vega', 4)},
    {r6(f'-s * n * sigma / (2 * sqrt(t)) + CASE WHEN is_call THEN -0.05 * w * {_cdf("d2")} ELSE 0.05 * w * {_cdf("-d2")} END', 'theta', 4)},
    {r6(f'CASE WHEN is_call THEN t * w * {_cdf("d2")} ELSE -t * w * {_cdf("-d2")} END', 'rho', 4)} FROM q""",
)
def option_greeks(spark, sf_dir):
    a = ("s", "k", 0.05, "sigma", "t")
    g = option_grid(spark, sf_dir).select("p_partkey", "m", options.delta(*a, "is_call").alias("delta"), options.gamma(*a).alias("gamma"), options.vega(*a).alias("vega"), options.theta(*a, "is_call").alias("theta"), options.rho(*a, "is_call").alias("rho"))
    return g.select("p_partkey", "m", *[(F.round(c, 6 if c in ("delta", "gamma") else 4) + 0.0).alias(c) for c in ("delta", "gamma", "vega", "theta", "rho")])


@register("implied_volatility", f"WITH {_GRID} SELECT p_partkey, CAST(m AS DOUBLE) AS m, {r6('sigma', 'iv', 4)} FROM q WHERE m = 1.0")
def implied_volatility(spark, sf_dir):
    d = option_grid(spark, sf_dir).where("m = 1.0").withColumn("p", options.price("s", "k", 0.05, "sigma", "t", "is_call"))
    return rounded(d.select("p_partkey", "m", options.implied_vol("p", "s", "k", 0.05, "t", "is_call")["iv"].alias("iv")), 4)


# --- microstructure -------------------------------------------------------------------------------------------------


def flow(spark, sf_dir):
    """key, seq, price, quantity, side, is_buy: line items of a supplier as orders."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.floor(F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").cast("long").alias("quantity"), F.when(F.col("l_returnflag") == "A", "bid").otherwise("ask").alias("side"), (F.col("l_linestatus") == "O").alias("is_buy"))


_FLOW = "f AS (SELECT l_suppkey AS key, l_orderkey * 10 + l_linenumber AS seq, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_returnflag = 'A' THEN 'bid' ELSE 'ask' END AS side, l_linestatus = 'O' AS is_buy FROM lineitem)"


@register("vwap_imbalance", f"WITH {_FLOW} SELECT key, {r6('sum(price * quantity) / sum(quantity)', 'vwap')}, {r6('sum(CASE WHEN is_buy THEN quantity ELSE -quantity END) / sum(quantity)', 'imbalance')} FROM f GROUP BY key")
def vwap_imbalance(spark, sf_dir):
    return rounded(flow(spark, sf_dir).groupBy("key").agg(stats.vwap().alias("vwap"), stats.trade_imbalance().alias("imbalance")))


@register("book_depth", f"WITH {_FLOW}, l AS (SELECT key, side, price, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS n_orders FROM f GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM l) WHERE level <= 3")
def book_depth(spark, sf_dir):
    return microstructure.depth(flow(spark, sf_dir), 3).select("key", "side", "price", "quantity", "n_orders", "level")


@register("book_quotes", f"WITH {_FLOW}, q AS (SELECT key, max(price) FILTER (WHERE side = 'bid') AS best_bid, min(price) FILTER (WHERE side = 'ask') AS best_ask, CAST(coalesce(sum(quantity) FILTER (WHERE side = 'bid'), 0) AS BIGINT) AS bid_volume, CAST(coalesce(sum(quantity) FILTER (WHERE side = 'ask'), 0) AS BIGINT) AS ask_volume, count(*) AS n_orders FROM f GROUP BY key) SELECT *, (best_bid + best_ask) / 2 AS mid, CASE WHEN best_bid IS NOT NULL AND best_ask IS NOT NULL THEN greatest(best_ask - best_bid, 0) END AS spread FROM q")
def book_quotes(spark, sf_dir):
    return microstructure.quotes(flow(spark, sf_dir))


@register("book_sweep", f"WITH {_FLOW}, a AS (SELECT *, coalesce(sum(quantity) OVER (PARTITION BY key ORDER BY price, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f WHERE side = 'ask') SELECT key, seq, price, CAST(greatest(0, least(quantity, 500 - b)) AS BIGINT) AS quantity FROM a WHERE greatest(0, least(quantity, 500 - b)) > 0")
def book_sweep(spark, sf_dir):
    return microstructure.sweep(flow(spark, sf_dir), True, 500).select("key", "seq", "price", F.col("quantity").cast("long").alias("quantity"))


@register("order_flow_imbalance", f"WITH {PX} SELECT key, idx, {r6('d - lag(d) OVER (PARTITION BY key ORDER BY idx)', 'ofi')} FROM (SELECT key, idx, coalesce(price, 0) - coalesce(CASE WHEN idx % 7 <> 0 THEN price / 2 END, 0) AS d FROM px) QUALIFY idx > 0")
def order_flow_imbalance(spark, sf_dir):
    d = series.px(spark, sf_dir).select("key", "idx", F.col("price").alias("bid_quantity"), F.when(F.col("idx") % 7 != 0, F.col("price") / 2).alias("ask_quantity"))
    return rounded(microstructure.order_flow_imbalance(d))


@register("book_replay")
def book_replay(spark, sf_dir):
    f = flow(spark, sf_dir)
    cmd = F.when(F.col("seq") % 10 == 7, "market").when(F.col("seq") % 10 == 6, "cancel").otherwise("add")
    return microstructure.replay(f.select(F.col("key").cast("string").alias("key"), "seq", cmd.alias("cmd"), F.when(cmd == "cancel", F.col("seq") - 1).otherwise(F.col("seq")).alias("id"), "side", "price", "quantity"))


@register("execution_cost", f"SELECT l_orderkey, l_linenumber, {r6('l_tax / 2', 'half_spread')}, {r6('0.02 * sqrt(abs(l_quantity / 1000))', 'impact')}, {r6('l_tax / 2 + 0.02 * sqrt(abs(l_quantity / 1000))', 'total')} FROM lineitem")
def execution_cost(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("c", rows.execution_cost("l_quantity", 1000.0, 0.02, "l_tax"))
    return rounded(d.select("l_orderkey", "l_linenumber", "c.*"))


# --- portfolios, factors and models ---------------------------------------------------------------------------------


@register("covariance", f"WITH {PANEL} SELECT a.asset AS i, b.asset AS j, {r6('covar_samp(a.r, b.r)', 'cov', 9)}, count(*) AS n FROM panel a JOIN panel b ON a.idx = b.idx GROUP BY 1, 2")
def covariance(spark, sf_dir):
    return rounded(portfolio.covariance(series.panel(spark, sf_dir)), 9)


@register("inverse_variance", f"WITH {PANEL}, v AS (SELECT asset, 1 / var_samp(r) AS iv FROM panel GROUP BY asset) SELECT asset, {r6('iv / sum(iv) OVER ()', 'weight')} FROM v")
def inverse_variance(spark, sf_dir):
    return rounded(portfolio.inverse_variance(series.panel(spark, sf_dir)))


@register("marginal_risk", f"WITH {PANEL}, c AS (SELECT a.asset AS i, covar_samp(a.r, b.r) AS cov FROM panel a JOIN panel b ON a.idx = b.idx GROUP BY a.asset, b.asset) SELECT i, {r6('sum(cov) / 5', 'marginal', 9)} FROM c GROUP BY i")
def marginal_risk(spark, sf_dir):
    p = series.panel(spark, sf_dir)
    return rounded(portfolio.marginal_risk(p.select("asset").distinct().withColumn("weight", F.lit(0.2)), portfolio.covariance(p)), 9)


_WEIGHTS = f"""{PANEL}, {sql_parts.wide()}, d AS (SELECT idx, key, a1 AS y, {', '.join(f'a1 - a{k} AS d{k}' for k in range(2, 6))} FROM wide), {sql_parts.least_squares('mv', 'd', 'y', ['d2', 'd3', 'd4', 'd5'])},
x AS (SELECT idx, key, 1.0 AS y, {', '.join(f'a{k} + 0.01 AS e{k}' for k in range(1, 6))} FROM wide), {', '.join(sql_parts.partial_slope(f't{k}', 'x', 'y', [f'e{j}' for j in range(1, 6)], f'e{k}', constant=False) for k in range(1, 6))},
w AS (SELECT 1 AS k, 1 - b_d2 - b_d3 - b_d4 - b_d5 AS v FROM mv {' '.join(f'UNION ALL SELECT {k}, b_d{k} FROM mv' for k in range(2, 6))}),
t AS (SELECT k, b / sum(b) OVER () AS v FROM ({' UNION ALL '.join(f'SELECT {k} AS k, b FROM t{k}' for k in range(1, 6))})),
am AS (SELECT k, asset, avg(r) AS m FROM named GROUP BY 1, 2), s AS (SELECT (avg(am.m) - sum(w.v * am.m)) / (sum(t.v * am.m) - sum(w.v * am.m)) AS s FROM w JOIN t ON t.k = w.k JOIN am ON am.k = w.k)"""


@register(
    "optimal_portfolios",
    f"""WITH {_WEIGHTS} SELECT 'min_variance' AS portfolio, asset, {r6('v', 'weight')} FROM w JOIN am ON am.k = w.k UNION ALL SELECT 'tangency', asset, {r6('v', 'weight')} FROM t JOIN am ON am.k = t.k
    UNION ALL SELECT 'frontier', asset, {r6('w.v + s * (t.v - w.v)', 'weight')} FROM w JOIN t ON t.k = w.k JOIN am ON am.k = w.k, s""",
)
def optimal_portfolios(spark, sf_dir):
    """Weights of least variance and of the tangency are regression coefficients, and any frontier portfolio is a mix of two: so the SQL needs no inverse."""
    u = portfolio.Universe.of(series.panel(spark, sf_dir))
    out = {"min_variance": portfolio.min_variance(u.cov), "tangency": portfolio.tangency(u.mean, u.cov, -0.01), "frontier": portfolio.frontier_point(u.mean, u.cov, float(u.mean.mean()))}
    return rounded(spark.createDataFrame([(n, a, float(x)) for n, w in out.items() for a, x in zip(u.assets, w, strict=True)], "portfolio string, asset string, weight double"))


_PCA = f"{PANEL}, {sql_parts.wide()}, {sql_parts.components(3)}, centred AS (SELECT idx, asset, k, avg(r) OVER (PARTITION BY asset) AS m, r - avg(r) OVER (PARTITION BY asset) AS x FROM named), scored AS (SELECT idx, c, sum(x * v) AS score FROM centred JOIN vec ON vec.k = centred.k GROUP BY 1, 2)"


@register("pca_scores", f"WITH RECURSIVE {_PCA} SELECT idx, CAST(c AS INT) AS component, {r6('score', 'score')} FROM scored")
def pca_scores(spark, sf_dir):
    p = series.panel(spark, sf_dir)
    return rounded(portfolio.Pca.fit(p, 3).transform(p))


@register("pca_reconstruction", f"WITH RECURSIVE {_PCA} SELECT scored.idx, asset, {r6('max(m) + sum(score * v)', 'r')} FROM scored JOIN vec ON vec.c = scored.c JOIN centred ON centred.idx = scored.idx AND centred.k = vec.k GROUP BY 1, 2")
def pca_reconstruction(spark, sf_dir):
    """What three of five components tell of the returns."""
    p = series.panel(spark, sf_dir)
    fit = portfolio.Pca.fit(p, 3)
    return rounded(fit.reconstruct(fit.transform(p)))


@register("ols_market", f"WITH {_MARKET} SELECT asset AS key, count(*) AS n, {r6('regr_intercept(r, m)', 'intercept')}, {r6('regr_slope(r, m)', 'slope')}, {r6('regr_r2(r, m)', 'r_squared')} FROM b GROUP BY asset")
def ols_market(spark, sf_dir):
    fit = models.ols(with_market(spark, sf_dir), "r", ["m"])
    return rounded(fit.select("key", "n", F.col("coefficients")[0].alias("intercept"), F.col("coefficients")[1].alias("slope"), "r_squared"))


_FACTORS = f"{_MARKET}, f AS (SELECT asset AS key, idx, r, m, sin(idx) / 100 AS f2, cos(idx * 2) / 100 AS f3 FROM b)"


@register(
    "three_factors",
    f"""WITH {_FACTORS}, {sql_parts.least_squares('q', 'f', 'r', ['m', 'f2', 'f3'])} SELECT key, {r6('a', 'alpha')}, {r6('b_m', 'market')}, {r6('b_f2', 'size')}, {r6('b_f3', 'value')}, {r6('sse / greatest(n - 4, 1)', 'residual_variance')}, {r6('1 - sse / sst', 'r_squared')} FROM q""",
)
def three_factors(spark, sf_dir):
    d = with_market(spark, sf_dir).withColumn("f2", F.sin(F.col("idx").cast("double")) / 100).withColumn("f3", F.cos(F.col("idx").cast("double") * 2) / 100)
    fit = models.ols(d, "r", ["m", "f2", "f3"])
    return rounded(fit.select("key", *[F.col("coefficients")[k].alias(n) for k, n in enumerate(("alpha", "market", "size", "value"))], (F.col("sse") / F.greatest(F.col("n") - 4, F.lit(1))).alias("residual_variance"), "r_squared"))


_CHANGED = "d AS (SELECT key, idx, lag(price) OVER (PARTITION BY key ORDER BY idx) AS l, price - lag(price) OVER (PARTITION BY key ORDER BY idx) AS d FROM px)"


@register(
    "adf_test",
    f"""WITH {PX}, {_CHANGED}, e AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY key ORDER BY idx)), {sql_parts.partial_slope('q', 'e', 'd', ['l', 'd1', 'd2'], 'l')},
    t AS (SELECT key, n, b / sqrt(sse / (n - 4) / tt) AS t FROM q) SELECT key, n, {r6('t', 'statistic', 5)}, t < -2.86 AS stationary, CAST(NULL AS VARCHAR) AS status FROM t""",
)
def adf_test(spark, sf_dir):
    return rounded(models.adf(series.px(spark, sf_dir), 2), 5)


@register("min_frac_diff")
def min_frac_diff(spark, sf_dir):
    return rounded(models.find_min_d(series.bars(spark, sf_dir).select("key", "idx", F.col("close").alias("price"))))


@register(
    "cusum_breaks",
    f"""WITH RECURSIVE {PX}, d AS (SELECT key, idx, price - avg(price) OVER (PARTITION BY key) AS x FROM px), c AS (SELECT key, idx, greatest(x - 5, 0.0) AS up, greatest(-x - 5, 0.0) AS down FROM d WHERE idx = 0
    UNION ALL SELECT d.key, d.idx, greatest(CASE WHEN up > 500 OR down > 500 THEN 0.0 ELSE up END + x - 5, 0.0), greatest(CASE WHEN up > 500 OR down > 500 THEN 0.0 ELSE down END - x - 5, 0.0) FROM c JOIN d ON d.key = c.key AND d.idx = c.idx + 1)
    SELECT key, idx, CASE WHEN up > 500 THEN 'up' ELSE 'down' END AS direction, CAST(0.95 AS DOUBLE) AS confidence FROM c WHERE up > 500 OR down > 500""",
)
def cusum_breaks(spark, sf_dir):
    d = series.px(spark, sf_dir)
    m = d.groupBy("key").agg(F.avg("price").alias("m"))
    return models.cusum(d.join(m, "key").select("key", "idx", (F.col("price") - F.col("m")).alias("price")), 500.0, 5.0)


@register("arch_variance", f"WITH {PANEL} SELECT asset AS key, idx, {r6('0.0001 + 0.3 * coalesce(pow(lag(r) OVER w, 2), 0) + 0.2 * coalesce(pow(lag(r, 2) OVER w, 2), 0)', 'variance', 9)} FROM panel WINDOW w AS (PARTITION BY asset ORDER BY idx)")
def arch_variance(spark, sf_dir):
    return rounded(models.arch_variances(keyed_panel(spark, sf_dir), 1e-4, [0.3, 0.2]).select("key", "idx", "variance"), 9)


@register("ewma_variance", f"WITH RECURSIVE {PANEL}, k AS (SELECT asset AS key, idx, r, row_number() OVER (PARTITION BY asset ORDER BY idx) AS n FROM panel), e AS (SELECT key, idx, n, r, r * r AS v FROM k WHERE n = 1 UNION ALL SELECT k.key, k.idx, k.n, k.r, 0.94 * e.v + 0.06 * e.r * e.r FROM e JOIN k ON k.key = e.key AND k.n = e.n + 1) SELECT key, idx, {r6('v', 'variance', 9)} FROM e")
def ewma_variance(spark, sf_dir):
    return rounded(models.ewma_vol(keyed_panel(spark, sf_dir)).select("key", "idx", "variance"), 9)


@register("garch_fit")
def garch_fit(spark, sf_dir):
    return models.garch(keyed_panel(spark, sf_dir)).select("key", "omega", "persistence", "log_likelihood", "status")


_TERMINAL = f"{sql_parts.normals([7], 20_000)}, p AS (SELECT i, 100 * exp((0.05 - 0.2 * 0.2 / 2) * 1.0 + 0.2 * sqrt(1.0) * z) AS v FROM z)"


@register("monte_carlo_call", f"WITH RECURSIVE {_TERMINAL}, g AS (SELECT greatest(v - 100, 0.0) * exp(-0.05) AS g FROM p) SELECT {r6('avg(g)', 'price')}, {r6('stddev_samp(g) / sqrt(count(*))', 'std_error')}, count(*) AS n FROM g")
def monte_carlo_call(spark, sf_dir):
    return rounded(simulation.mc_price(spark, 100.0, 100.0, 0.05, 0.2, 1.0, 20_000, 7))


@register("gbm_paths", f"WITH RECURSIVE {sql_parts.gbm(42, 100.0, 0.05, 0.2, 1.0, 12, 500)} SELECT path_id, step, {r6('value', 'value')} FROM g")
def gbm_paths(spark, sf_dir):
    return rounded(simulation.gbm_paths(spark, 100.0, 0.05, 0.2, 1.0, 12, 500, 42))
