"""Anomaly scores and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.functions.rows import ratio
from tidemark.operators import stats


def range_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the least and largest values of columns, as min_ and max_ and their names, for rows.normalize."""
    return df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])


def zscore_fit(df: DataFrame, features: str = "features", size: int | None = None) -> DataFrame:
    """One row: means and population deviations of each place of the array, as arrays. No rows: empty arrays, or nulls.

    size: how long the arrays are; then one pass sums all places, without a row for each.
    """
    if size is not None:
        x = [F.get(features, F.lit(k)) for k in range(size)]
        return df.agg(F.array(*map(F.avg, x)).alias("means"), F.array(*map(F.stddev_pop, x)).alias("stds"))
    one = df.select(F.posexplode(features).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return one.agg(F.sort_array(F.collect_list(F.struct("pos", "m", "s"))).alias("fit")).select(F.col("fit.m").alias("means"), F.col("fit.s").alias("stds"))


def zscores(features="features") -> Column:
    """Absolute z-scores from columns means and stds; null where a deviation is 0."""
    z = F.arrays_zip(F.col(features).alias("x"), F.col("means").alias("m"), F.col("stds").alias("s"))
    return F.transform(z, lambda e: F.abs(e["x"] - e["m"]) / F.nullif(e["s"], F.lit(0.0)))


def zscore_predict(df: DataFrame, fit: DataFrame, threshold: float = 3.0, features: str = "features", size: int | None = None) -> DataFrame:
    """Adds anomaly, whether any z-score is above threshold, and triggers, the places that are. The fit is one row, and broadcast.

    size: how long the arrays are; then the places are plain columns.
    """
    d = df.crossJoin(F.broadcast(fit))
    if size is not None:
        x, m, s = ([F.get(c, F.lit(k)) for k in range(size)] for c in (features, "means", "stds"))
        above = [F.coalesce(F.abs(a - b) / F.nullif(c, F.lit(0.0)) > threshold, F.lit(False)) for a, b, c in zip(x, m, s, strict=True)]
        hit = F.array_compact(F.array(*[F.when(y, k) for k, y in enumerate(above)]))
        anomaly = above[0]
        for y in above[1:]:
            anomaly = anomaly | y
        return d.withColumn("triggers", hit).withColumn("anomaly", anomaly).drop("means", "stds")
    d = d.withColumn("_z", zscores(features)).drop("means", "stds")
    hit = F.filter(F.transform("_z", lambda z, i: F.when(z > threshold, i)), lambda i: i.isNotNull())
    return d.withColumn("triggers", hit).withColumn("anomaly", F.size("triggers") > 0).drop("_z")


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str = "score", label: str = "label", strict: bool = True) -> DataFrame:
    """threshold, tp, fp, tn, fn, precision, recall, f1: one pass, as conditional counts."""
    t = F.explode(F.array(*map(F.lit, thresholds)))
    d = df.select(score, label, t.alias("threshold"))
    p = F.col(score) > F.col("threshold") if strict else F.col(score) >= F.col("threshold")
    return stats.precision_recall(d.groupBy("threshold").agg(*stats.confusion(label, p)))


#: Rows of a range of the order of scores, about, and ranges at least.
RANGE_ROWS, LEAST_RANGES = 1_000_000, 64


def _ranges(df: DataFrame, score: str, tie: str, parts: int | None) -> DataFrame:
    """df with _part and _sub, which rise in the order of falling scores and rising ties.

    Ranges of scores are cut by approximate quantiles. A score that fills more than one range is a range of its own,
    which is cut by quantiles of its ties, where these are numbers.
    """
    parts = max(LEAST_RANGES, df.count() // RANGE_ROWS) if parts is None else parts
    cuts = df.approxQuantile(score, [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    hot = {c: cuts.count(c) for c in cuts if cuts.count(c) > 1}
    c = F.col(score)
    part = F.lit(0)
    below = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else None
    if below is not None:
        part = F.size(F.filter(below, lambda x: c < x))
    if hot:
        part = part + F.size(F.filter(F.array(*[F.lit(x) for x in sorted(hot)]), lambda x: c <= x))
    sub = F.lit(0)
    if df.schema[tie].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double"):
        for x, n in sorted(hot.items()):
            inner = sorted(set(df.where(c == x).approxQuantile(tie, [k / (n + 1) for k in range(1, n + 1)], 0.1 / (n + 1))))
            sub = F.when(c == x, F.size(F.filter(F.array(*[F.lit(y) for y in inner]), lambda y: F.col(tie) >= y))).otherwise(sub)
    return df.withColumn("_part", part).withColumn("_sub", sub)


def _running(df: DataFrame, score: str, label: str, tie: str, parts: int | None) -> DataFrame:
    """df with tp and fp, the labels at or before each row by falling score (then tie): sums of the ranges before, and within one."""
    d = _ranges(df, score, tie, parts).withColumn("_y", F.col(label).cast("long"))
    sums = d.groupBy("_part", "_sub").agg(F.sum("_y").alias("_p"), F.count("*").alias("_n"))  # a row for each range
    before = W.Window.orderBy("_part", "_sub").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select("_part", "_sub", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    inside = W.Window.partitionBy("_part", "_sub").orderBy(F.col(score).desc(), tie).rowsBetween(W.Window.unboundedPreceding, 0)
    d = d.withColumn("_tp", F.sum("_y").over(inside)).withColumn("_rn", F.row_number().over(inside)).join(F.broadcast(sums), ["_part", "_sub"])
    return d.withColumn("tp", F.col("_tp") + F.col("_p")).withColumn("fp", F.col("_rn") + F.col("_n") - F.col("tp")).drop("_part", "_sub", "_y", "_tp", "_rn", "_p", "_n")


def ordinal(df: DataFrame, order: str, tie: str) -> DataFrame:
    """df with nth, a row's place (from 0) by rising order, then tie, without a task that holds all rows. order is a number."""
    d = _running(df.withColumn("_neg", -F.col(order)).withColumn("_one", F.lit(True)), "_neg", "_one", tie, None)
    return d.withColumn("nth", (F.col("tp") + F.col("fp") - 1).cast("long")).drop("tp", "fp", "_neg", "_one")


def chronological(df: DataFrame, order: str, tie: str, share: float = 0.8) -> DataFrame:
    """df with is_train: the first share of the rows in order, rounded down; the rest are the test."""
    n = df.agg(F.floor(F.count("*") * share).alias("_n"))
    return ordinal(df, order, tie).crossJoin(F.broadcast(n)).withColumn("is_train", F.col("nth") < F.col("_n")).drop("nth", "_n")


def discriminative(df: DataFrame, fit: DataFrame, label: str = "class", features: str = "features") -> DataFrame:
    """One row, place and mean_z: the feature whose absolute z-score is largest on average in rows of class 1, the last of equal ones."""
    d = df.where(F.col(label).cast("int") == 1).crossJoin(F.broadcast(fit)).select(F.posexplode(zscores(features)).alias("place", "z"))
    return d.groupBy("place").agg(F.avg("z").alias("mean_z")).agg(F.max(F.struct("mean_z", "place")).alias("b")).select("b.place", "b.mean_z")


def fold_auc(df: DataFrame, n_folds: int = 5, score: str = "score", label: str = "label", order: str = "row_id") -> DataFrame:
    """fold, n, auc of contiguous folds by order (a number), the remainder in the last; ties of scores go by order. One class only: 0.5."""
    n = df.agg(F.count("*").alias("_n"))
    size = F.greatest(F.floor(F.col("_n") / n_folds), F.lit(1))
    d = ordinal(df, order, order).crossJoin(F.broadcast(n)).withColumn("fold", F.least(F.floor(F.col("nth") / size), F.lit(n_folds - 1)).cast("int"))
    y = F.col(label).cast("long")
    below = F.sum(1 - y).over(W.Window.partitionBy("fold").orderBy(score, order).rowsBetween(W.Window.unboundedPreceding, -1))
    g = d.withColumn("_b", F.coalesce(below, F.lit(0)) * y).groupBy("fold").agg(F.count("*").alias("n"), F.sum("_b").alias("_u"), F.sum(y).alias("_p"))
    pairs = F.col("_p") * (F.col("n") - F.col("_p"))
    return g.select("fold", "n", F.when(pairs == 0, 0.5).otherwise(F.col("_u") / F.nullif(pairs, F.lit(0))).alias("auc"))


def best_threshold(df: DataFrame, thresholds: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """One row, threshold and f1: the threshold (scores at it count as above) with the largest F1, the least of equal ones."""
    d = threshold_sweep(df, thresholds, score, label, strict=False)
    return d.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.threshold", "b.f1")


def youden(df: DataFrame, score: str = "score", label: str = "label", tie: str = "row_id") -> DataFrame:
    """One row, place, fpr and tpr: the point of roc_curve with the largest tpr - fpr, the first of equal ones."""
    p = roc_curve(df, score, label, tie)
    return p.agg(F.max_by(F.struct("place", "fpr", "tpr"), F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), -F.col("place"))).alias("b")).select("b.*")


def roc_curve(df: DataFrame, score: str = "score", label: str = "label", tie: str = "row_id", parts: int | None = None) -> DataFrame:
    """place, fpr, tpr: a point for each row by falling score, ties by the column tie, after (0, 0). One class only: (0, 0) and (1, 1)."""
    total = df.agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    d = _running(df, score, label, tie, parts).crossJoin(F.broadcast(total))
    points = d.where("pos > 0 and pos < n").select((F.col("tp") + F.col("fp")).alias("place"), (F.col("fp") / (F.col("n") - F.col("pos"))).alias("fpr"), (F.col("tp") / F.col("pos")).alias("tpr"))
    start = total.where("n > 0").select(F.lit(0).cast("long").alias("place"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    one = total.where("n > 0 and (pos = 0 or pos = n)").select(F.lit(1).cast("long").alias("place"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))
    return points.unionByName(start).unionByName(one)


def auc(df: DataFrame, score: str = "score", label: str = "label", tie: str = "row_id", parts: int | None = None) -> DataFrame:
    """One row, auc: the trapezoids under roc_curve, which for single rows are the true rates at each false one."""
    d = _running(df, score, label, tie, parts)
    got = d.agg(F.sum(F.when(~F.col(label).cast("boolean"), F.col("tp"))).alias("area"), F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    return got.select(F.when(F.col("n") == 0, 0.0).when((F.col("pos") == 0) | (F.col("pos") == F.col("n")), 0.5).otherwise(ratio("area", F.col("pos") * (F.col("n") - F.col("pos")))).alias("auc"))


def calibration(df: DataFrame, bins: int = 10, score: str = "score", label: str = "label", tie: str = "row_id") -> DataFrame:
    """bin, n, mean_score, rate: bins of equal size by rising score, the remainder in the last."""
    n = df.agg(F.count("*").alias("_n"))
    d = _running(df.withColumn("_neg", -F.col(score)), "_neg", label, tie, None).withColumn("_r", F.col("tp") + F.col("fp")).crossJoin(F.broadcast(n))
    cut = F.least(F.floor((F.col("_r") - 1) / F.greatest(F.floor(F.col("_n") / bins), F.lit(1))), F.lit(bins - 1))
    return d.withColumn("bin", cut).groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))
