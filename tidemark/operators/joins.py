"""Joins of two series: by row number from either end, to the latest row before, and of rows without a partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.operators.returns import by


def align_head(left: DataFrame, right: DataFrame, value: str = "price") -> DataFrame:
    """key, idx, a, b: the values of two tables of series by their row number from the first on, as far as the shorter goes."""
    return _aligned(left, right, value, by(), 1)


def align_tail(left: DataFrame, right: DataFrame, n: int | None = None, value: str = "price") -> DataFrame:
    """align_head counted from the last row back; idx is 0 for the last row, and -1 before it. n: so many rows at most, all if None."""
    d = _aligned(left, right, value, W.Window.partitionBy("key").orderBy(F.col("idx").desc()), -1)
    return d if n is None else d.where(F.col("idx") > -n)


def _aligned(left: DataFrame, right: DataFrame, value: str, order, sign: int) -> DataFrame:
    side = lambda d, name: d.select("key", (sign * (F.row_number().over(order) - 1)).cast("long").alias("idx"), F.col(value).alias(name))
    return side(left, "a").join(side(right, "b"), ["key", "idx"])


def asof(left: DataFrame, right: DataFrame, key: str = "key", at: str = "ts", tie: str = "seq") -> DataFrame:
    """left with match: a struct of right's other columns, of its last row at or before left's by (at, tie); null if there is none.

    One shuffle and one sort of both sides together, without a join of ranges. A right row at the same place counts as before.
    """
    kept = [c for c in right.columns if c not in (key, at, tie)]
    inner = F.struct(*(F.col(c) for c in kept))
    own = F.struct(*(F.col(c) for c in left.columns))
    empty = lambda d, e: F.lit(None).cast(d.select(e.alias("x")).schema["x"].dataType)
    rows = left.select(F.col(key), F.col(at), F.col(tie), F.lit(1).alias("_side"), own.alias("_own"), empty(right, inner).alias("_right"))
    rows = rows.unionByName(right.select(F.col(key), F.col(at), F.col(tie), F.lit(0).alias("_side"), empty(left, own).alias("_own"), inner.alias("_right")))
    order = W.Window.partitionBy(key).orderBy(at, tie, "_side").rowsBetween(W.Window.unboundedPreceding, 0)
    return rows.withColumn("match", F.last("_right", ignorenulls=True).over(order)).where("_side = 1").select("_own.*", "match")


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys right doesn't have; nulls equal nothing, so that their rows stay."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")
