"""Financial labels, sample weights and cross-validation splits of keyed series (key, idx, price)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.operators.returns import by, log_returns


@dataclass(frozen=True)
class TripleBarrier:
    upper: float = 0.02
    lower: float = -0.02
    horizon: int = 10

    def __post_init__(self):
        if not (self.upper > 0 and self.lower < 0 and self.horizon > 0):
            raise ValueError("upper and horizon must be positive, lower negative")


def _gain(later: Column) -> Column:
    """The return from a row's price to a later one. Null from 0: what selects entries by price may run together with filters on their labels."""
    return F.try_divide(later, F.col("price")) - 1


def _event(kind: Column, exit_idx: Column, exit_price: Column) -> list[Column]:
    return ["key", F.col("idx").alias("entry"), exit_idx.alias("exit"), kind.alias("label"), _gain(exit_price).alias("return_pct"), (exit_idx - F.col("idx")).alias("holding")]


def _scan(df: DataFrame, up: Column, low: Column, horizon: int, entry: Column) -> DataFrame:
    """The first later row within horizon whose return reaches up or low (up first), else the last such row."""
    ahead = F.collect_list(F.struct(F.col("idx").alias("i"), F.col("price").alias("p"))).over(by().rowsBetween(1, horizon))
    d = df.withColumn("_a", ahead).withColumn("_u", up).withColumn("_l", low).where(entry & (F.col("price") > 0))
    gone = F.filter("_a", lambda x: (_gain(x["p"]) >= F.col("_u")) | (_gain(x["p"]) <= F.col("_l")))
    d = d.withColumn("_hit", F.get(gone, F.lit(0))).withColumn("_last", F.get("_a", F.size("_a") - 1))
    kind = F.when(F.col("_hit").isNull(), "Time").when(_gain(F.col("_hit.p")) >= F.col("_u"), "Upper").otherwise("Lower")
    at = F.coalesce("_hit", "_last", F.struct(F.col("idx").alias("i"), F.col("price").alias("p")))
    return d.withColumn("_at", at).select(*_event(kind, F.col("_at.i"), F.col("_at.p")))


def triple_barrier(df: DataFrame, config: TripleBarrier, entry: Column | None = None) -> DataFrame:
    """key, entry, exit, label (Upper, Lower, Time), return_pct, holding for each entry row; rows of prices that aren't positive are no entries."""
    return _scan(df, F.lit(config.upper), F.lit(config.lower), config.horizon, F.lit(True) if entry is None else entry)


def dynamic_barrier(df: DataFrame, n_std: float = 2.0, window: int = 20, horizon: int = 10, entry: Column | None = None) -> DataFrame:
    """triple_barrier with barriers of n_std deviations of the trailing log returns; with exactly one return, always Time."""
    lr = log_returns(df).select("key", "idx", F.col("r").alias("_r"))
    d = df.join(lr, ["key", "idx"], "left")
    frame = by().rowsBetween(-(window - 2), 0)
    n, sd = F.count("_r").over(frame), F.stddev_samp("_r").over(frame)
    vol = F.when(n == 0, 0.01).when(n == 1, F.lit(None)).otherwise(sd)
    d = d.withColumn("_v", vol).drop("_r")
    return _scan(d, F.coalesce(n_std * F.col("_v"), F.lit(float("inf"))), F.coalesce(-n_std * F.col("_v"), F.lit(float("-inf"))), horizon, F.lit(True) if entry is None else entry)


def fixed_horizon(df: DataFrame, horizon: int, min_return: float = 0.0, entry: Column | None = None) -> DataFrame:
    last = W.Window.partitionBy("key").orderBy("idx").rowsBetween(0, horizon)
    d = df.withColumn("_i", F.last("idx").over(last)).withColumn("_p", F.last("price").over(last)).where("price > 0")
    r = _gain(F.col("_p"))
    kind = F.when(r >= min_return, "Upper").when(r < -min_return, "Lower").otherwise("Time")
    return (d if entry is None else d.where(entry)).select(*_event(kind, F.col("_i"), F.col("_p")))


def trend_scanning(df: DataFrame, shortest: int, longest: int, min_return: float = 0.0, entry: Column | None = None) -> DataFrame:
    """The horizon whose price trend has the largest t statistic, the shortest of equal ones.

    Sums of each horizon grow out of those of the one before, over prices less the entry's, so that nothing cancels on long series;
    a horizon beyond the series ends with its last row.
    """
    if not 1 <= shortest <= longest:
        raise ValueError("shortest must be 1 at least, and longest not below it")
    lead = lambda c, k: F.lead(c, k).over(by())
    later = range(1, longest + 1)
    d = df.select("key", "idx", "price", *[lead("price", k).alias(f"_p{k}") for k in later], *[lead("idx", k).alias(f"_i{k}") for k in later], F.count("idx").over(by().rowsBetween(1, longest)).alias("_n")).where("price > 0")
    d = d if entry is None else d.where(entry)
    if longest <= MOST_COLUMNS:
        d = _trend_by_columns(d, shortest, longest)
    else:
        d = d.withColumn("_b", _trend_by_arrays(shortest, longest)).withColumns({f"_{c}": F.col(f"_b.{c}") for c in "tip"})
    r = _gain(F.col("_p"))
    kind = F.when(r >= min_return, "Upper").when(r < -min_return, "Lower").otherwise("Time")
    return d.select(*_event(kind, F.col("_i"), F.col("_p")), F.col("_t").alias("t_stat"))


#: Horizons up to which trends are plain columns, and not arrays.
MOST_COLUMNS = 40


def _t_stat(n: Column, ty: Column, tyy: Column, tky: Column) -> Column:
    """The slope's t statistic over n prices from the sums of their gaps to the first one; 0 for fewer than 3, or no residual."""
    sxx, cov, var = n * (n * n - 1) / 12, tky - (n - 1) / 2 * ty, tyy - ty * ty / n
    sse = F.greatest(var - F.try_divide(cov * cov, sxx), F.lit(0.0))
    se = F.sqrt(F.try_divide(F.try_divide(sse, n - 2), sxx))
    return F.when((n < 3) | se.isNull() | (sse <= 1e-9 * F.greatest(var, F.lit(1e-300))), 0.0).otherwise(F.try_divide(F.try_divide(cov, sxx), se))


def _trend_by_columns(d: DataFrame, shortest: int, longest: int) -> DataFrame:
    """d with _t, _i and _p of the best horizon. Gaps, their sums, moments and statistics are columns one after another, so that none is worked out twice."""
    later, zero = range(1, longest + 1), F.lit(0.0)
    d = d.withColumns({f"_y{k}": F.coalesce(F.col(f"_p{k}") - F.col("price"), zero) for k in later})
    sums = {}
    for k in later:
        y = F.col(f"_y{k}")
        for name, x in (("_s", y), ("_ss", y * y), ("_ks", k * y)):
            sums[f"{name}{k}"] = x if k == 1 else sums[f"{name}{k - 1}"] + x
    d = d.withColumns(sums)
    sxx = {k: (k + 1.0) * ((k + 1.0) ** 2 - 1) / 12 for k in later}
    d = d.withColumns({f"_c{k}": F.col(f"_ks{k}") - k / 2 * F.col(f"_s{k}") for k in later} | {f"_v{k}": F.col(f"_ss{k}") - F.col(f"_s{k}") * F.col(f"_s{k}") / (k + 1.0) for k in later})
    d = d.withColumns({f"_e{k}": F.greatest(F.col(f"_v{k}") - F.col(f"_c{k}") * F.col(f"_c{k}") / sxx[k], zero) for k in later if k > 1})
    slope = {k: F.col(f"_c{k}") / sxx[k] / F.sqrt(F.col(f"_e{k}") / (k - 1.0) / sxx[k]) for k in later if k > 1}
    d = d.withColumns({f"_t{k}": F.when(F.col(f"_e{k}") <= 1e-9 * F.greatest(f"_v{k}", F.lit(1e-300)), 0.0).otherwise(slope[k]) if k > 1 else zero for k in later})
    # The horizons within the series, or what there is of the shortest; then the end of the one with the largest statistic.
    found = [F.when(F.col("_n") >= k if k >= shortest else F.col("_n") == k, F.struct(F.abs(f"_t{k}").alias("size"), F.lit(-k).alias("h"))) for k in later]
    none = F.lit(None).cast("struct<size:double,h:int>")
    d = d.withColumn("_h", -F.coalesce(F.greatest(*found, none)["h"], F.lit(0)))
    pick = lambda own, name: F.element_at(F.array(own, *[F.col(f"{name}{k}") for k in later]), F.col("_h") + 1)
    return d.withColumns({"_t": pick(zero, "_t"), "_i": pick(F.col("idx"), "_i"), "_p": pick(F.col("price"), "_p")})


def _trend_by_arrays(shortest: int, longest: int) -> Column:
    held = F.array(*[F.struct((F.col("price") if k == 0 else F.col(f"_p{k}")).alias("p"), (F.col("idx") if k == 0 else F.col(f"_i{k}")).alias("i")) for k in range(longest + 1)])
    held = F.slice(held, F.lit(1), (F.col("_n") + 1).cast("int"))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("k"), zero.alias("y"), zero.alias("yy"), zero.alias("ky"), F.array().cast("array<struct<size:double,h:int,t:double,i:bigint,p:double>>").alias("t"))

    def step(s, x):
        v = x["p"] - F.col("price")
        n, ty, tyy, tky = s["k"] + 1, s["y"] + v, s["yy"] + v * v, s["ky"] + s["k"] * v
        t = _t_stat(n, ty, tyy, tky)
        one = F.struct(F.abs(t).alias("size"), (1 - n).cast("int").alias("h"), t.alias("t"), x["i"].alias("i"), x["p"].alias("p"))
        return F.struct(n.alias("k"), ty.alias("y"), tyy.alias("yy"), tky.alias("ky"), F.concat(s["t"], F.array(one)).alias("t"))

    told = F.aggregate(held, start, step, lambda s: s["t"])
    return F.array_max(F.filter(told, lambda x: (-x["h"] >= shortest) | (-x["h"] == F.col("_n"))))


def to_binary(min_return: float = 0.0) -> Column:
    return F.when(F.col("label") == "Upper", 1).when(F.col("label") == "Lower", 0).otherwise((F.col("return_pct") >= min_return).cast("int"))


def to_ternary() -> Column:
    return F.when(F.col("label") == "Upper", 1).when(F.col("label") == "Lower", -1).otherwise(0)


def concurrent_events(events: DataFrame, bars: DataFrame) -> DataFrame:
    """key, idx, n: events whose entry to exit, both included, covers each bar; by sums of begins and ends."""
    up = events.select("key", F.col("entry").alias("idx"), F.lit(1).alias("d"))
    down = events.select("key", (F.col("exit") + 1).alias("idx"), F.lit(-1).alias("d"))
    d = bars.select("key", "idx", F.lit(0).alias("d")).unionByName(up).unionByName(down).groupBy("key", "idx").agg(F.sum("d").alias("d"))
    run = d.withColumn("n", F.sum("d").over(by().rowsBetween(W.Window.unboundedPreceding, 0)))
    return bars.select("key", "idx").join(run.select("key", "idx", "n"), ["key", "idx"])


def uniqueness(events: DataFrame, bars: DataFrame) -> DataFrame:
    """events with uniqueness (the mean of one over the events at each of its bars) and weight (one over their mean, summing to 1 for a key).

    Begins, ends and bars are one table: running sums over it give the events at each bar, and each event's sums from its entry to its
    exit. Events are distinct.
    """
    own = F.struct(*(F.col(c) for c in events.columns))
    mark = lambda at, d, which: F.struct(at.cast("long").alias("idx"), F.lit(d).alias("_d"), F.lit(which).cast("int").alias("_which"))
    marks = events.select("key", own.alias("_ev"), F.explode(F.array(mark(F.col("entry"), 1, 0), mark(F.col("exit") + 1, -1, None), mark(F.col("exit"), 0, 1))).alias("m")).select("key", "_ev", "m.*", F.lit(False).alias("_bar"))
    rows = bars.select("key", F.lit(None).cast(marks.schema["_ev"].dataType).alias("_ev"), F.col("idx").cast("long").alias("idx"), F.lit(0).alias("_d"), F.lit(None).cast("int").alias("_which"), F.lit(True).alias("_bar")).unionByName(marks)
    till, before = by().rangeBetween(W.Window.unboundedPreceding, 0), by().rangeBetween(W.Window.unboundedPreceding, -1)
    n = rows.withColumn("n", F.sum("_d").over(till))
    one, many = F.when(F.col("_bar"), F.try_divide(F.lit(1.0), F.col("n"))), F.when(F.col("_bar"), F.col("n"))
    for c, x in (("_o", one), ("_m", many)):
        n = n.withColumn(c, F.when(F.col("_which") == 0, F.coalesce(F.sum(x).over(before), F.lit(0))).otherwise(F.sum(x).over(till)))
    at = lambda c, k: F.max(F.when(F.col("_which") == k, F.col(c)))
    one_row = n.where("_which is not null").groupBy("key", "_ev").agg((at("_o", 1) - at("_o", 0)).alias("_o"), (at("_m", 1) - at("_m", 0)).alias("_m"))
    size = F.col("_ev.exit") - F.col("_ev.entry") + 1
    d = one_row.select("_ev.*", (F.col("_o") / size).alias("uniqueness"), (size / F.col("_m")).alias("_w"))
    return d.withColumn("weight", F.col("_w") / F.sum("_w").over(W.Window.partitionBy("key"))).select(*events.columns, "uniqueness", "weight")


def folds(spark: SparkSession, n_bars: int, n_folds: int) -> DataFrame:
    """fold, start, end (not included): equal runs of bars, the last with the remainder."""
    if n_folds < 1:
        raise ValueError("at least one fold")
    size = n_bars // n_folds
    return spark.createDataFrame([(k, k * size, n_bars if k == n_folds - 1 else (k + 1) * size) for k in range(n_folds)], "fold int, start long, end long")


def overlaps(start: Column, end: Column) -> Column:
    return (F.col("entry") < end) & (F.col("exit") > start)


def purged_kfold(events: DataFrame, n_bars: int | DataFrame, n_folds: int, embargo: int = 0) -> DataFrame:
    """events by fold, with role: test, purged (overlaps the fold), embargoed (begins just after it), or train.

    n_bars: the rows of all series, or a table of key and n. Folds are equal runs of a series' rows, the last with the remainder.
    """
    if n_folds < 1:
        raise ValueError("at least one fold")
    d = events.withColumn("_n", F.lit(n_bars).cast("long")) if isinstance(n_bars, int) else events.join(n_bars.select("key", F.col("n").alias("_n")), "key")
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    size = F.floor(F.col("_n") / n_folds)
    d = d.withColumn("_s", F.col("fold") * size).withColumn("_e", F.when(F.col("fold") == n_folds - 1, F.col("_n")).otherwise((F.col("fold") + 1) * size))
    start, end = F.col("_s"), F.col("_e")
    role = F.when(F.col("entry").between(start, end - 1), "test").when(overlaps(start, end), "purged").when(F.col("entry").between(end, end + embargo - 1), "embargoed").otherwise("train")
    return d.withColumn("role", role).drop("_n", "_s", "_e")


def test_rows(df: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """df with split for each split of walk_forward whose test rows it is in; splits that end beyond a key's rows don't count.

    A row's splits follow from its idx (from 0), so that nothing is joined by ranges. Other rows go.
    """
    if min(train, test, step) <= 0:
        raise ValueError("sizes must be positive")
    n = F.count("*").over(W.Window.partitionBy("key"))
    first = F.greatest(F.ceil((F.col("idx") - train - test + 1) / step), F.lit(0))
    last = F.least(F.floor((F.col("idx") - train) / step), F.floor((F.col("_n") - train - test) / step))
    d = df.withColumn("_n", n).withColumn("_f", first.cast("int")).withColumn("_l", last.cast("int")).where("_f <= _l")
    return d.withColumn("split", F.explode(F.sequence("_f", "_l"))).drop("_n", "_f", "_l")


def walk_forward(spark: SparkSession, n_bars: int, train: int, test: int, step: int, anchored: bool = False) -> DataFrame:
    """split, train_start, train_end, test_start, test_end (ends not included). Too few bars: no rows."""
    if min(train, test, step) <= 0:
        raise ValueError("sizes must be positive")
    rows = [(k, 0 if anchored else k * step, k * step + train, k * step + train, k * step + train + test) for k in range(max(0, (n_bars - train - test) // step + 1))]
    return spark.createDataFrame(rows, "split int, train_start long, train_end long, test_start long, test_end long")
