"""Loaders of transactions, loans and price bars; each says what it does with bad rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import rows

BARS = "date date, open double, high double, low double, close double, volume long, adj_close double"
LOANS = "income double, loan_amount double, interest_rate double, dti double, grade byte, home_ownership string, defaulted boolean"
HOMES = ("RENT", "OWN", "MORTGAGE")


def transactions(spark: SparkSession, path: str, n_features: int = 28, strict: bool = True) -> DataFrame:
    """time, features, amount, class from a CSV file with a header: the first column is the time, the last two amount and class.

    strict: a cell that can't be read is an error when rows are read; else it counts as 0, and rows with missing cells go.
    """
    names = ["time", *(f"v{k}" for k in range(1, n_features + 1)), "amount", "class"]
    fields = [T.StructField(n, T.DoubleType()) for n in names]
    df = spark.read.schema(T.StructType([*fields, T.StructField("_bad", T.StringType())][: None if not strict else -1])).option("header", True).option("enforceSchema", True)
    df = df.option("mode", "FAILFAST").csv(path) if strict else df.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    if not strict:
        df = df.where(F.col("_bad").isNull() | (F.size(F.split("_bad", ",")) >= len(names))).fillna(0.0, names)
    return df.select("time", F.array(*names[1:-2]).alias("features"), "amount", F.col("class").cast("byte").alias("class"))


def loans(spark: SparkSession, path: str) -> DataFrame:
    """Loan applications by column name; rows that can't be read, or with another kind of home, are left out."""
    # Cells are read as text and cast here, so that a row's fate doesn't depend on the columns that a later step reads.
    kinds = T._parse_datatype_string(LOANS)
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in kinds])).option("header", True).csv(path)
    cast = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kinds]
    good = F.lit(True)
    for f in kinds:
        good = good & F.col(f.name).try_cast(f.dataType).isNotNull()
    return raw.where(good & F.col("home_ownership").isin(*HOMES)).select(*cast)


def ohlcv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Daily bars by column name. strict: a bar whose prices don't fit is an error; else column valid tells."""
    df = spark.read.schema(BARS).option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    ok = F.coalesce(rows.valid_bar(), F.lit(False))
    return df.where(F.assert_true(ok, "prices of a bar don't fit").isNull()) if strict else df.withColumn("valid", ok)


def ohlcv_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars from files with one JSON array each, keyed by the file's name."""
    df = spark.read.schema(BARS).option("multiLine", True).json(path)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("key"), "*")


def loan(income: float, loan_amount: float, interest_rate: float, dti: float, grade: int, home_ownership: str, defaulted: bool) -> tuple:
    if home_ownership not in HOMES:
        raise ValueError(f"no such kind of home: {home_ownership}")
    return income, loan_amount, interest_rate, dti, grade, home_ownership, defaulted


def validated_prices(df: DataFrame, price: str = "price") -> DataFrame:
    """df, in which reading a price that isn't positive and finite is an error."""
    return df.where(F.assert_true(rows.valid_price(price), "prices must be positive and finite").isNull())


def series_status(df: DataFrame, price: str = "price") -> DataFrame:
    """key, n, status (null: all prices are good): one bad series doesn't stop the others."""
    bad = F.count_if(~rows.valid_price(price))
    return df.groupBy("key").agg(F.count("*").alias("n"), F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" bad prices"))).alias("status"))
