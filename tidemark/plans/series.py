"""Keyed, ordered series from the driver's tables: as DataFrames, and as SQL common table expressions of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, idx (from 0), price: the values of each event type in time order."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("key"), F.col("value").alias("price"))
    return e.select("key", (F.row_number().over(W.Window.partitionBy("key").orderBy("ts", "event_id")) - 1).cast("long").alias("idx"), "price")


PX = "px AS (SELECT event_type AS key, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, value AS price FROM events)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, idx, day, open, high, low, close, volume: orders by priority and day."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day"), "o_orderkey", F.col("o_totalprice").alias("p"))
    b = o.groupBy("key", "day").agg(F.min_by("p", "o_orderkey").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o_orderkey").alias("close"), F.count("*").alias("volume"))
    return b.withColumn("idx", (F.row_number().over(W.Window.partitionBy("key").orderBy("day")) - 1).cast("long"))


BARS = """bars AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY day) - 1 AS BIGINT) AS idx FROM (
  SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2))"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, asset, r: log returns of the monthly mean price of each priority, in months that all five have."""
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(F.col("o_orderpriority").alias("asset"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("month")).agg(F.avg("o_totalprice").alias("p"))
    before = F.lag("p").over(W.Window.partitionBy("asset").orderBy("month"))
    r = m.withColumn("r", F.ln(F.col("p") / before)).where("r is not null")
    full = r.groupBy("month").agg(F.count("*").alias("n")).where("n = 5").select("month")
    return r.join(full, "month").select(F.col("month").alias("idx"), "asset", "r")


PANEL = """m AS (SELECT o_orderpriority AS asset, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS idx, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2),
pr AS (SELECT idx, asset, ln(p / lag(p) OVER (PARTITION BY asset ORDER BY idx)) AS r FROM m),
panel AS (SELECT * FROM pr WHERE r IS NOT NULL AND idx IN (SELECT idx FROM pr WHERE r IS NOT NULL GROUP BY idx HAVING count(*) = 5))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id (a struct of keys), features (4), class: line items; class 1 if returned."""
    x = table(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"), (F.col("l_returnflag") == "R").cast("int").alias("class"))
