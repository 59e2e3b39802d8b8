"""Order flow and limit order books."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.operators.returns import by


def order_flow_imbalance(snapshots: DataFrame) -> DataFrame:
    """key, idx, ofi from bid_quantity and ask_quantity (null: 0): the change of the bid's less the change of the ask's. The first row goes."""
    net = F.coalesce("bid_quantity", F.lit(0)) - F.coalesce("ask_quantity", F.lit(0))
    return snapshots.select("key", "idx", (net - F.lag(net).over(by())).alias("ofi")).where("ofi is not null")


def depth(orders: DataFrame, levels: int) -> DataFrame:
    """key, side, level, price, quantity, n_orders: the best levels of resting orders (key, side, price, quantity)."""
    lv = orders.groupBy("key", "side", "price").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n_orders"))
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    return lv.withColumn("level", F.row_number().over(W.Window.partitionBy("key", "side").orderBy(best))).where(F.col("level") <= levels)


def quotes(orders: DataFrame) -> DataFrame:
    """key, best_bid, best_ask, mid, spread (0 if crossed; null if a side is empty), bid_volume, ask_volume, n_orders."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    q = orders.groupBy("key").agg(F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"), F.coalesce(F.sum(F.when(bid, F.col("quantity"))), F.lit(0)).alias("bid_volume"), F.coalesce(F.sum(F.when(ask, F.col("quantity"))), F.lit(0)).alias("ask_volume"), F.count("*").alias("n_orders"))
    return q.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2).withColumn("spread", F.when(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull(), F.greatest(F.col("best_ask") - F.col("best_bid"), F.lit(0))))


def sweep(orders: DataFrame, is_buy: bool, quantity: int) -> DataFrame:
    """key, price, quantity, seq: what a market order takes of each resting order, best price first, then by seq; too large an order takes all."""
    side = "ask" if is_buy else "bid"
    best = F.col("price") if is_buy else -F.col("price")
    w = W.Window.partitionBy("key").orderBy(best, "seq").rowsBetween(W.Window.unboundedPreceding, -1)
    d = orders.where(F.col("side") == side).withColumn("_before", F.coalesce(F.sum("quantity").over(w), F.lit(0)))
    return d.withColumn("quantity", F.greatest(F.lit(0), F.least(F.col("quantity"), F.lit(quantity) - F.col("_before")))).where("quantity > 0").drop("_before", "side")


class Book:
    """Resting orders by side and price, in order of arrival. Limit orders are never matched with each other."""

    def __init__(self, tick: int = 1):
        self.tick, self.levels, self.where = tick, {"bid": {}, "ask": {}}, {}
        self.prices: dict[str, list[int]] = {"bid": [], "ask": []}

    def add(self, order_id: int, side: str, price: int, quantity: int) -> str:
        if quantity <= 0:
            return "quantity"
        if price % self.tick:
            return "off tick"
        if order_id in self.where:
            return "duplicate"
        level = self.levels[side].get(price)
        if level is None:
            level = self.levels[side][price] = {}
            insort(self.prices[side], price)
        level[order_id] = quantity
        self.where[order_id] = (side, price)
        return ""

    def _drop(self, order_id: int) -> int:
        side, price = self.where.pop(order_id)
        level = self.levels[side][price]
        left = level.pop(order_id)
        if not level:
            del self.levels[side][price]
            self.prices[side].pop(bisect_left(self.prices[side], price))
        return left

    def cancel(self, order_id: int) -> int | None:
        return self._drop(order_id) if order_id in self.where else None

    def market(self, side: str, quantity: int) -> list[tuple[int, int, int]]:
        """(price, quantity, resting order) taken by an order of side bid (buys) or ask (sells)."""
        other, out = "ask" if side == "bid" else "bid", []
        while quantity > 0 and self.prices[other]:
            price = self.prices[other][0 if other == "ask" else -1]
            order_id, there = next(iter(self.levels[other][price].items()))
            took = min(there, quantity)
            out.append((price, took, order_id))
            quantity -= took
            if took == there:
                self._drop(order_id)
            else:
                self.levels[other][price][order_id] = there - took
        return out

    def best(self, side: str) -> tuple[int, int] | None:
        if not self.prices[side]:
            return None
        price = self.prices[side][-1 if side == "bid" else 0]
        return price, sum(self.levels[side][price].values())


REPLAYED = "key string, seq long, status string, filled long, notional long, best_bid long, bid_quantity long, best_ask long, ask_quantity long, n_orders long"


def execute(book: Book, key: str, commands: pd.DataFrame) -> pd.DataFrame:
    """Runs a book's commands in order of seq, then of what they say; a row for each, with the quotes after it."""
    c, rows = commands.sort_values(["seq", "cmd", "id", "side", "price", "quantity"]), []
    for seq, cmd, order_id, side, price, quantity in zip(*(c[x].tolist() for x in ("seq", "cmd", "id", "side", "price", "quantity")), strict=True):
        status, fills = "", []
        if cmd == "add":
            status = book.add(int(order_id), side, int(price), int(quantity))
        elif cmd == "cancel":
            status = "" if book.cancel(int(order_id)) is not None else "not found"
        else:
            fills = book.market(side, int(quantity))
        b, a = book.best("bid") or (None, None), book.best("ask") or (None, None)
        rows.append((key, seq, status, sum(q for _, q, _ in fills), sum(p * q for p, q, _ in fills), *b, *a, len(book.where)))
    names = [x.split()[0] for x in REPLAYED.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in names if n not in ("key", "status")})


def replay(commands: DataFrame, tick: int = 1) -> DataFrame:
    """Runs each key's commands (key, seq, cmd: add, cancel or market; id, side, price, quantity) in order of seq; a row for each, with the quotes after it."""
    return commands.groupBy("key").applyInPandas(lambda pdf: execute(Book(tick), pdf["key"].iloc[0], pdf), REPLAYED)


def flow_correlation(snapshots: DataFrame) -> DataFrame:
    """key, n, correlation of order_flow_imbalance with the change of mid over the same rows (key, idx, bid_quantity, ask_quantity, mid); 0 if either doesn't vary."""
    move = snapshots.select("key", "idx", (F.col("mid") - F.lag("mid").over(by())).alias("_m"))
    d = order_flow_imbalance(snapshots).join(move, ["key", "idx"])
    both = F.col("ofi").isNotNull() & F.col("_m").isNotNull()
    return d.where(both).groupBy("key").agg(F.count("*").alias("n"), F.coalesce(F.nanvl(F.corr("ofi", "_m"), F.lit(0.0)), F.lit(0.0)).alias("correlation"))
