"""Reports over ledgers, equity curves and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.functions.scan import blocked


def equity(ledger: DataFrame) -> DataFrame:
    """scenario_id, dt, tot_value, reward (change against the day before), cum_return of each day."""
    w = Window.partitionBy("scenario_id").orderBy("dt")
    days = ledger.groupBy("scenario_id", "dt").agg(F.max("tot_value").alias("tot_value"))
    return days.withColumns({"reward": F.col("tot_value") - F.lag("tot_value").over(w), "cum_return": F.col("tot_value") / F.first("tot_value").over(w) - 1})


def drawdown(values: DataFrame, key: list[str], order: str, c: str) -> DataFrame:
    """key, max_drawdown, max_profit: the least value / running maximum - 1 and the greatest value / running minimum - 1.

    The extremes run over blocks of days, so that a long series isn't one task's; values is read twice.
    """
    df = blocked(values, {"__high": ("max", c), "__low": ("min", c)}, key, order)
    return df.groupBy(*key).agg(F.min(F.col(c) / F.col("__high") - 1).alias("max_drawdown"), F.max(F.col(c) / F.col("__low") - 1).alias("max_profit"))


def sharpe(values: DataFrame, key: list[str], order: str, c: str, risk_free: float = 0.0) -> DataFrame:
    """key, sharpe: of the cumulative return series, mean less risk_free over population deviation; null if that is 0."""
    first = F.first(c).over(Window.partitionBy(*key).orderBy(order))
    df = values.withColumn("__r", F.col(c) / first - 1)
    return df.groupBy(*key).agg(((F.avg("__r") - risk_free) / F.nullif(F.stddev_pop("__r"), F.lit(0.0))).alias("sharpe"))


def market_return(log_returns: str = "returns") -> Column:
    """Percent gained over a sum of log returns."""
    return F.round(F.exp(F.sum(log_returns)) * 100 - 100, 2)


def fills(ledger: DataFrame) -> DataFrame:
    return ledger.filter("order_type IS NOT NULL").select("scenario_id", F.col("dt").alias("timestamp"), "symbol", "order_type", "price", "quantity", "order_id")


def trade_pairs(filled: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Fills of a key two by two: buy, sell, return in percent, revenue, best first; an odd last one is left out."""
    w = Window.partitionBy(*key).orderBy(*order)
    df = filled.withColumn("__n", F.row_number().over(w) - 1).withColumn("pair", F.floor(F.col("__n") / 2))
    df = df.withColumn("sell_price", F.lead("price").over(w)).withColumn("sell_time", F.lead("timestamp").over(w))
    pairs = df.filter((F.col("__n") % 2 == 0) & F.col("sell_price").isNotNull())
    percent = F.round((F.col("sell_price") / F.col("price") - 1) * 100, 2)
    return pairs.select(*key, "pair", F.col("timestamp").alias("buy_time"), "sell_time", F.col("price").alias("buy_price"), "sell_price", "quantity", percent.alias("return_pct"), ((F.col("sell_price") - F.col("price")) * F.col("quantity")).alias("revenue")).orderBy(F.desc("return_pct"))


def realized_by_symbol(pairs: DataFrame) -> DataFrame:
    """symbol, pnl (gross of fees), worst first."""
    return pairs.groupBy("symbol").agg(F.sum("revenue").alias("pnl")).orderBy("pnl")


def marked_to_market(positions: DataFrame) -> DataFrame:
    """dt, value: the sum of position * close."""
    return positions.groupBy("dt").agg(F.sum(F.col("position") * F.col("close")).alias("value"))


def chart(bars: DataFrame, filled: DataFrame, histogram: str = "macd_close_weekly") -> DataFrame:
    """Bars with the colour of their histogram bar and the markers of fills: buys at the low, others at the high."""
    marks = filled.select("symbol", F.col("timestamp").alias("dt"), "order_type")
    df = bars.join(marks, ["symbol", "dt"], "left").withColumn("colour", F.when(F.col(histogram) >= 0, "green").otherwise("red"))
    return df.withColumn("marker", F.when(F.col("order_type") == "buy", F.col("low")).when(F.col("order_type").isNotNull(), F.col("high")))


def named_orders(orders: DataFrame, universe: DataFrame) -> DataFrame:
    return orders.join(universe.select("symbol", "name"), "symbol", "left")


def panels(equity: DataFrame, bars: DataFrame, run: str = "scenario_id") -> DataFrame:
    """One row a run and day for five panels: position, value, return in percent, capital, and the market's cumulative return.

    equity has the run, dt, position, tot_value and capital, bars the one symbol that all runs
    are held against. The first days come by aggregates, so that no task sees all days.
    """
    first_bar = bars.agg(F.min_by("close", "dt").alias("__bar"))
    market = bars.select("dt", "close").join(F.broadcast(first_bar)).select("dt", (F.col("close") / F.col("__bar") - 1).alias("market"))
    first_value = equity.groupBy(run).agg(F.min_by("tot_value", "dt").alias("__value"))
    df = equity.select(run, "dt", "position", "tot_value", "capital").join(first_value, run)
    return df.withColumn("return_pct", (F.col("tot_value") / F.col("__value") - 1) * 100).drop("__value").join(market, "dt", "left")
