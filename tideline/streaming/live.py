"""Live bars and ticks as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.functions.windows import lag
from tideline.sources.bars import SNAPSHOT
from tideline.sources.sinks import upsert_bars


def read_snapshots(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of quote snapshots (CSV files with a header): symbol, ts and the fields of SNAPSHOT."""
    reader = spark.readStream.schema(SNAPSHOT).option("header", True)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.csv(path).withColumnRenamed("code", "symbol").withColumn("ts", F.to_timestamp("date"))


def intraday(snapshots: DataFrame, yesterday: DataFrame, spans: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Snapshots scaled by yesterday's adj_factor, with ema<n> one step on from yesterday's (the day itself doesn't compound)."""
    state = yesterday.select("symbol", "adj_factor", *[F.col(f"ema{n}").alias(f"__ema{n}") for n in spans])
    df = snapshots.join(state, "symbol")
    df = df.withColumns({c: F.col(c) * F.col("adj_factor") for c in ("open", "high", "low", "close")})
    step: dict[str, Column] = {f"ema{n}": F.col("close") * (2 / (n + 1)) + F.col(f"__ema{n}") * (1 - 2 / (n + 1)) for n in spans}
    return df.withColumns(step).drop(*[f"__ema{n}" for n in spans])


def tick_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of ticks (symbol, ts, price, tick_id) by tumbling event-time windows; later ticks than `late` are dropped."""
    df = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withWatermark("ts", late) if df.isStreaming else df
    at = F.struct("ts", "tick_id")
    return df.groupBy(F.window("ts", width), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("n")
    ).select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def running_ema(closes: DataFrame, spans: tuple[int, ...] = (5, 10, 13, 20)) -> DataFrame:
    """A stream of symbol, dt, close to the same rows with ema<n>, kept up across batches in a symbol's state.

    Rows of a symbol must come in order of dt from batch to batch; inside one they are sorted.
    """
    names = [f"ema{n}" for n in spans]

    def update(key, frames, state):
        import pandas as pd

        last = list(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("dt")
        out = []
        for dt, close in zip(rows["dt"], rows["close"], strict=True):
            last = [close if last is None else y + 2 / (n + 1) * (close - y) for n, y in zip(spans, last or spans, strict=True)]
            out.append((key[0], dt, close, *last))
        state.update(tuple(last))
        yield pd.DataFrame(out, columns=["symbol", "dt", "close", *names])

    values = ", ".join(f"{n} double" for n in names)
    return closes.groupBy("symbol").applyInPandasWithState(update, f"symbol string, dt date, close double, {values}", values, "append", "NoTimeout")


def intended_orders(quotes: DataFrame, waiting: DataFrame, late: str = "1 day") -> DataFrame:
    """Orders of `waiting` (order_id, symbol, kind, last_high, last_low) that a quote fires, each once.

    Buys fire above the high of the day before, stops below its low and ema10, by close.
    """
    df = quotes.withWatermark("ts", late).join(waiting, "symbol")
    fires = ((F.col("kind") == "buy") & (F.col("close") > F.col("last_high"))) | ((F.col("kind") != "buy") & (F.col("close") < F.col("last_low")) & (F.col("close") < F.col("ema10")))
    return df.filter(fires).select("order_id", "symbol", "kind", "close", "ts").dropDuplicatesWithinWatermark(["order_id"])


def store_daily(bars: DataFrame, path: str, checkpoint: str):
    """Writes each batch of bars into the store, new rows winning over old ones; the query runs until input ends."""
    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert_bars(batch, path)

    return bars.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def policy_memory(df: DataFrame) -> DataFrame:
    """Adds the bars before and the one before that, as the order policies look at them."""
    return df.withColumns({f"{c}_{k}": lag(c, k) for c in ("high", "low") for k in (1, 2)})
