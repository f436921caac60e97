"""Feature pipelines: the stages in the order that fixes their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.indicators import amplitude, force_index, force_kdj_emas, log_return, macd, rsi, weekly_bars, weekly_macd_pit
from tideline.functions.windows import ema_spans, forward_fill, sma

SUFFIX = "_weekly"


def with_weekly(df: DataFrame, weekly: DataFrame, mode: str = "left", block: Column | None = None) -> DataFrame:
    """Joins weekly columns (suffixed) on the day and fills forward.

    left: a week whose Friday has no bar is lost, and the week before it stays in force.
    outer: such a Friday becomes a row, filled from the day before.
    With blocks the fill goes by `blocked`.
    """
    weekly = weekly.toDF(*[c if c in ("symbol", "dt") else c + SUFFIX for c in weekly.columns])
    joined = df.join(weekly, ["symbol", "dt"], {"left": "left", "outer": "full"}[mode])
    return forward_fill(joined, [c for c in joined.columns if c not in ("symbol", "dt")], block)


def daily_features(bars: DataFrame) -> DataFrame:
    """From back-adjusted bars: weekly MACD as known each day, the joined week's bar and MACD, force index, KDJ, EMAs, amplitude, return.

    The weekly columns are open_weekly, high_weekly, low_weekly, close_weekly_vis, volume_weekly,
    amount_weekly and macd_close_weekly_vis, of the last week whose Friday had a bar.
    """
    df = weekly_macd_pit(bars.na.drop("any"))
    names = {c: f"{c}{SUFFIX}" for c in ("open", "high", "low", "volume", "amount")} | {"close": f"close{SUFFIX}_vis", "macd_close": f"macd_close{SUFFIX}_vis"}
    weekly = macd(weekly_bars(df), "close", "macd_close").select("symbol", "dt", *[F.col(c).alias(n) for c, n in names.items()])
    joined = forward_fill(df.join(weekly, ["symbol", "dt"], "left"), [c for c in df.columns if c not in ("symbol", "dt")] + list(names.values()))
    df = force_kdj_emas(joined, (5, 10, 13, 20)).na.drop("any")
    return df.withColumns({"amplitude": amplitude(), "returns": log_return()}).na.drop("any")


# The columns of the older pipeline's output.
CSV_COLUMNS = ["symbol", "dt", "open", "high", "low", "close", "volume", "amplitude", "returns", "macd_close_weekly", "force_index_close", "MA5", "ema5", "ema10", "ema20"]


def file_features(bars: DataFrame) -> DataFrame:
    """The older pipeline over adjusted bars: weekly joined with synthetic Fridays, moving averages and RSI after trimming."""
    weekly = macd(weekly_bars(bars), "close", "macd_close")
    df = force_index(with_weekly(bars, weekly, "outer"))
    df = ema_spans(df, (5, 10, 20)).na.drop("any")
    df = df.withColumns({"amplitude": amplitude(), "returns": log_return()})
    df = df.withColumns({f"MA{n}": sma("close", n) for n in (5, 10, 20)})
    df = rsi(df).na.drop("any")
    return df.select(*CSV_COLUMNS)
