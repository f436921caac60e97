"""Entry and exit signals, and candidates of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideline.functions.scan import blocked
from tideline.functions.windows import by_symbol, lag, running


def previous_distinct(df: DataFrame, c: str, out: str) -> DataFrame:
    """Adds out, the value of c before the last change of it, known once two values went before today."""
    changed = (F.coalesce(F.col(c) != lag(c), F.lit(True))).cast("int")
    df = df.withColumn("__changed", changed).withColumn("__before", lag(c))
    df = df.withColumn("__run", running(F.sum, "__changed"))
    value = F.last(F.when(F.col("__changed") == 1, F.col("__before")), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when(F.col("__run") >= 2 + F.col("__changed"), value)).drop("__changed", "__before", "__run")


def signal_three(df: DataFrame, weekly: str = "macd_close_weekly_vis", force: str = "force_index_close") -> DataFrame:
    """Adds signal: 1 if the weekly value rises and the force index falls through zero; -1 if it doesn't rise; else 0.

    Nothing is signalled before a force index other than 0, or while the weekly value before is unknown or 0.
    """
    df = previous_distinct(df, weekly, "__weekly")
    before = lag(force)
    known = (F.coalesce(before, F.lit(0.0)) != 0) & (F.coalesce(F.col("__weekly"), F.lit(0.0)) != 0)
    crossed = (F.col(force) < 0) & (before > 0)
    return df.withColumn("signal", F.when(known & (F.col(weekly) > F.col("__weekly")) & crossed, 1).when(known & ~(F.col(weekly) > F.col("__weekly")), -1).otherwise(0)).drop("__weekly")


def signal_ema(df: DataFrame, average: str = "ema13", force: str = "force_index_close") -> DataFrame:
    """Adds signal: 1 if the average rises and the force index falls through zero, -1 if it doesn't rise and that one rises through zero."""
    before, rising = lag(force), F.col(average) > lag(average)
    known = F.coalesce(before, F.lit(0.0)) != 0
    return df.withColumn("signal", F.when(known & rising & (F.col(force) < 0) & (before > 0), 1).when(known & ~rising & (F.col(force) > 0) & (before < 0), -1).otherwise(0))


def best_candidate(df: DataFrame, force: str = "force_index_close", by_size: bool = False) -> DataFrame:
    """Of each day's buy signals the one of least force index (by_size: nearest to zero); ties go to the earlier symbol."""
    rank = F.abs(force) if by_size else F.col(force)
    order = [rank, *([F.col("ordinal")] if "ordinal" in df.columns else []), F.col("symbol")]
    w = Window.partitionBy("dt").orderBy(*order)
    return df.filter("signal = 1").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def monotonic_runs(df: DataFrame, c: str = "close") -> DataFrame:
    """symbol, start, end, trend: stretches of one direction by place from 0; level ones are left out.

    By blocks of days, so that a long symbol isn't one task's; what a pass adds is stored for the next.
    """
    df = blocked(df.select("symbol", "dt", c), {"place": ("count", F.lit(1)), "__before": ("before", c)})
    df = df.select("symbol", "dt", (F.col("place") - 1).cast("int").alias("place"), F.signum(F.coalesce(F.col(c) - F.col("__before"), F.lit(0.0))).cast("int").alias("trend"))
    df = blocked(df, {"__before": ("before", "trend")}, stored=True)
    df = df.withColumn("__start", F.when(F.col("trend").eqNullSafe(F.col("__before")), None).otherwise(F.col("place")))
    df = blocked(df.select("symbol", "dt", "place", "trend", "__start"), {"start": ("last", "__start")}, stored=True)
    return df.filter("trend <> 0").groupBy("symbol", "start", "trend").agg(F.max("place").alias("end")).select("symbol", "start", "end", "trend")


def lockstep(df: DataFrame) -> DataFrame:
    """Adds step (from 0), the place of a row among its symbol's, up to the last that all symbols have."""
    df = df.withColumn("step", F.row_number().over(by_symbol()) - 1)
    shortest = df.groupBy("symbol").count().agg(F.min("count").alias("__n"))
    return df.join(F.broadcast(shortest), F.col("step") < F.col("__n")).drop("__n")


def common_days(df: DataFrame) -> DataFrame:
    """The days on which all symbols have a bar."""
    n = df.select("symbol").distinct().agg(F.count(F.lit(1)).alias("__n"))
    days = df.groupBy("dt").agg(F.count_distinct("symbol").alias("__m")).join(F.broadcast(n), F.col("__m") == F.col("__n")).select("dt")
    return df.join(days, "dt", "left_semi")
