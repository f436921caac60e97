"""Technical indicators: each takes bars and adds columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.functions.scan import blocked
from tideline.functions.windows import Averages, averages, averages_of, by_symbol, diff, lag, rolling, running, sma, week_end


def macd(df: DataFrame, c: str = "close", out: str = "macd", short: int = 12, long: int = 26, signal: int = 9) -> DataFrame:
    """Adds out, the histogram: EMA(short) - EMA(long) less its own EMA(signal)."""
    a, b, s = (f"__{out}_{n}" for n in ("short", "long", "signal"))
    df = macd_state(df, c, a, b, s, short, long, signal)
    return df.withColumn(out, F.col(a) - F.col(b) - F.col(s)).drop(a, b, s)


def macd_state(df: DataFrame, c: str, a: str, b: str, s: str, short: int, long: int, signal: int) -> DataFrame:
    """Adds the averages a (short) and b (long) of c, and s (signal) of their difference."""
    return averages(df, c, {a: 2 / (short + 1), b: 2 / (long + 1)}, {s: (lambda y: f"{y(a)} - {y(b)}", 2 / (signal + 1))})


def _force(raw: str, out: str, period: int) -> Averages:
    return raw, {out: 2 / (period + 1)}, {}


def _with_rsv(df: DataFrame, n: int) -> DataFrame:
    df = df.withColumns({"low_n": rolling(F.min, "low", n, full=False), "high_n": rolling(F.max, "high", n, full=False)})
    return df.withColumn("RSV", (F.col("close") - F.col("low_n")) / F.nullif(F.col("high_n") - F.col("low_n"), F.lit(0.0)) * 100)


def _kdj(com: float) -> Averages:
    return "RSV", {"K": 1 / (1 + com)}, {"D": (lambda y: y("K"), 1 / (1 + com))}


def force_index(df: DataFrame, c: str = "close", out: str = "force_index_close", period: int = 2) -> DataFrame:
    """Adds out: EMA(period) of the change of c times volume; the first row is null."""
    raw = f"__{out}_raw"
    return averages_of(df.withColumn(raw, diff(c) * F.col("volume")), [_force(raw, out, period)]).drop(raw)


def kdj(df: DataFrame, n: int = 5, com: float = 3) -> DataFrame:
    """Adds low_n, high_n, RSV, K, D, J; in a flat window RSV is null and K, D carry on."""
    return averages_of(_with_rsv(df, n), [_kdj(com)]).withColumn("J", F.col("K") * 3 - F.col("D") * 2)


def force_kdj_emas(df: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """What force_index, kdj and ema_spans add, in one scan."""
    raw = "__force_raw"
    df = _with_rsv(df.withColumn(raw, diff("close") * F.col("volume")), 5)
    df = averages_of(df, [_force(raw, "force_index_close", 2), _kdj(3), ("close", {f"ema{n}": 2 / (n + 1) for n in spans}, {})])
    return df.drop(raw).withColumn("J", F.col("K") * 3 - F.col("D") * 2)


def rsi(df: DataFrame, n: int = 6, out: str = "RSI") -> DataFrame:
    """Adds out by plain means of gains and losses (first change counts as none): 100 without losses, null without either."""
    change = "__change"
    df = df.withColumn(change, F.coalesce(diff("close"), F.lit(0.0)))
    df = df.withColumns({"__gain": sma(F.greatest(F.col(change), F.lit(0.0)), n, full=False), "__loss": sma(F.greatest(-F.col(change), F.lit(0.0)), n, full=False)})
    ratio = F.col("__gain") / F.nullif(F.col("__loss"), F.lit(0.0))
    value = F.when(F.col("__loss") > 0, 100 - 100 / (1 + ratio)).when(F.col("__gain") > 0, 100.0)
    return df.withColumn(out, value).drop(change, "__gain", "__loss")


def amplitude() -> Column:
    return (F.col("high") - F.col("low")) / lag("close")


def log_return() -> Column:
    return F.ln(F.col("close") / lag("close"))


def back_adjusted(df: DataFrame, first_is_one: bool = False, block: Column | None = None) -> DataFrame:
    """Adds adj_factor, the product of previous close / pre_close, and scales open, high, low, close by it.

    The first row's factor is null, and so are its prices, unless first_is_one. With blocks (see
    `blocked`; df should be a stored table then) a symbol's rows fall to many tasks.
    """
    df = blocked(df, {"__before": ("before", "close")}, block=block) if block is not None else df.withColumn("__before", lag("close"))
    step = F.col("__before") / F.nullif(F.col("pre_close"), F.lit(0.0))
    # Only a first row has no close before it, as closes aren't null.
    df = df.withColumn("__step", F.coalesce(step, F.when(F.col("__before").isNull(), 1.0)) if first_is_one else step).drop("__before")
    df = blocked(df, {"adj_factor": ("product", "__step")}, block=block) if block is not None else df.withColumn("adj_factor", running(F.product, "__step"))
    df = df.withColumn("adj_factor", F.when(F.col("__step").isNotNull(), F.col("adj_factor"))).drop("__step")
    return df.withColumns({c: F.col(c) * F.col("adj_factor") for c in ("open", "high", "low", "close")})


def weekly_bars(df: DataFrame) -> DataFrame:
    """Bars of weeks Saturday to Friday, dt being their Friday (also if that is no trading day, or yet to come)."""
    return df.groupBy("symbol", week_end().alias("dt")).agg(
        F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")
    )


def week_to_date(df: DataFrame) -> DataFrame:
    """Adds wtd_open .. wtd_volume: the week's bar (from Monday) up to each day."""
    w = Window.partitionBy("symbol", F.date_trunc("week", "dt")).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"wtd_open": F.first("open").over(w), "wtd_high": F.max("high").over(w), "wtd_low": F.min("low").over(w), "wtd_close": F.col("close"), "wtd_volume": F.sum("volume").over(w), "wtd_amount": F.sum("amount").over(w)})


def weekly_macd_pit(df: DataFrame, short: int = 12, long: int = 26, signal: int = 9) -> DataFrame:
    """Adds, for each day, the weekly MACD histogram as known then, and _last: that of the last completed week.

    A week completes on a Friday bar; a day's close stands for the running week. That is
    one more step from the state of the last completed week, so the state is computed
    once for each Friday and carried to the days after it. Before any week is complete
    the histogram is 0 and _last null.
    """
    fridays = df.filter(F.weekday("dt") == 4).select("symbol", "dt", "close")
    fridays = macd_state(fridays, "close", "__a", "__b", "__s", short, long, signal).withColumn("__m", F.col("__a") - F.col("__b"))
    fridays = fridays.select("symbol", "dt", F.struct("__a", "__b", "__s", "__m").alias("__state"))
    df = df.join(fridays, ["symbol", "dt"], "left")
    state = F.last("__state", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__state", state)

    def step(name: str, x: Column, n: int) -> Column:
        return F.col(f"__state.{name}") * ((n - 1) / (n + 1)) + x * (2 / (n + 1))

    m = step("__a", F.col("close"), short) - step("__b", F.col("close"), long)
    return df.withColumns({"macd_close_weekly": F.coalesce(m - step("__s", m, signal), F.lit(0.0)), "macd_close_weekly_last": F.col("__state.__m") - F.col("__state.__s")}).drop("__state")
