"""Indicators and signals of live bars, with their memory in a symbol's state across batches.

The streams have the columns of the batch functions and give the same numbers: a day is one
step from what the days before it have left. State needs a store that can hold several
variables a key; `rocksdb` sets it for the session.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.functions.indicators import kdj, macd_state
from tideline.functions.windows import averages, by_symbol, diff

SPANS = (5, 10, 13, 20)
SHORT, LONG, SIGNAL = 12, 26, 9
FORCE = 2
#: Bars of a KDJ window, and the decay of K and D.
KDJ, COM = 5, 3
_DAY_MS = 86_400_000

_AVERAGES = ["short", "long", "signal", "force", "k", "d", *[f"ema{n}" for n in SPANS]]
LAST = "close double, gap int, " + ", ".join(f"{c} double" for c in _AVERAGES)
WEEK = "short double, long double, signal double"
RECENT = "low double, high double"
BARS = "symbol string, dt date, high double, low double, close double, volume double"
INDICATORS = "symbol string, dt date, close double, macd double, force_index_close double, RSV double, K double, D double, J double, macd_close_weekly double, macd_close_weekly_last double, " + ", ".join(f"ema{n} double" for n in SPANS)
INITIAL = f"symbol string, last struct<{LAST.replace(' double', ': double').replace(' int', ': int')}>, week struct<{WEEK.replace(' double', ': double')}>, recent array<struct<{RECENT.replace(' double', ': double')}>>"


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _toward(y: float | None, x: float | None, alpha: float) -> float | None:
    """An exponential average one value on; the first value is the average itself."""
    return y if x is None else x if y is None else (1 - alpha) * y + alpha * x


def _number(x: Any) -> float | None:
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x)


class IndicatorState(StatefulProcessor):
    """Steps a symbol's indicators from bar to bar; bars of a batch are sorted, batches come in order of dt."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST)
        self.week = handle.getValueState("week", WEEK)
        self.recent = handle.getListState("recent", RECENT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = ["close", "gap", *_AVERAGES]
        s = dict(zip(names, self.last.get() if self.last.exists() else [None] * len(names), strict=True))
        week = self.week.get() if self.week.exists() else None
        recent = list(self.recent.get()) if self.recent.exists() else []
        out = []
        for bar in pd.concat(list(rows)).sort_values("dt").itertuples():
            close = float(bar.close)
            moved = None if s["close"] is None else (close - s["close"]) * float(bar.volume)
            recent = [*recent, (float(bar.low), float(bar.high))][-KDJ:]
            low, high = min(x[0] for x in recent), max(x[1] for x in recent)
            rsv = (close - low) / (high - low) * 100 if high > low else None
            if rsv is not None:
                # Rows without a value let the weight of the past decay.
                left = (1 - 1 / (1 + COM)) ** (s["gap"] or 1)
                s["k"] = rsv if s["k"] is None else (left * s["k"] + rsv / (1 + COM)) / (left + 1 / (1 + COM))
            s["gap"] = 1 if rsv is not None else s["gap"] and s["gap"] + 1
            s["d"] = _toward(s["d"], s["k"], 1 / (1 + COM))
            s["short"], s["long"] = _toward(s["short"], close, 2 / (SHORT + 1)), _toward(s["long"], close, 2 / (LONG + 1))
            s["signal"] = _toward(s["signal"], s["short"] - s["long"], 2 / (SIGNAL + 1))
            s["force"] = _toward(s["force"], moved, 2 / (FORCE + 1))
            for n in SPANS:
                s[f"ema{n}"] = _toward(s[f"ema{n}"], close, 2 / (n + 1))
            today = self._week(week, close)
            known, before = (today[0] - today[1] - today[2], week[0] - week[1] - week[2]) if week else (0.0, None)
            week = today if pd.Timestamp(bar.dt).weekday() == 4 else week
            s["close"] = close
            k, d = s["k"], s["d"]
            out.append((key[0], bar.dt, close, s["short"] - s["long"] - s["signal"], s["force"], rsv, k, d, None if k is None else 3 * k - 2 * d, known, before, *[s[f"ema{n}"] for n in SPANS]))
        self.last.update(tuple(s.values()))
        self.recent.put(recent)
        if week:
            self.week.update(week)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in INDICATORS.split(", ")])

    @staticmethod
    def _week(week: tuple | None, close: float) -> tuple[float, float, float]:
        """The weekly averages with a close as that of the running week."""
        short, long, signal = week or (None, None, None)
        short, long = _toward(short, close, 2 / (SHORT + 1)), _toward(long, close, 2 / (LONG + 1))
        return short, long, _toward(signal, short - long, 2 / (SIGNAL + 1))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        last = row["last"]
        gap = _number(last["gap"])
        self.last.update((_number(last["close"]), None if gap is None else int(gap), *[_number(last[c]) for c in _AVERAGES]))
        if row["week"] is not None and _number(row["week"]["short"]) is not None:
            self.week.update(tuple(_number(row["week"][c]) for c in ("short", "long", "signal")))
        self.recent.put([(float(x["low"]), float(x["high"])) for x in row["recent"]])

    def close(self) -> None:
        pass


def indicator_state(bars: DataFrame) -> DataFrame:
    """symbol, last, week, recent: the state after stored bars, for a stream that goes on from there."""
    df = kdj(bars.select("symbol", "dt", "high", "low", "close", "volume"), KDJ, COM)
    df = averages(df, "close", {"__short": 2 / (SHORT + 1), "__long": 2 / (LONG + 1), **{f"ema{n}": 2 / (n + 1) for n in SPANS}}, {"__signal": (lambda y: f"{y('__short')} - {y('__long')}", 2 / (SIGNAL + 1))})
    df = averages(df.withColumn("__moved", diff("close") * F.col("volume")), "__moved", {"__force": 2 / (FORCE + 1)})
    w = by_symbol()
    place = F.row_number().over(w)
    since = place - F.last(F.when(F.col("RSV").isNotNull(), F.col("__place")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    recent = F.collect_list(F.struct("low", "high")).over(w.rowsBetween(-(KDJ - 1), 0))
    df = df.withColumn("__place", place).withColumns({"__gap": since.cast("int"), "__recent": recent})
    last = F.struct("close", F.col("__gap").alias("gap"), *[F.col(c).alias(n) for n, c in zip(_AVERAGES, ["__short", "__long", "__signal", "__force", "K", "D", *[f"ema{n}" for n in SPANS]], strict=True)])
    state = df.groupBy("symbol").agg(F.max_by(last, "dt").alias("last"), F.max_by("__recent", "dt").alias("recent"))
    fridays = macd_state(bars.filter(F.weekday("dt") == 4).select("symbol", "dt", "close"), "close", "short", "long", "signal", SHORT, LONG, SIGNAL)
    weeks = fridays.groupBy("symbol").agg(F.max_by(F.struct("short", "long", "signal"), "dt").alias("week"))
    return state.join(weeks, "symbol", "left").select("symbol", "last", "week", "recent")


def running_indicators(bars: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """A stream of bars (symbol, dt, high, low, close, volume; none null) to their indicators.

    The same numbers as macd, force_index, kdj, ema_spans and weekly_macd_pit over all bars so
    far; initial (of `indicator_state`) has what came before the stream.
    """
    rows = bars.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in BARS.split(", ")])
    start = initial.groupBy("symbol") if initial is not None else None
    return rows.groupBy("symbol").transformWithStateInPandas(IndicatorState(), INDICATORS, "Append", "None", start)


class SignalMemory(StatefulProcessor):
    """What signal_three remembers of a symbol: the force index before, and the last two distinct weekly values."""

    def __init__(self, silent_days: int) -> None:
        self.silent = silent_days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.force = handle.getValueState("force", "force double, changes long")
        self.weekly = handle.getListState("weekly", "weekly double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        force, changes = self.force.get() if self.force.exists() else (None, 0)
        values = [x[0] for x in self.weekly.get()] if self.weekly.exists() else []
        out = []
        df = pd.concat(list(rows)).sort_values("dt")
        for row in df.itertuples():
            weekly, now = _number(row.weekly), _number(row.force)
            changed = not values or weekly is None or values[-1] is None or weekly != values[-1]
            changes += changed
            # values ends with the weekly value of the row before, and before it the one that it replaced.
            before = (values[-1] if values and values[-1] is not None else values[0] if len(values) > 1 else None) if changed else values[0] if len(values) > 1 else None
            usable = before if changes >= 2 + changed else None
            signal = 0
            if force and usable and weekly is not None:
                signal = (1 if now is not None and now < 0 < force else 0) if weekly > usable else -1
            out.append((key[0], row.dt, signal))
            values, force = [before, weekly], now
        self.force.update((force, changes))
        self.weekly.put([(x,) for x in values])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int(pd.Timestamp(df["ts"].max()).timestamp() * 1000) + self.silent)
        yield pd.DataFrame(out, columns=["symbol", "dt", "signal"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.force.clear()
        self.weekly.clear()
        yield pd.DataFrame({"symbol": [key[0]], "dt": [None], "signal": [None]}).astype({"signal": "object"})

    def close(self) -> None:
        pass


def running_signals(df: DataFrame, weekly: str = "macd_close_weekly_vis", force: str = "force_index_close", silent_days: int = 30, late: str = "1 day") -> DataFrame:
    """A stream of days (symbol, dt, the weekly value, the force index) to symbol, dt, signal as by signal_three.

    A symbol without a day for silent_days, by the days of all symbols, is forgotten, which a
    row without dt and signal tells; it begins anew with its next day.
    """
    rows = df.select("symbol", F.col("dt").cast("date").alias("dt"), F.col("dt").cast("timestamp").alias("ts"), F.col(weekly).cast("double").alias("weekly"), F.col(force).cast("double").alias("force"))
    return rows.withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(SignalMemory(silent_days), "symbol string, dt date, signal int", "Append", "EventTime")
