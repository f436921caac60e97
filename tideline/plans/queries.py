"""Queries over the driver's tables, each with the same result in DuckDB SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.functions import indicators as I
from tideline.functions import scan
from tideline.functions import windows as W
from tideline.operators import datasets, report, sampling, signals, simulate
from tideline.plans.features import daily_features, file_features, with_weekly
from tideline.sources import lookups, store
from tideline.sources.bars import bars_from_trades, closed, half_open, in_universe, points_to_rows, prefixed, recent, row_slice, unpivoted_pre_close, with_pre_close
from tideline.sources.sinks import latest
from tideline.streaming.live import intraday, policy_memory, tick_bars


def bars(spark: SparkSession, d: str, weekdays: bool = True) -> DataFrame:
    """Daily bars of line items: a symbol for each flag and status, the price an item; without weekends, as trading days are, if weekdays."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    day = F.col("l_shipdate").cast("date")
    t = t.filter(F.weekday(day) < 5) if weekdays else t
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return bars_from_trades(t, F.concat("l_returnflag", "l_linestatus"), day, F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.col("l_extendedprice"), order)


def priced(spark: SparkSession, d: str) -> DataFrame:
    """Bars with a pre_close that differs from the close before on every 250th day."""
    n = F.row_number().over(W.by_symbol())
    return bars(spark, d).withColumn("pre_close", F.when(n % 250 == 0, W.lag("close") / 1.1).otherwise(W.lag("close")))


def featured(spark: SparkSession, d: str) -> DataFrame:
    """What signals need: weekly MACD as joined, force index, averages."""
    b = bars(spark, d)
    weekly = I.macd(I.weekly_bars(b), "close", "macd_close").select("symbol", "dt", "macd_close")
    df = I.force_index(with_weekly(b, weekly)).withColumnRenamed("macd_close_weekly", "macd_close_weekly_vis")
    return W.ema_spans(df, (5, 10, 13))


def _rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: _round(F.col(c), places) for c in columns})


def _round(c: Column, places: int) -> Column:
    """Half up, a little below half too: both engines then agree on short decimals in spite of their last bits."""
    k = 10.0**places
    return F.floor(c * k + 0.5001) / k


def _round_sql(sql: str) -> str:
    """SQL with round(x, n) written out as _round does it."""
    at = sql.find("round(")
    while at >= 0:
        depth, comma, end = 1, at, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if depth == 1 and sql[end] == "," else comma
            end += 1
        k = f"1e{sql[comma + 1 : end - 1].strip()}"
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]}) * {k} + 0.5001) / {k}){sql[end:]}"
        at = sql.find("round(")
    return sql


def _days(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("symbol", "dt", *columns)


def _signals(df: DataFrame) -> DataFrame:
    return df.filter("signal <> 0").select("symbol", "dt", F.col("signal").cast("int").alias("signal"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet")
    return t.groupBy(F.col("o_orderpriority").alias("key"), F.col("o_orderdate").cast("date").alias("dt")).agg(F.sum("o_totalprice").alias("value"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BARS = """bars AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS dt,
    arg_min(l_extendedprice / l_quantity, k) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, k) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume, sum(l_extendedprice) AS amount
  FROM (SELECT *, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE isodow(CAST(l_shipdate AS DATE)) < 6 GROUP BY ALL
), numbered AS (SELECT *, row_number() OVER w AS n, lag(close) OVER w AS prev FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt))"""
_WEEKS = """weeks AS (
  SELECT symbol, CAST(dt + CAST((5 - isodow(dt) + 7) % 7 AS INTEGER) AS DATE) AS we, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low, arg_max(close, dt) AS close, sum(volume) AS volume, sum(amount) AS amount
  FROM bars GROUP BY ALL
), wn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY we) AS n FROM weeks)"""


def _macd_sql(source: str, name: str, day: str) -> str:
    """A recursive CTE over numbered rows: EMAs 12 and 26, and the EMA 9 of their difference."""
    return f"""{name} AS (
  SELECT symbol, {day} AS dt, n, close, close AS a, close AS b, CAST(0 AS DOUBLE) AS s FROM {source} WHERE n = 1
  UNION ALL
  SELECT symbol, dt, n, close, a, b, s * 0.8 + (a - b) * 0.2 FROM (
    SELECT r.symbol, r.{day} AS dt, r.n, r.close, m.a * 11 / 13 + r.close * 2 / 13 AS a, m.b * 25 / 27 + r.close * 2 / 27 AS b, m.s
    FROM {name} m JOIN {source} r ON r.symbol = m.symbol AND r.n = m.n + 1))"""


_FORCE = """moved AS (SELECT symbol, dt, n - 1 AS n, (close - prev) * volume AS x FROM numbered WHERE n > 1
), force AS (
  SELECT symbol, dt, n, x AS f FROM moved WHERE n = 1
  UNION ALL SELECT r.symbol, r.dt, r.n, m.f / 3 + r.x * 2 / 3 FROM force m JOIN moved r ON r.symbol = m.symbol AND r.n = m.n + 1)"""
_PIT = f"""fr AS (SELECT symbol, dt, close, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS n FROM bars WHERE isodow(dt) = 5
), {_macd_sql("fr", "fm", "dt")}, st AS (
  SELECT b.symbol, b.dt, b.close, f.a, f.b, f.s, row_number() OVER (PARTITION BY b.symbol, b.dt ORDER BY f.dt DESC) AS k FROM bars b LEFT JOIN fm f ON f.symbol = b.symbol AND f.dt < b.dt
), x AS (SELECT *, (a * 11 / 13 + close * 2 / 13) - (b * 25 / 27 + close * 2 / 27) AS m FROM st WHERE k = 1)"""
_WEEKLY = f"""{_WEEKS}, {_macd_sql("wn", "wm", "we")}, joined AS (
  SELECT b.*, last_value(w.a - w.b - w.s IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.dt) AS mw
  FROM numbered b LEFT JOIN wm w ON w.symbol = b.symbol AND w.dt = b.dt)"""
_KDJ = """r0 AS (
  SELECT symbol, dt, n, min(low) OVER w AS l, max(high) OVER w AS h, close FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS 4 PRECEDING)
), r1 AS (SELECT symbol, dt, n, CASE WHEN h > l THEN (close - l) / (h - l) * 100 END AS rsv FROM r0
), k AS (
  SELECT symbol, dt, n, rsv, rsv AS k, rsv AS d, CASE WHEN rsv IS NULL THEN 0 ELSE 1 END AS g FROM r1 WHERE n = 1
  UNION ALL
  SELECT symbol, dt, n, rsv, k, CASE WHEN k IS NULL THEN NULL WHEN d0 IS NULL THEN k ELSE 0.75 * d0 + 0.25 * k END, CASE WHEN rsv IS NULL THEN g + (CASE WHEN k IS NULL THEN 0 ELSE 1 END) ELSE 1 END FROM (
    SELECT r.symbol, r.dt, r.n, r.rsv, m.g, m.d AS d0,
      CASE WHEN r.rsv IS NULL THEN m.k WHEN m.k IS NULL THEN r.rsv ELSE (power(0.75, m.g) * m.k + 0.25 * r.rsv) / (power(0.75, m.g) + 0.25) END AS k
    FROM k m JOIN r1 r ON r.symbol = m.symbol AND r.n = m.n + 1))"""


def _ema_sql(span: int) -> str:
    return f"""e{span} AS (
  SELECT symbol, dt, n, close AS e FROM numbered WHERE n = 1
  UNION ALL SELECT r.symbol, r.dt, r.n, m.e * {span - 1} / {span + 1} + r.close * 2 / {span + 1} FROM e{span} m JOIN numbered r ON r.symbol = m.symbol AND r.n = m.n + 1)"""


_EMA13 = """e13 AS (
  SELECT symbol, dt, n, close AS e FROM numbered WHERE n = 1
  UNION ALL SELECT r.symbol, r.dt, r.n, m.e * 12 / 14 + r.close * 2 / 14 FROM e13 m JOIN numbered r ON r.symbol = m.symbol AND r.n = m.n + 1)"""


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = _round_sql(f"WITH RECURSIVE {sql}")


_add("daily_bars", lambda s, d: bars(s, d), f"{_BARS} SELECT * FROM bars")
_add("weekly_bars", lambda s, d: _rounded(I.weekly_bars(bars(s, d)), "amount", places=2), f"{_BARS}, {_WEEKS} SELECT symbol, we AS dt, open, high, low, close, volume, round(amount, 2) AS amount FROM weeks")
_add(
    "week_to_date_bars",
    lambda s, d: _days(I.week_to_date(bars(s, d)), "wtd_open", "wtd_high", "wtd_low", "wtd_close", "wtd_volume"),
    f"{_BARS} SELECT symbol, dt, first_value(open) OVER w AS wtd_open, max(high) OVER w AS wtd_high, min(low) OVER w AS wtd_low, close AS wtd_close, sum(volume) OVER w AS wtd_volume FROM bars WINDOW w AS (PARTITION BY symbol, date_trunc('week', dt) ORDER BY dt)",
)
_add(
    "sma",
    lambda s, d: _rounded(_days(bars(s, d).withColumns({f"ma{n}": W.sma("close", n) for n in (5, 10, 20)} | {"ma6_short": W.sma("close", 6, full=False)}), "ma5", "ma10", "ma20", "ma6_short"), "ma5", "ma10", "ma20", "ma6_short"),
    f"{_BARS} SELECT symbol, dt, " + ", ".join(f"CASE WHEN n >= {k} THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS {k - 1} PRECEDING), 4) END AS ma{k}" for k in (5, 10, 20)) + ", round(avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS 5 PRECEDING), 4) AS ma6_short FROM numbered",
)
_add(
    "rolling_minmax",
    lambda s, d: _days(scan.blocked(bars(s, d), {"runmax": ("max", "close"), "runmin": ("min", "close")}).withColumns({"low5": W.rolling(F.min, "low", 5, False), "high5": W.rolling(F.max, "high", 5, False)}), "low5", "high5", "runmax", "runmin"),
    f"{_BARS} SELECT symbol, dt, min(low) OVER (w ROWS 4 PRECEDING) AS low5, max(high) OVER (w ROWS 4 PRECEDING) AS high5, max(close) OVER w AS runmax, min(close) OVER w AS runmin FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)".replace("(w ROWS 4 PRECEDING)", "(PARTITION BY symbol ORDER BY dt ROWS 4 PRECEDING)"),
)
_add(
    "lag_returns",
    lambda s, d: _rounded(_days(bars(s, d).withColumns({"change": W.diff("close"), "amplitude": I.amplitude(), "returns": I.log_return(), "next_close": W.lead("close")}), "change", "amplitude", "returns", "next_close"), "change", "amplitude", "returns", places=6),
    f"{_BARS} SELECT symbol, dt, round(close - prev, 6) AS change, round((high - low) / prev, 6) AS amplitude, round(ln(close / prev), 6) AS returns, lead(close) OVER (PARTITION BY symbol ORDER BY dt) AS next_close FROM numbered",
)
_add(
    "adjusted_prices",
    lambda s, d: _rounded(_days(I.back_adjusted(priced(s, d).checkpoint(), first_is_one=True, block=scan.days("dt")), "adj_factor", "open", "high", "low", "close"), "adj_factor", "open", "high", "low", "close"),
    f"{_BARS} SELECT symbol, dt, " + ", ".join(f"round({c} * power(1.1, n // 250), 4) AS {c}" for c in ("open", "high", "low", "close")) + ", round(power(1.1, n // 250), 4) AS adj_factor FROM numbered",
)
_add(
    "cumulative_return",
    lambda s, d: _rounded(_days(scan.blocked(bars(s, d).withColumn("returns", I.log_return()), {"cum": ("sum", "returns")}), "cum"), "cum", places=6),
    f"{_BARS} SELECT symbol, dt, CASE WHEN n > 1 THEN round(ln(close / first_value(close) OVER (PARTITION BY symbol ORDER BY dt)), 6) + 0.0 END AS cum FROM numbered",
)
_add(
    "normalize_minmax",
    lambda s, d: _rounded(_days(bars(s, d).withColumns({"norm": W.min_max("close"), "z": W.standardized("close")}), "norm", "z"), "norm", "z", places=6),
    f"{_BARS} SELECT symbol, dt, round((close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w), 6) + 0.0 AS norm, round((close - avg(close) OVER w) / stddev_samp(close) OVER w, 6) + 0.0 AS z FROM bars WINDOW w AS (PARTITION BY symbol)",
)
# The operator rounds by itself here.
_add(
    "market_return",
    lambda s, d: bars(s, d).withColumn("returns", I.log_return()).groupBy("symbol").agg(report.market_return().alias("market_return")),
    f"{_BARS} SELECT symbol, round((arg_max(close, dt) / arg_min(close, dt)) * 100 - 100, 2) AS market_return FROM bars GROUP BY symbol",
)
_add(
    "ema",
    lambda s, d: _rounded(_days(W.ema_spans(bars(s, d), (2, 13)), "ema2", "ema13"), "ema2", "ema13"),
    f"""{_BARS}, {_EMA13}, e2 AS (
  SELECT symbol, dt, n, close AS e FROM numbered WHERE n = 1
  UNION ALL SELECT r.symbol, r.dt, r.n, m.e / 3 + r.close * 2 / 3 FROM e2 m JOIN numbered r ON r.symbol = m.symbol AND r.n = m.n + 1)
SELECT e2.symbol, e2.dt, round(e2.e, 4) AS ema2, round(e13.e, 4) AS ema13 FROM e2 JOIN e13 ON e2.symbol = e13.symbol AND e2.n = e13.n""",
)
_add("macd", lambda s, d: _rounded(_days(I.macd(bars(s, d)), "macd"), "macd"), f"{_BARS}, {_macd_sql('numbered', 'm', 'dt')} SELECT symbol, dt, round(a - b - s, 4) + 0.0 AS macd FROM m")
_add("force_index", lambda s, d: _rounded(_days(I.force_index(bars(s, d)), "force_index_close"), "force_index_close", places=2), f"{_BARS}, {_FORCE} SELECT b.symbol, b.dt, round(f, 2) + 0.0 AS force_index_close FROM bars b LEFT JOIN force ON force.symbol = b.symbol AND force.dt = b.dt")
_add(
    "kdj",
    lambda s, d: _rounded(_days(I.kdj(bars(s, d)), "RSV", "K", "D", "J"), "RSV", "K", "D", "J"),
    f"""{_BARS}, {_KDJ}
SELECT symbol, dt, round(rsv, 4) + 0.0 AS "RSV", round(k, 4) + 0.0 AS "K", round(d, 4) + 0.0 AS "D", round(3 * k - 2 * d, 4) + 0.0 AS "J" FROM k""",
)
_add(
    "rsi",
    lambda s, d: _rounded(_days(I.rsi(bars(s, d)), "RSI"), "RSI"),
    f"""{_BARS}, c AS (SELECT symbol, dt, coalesce(close - prev, 0) AS x FROM numbered
), g AS (SELECT symbol, dt, avg(greatest(x, 0)) OVER w AS g, avg(greatest(-x, 0)) OVER w AS l FROM c WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS 5 PRECEDING))
SELECT symbol, dt, CASE WHEN l > 0 THEN round(100 - 100 / (1 + g / l), 4) WHEN g > 0 THEN 100.0 END AS "RSI" FROM g""",
)
_add(
    "weekly_macd_pit",
    lambda s, d: _rounded(_days(I.weekly_macd_pit(bars(s, d)), "macd_close_weekly", "macd_close_weekly_last"), "macd_close_weekly", "macd_close_weekly_last"),
    f"""{_BARS}, {_PIT}
SELECT symbol, dt, round(coalesce(m - (s * 0.8 + m * 0.2), 0), 4) + 0.0 AS macd_close_weekly, round(a - b - s, 4) + 0.0 AS macd_close_weekly_last FROM x""",
)
_add("weekly_macd_joined", lambda s, d: _rounded(_days(featured(s, d), "macd_close_weekly_vis"), "macd_close_weekly_vis"), f"{_BARS}, {_WEEKLY} SELECT symbol, dt, round(mw, 4) + 0.0 AS macd_close_weekly_vis FROM joined")
_add(
    "weekly_outer_join",
    lambda s, d: _days(with_weekly(bars(s, d), I.weekly_bars(bars(s, d)).select("symbol", "dt", "close"), "outer", scan.days("dt")), "close", "close_weekly"),
    f"{_BARS}, {_WEEKS} SELECT symbol, dt, last_value(close IGNORE NULLS) OVER w AS close, last_value(cw IGNORE NULLS) OVER w AS close_weekly FROM (SELECT coalesce(b.symbol, k.symbol) AS symbol, coalesce(b.dt, k.we) AS dt, b.close, k.close AS cw FROM bars b FULL JOIN weeks k ON b.symbol = k.symbol AND b.dt = k.we) WINDOW w AS (PARTITION BY symbol ORDER BY dt)",
)
_SIGNAL3 = f"""{_BARS}, {_WEEKLY}, {_FORCE}, c0 AS (
  SELECT j.symbol, j.dt, j.mw, f.f, lag(f.f) OVER w AS pf, lag(j.mw) OVER w AS pm FROM joined j LEFT JOIN force f ON f.symbol = j.symbol AND f.dt = j.dt WINDOW w AS (PARTITION BY j.symbol ORDER BY j.dt)
), c1 AS (SELECT *, CASE WHEN pm IS NULL OR mw IS NULL OR mw <> pm THEN 1 ELSE 0 END AS ch FROM c0
), c2 AS (SELECT *, sum(ch) OVER w AS run, last_value(CASE WHEN ch = 1 THEN pm END IGNORE NULLS) OVER w AS bv FROM c1 WINDOW w AS (PARTITION BY symbol ORDER BY dt)
), c3 AS (SELECT *, CASE WHEN run >= 2 + ch THEN bv END AS before FROM c2
), sig AS (SELECT symbol, dt, f, CASE WHEN coalesce(pf, 0) = 0 OR coalesce(before, 0) = 0 THEN 0 WHEN mw > before THEN CASE WHEN f < 0 AND pf > 0 THEN 1 ELSE 0 END WHEN mw <= before THEN -1 ELSE 0 END AS signal FROM c3)"""
_add("signal_three", lambda s, d: _signals(signals.signal_three(featured(s, d))), f"{_SIGNAL3} SELECT symbol, dt, signal FROM sig WHERE signal <> 0")
_add(
    "signal_ema",
    lambda s, d: _signals(signals.signal_ema(featured(s, d))),
    f"""{_BARS}, {_FORCE}, {_EMA13}, c0 AS (SELECT e.symbol, e.dt, e.e, lag(e.e) OVER w AS pe, f.f, lag(f.f) OVER w AS pf FROM e13 e LEFT JOIN force f ON f.symbol = e.symbol AND f.dt = e.dt WINDOW w AS (PARTITION BY e.symbol ORDER BY e.dt))
SELECT symbol, dt, CASE WHEN e > pe THEN 1 ELSE -1 END AS signal FROM c0 WHERE pf <> 0 AND ((e > pe AND f < 0 AND pf > 0) OR (e <= pe AND f > 0 AND pf < 0))""",
)
_add("top1_candidate", lambda s, d: signals.best_candidate(signals.signal_three(featured(s, d))).select("dt", "symbol"), f"{_SIGNAL3} SELECT dt, symbol FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY f, symbol) AS k FROM sig WHERE signal = 1) WHERE k = 1")
_add(
    "monotonic_runs",
    lambda s, d: signals.monotonic_runs(bars(s, d)),
    f"""{_BARS}, t AS (SELECT symbol, dt, n - 1 AS p, CAST(sign(coalesce(close - prev, 0)) AS INT) AS trend FROM numbered
), c AS (SELECT *, CASE WHEN trend IS DISTINCT FROM lag(trend) OVER (PARTITION BY symbol ORDER BY dt) THEN 1 ELSE 0 END AS ch FROM t
), r AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY dt) AS run FROM c)
SELECT symbol, CAST(min(p) AS INT) AS start, CAST(max(p) AS INT) AS "end", trend FROM r WHERE trend <> 0 GROUP BY symbol, run, trend""",
)
_add(
    "lockstep_join",
    lambda s, d: signals.lockstep(bars(s, d)).groupBy("step").agg(F.min("dt").alias("first_dt"), _round(F.sum("close"), 4).alias("total"), F.count(F.lit(1)).alias("n")).withColumn("step", F.col("step").cast("int")),
    f"{_BARS}, m AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM bars GROUP BY symbol)) SELECT CAST(n - 1 AS INT) AS step, min(dt) AS first_dt, round(sum(close), 4) AS total, count(*) AS n FROM numbered, m WHERE n <= c GROUP BY numbered.n",
)
_FORWARD = f"{_BARS}, fw AS (SELECT symbol, dt, n, close, lead(close, 5) OVER (PARTITION BY symbol ORDER BY dt) / close - 1 AS r FROM numbered)"
_add("forward_label", lambda s, d: _rounded(_days(datasets.forward_return(bars(s, d)), "fwd_return", "label"), "fwd_return", places=6), f"{_FORWARD} SELECT symbol, dt, round(r, 6) + 0.0 AS fwd_return, CAST(r > 0 AS INT) AS label FROM fw")
_add(
    "slope_hit_rate",
    lambda s, d: datasets.slope_hits(I.macd(datasets.forward_return(bars(s, d)))).groupBy("symbol").agg(_round(F.avg("hit"), 6).alias("hit_rate"), F.count("hit").alias("n")),
    f"{_FORWARD}, {_macd_sql('numbered', 'm', 'dt')}, h AS (SELECT symbol, n, a - b - s AS h, lead(a - b - s) OVER (PARTITION BY symbol ORDER BY n) AS h1 FROM m) SELECT fw.symbol, round(avg(CASE WHEN (h1 - h) * r > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, count(*) AS n FROM fw JOIN h ON fw.symbol = h.symbol AND fw.n = h.n WHERE r IS NOT NULL AND h1 IS NOT NULL GROUP BY fw.symbol",
)
_add("train_test_split", lambda s, d: _days(datasets.split_by_place(bars(s, d)), "is_train"), f"{_BARS} SELECT symbol, dt, n - 1 < floor(0.8 * count(*) OVER (PARTITION BY symbol)) AS is_train FROM numbered")
_add(
    "sliding_windows",
    lambda s, d: datasets.sliding_windows(bars(s, d), ["close", "volume"], "close").select("symbol", "dt", F.size("window").alias("n"), F.get(F.col("window"), F.lit(0))[0].alias("first_close"), F.get(F.col("window"), F.lit(29))[1].alias("last_volume"), "target"),
    f"{_BARS} SELECT symbol, dt, 30 AS n, close AS first_close, v AS last_volume, t AS target FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS c, lead(volume, 29) OVER w AS v, lead(close, 30) OVER w AS t FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY dt)) WHERE n <= c - 35",
)
_add(
    "histogram100",
    lambda s, d: datasets.histogram(bars(s, d), "volume"),
    f"{_BARS}, e AS (SELECT min(volume) AS lo, max(volume) AS hi FROM bars) SELECT CAST(least(floor((volume - lo) / (hi - lo) * 100) + 1, 100) AS INT) AS bin, count(*) AS n FROM bars, e GROUP BY 1",
)
_ORDERS = "o AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS dt, sum(o_totalprice) AS v FROM orders GROUP BY ALL)"
_add(
    "drawdown_profit",
    lambda s, d: _rounded(report.drawdown(_orders(s, d), ["key"], "dt", "value"), "max_drawdown", "max_profit", places=6),
    f"{_ORDERS}, x AS (SELECT key, v / max(v) OVER w - 1 AS a, v / min(v) OVER w - 1 AS b FROM o WINDOW w AS (PARTITION BY key ORDER BY dt)) SELECT key, round(min(a), 6) AS max_drawdown, round(max(b), 6) AS max_profit FROM x GROUP BY key",
)
_add("sharpe", lambda s, d: _rounded(report.sharpe(_orders(s, d), ["key"], "dt", "value"), "sharpe", places=6), f"{_ORDERS}, x AS (SELECT key, v / first_value(v) OVER (PARTITION BY key ORDER BY dt) - 1 AS r FROM o) SELECT key, round(avg(r) / stddev_pop(r), 6) AS sharpe FROM x GROUP BY key")
_add(
    "trade_pairs",
    lambda s, d: report.trade_pairs(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("timestamp"), F.col("o_totalprice").alias("price"), F.lit(100.0).alias("quantity")), ["symbol"], ["timestamp"]).select("symbol", F.col("pair").cast("int").alias("pair"), "buy_price", "sell_price", _round(F.col("revenue"), 2).alias("revenue")),
    "n AS (SELECT o_custkey AS symbol, o_totalprice AS p, row_number() OVER w - 1 AS k, lead(o_totalprice) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT symbol, CAST(k // 2 AS INT) AS pair, p AS buy_price, q AS sell_price, round((q - p) * 100.0, 2) AS revenue FROM n WHERE k % 2 = 0 AND q IS NOT NULL",
)
_add(
    "discounted_return",
    lambda s, d: _rounded(_days(datasets.discounted(bars(s, d), "close"), "ret"), "ret", places=2),
    f"{_BARS}, rv AS (SELECT symbol, dt, close, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS n FROM bars), dr AS (SELECT symbol, dt, n, close AS r FROM rv WHERE n = 1 UNION ALL SELECT x.symbol, x.dt, x.n, x.close + 0.99 * m.r FROM dr m JOIN rv x ON x.symbol = m.symbol AND x.n = m.n + 1) SELECT symbol, dt, round(r, 2) AS ret FROM dr",
)
_add("baseline_advantage", lambda s, d: _rounded(_days(datasets.baseline_advantage(bars(s, d), "close"), "advantage"), "advantage"), f"{_BARS} SELECT symbol, dt, round(close - coalesce(avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), close), 4) + 0.0 AS advantage FROM bars")
_add("replay_buffer", lambda s, d: datasets.replay_buffer(bars(s, d), 100).select("symbol", "dt", "close"), f"{_BARS} SELECT symbol, dt, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k FROM bars) WHERE k <= 100")
_add(
    "pivot_fields",
    lambda s, d: points_to_rows(bars(s, d).unpivot(["symbol", "dt"], ["open", "close", "volume"], "field", "value"), ["open", "close", "volume"], ["symbol", "dt"]),
    f"{_BARS} SELECT symbol, dt, open, close, volume FROM bars",
)
_add("half_open_range", lambda s, d: half_open(bars(s, d), "1995-01-02", "1996-01-01").select("symbol", "dt", "close"), f"{_BARS} SELECT symbol, dt, close FROM bars WHERE dt >= DATE '1995-01-02' AND dt < DATE '1996-01-01'")
_add("upsert_latest", lambda s, d: latest(_events(s, d), ["user_id", "event_type"], F.col("ts")).select("user_id", "event_type", "event_id", "value"), "x AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS k FROM events) SELECT user_id, event_type, event_id, value FROM x WHERE k = 1")
_add("json_props", lambda s, d: _events(s, d).select("event_id", F.from_json("props", "k long")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")), "x AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT k, count(*) AS n FROM x GROUP BY k")
_add(
    "tumbling_ticks",
    lambda s, d: tick_bars(_events(s, d).select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("tick_id"))).withColumn("start", F.col("start").cast("timestamp_ntz")),
    "x AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS start, value, (ts, event_id) AS k FROM events) SELECT symbol, start, arg_min(value, k) AS open, max(value) AS high, min(value) AS low, arg_max(value, k) AS close, count(*) AS n FROM x GROUP BY symbol, start",
)
_add("chart_table", lambda s, d: report.chart(I.macd(bars(s, d)), _fills(bars(s, d)), "macd").select("symbol", "dt", "colour", "marker"), f"{_BARS}, {_macd_sql('numbered', 'm', 'dt')}, f AS (SELECT symbol, dt, CASE WHEN symbol LIKE 'A%' THEN low ELSE high END AS marker FROM bars WHERE day(dt) = 1) SELECT m.symbol, m.dt, CASE WHEN a - b - s >= 0 THEN 'green' ELSE 'red' END AS colour, marker FROM m LEFT JOIN f ON f.symbol = m.symbol AND f.dt = m.dt")
_ADJUSTED = f"""{_BARS.replace("bars AS (", "raw AS (", 1).replace("numbered AS (", "raw_numbered AS (").replace("FROM bars WINDOW", "FROM raw WINDOW")}, bars AS (
  SELECT symbol, dt, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume, amount, CASE WHEN n % 250 = 0 THEN prev / 1.1 ELSE prev END AS pre_close, f AS adj_factor
  FROM (SELECT *, power(1.1, n // 250) AS f FROM raw_numbered) WHERE n > 1
), numbered AS (SELECT *, row_number() OVER w AS n, lag(close) OVER w AS prev FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt))"""
_FEATURES = {
    "open": 4, "high": 4, "low": 4, "close": 4, "volume": 2, "amount": 2, "pre_close": 4, "adj_factor": 6, "macd_close_weekly": 4, "macd_close_weekly_last": 4, "open_weekly": 4, "high_weekly": 4, "low_weekly": 4,
    "close_weekly_vis": 4, "volume_weekly": 2, "amount_weekly": 2, "macd_close_weekly_vis": 4, "force_index_close": 2, "RSV": 4, "K": 4, "D": 4, "J": 4, "ema5": 4, "ema10": 4, "ema13": 4, "ema20": 4, "amplitude": 6, "returns": 6,
}
_FRAME = f"""{_ADJUSTED}, {_PIT}, {_WEEKLY}, {_FORCE}, {_KDJ}, {", ".join(_ema_sql(n) for n in (5, 10, 13, 20))}, parts AS (
  SELECT b.symbol, b.dt, b.open, b.high, b.low, b.close, b.volume, b.amount, b.pre_close, b.adj_factor, coalesce(x.m - (x.s * 0.8 + x.m * 0.2), 0) AS macd_close_weekly, x.a - x.b - x.s AS macd_close_weekly_last,
    {", ".join(f"last_value(weeks.{c} IGNORE NULLS) OVER w AS {c}_weekly{'_vis' if c == 'close' else ''}" for c in ("open", "high", "low", "close", "volume", "amount"))}, j.mw AS macd_close_weekly_vis, f.f AS force_index_close,
    k.rsv AS "RSV", k.k AS "K", k.d AS "D", 3 * k.k - 2 * k.d AS "J", e5.e AS ema5, e10.e AS ema10, e13.e AS ema13, e20.e AS ema20
  FROM numbered b LEFT JOIN x ON x.symbol = b.symbol AND x.dt = b.dt LEFT JOIN weeks ON weeks.symbol = b.symbol AND weeks.we = b.dt LEFT JOIN joined j ON j.symbol = b.symbol AND j.dt = b.dt
    LEFT JOIN force f ON f.symbol = b.symbol AND f.dt = b.dt LEFT JOIN k ON k.symbol = b.symbol AND k.dt = b.dt
    {" ".join(f"JOIN e{n} ON e{n}.symbol = b.symbol AND e{n}.dt = b.dt" for n in (5, 10, 13, 20))}
  WINDOW w AS (PARTITION BY b.symbol ORDER BY b.dt)
), whole AS (SELECT * FROM parts WHERE macd_close_weekly_last IS NOT NULL AND macd_close_weekly_vis IS NOT NULL AND force_index_close IS NOT NULL AND "RSV" IS NOT NULL
), moves AS (SELECT *, (high - low) / lag(close) OVER w AS amplitude, ln(close / lag(close) OVER w) AS returns FROM whole WINDOW w AS (PARTITION BY symbol ORDER BY dt))
SELECT symbol, dt, {", ".join(f'round("{c}", {n}) + 0.0 AS "{c}"' for c, n in _FEATURES.items())} FROM moves WHERE amplitude IS NOT NULL"""
_add("feature_frame", lambda s, d: daily_features(I.back_adjusted(priced(s, d))).select("symbol", "dt", *[_round(F.col(c), n).alias(c) for c, n in _FEATURES.items()]), _FRAME)
_FILE_FEATURES = {"open": 4, "high": 4, "low": 4, "close": 4, "volume": 2, "amplitude": 6, "returns": 6, "macd_close_weekly": 4, "force_index_close": 2, "MA5": 4, "ema5": 4, "ema10": 4, "ema20": 4}
_FILE_FRAME = f"""{_BARS.replace("bars AS (", "raw AS (", 1).replace("numbered AS (", "raw_numbered AS (").replace("FROM bars WINDOW", "FROM raw WINDOW")}, {_WEEKS.replace("FROM bars GROUP", "FROM raw GROUP")}, {_macd_sql("wn", "wm", "we")}, outer_rows AS (
  SELECT coalesce(b.symbol, m.symbol) AS symbol, coalesce(b.dt, m.dt) AS dt, b.open, b.high, b.low, b.close, b.volume, b.amount, m.a - m.b - m.s AS mw FROM raw b FULL JOIN wm m ON m.symbol = b.symbol AND m.dt = b.dt
), bars AS (
  SELECT symbol, dt, {", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("open", "high", "low", "close", "volume", "amount", "mw"))} FROM outer_rows WINDOW w AS (PARTITION BY symbol ORDER BY dt)
), numbered AS (SELECT *, row_number() OVER w AS n, lag(close) OVER w AS prev FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)
), {_FORCE}, {", ".join(_ema_sql(n) for n in (5, 10, 20))}, whole AS (
  SELECT b.*, f.f AS force_index_close, e5.e AS ema5, e10.e AS ema10, e20.e AS ema20 FROM numbered b JOIN force f ON f.symbol = b.symbol AND f.dt = b.dt
    {" ".join(f"JOIN e{n} ON e{n}.symbol = b.symbol AND e{n}.dt = b.dt" for n in (5, 10, 20))} WHERE b.mw IS NOT NULL
), moves AS (
  SELECT *, (high - low) / lag(close) OVER w AS amplitude, ln(close / lag(close) OVER w) AS returns, close - lag(close) OVER w AS c, row_number() OVER w AS place,
    {", ".join(f"avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS {n - 1} PRECEDING) AS m{n}" for n in (5, 10, 20))} FROM whole WINDOW w AS (PARTITION BY symbol ORDER BY dt)
), sides AS (SELECT *, avg(greatest(coalesce(c, 0), 0)) OVER w AS g, avg(greatest(-coalesce(c, 0), 0)) OVER w AS l FROM moves WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS 5 PRECEDING))
SELECT symbol, dt, {", ".join(f'round({dict(macd_close_weekly="mw", MA5="m5").get(c, c)}, {n}) + 0.0 AS "{c}"' for c, n in _FILE_FEATURES.items())} FROM sides WHERE place >= 20 AND (g > 0 OR l > 0)"""
_add("file_features", lambda s, d: file_features(bars(s, d)).select("symbol", "dt", *[_round(F.col(c), n).alias(c) for c, n in _FILE_FEATURES.items()]), _FILE_FRAME)


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    rows = [(f"{c:.0f}/{e}", c, e) for c in (1e5, 1e6, 1e7) for e in ("ema5", "ema10")]
    return simulate.backtest(signals.signal_three(featured(spark, d)).na.drop("any"), spark.createDataFrame(rows, "scenario_id string, capital double, exit_average string"))


_add("backtest_ledger", _scenarios)
_add("backtest_report", lambda s, d: (lambda e: report.drawdown(e, ["scenario_id"], "dt", "tot_value").join(report.sharpe(e, ["scenario_id"], "dt", "tot_value"), "scenario_id"))(report.equity(_scenarios(s, d))))


def _universe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("AF", 0, "first"), ("NO", 1, "second"), ("RF", 2, "third")], "symbol string, ordinal long, name string")


def _fills(df: DataFrame) -> DataFrame:
    """A fill on each first of a month: buys of the symbols of A, sells of the others."""
    return df.filter(F.dayofmonth("dt") == 1).select("symbol", F.col("dt").alias("timestamp"), F.when(F.startswith("symbol", F.lit("A")), "buy").otherwise("sell").alias("order_type"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("timestamp"), F.col("o_totalprice").alias("price"), F.lit(100.0).alias("quantity"))
    return report.trade_pairs(t, ["symbol"], ["timestamp"])


_UNIVERSE = "u AS (SELECT * FROM (VALUES ('AF', 0, 'first'), ('NO', 1, 'second'), ('RF', 2, 'third')) AS v(symbol, ordinal, name))"
_MARKS = "f AS (SELECT symbol, dt, CASE WHEN symbol LIKE 'A%' THEN 'buy' ELSE 'sell' END AS order_type FROM bars WHERE day(dt) = 1)"
_PAIRS = "n AS (SELECT o_custkey AS symbol, o_totalprice AS p, row_number() OVER w - 1 AS k, lead(o_totalprice) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"

_add("closed_range", lambda s, d: _days(closed(bars(s, d), "1995-01-02", "1995-12-29"), "close"), f"{_BARS} SELECT symbol, dt, close FROM bars WHERE dt BETWEEN DATE '1995-01-02' AND DATE '1995-12-29'")
_add("recent_days", lambda s, d: _days(recent(bars(s, d).filter("symbol = 'NO'"), "1996-06-28"), "close"), f"{_BARS} SELECT symbol, dt, close FROM bars WHERE symbol = 'NO' AND dt > DATE '1996-06-28' - 30 AND dt <= DATE '1996-06-28'")
_add("prefix_filter", lambda s, d: _days(prefixed(bars(s, d), "symbol", ["A", "RF"]), "close"), f"{_BARS} SELECT symbol, dt, close FROM bars WHERE symbol LIKE 'A%' OR symbol LIKE 'RF%'")
_add("row_slice", lambda s, d: _days(row_slice(bars(s, d), 10, 30), "close"), f"{_BARS} SELECT symbol, dt, close FROM numbered WHERE n > 10 AND n <= 30")
_add("lot_rounding", lambda s, d: bars(s, d).select("symbol", "dt", datasets.lots(F.lit(1e6), F.col("close")).cast("long").alias("quantity")), f"{_BARS} SELECT symbol, dt, CAST(floor(CAST(1e6 AS DOUBLE) / close / 100) * 100 AS BIGINT) AS quantity FROM bars")
_add("transitions", lambda s, d: datasets.transitions(bars(s, d), "close"), f"{_BARS} SELECT symbol, dt, close, lead(close) OVER w AS next_close, lead(dt) OVER w IS NULL AS done FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)")
_add(
    "gathered_batches",
    lambda s, d: _days(datasets.gathered([bars(s, d).filter(F.year("dt") == y) for y in (1994, 1995)]), "close"),
    f"{_BARS} SELECT symbol, dt, close FROM bars WHERE year(dt) IN (1994, 1995)",
)
_add("linear_epsilon", lambda s, d: _rounded(_days(bars(s, d).withColumn("epsilon", datasets.linear_epsilon(F.row_number().over(W.by_symbol()))), "epsilon"), "epsilon"), f"{_BARS} SELECT symbol, dt, round(greatest(0.01, 1 - 0.99 * CAST(n AS DOUBLE) / 100), 4) AS epsilon FROM numbered")
_add("exponential_epsilon", lambda s, d: _rounded(_days(bars(s, d).withColumn("epsilon", datasets.epsilon(F.row_number().over(W.by_symbol()))), "epsilon"), "epsilon"), f"{_BARS} SELECT symbol, dt, round(0.01 + 0.99 * exp(-CAST(n AS DOUBLE) / 500), 4) AS epsilon FROM numbered")
_add("episodes", lambda s, d: _days(datasets.episodes(bars(s, d), 50), "close"), f"{_BARS} SELECT symbol, dt, close FROM numbered WHERE n <= 50")
_add("common_days", lambda s, d: _days(signals.common_days(bars(s, d)), "close"), f"{_BARS} SELECT symbol, dt, close FROM bars WHERE dt IN (SELECT dt FROM bars GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars))")
_add("mark_to_market", lambda s, d: _rounded(report.marked_to_market(bars(s, d).withColumn("position", F.col("volume"))), "value", places=2), f"{_BARS} SELECT dt, round(sum(volume * close), 2) AS value FROM bars GROUP BY dt")
_add(
    "pre_close_join",
    lambda s, d: _days(with_pre_close(bars(s, d), bars(s, d).filter("volume > 40").select("symbol", "dt", F.col("close").alias("pre_close"))), "pre_close"),
    f"{_BARS} SELECT symbol, dt, CASE WHEN volume > 40 THEN close END AS pre_close FROM bars",
)
_add("universe_join", lambda s, d: in_universe(bars(s, d), F.broadcast(_universe(s))).select("symbol", "dt", "ordinal", "name"), f"{_BARS}, {_UNIVERSE} SELECT symbol, dt, CAST(ordinal AS BIGINT) AS ordinal, name FROM bars JOIN u USING (symbol)")
_add("named_orders", lambda s, d: report.named_orders(bars(s, d), F.broadcast(_universe(s))).select("symbol", "dt", "name"), f"{_BARS}, {_UNIVERSE} SELECT symbol, dt, name FROM bars LEFT JOIN u USING (symbol)")
_add(
    "chart_markers",
    lambda s, d: report.chart(bars(s, d).withColumn("change", F.col("close") - F.col("open")), _fills(bars(s, d)), "change").select("symbol", "dt", "colour", "order_type", "marker"),
    f"{_BARS}, {_MARKS} SELECT symbol, dt, CASE WHEN close - open >= 0 THEN 'green' ELSE 'red' END AS colour, order_type, CASE WHEN order_type = 'buy' THEN low WHEN order_type IS NOT NULL THEN high END AS marker FROM bars LEFT JOIN f USING (symbol, dt)",
)
_add("realized_pnl", lambda s, d: _rounded(report.realized_by_symbol(_pairs(s, d)), "pnl", places=2), f"{_PAIRS} SELECT symbol, round(sum((q - p) * 100.0), 2) AS pnl FROM n WHERE k % 2 = 0 AND q IS NOT NULL GROUP BY symbol")
_add(
    "five_panels",
    lambda s, d: _rounded(report.panels(bars(s, d).select(F.col("symbol").alias("scenario_id"), "dt", F.col("volume").alias("position"), F.col("amount").alias("tot_value"), F.col("close").alias("capital")), bars(s, d).filter("symbol = 'RF'")), "return_pct", "market"),
    f"{_BARS}, m AS (SELECT dt, close / first_value(close) OVER (ORDER BY dt) - 1 AS market FROM bars WHERE symbol = 'RF') SELECT symbol AS scenario_id, dt, volume AS position, amount AS tot_value, close AS capital, round((amount / first_value(amount) OVER (PARTITION BY symbol ORDER BY dt) - 1) * 100, 4) AS return_pct, round(market, 4) AS market FROM bars LEFT JOIN m USING (dt)",
)


def _scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.gettempdir()
    return f"{folder.rstrip('/')}/tideline-store-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Bars that came in three batches, the last of which corrects what the first had wrong and comes twice."""
    all_bars, path = bars(spark, d), _scratch(spark)
    store.upsert(all_bars.filter("dt < '1996-01-01'").withColumn("close", F.when(F.col("symbol") == "NO", F.col("close") * 2).otherwise(F.col("close"))), path, 0)
    store.upsert(all_bars.filter("dt >= '1996-01-01'"), path, 1)
    for _ in range(2):
        store.upsert(all_bars.filter("symbol = 'NO' AND dt < '1996-01-01'"), path, 2)
    return store.read_bars(spark, path, fields=["close", "volume"])


def _intraday(spark: SparkSession, d: str) -> DataFrame:
    before = bars(spark, d).filter("dt < '1996-01-01'")
    state = W.ema_spans(before, (5, 10, 20)).groupBy("symbol").agg(*[F.max_by(f"ema{n}", "dt").alias(f"ema{n}") for n in (5, 10, 20)]).withColumn("adj_factor", F.lit(2.0))
    return intraday(bars(spark, d).filter("dt >= '1996-01-01' AND dt < '1996-02-01'"), state)


_WEIGHTED = "-ln(u) / volume"
_UNIFORM = "(CAST('0x' || substr(md5(concat_ws('|', symbol, CAST(dt AS VARCHAR), '7')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


def _sample_sql(priority: str, k: int) -> str:
    return f"""{_BARS}, u AS (SELECT symbol, dt, volume, {_UNIFORM} AS u FROM bars), p AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY {priority}) AS place FROM u)
SELECT symbol, dt FROM p WHERE place <= {k}"""


_add("sampled_bars", lambda s, d: sampling.bottom_k(bars(s, d), 50, ["symbol", "dt"], 7, ["symbol"]).select("symbol", "dt"), _sample_sql("u", 50))
_add(
    "merged_samples",
    lambda s, d: sampling.merged([sampling.bottom_k(bars(s, d).filter(F.year("dt") % 3 == i), 40, ["symbol", "dt"], 7, ["symbol"], "volume") for i in range(3)], 40, ["symbol"]).select("symbol", "dt"),
    _sample_sql(_WEIGHTED, 40),
)
_add("stored_bars", _stored, f"{_BARS} SELECT symbol, dt, close, volume FROM bars")
_add(
    "listed_symbols",
    lambda s, d: _days(lookups.look_up(bars(s, d), ["RF", "AF", "NO"]).rows, "close"),
    f"{_BARS} SELECT symbol, dt, close FROM bars WHERE symbol IN ('RF', 'AF', 'NO')",
)
_add(
    "unpivoted_pre_close",
    lambda s, d: unpivoted_pre_close(bars(s, d).groupBy("dt").pivot("symbol", ["AF", "NO", "RF"]).agg(F.max(F.when(F.col("volume") > 30, F.col("close")).otherwise(0.0))).toDF("date", "AF.X", "NO.X", "RF.X")),
    f"{_BARS} SELECT symbol, dt, close AS pre_close FROM bars WHERE symbol IN ('AF', 'NO', 'RF') AND volume > 30",
)
_add(
    "intraday_snapshots",
    lambda s, d: _rounded(_days(_intraday(s, d), "close", "ema5", "ema10", "ema20"), "close", "ema5", "ema10", "ema20"),
    f"""{_BARS}, {", ".join(_ema_sql(n) for n in (5, 10, 20))}, y AS (
  SELECT e5.symbol, arg_max(e5.e, e5.dt) AS e5, arg_max(e10.e, e5.dt) AS e10, arg_max(e20.e, e5.dt) AS e20 FROM e5 JOIN e10 ON e10.symbol = e5.symbol AND e10.n = e5.n JOIN e20 ON e20.symbol = e5.symbol AND e20.n = e5.n WHERE e5.dt < DATE '1996-01-01' GROUP BY e5.symbol)
SELECT symbol, dt, round(close * 2, 4) AS close, round(close * 2 / 3 + e5 * 4 / 6, 4) AS ema5, round(close * 4 / 11 + e10 * 9 / 11, 4) AS ema10, round(close * 4 / 21 + e20 * 19 / 21, 4) AS ema20
FROM bars JOIN y USING (symbol) WHERE dt >= DATE '1996-01-01' AND dt < DATE '1996-02-01'""",
)
_add(
    "candidate_by_size",
    lambda s, d: signals.best_candidate(signals.signal_ema(featured(s, d)), by_size=True).select("dt", "symbol"),
    f"""{_BARS}, {_FORCE}, {_EMA13}, c0 AS (SELECT e.symbol, e.dt, e.e, lag(e.e) OVER w AS pe, f.f, lag(f.f) OVER w AS pf FROM e13 e LEFT JOIN force f ON f.symbol = e.symbol AND f.dt = e.dt WINDOW w AS (PARTITION BY e.symbol ORDER BY e.dt))
SELECT dt, symbol FROM (SELECT dt, symbol, row_number() OVER (PARTITION BY dt ORDER BY abs(f), symbol) AS k FROM c0 WHERE pf <> 0 AND e > pe AND f < 0 AND pf > 0) WHERE k = 1""",
)
_add(
    "trades_by_return",
    lambda s, d: _pairs(s, d).select("symbol", F.col("pair").cast("int").alias("pair"), "return_pct", _round(F.col("revenue"), 2).alias("revenue")),
    f"{_PAIRS} SELECT symbol, CAST(k // 2 AS INT) AS pair, (SELECT x FROM (SELECT floor(abs((q / p - 1) * 100) * 100 + 0.5) / 100 * sign(q - p) AS x)) + 0.0 AS return_pct, round((q - p) * 100.0, 2) AS revenue FROM n WHERE k % 2 = 0 AND q IS NOT NULL",
)
_add("sma_or_zero", lambda s, d: _rounded(_days(bars(s, d).withColumn("ma100", W.sma_or_zero("close")), "ma100"), "ma100"), f"{_BARS} SELECT symbol, dt, CASE WHEN n >= 100 THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS 99 PRECEDING), 4) ELSE 0.0 END AS ma100 FROM numbered")
_add(
    "greedy_action",
    lambda s, d: bars(s, d).select("symbol", "dt", datasets.greedy_action(F.array("open", "close", (F.col("high") + F.col("low")) / 2)).cast("int").alias("action")),
    f"{_BARS} SELECT symbol, dt, CAST(list_position(v, list_max(v)) - 1 AS INT) AS action FROM (SELECT symbol, dt, [open, close, (high + low) / 2] AS v FROM bars)",
)
_add(
    "order_memory",
    lambda s, d: _days(policy_memory(bars(s, d)), "high_1", "low_1", "high_2", "low_2"),
    f"{_BARS} SELECT symbol, dt, lag(high) OVER w AS high_1, lag(low) OVER w AS low_1, lag(high, 2) OVER w AS high_2, lag(low, 2) OVER w AS low_2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)",
)
