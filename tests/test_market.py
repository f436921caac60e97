"""Indicators against pandas, simulation against its rules, streams against batches, queries against DuckDB."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import indicators, windows
from tideline.operators import datasets, report, signals, simulate
from tideline.plans import features, queries
from tideline.sources import bars as sources
from tideline.sources import sinks
from tideline.streaming import live

DAYS = [d.date() for d in pd.bdate_range("2024-01-01", periods=400) if d.date() != dt.date(2024, 3, 29)]


def walk(seed, n=len(DAYS), flat=False):
    r = np.random.default_rng(seed)
    close = np.full(n, 10.0) if flat else np.round(10 * np.exp(np.cumsum(r.normal(0, 0.02, n))), 3)
    high, low = (close, close) if flat else (close + r.uniform(0, 0.3, n).round(3), close - r.uniform(0, 0.3, n).round(3))
    return pd.DataFrame({"symbol": f"s{seed}", "dt": DAYS[:n], "open": close, "high": high, "low": low, "close": close, "volume": r.integers(1, 1000, n) * 1.0, "amount": 1.0})


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(pd.concat([walk(1), walk(2, 200), walk(3, 30, flat=True), walk(4, 1)])).cache()


def test_averages_across_blocks_with_nulls(spark):
    rng = np.random.default_rng(5)
    x = pd.Series(np.where(rng.random(1500) < 0.4, np.nan, rng.random(1500)))
    x[200:500] = np.nan
    df = spark.createDataFrame([("s", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "symbol string, dt int, x double")
    got = windows.averages(df, "x", {"a": 2 / 3, "b": 2 / 27, "c": 1.0}, {"d": (lambda y: f"{y('a')} - {y('b')}", 0.2)}).orderBy("dt").toPandas()
    a, b = x.ewm(alpha=2 / 3, adjust=False).mean(), x.ewm(alpha=2 / 27, adjust=False).mean()
    for name, want in {"a": a, "b": b, "c": x.ffill(), "d": (a - b).ewm(alpha=0.2, adjust=False).mean()}.items():
        assert np.allclose(got[name].astype(float), want, rtol=1e-9, equal_nan=True), name
    fast = windows.averages(df, "x", {"a": 2 / 3}).orderBy("dt").toPandas()
    assert np.allclose(fast["a"].astype(float), a, rtol=1e-9, equal_nan=True)


def test_ema_matches_pandas_with_nulls(spark):
    r = np.random.default_rng(0)
    x = pd.Series(np.where(r.random(3000) < 0.3, np.nan, r.normal(size=3000)))
    x[:3] = np.nan
    x[1000:1200] = np.nan
    days = [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(len(x))]
    df = spark.createDataFrame([("a", d, None if math.isnan(v) else float(v)) for d, v in zip(days, x, strict=True)], "symbol string, dt date, x double")
    got = windows.ema(windows.ema(df, "x", "a", com=3), "x", "b", span=26).orderBy("dt").toPandas()
    for name, kind in (("a", {"com": 3}), ("b", {"span": 26})):
        assert np.allclose(got[name].astype(float), x.ewm(adjust=False, **kind).mean(), atol=1e-9, equal_nan=True)


def test_indicators_match_pandas(bars):
    got = indicators.rsi(indicators.kdj(indicators.force_index(indicators.macd(bars)))).toPandas()
    for symbol, g in got.groupby("symbol"):
        g = g.sort_values("dt").reset_index(drop=True)
        e = lambda s, **k: s.ewm(adjust=False, **k).mean()
        line = e(g.close, span=12) - e(g.close, span=26)
        assert np.allclose(g.macd, line - e(line, span=9), atol=1e-9)
        assert np.allclose(g.force_index_close.astype(float), e(g.close.diff() * g.volume, span=2), atol=1e-6, equal_nan=True)
        low, high = g.low.rolling(5, min_periods=1).min(), g.high.rolling(5, min_periods=1).max()
        rsv = (g.close - low) / (high - low).replace(0, np.nan) * 100
        k = e(rsv, com=3)
        assert np.allclose(g.K.astype(float), k, atol=1e-8, equal_nan=True), symbol
        assert np.allclose(g.D.astype(float), e(k, com=3), atol=1e-8, equal_nan=True)


def test_weekly_macd_known_each_day_matches_the_slow_form(bars):
    got = indicators.weekly_macd_pit(bars.filter("symbol = 's2'")).orderBy("dt").toPandas()
    fridays: list[float] = []
    for d, close, value in zip(got.dt, got.close, got.macd_close_weekly, strict=True):
        s = pd.Series([*fridays, close])
        line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
        assert abs((line - line.ewm(span=9, adjust=False).mean()).iloc[-1] - value) < 1e-9
        if pd.Timestamp(d).weekday() == 4:
            fridays.append(close)


def test_week_labels(spark):
    df = spark.createDataFrame([("2024-01-04", "2024-01-05"), ("2024-01-05", "2024-01-05"), ("2024-01-06", "2024-01-12")], "a string, b string")
    assert df.filter(windows.week_end(F.to_date("a")) != F.to_date("b")).isEmpty()


def test_product_skips_nulls_and_empty_tables_pass(spark, bars):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([None, 2.0, None, 3.0])], "symbol string, dt int, x double")
    assert [r.p for r in df.withColumn("p", windows.cumulative_product("x")).orderBy("dt").collect()] == [None, 2, None, 6]
    assert features.daily_features(bars.limit(0)).count() == 0


def simulated(bars):
    df = features.daily_features(bars)
    r = signals.signal_three(df)
    rows = [("small", 1e4, "ema10"), ("large", 1e6, "ema5")]
    return simulate.backtest(r, bars.sparkSession.createDataFrame(rows, "scenario_id string, capital double, exit_average string"))


def test_simulation_keeps_its_rules(bars):
    ledger = simulated(bars.filter("symbol < 's3'")).cache()
    fills = report.fills(ledger).toPandas()
    assert len(fills)
    assert fills.groupby(["scenario_id", "timestamp"]).size().max() == 1
    assert (fills[fills.order_type == "buy"].quantity % 100 == 0).all()
    assert ledger.groupBy("scenario_id", "dt").agg(F.sum((F.col("position") > 0).cast("int")).alias("n")).filter("n > 1").isEmpty()
    for _, g in fills.sort_values("timestamp").groupby("scenario_id"):
        kinds = list(g.order_type)
        assert all(a != b for a, b in zip(kinds, kinds[1:], strict=False)) and kinds[0] == "buy"


def test_signals_follow_their_sequential_definition(bars):
    df = features.daily_features(bars.filter("symbol = 's1'"))
    got = signals.signal_three(df).orderBy("dt").toPandas()
    seen, last = [], None
    for weekly, force, signal in zip(got.macd_close_weekly_vis, got.force_index_close, got.signal, strict=True):
        want = 0
        if last and len(seen) > 1:
            before = seen[-1] if weekly != seen[-1] else seen[-2]
            if before:
                want = (1 if force < 0 < last else 0) if weekly > before else -1
        assert signal == want
        if not seen or weekly != seen[-1]:
            seen.append(weekly)
        last = force


def test_discounting_stops_at_ends(spark):
    df = spark.createDataFrame([("a", DAYS[i], 1.0, int(i == 1)) for i in range(4)], "symbol string, dt date, r double, done int")
    got = [r.ret for r in datasets.discounted(df, "r", gamma=0.5, done="done").orderBy("dt").collect()]
    assert np.allclose(got, [1.5, 1.0, 1.5, 1.0])


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "000001.csv").write_text("2024/01/02,1,2,0.5,1.5,10,100\n2024-01-03,1,2,0.5,1.6,10,100\n")
    df = sources.read_bars(spark, str(tmp_path / "000001.csv"))
    assert [(r.symbol, str(r.dt), r.close) for r in df.orderBy("dt").collect()] == [("000001", "2024-01-02", 1.5), ("000001", "2024-01-03", 1.6)]
    assert sources.read_bars(spark, str(tmp_path / "000001.csv"), skip_first_row=True).count() == 1
    (tmp_path / "SZ#000002.txt").write_text("title\nheader\n2024/01/02,1,2,0.5,1.5,10,100\nsource\n")
    assert [(r.symbol, r.close) for r in sources.read_vendor_text(spark, str(tmp_path / "SZ#000002.txt")).collect()] == [("000002", 1.5)]
    wide = spark.createDataFrame([("2024-01-02", 1.0, 0.0)], "date string, `1.SZ` double, `2.SH` double")
    assert [tuple(r) for r in sources.unpivoted_pre_close(wide).collect()] == [("1", "2024-01-02", 1.0)]
    store = str(tmp_path / "store")
    sinks.write_bars(df, store)
    new = spark.createDataFrame([("000001", dt.date(2024, 1, 3), 9.0), ("000009", dt.date(2024, 1, 3), 1.0)], "symbol string, dt date, close double")
    sinks.upsert_bars(new.select("symbol", "dt", *[F.col("close").alias(c) for c in ("open", "high", "low", "close", "volume", "amount")]), store)
    spark.catalog.clearCache()
    rows = spark.read.schema(df.schema).parquet(store).orderBy("symbol", "dt").collect()
    assert [(r.symbol, r.close) for r in rows] == [("000001", 1.5), ("000001", 9.0), ("000009", 1.0)]


def test_streams_equal_batches(spark, bars, tmp_path):
    df = bars.filter("symbol < 's3'").select("symbol", "dt", "close")
    path = str(tmp_path / "in")
    cut = DAYS[150]
    df.filter(F.col("dt") < F.lit(cut)).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    check = str(tmp_path / "check")

    def run():
        q = live.running_ema(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    df.filter(F.col("dt") >= F.lit(cut)).coalesce(1).write.mode("append").parquet(path)
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("symbol", "dt").toPandas()
    want = windows.ema(df, "close", "ema13", span=13).orderBy("symbol", "dt").toPandas()
    assert len(got) == len(want) and np.allclose(got.ema13, want.ema13)


def test_queries_match_duckdb(spark, data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name in ("daily_bars", "macd", "kdj", "weekly_macd_pit", "signal_three", "trade_pairs", "tumbling_ticks"):
        want = c.sql(queries.ORACLES[name]).df()
        got = queries.QUERIES[name](spark, data).toPandas()[list(want.columns)]
        assert len(got) == len(want)
        key = [x for x in ("symbol", "dt", "start", "pair") if x in want]
        a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
        for col in want:
            if a[col].dtype.kind == "f":
                assert np.allclose(a[col], b[col], atol=1e-3, equal_nan=True), (name, col)


def test_store_reader_prunes_and_the_first_batch_creates_a_store(spark, data, tmp_path):
    from tideline.plans.queries import bars as daily
    from tideline.sources import bars as sources
    from tideline.sources import sinks

    store = f"file://{tmp_path}/store"
    df = daily(spark, data).select("symbol", "dt", "open", "high", "low", "close", "volume", "amount")
    sinks.upsert_bars(df, store)
    sinks.upsert_bars(df.filter("symbol = 'NO'").withColumn("close", F.lit(1.0)), store)
    back = sources.read_store(spark, store, "1995-01-02", "1996-01-01", ["NO"], ["close"])
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan or "PartitionFilters: [(symbol" in plan
    assert "GreaterThanOrEqual(dt" in plan and "open" not in plan.split("ReadSchema")[1]
    rows = back.collect()
    assert rows and {r["close"] for r in rows} == {1.0} and {r["symbol"] for r in rows} == {"NO"}
    assert sources.read_store(spark, store).count() == df.count()
