"""Streams with state against the batch functions: one batch, two batches, and a stream that goes on from stored bars."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_market import DAYS, walk
from tideline.functions import indicators, windows
from tideline.operators import signals
from tideline.streaming import state


@pytest.fixture(scope="module", autouse=True)
def several_variables(spark):
    state.rocksdb(spark)


@pytest.fixture(scope="module")
def bars(spark):
    flat = walk(7, 120)
    flat.loc[20:50, ["close", "high", "low"]] = 10.0
    return spark.createDataFrame(pd.concat([walk(1), walk(2, 200), walk(3, 30, flat=True), walk(4, 1), flat])).cache()


def by_batches(spark, parts, make, tmp_path):
    """The rows of a stream whose batches are the parts."""
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    got = None
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        got = make(spark.readStream.schema(part.schema).parquet(path))
        got.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def batch_indicators(bars):
    df = windows.ema_spans(indicators.kdj(indicators.force_index(indicators.macd(indicators.weekly_macd_pit(bars)))), state.SPANS)
    return df.select(*[c.split(" ")[0] for c in state.INDICATORS.split(", ")])


def same(a, b, columns):
    a, b = (x.orderBy("symbol", "dt").toPandas() for x in (a, b))
    assert len(a) == len(b) and list(a.symbol) == list(b.symbol) and list(a.dt) == list(b.dt)
    for c in columns:
        assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-6, equal_nan=True), c


@pytest.mark.parametrize("cuts", [[90], [1, 25, 160]])
def test_indicators_across_batches(spark, bars, tmp_path, cuts):
    edges = [DAYS[0], *[DAYS[c] for c in cuts], DAYS[-1] + pd.Timedelta(days=1)]
    parts = [bars.filter((F.col("dt") >= F.lit(a)) & (F.col("dt") < F.lit(b))) for a, b in zip(edges, edges[1:], strict=False)]
    got = by_batches(spark, parts, state.running_indicators, tmp_path)
    want = batch_indicators(bars)
    same(got, want, want.columns[2:])


def test_indicators_go_on_from_stored_bars(spark, bars, tmp_path):
    cut = DAYS[40]
    initial = state.indicator_state(bars.filter(F.col("dt") < F.lit(cut)))
    assert initial.schema.simpleString() == spark.createDataFrame([], state.INITIAL).schema.simpleString()
    rest = bars.filter(F.col("dt") >= F.lit(cut))
    got = by_batches(spark, [rest], lambda s: state.running_indicators(s, initial), tmp_path)
    want = batch_indicators(bars).filter(F.col("dt") >= F.lit(cut))
    same(got, want, want.columns[2:])


def test_signals_across_batches(spark, tmp_path):
    r = np.random.default_rng(6)
    rows = []
    for k in range(4):
        weekly = np.repeat(r.integers(-3, 4, 60) * 1.0, 5)[: 300 - 40 * k]
        for i, w in enumerate(weekly):
            rows.append((f"s{k}", DAYS[i], None if i < 12 * k else float(w), None if i == 0 else float(r.integers(-2, 3))))
    df = spark.createDataFrame(rows, "symbol string, dt date, macd_close_weekly_vis double, force_index_close double").cache()
    want = signals.signal_three(df).select("symbol", "dt", "signal")
    parts = [df.filter((F.col("dt") >= F.lit(a)) & (F.col("dt") < F.lit(b))) for a, b in ((DAYS[0], DAYS[33]), (DAYS[33], DAYS[150]), (DAYS[150], DAYS[-1]))]
    got = by_batches(spark, parts, lambda s: state.running_signals(s, silent_days=100_000), tmp_path)
    same(got, want, ["signal"])
    assert want.filter("signal = 1").count() > 5 and want.filter("signal = -1").count() > 20


def test_a_silent_symbol_is_forgotten(spark, tmp_path):
    schema = "symbol string, dt date, macd_close_weekly_vis double, force_index_close double"
    before = [("a", DAYS[i], 1.0 + (i // 5), 1.0) for i in range(20)]
    others = [("b", DAYS[i], 1.0, 1.0) for i in range(20, 120)]
    after = [("a", DAYS[i], 50.0 + i, -1.0 if i == 121 else 1.0) for i in range(120, 126)]
    parts = [spark.createDataFrame(x, schema) for x in (before, others, after)]
    got = by_batches(spark, parts, lambda s: state.running_signals(s, silent_days=30), tmp_path)
    assert [r.symbol for r in got.filter("dt IS NULL").collect()] == ["a"]
    own = got.filter(F.col("dt") >= F.lit(DAYS[120])).orderBy("dt").collect()
    # Remembered, the rise with a falling force index would be a signal on the second day.
    assert [r.signal for r in own if r.symbol == "a"][:3] == [0, 0, 0]
