"""Running aggregates by blocks against windows, and linear recurrences against loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tideline.functions import indicators, scan, windows

START = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(1)
    rows = []
    for symbol, n in (("long", 3000), ("short", 3), ("one", 1)):
        days = np.cumsum(r.choice([1, 1, 1, 2, 90], n))
        rows += [(symbol, START + dt.timedelta(int(d)), None if r.random() < 0.3 or (symbol == "long" and i < 100) else float(np.round(r.uniform(0.9, 1.1), 3))) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "symbol string, dt date, x double").cache()


def test_blocked_equals_windows(series):
    wanted = {kind: (kind, "x") for kind in ("count", "sum", "product", "min", "max", "last", "first", "before")}
    w = Window.partitionBy("symbol").orderBy("dt")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = {"count": F.count("x"), "sum": F.sum("x"), "product": F.product("x"), "min": F.min("x"), "max": F.max("x"), "last": F.last("x", ignorenulls=True), "first": F.first("x", ignorenulls=True)}
    want = series.withColumns({k: f.over(to_here) for k, f in plain.items()} | {"before": F.lag("x").over(w)}).orderBy("symbol", "dt").toPandas()
    for block in (None, scan.days("dt", 7), F.year("dt")):
        got = scan.blocked(series, wanted, block=block).orderBy("symbol", "dt").toPandas()
        for kind in wanted:
            assert np.allclose(got[kind].astype(float), want[kind].astype(float), rtol=1e-9, equal_nan=True), kind


def test_a_symbol_falls_to_all_tasks(spark, series):
    long = series.filter("symbol = 'long'").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = {r[0] for r in scan.blocked(long, {"s": ("sum", "x")}).select(F.spark_partition_id()).distinct().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(tasks) == 4


def test_blocked_of_an_empty_table_and_in_place(series):
    assert scan.blocked(series.limit(0), {"s": ("sum", "x")}).collect() == []
    filled = windows.forward_fill(series, ["x"], scan.days("dt", 30))
    assert filled.columns == series.columns
    assert sorted(map(str, filled.collect())) == sorted(map(str, windows.forward_fill(series, ["x"]).collect()))


def test_adjusted_prices_by_blocks(spark, series):
    bars = series.filter("x IS NOT NULL").select("symbol", "dt", *[F.col("x").alias(c) for c in ("open", "high", "low", "close")], (F.col("x") * 0.999).alias("pre_close")).cache()
    for first in (False, True):
        a, b = (indicators.back_adjusted(bars, first, block).orderBy("symbol", "dt").toPandas() for block in (None, scan.days("dt")))
        for c in ("adj_factor", "open", "close"):
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("rows", [1, 7, 512])
def test_linear_against_a_loop(spark, rows):
    r = np.random.default_rng(2)
    a, b = r.choice([0.0, 0.5, 1.0, -1.0], 400), r.normal(size=400)
    df = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "symbol string, dt int, a double, b double")
    got = scan.linear(df, {"__a": F.col("a"), "__b": F.col("b")}, [lambda v: {"y": (v("__a"), v("__b"))}, lambda v: {"z": ("0.5D", v("y"))}], rows=rows).orderBy("dt").toPandas()
    y = z = 0.0
    for i in range(400):
        y = a[i] * y + b[i]
        z = 0.5 * z + y
        assert abs(got.y[i] - y) < 1e-9 and abs(got.z[i] - z) < 1e-9
    assert list(got.columns) == ["symbol", "dt", "a", "b", "y", "z"]


def test_several_columns_in_one_scan(series):
    one = windows.averages_of(series.withColumn("v", F.col("x") * 2), [("x", {"p": 0.3}, {}), ("v", {"q": 0.01}, {"r": (lambda y: f"{y('q')} - {y('p')}", 0.2)})])
    two = windows.averages(windows.averages(series.withColumn("v", F.col("x") * 2), "x", {"p": 0.3}), "v", {"q": 0.01})
    a, b = (d.orderBy("symbol", "dt").toPandas() for d in (one, two))
    for c in ("p", "q"):
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True)
    for _, g in a.groupby("symbol"):
        known = g.dropna(subset=["q"])
        want = (known.q - known.p).ewm(alpha=0.2, adjust=False).mean()
        assert np.allclose(known.r.astype(float), want)
