"""Readers and writers of files, snapshots, and orders that quotes fire."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tideline.operators import report
from tideline.sources import bars as sources
from tideline.sources import sinks
from tideline.streaming import live


def written(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_bars_with_headers(spark, tmp_path):
    combined = written(tmp_path, "159.csv", "datetime,open,high,low,close,volume,amount,pre_close\n2024-01-02,1,2,0.5,1.5,3000000000,9,1.4\n")
    assert [tuple(r) for r in sources.read_combined(spark, combined).collect()] == [("159", dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 3e9, 9.0, 1.4)]
    columns = "date,code,open,high,low,close,preclose,volume,amount,adjustflag,turn,tradestatus,pctChg,isST"
    vendor = written(tmp_path, "v.csv", f"{columns}\n2024-06-11,xx.603,58,59,57,58.5,57.75,,1.5,3,0.1,1,2,0\n2024-06-12,xx.603,58,59,57,58,58.5,7,1.5,3,0.1,1,2,0\n")
    rows = sources.read_vendor_bars(spark, vendor).orderBy("dt").collect()
    assert [(r.symbol, r.close, r.volume, r.pre_close) for r in rows] == [("603", 58.5, 0.0, 57.75), ("603", 58.0, 7.0, 58.5)]


def test_universes_and_constituents(spark, tmp_path):
    universe = written(tmp_path, "u.csv", "sz.1,5,first\nsh.2,5,second")
    rows = sources.read_universe(spark, universe).orderBy("ordinal").collect()
    assert [(r.symbol, r.code, r.freq, r.name) for r in rows] == [("1", "sz.1", 5, "first"), ("2", "sh.2", 5, "second")]
    members = written(tmp_path, "c.csv", "updateDate,code,code_name\n2024-01-02,sh.2,second\n")
    assert [tuple(r) for r in sources.read_constituents(spark, members).collect()] == [(dt.date(2024, 1, 2), "sh.2", "second")]
    empty = written(tmp_path, "e.csv", "updateDate,code,code_name\n")
    assert sources.read_constituents(spark, empty).count() == 0


def test_written_files_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "symbol string, x double")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, spark.read.csv(f"{tmp_path}/csv", header=True, schema=df.schema).collect()), key=str) == [("a", 1.5), ("b", None)]
    sinks.write_text(df.select(F.col("symbol").alias("value")), f"{tmp_path}/text")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/text").collect()) == ["a", "b"]


def finished(stream, tmp_path):
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{tmp_path}/out")


def test_snapshots_and_orders_that_they_fire_once(spark, tmp_path):
    folder = tmp_path / "quotes"
    folder.mkdir()
    header = "code,close,amount,open,high,low,pre_close,date\n"
    first = written(folder, "1.csv", header + "a,11,1,1,1,1,1,2024-01-02 10:00:00\nb,4,1,1,1,1,1,2024-01-02 10:00:00\n")
    written(folder, "2.csv", header + "a,12,1,1,1,1,1,2024-01-02 10:01:00\nc,9,1,1,1,1,1,2024-01-02 10:01:00\n")
    os.utime(first, (1e9, 1e9))  # files come in order of their times
    quotes = live.read_snapshots(spark, str(folder), 1)
    yesterday = spark.createDataFrame([(s, 1.0, 6.0, 6.0, 6.0) for s in "abc"], "symbol string, adj_factor double, ema5 double, ema10 double, ema20 double")
    waiting = spark.createDataFrame([(1, "a", "buy", 10.0, 5.0), (2, "b", "stop", 10.0, 5.0), (3, "c", "buy", 10.0, 5.0)], "order_id int, symbol string, kind string, last_high double, last_low double")
    fired = finished(live.intended_orders(live.intraday(quotes, yesterday).select("symbol", "ts", "close", "ema10"), waiting), tmp_path).collect()
    assert sorted((r.order_id, r.kind, r.close) for r in fired) == [(1, "buy", 11.0), (2, "stop", 4.0)]


def test_fills_and_equity_of_a_ledger(spark):
    day = dt.date(2024, 1, 2)
    rows = [("s", day, "a", 100.0, None, None, None, None), ("s", day + dt.timedelta(1), "a", 110.0, "buy", 1.0, 100.0, 7)]
    ledger = spark.createDataFrame(rows, "scenario_id string, dt date, symbol string, tot_value double, order_type string, price double, quantity double, order_id int")
    assert [(r.symbol, r.order_type, r.order_id) for r in report.fills(ledger).collect()] == [("a", "buy", 7)]
    assert [(r.tot_value, r.reward, round(r.cum_return, 6)) for r in report.equity(ledger).orderBy("dt").collect()] == [(100.0, None, 0.0), (110.0, 10.0, 0.1)]
