"""Readers of bars and their side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

# The columns of the files and feeds that are read.
_DOUBLES = ["open", "high", "low", "close", "volume", "amount"]
_VENDOR = ["date", "code", "open", "high", "low", "close", "preclose", "volume", "amount", "adjustflag", "turn", "tradestatus", "pctChg", "isST"]
_SNAPSHOT = ["code", "close", "amount", "open", "high", "low", "pre_close", "date"]


def _schema(columns: list[str], texts: list[str]) -> T.StructType:
    """Columns of doubles, but for texts."""
    return T.StructType([T.StructField(c, T.StringType() if c in texts else T.DoubleType()) for c in columns])


BARS = _schema(["datetime", *_DOUBLES], ["datetime"])
VENDOR_BARS = _schema(_VENDOR, ["date", "code"])
UNIVERSE = T.StructType([T.StructField("code", T.StringType()), T.StructField("freq", T.IntegerType()), T.StructField("name", T.StringType())])
SNAPSHOT = _schema(_SNAPSHOT, ["code", "date"])


def parsed_date(c: str | Column) -> Column:
    """Dates with / or - between the parts; null if neither fits."""
    return F.coalesce(F.try_to_date(c, "yyyy/MM/dd"), F.try_to_date(c, "yyyy-MM-dd"))


def _file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(?:\.[^.]*)?$", 1)


def read_bars(spark: SparkSession, path: str, skip_first_row: bool = False) -> DataFrame:
    """Headerless daily bars; the symbol is the file's stem. skip_first_row drops each file's first day (for comparisons)."""
    df = spark.read.schema(BARS).csv(path, header=False).select(_file_stem().alias("symbol"), parsed_date("datetime").alias("dt"), *_DOUBLES)
    if skip_first_row:
        first = df.groupBy("symbol").agg(F.min("dt").alias("__first"))
        df = df.join(first, "symbol").filter("dt > __first").drop("__first")
    return df


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """Bars with a header and pre_close."""
    schema = T.StructType([*BARS.fields, T.StructField("pre_close", T.DoubleType())])
    return spark.read.schema(schema).csv(path, header=True).select(_file_stem().alias("symbol"), parsed_date("datetime").alias("dt"), *_DOUBLES, "pre_close")


def read_vendor_bars(spark: SparkSession, path: str) -> DataFrame:
    """The second vendor's bars: the symbol stands after the dot of code; missing volumes are 0."""
    df = spark.read.schema(VENDOR_BARS).csv(path, header=True)
    return df.select(F.element_at(F.split("code", r"\."), -1).alias("symbol"), parsed_date("date").alias("dt"), "open", "high", "low", "close", F.coalesce(F.col("volume").cast("bigint"), F.lit(0)).cast("double").alias("volume"), "amount", F.col("preclose").alias("pre_close"))


def read_vendor_text(spark: SparkSession, path: str) -> DataFrame:
    """Exports named XX#code.ext: two lines before the bars and one after them are dropped; undecodable bytes are ignored."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(?:#|%23)(\d+)\.", 1).alias("symbol"), F.split(F.regexp_replace("value", "\r|�", ""), "\n").alias("lines"))
    lines = F.filter("lines", lambda x: F.trim(x) != "")
    rows = raw.select("symbol", F.explode(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 3, F.lit(0)))).alias("line"))
    bar = F.from_csv("line", BARS.simpleString()[7:-1].replace(":", " "))
    return rows.select("symbol", bar.alias("b")).select("symbol", parsed_date("b.datetime").alias("dt"), *[f"b.{c}" for c in _DOUBLES])


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """code, freq, name, symbol and their place in the file (a small file: one task numbers it)."""
    df = spark.read.schema(UNIVERSE).csv(path, header=False).withColumn("ordinal", F.monotonically_increasing_id())
    return df.withColumn("symbol", F.element_at(F.split("code", r"\."), -1))


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("updateDate date, code string, code_name string").csv(path, header=True)


def unpivoted_pre_close(wide: DataFrame, date: str = "date") -> DataFrame:
    """symbol, dt, pre_close of a table with a column code.suffix for each symbol; zeros are missing."""
    columns = [c for c in wide.columns if c != date]
    long = wide.unpivot([F.col(f"`{date}`")], [F.col(f"`{c}`").cast("double").alias(c.partition(".")[0]) for c in columns], "symbol", "pre_close")
    return long.filter("pre_close <> 0").select("symbol", F.col(date).alias("dt"), "pre_close")


def with_pre_close(bars: DataFrame, pre_close: DataFrame) -> DataFrame:
    return bars.join(pre_close, ["symbol", "dt"], "left")


def in_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of the universe's symbols, with ordinal and name."""
    return df.join(universe.select("symbol", "ordinal", "name"), "symbol")


def points_to_rows(points: DataFrame, fields: list[str], key: list[str]) -> DataFrame:
    """Long rows (key, field, value) to a column a field; fields are given, so no extra pass finds them."""
    return points.groupBy(*key).pivot("field", fields).agg(F.first("value"))


def half_open(df: DataFrame, start: str, stop: str) -> DataFrame:
    return df.filter((F.col("dt") >= F.lit(start).cast("date")) & (F.col("dt") < F.lit(stop).cast("date")))


def closed(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        df = df.filter(F.col("dt") >= F.lit(start).cast("date"))
    return df.filter(F.col("dt") <= F.lit(end).cast("date")) if end else df


def bars_from_trades(trades: DataFrame, symbol: Column, dt: Column, price: Column, quantity: Column, amount: Column, order: list[Column]) -> DataFrame:
    """Daily bars of trades; order must tell all trades of a day apart."""
    at = F.struct(*order)
    rows = trades.select(symbol.alias("symbol"), dt.cast("date").alias("dt"), price.alias("price"), quantity.alias("q"), amount.alias("amount"), at.alias("at"))
    return rows.groupBy("symbol", "dt").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("q").cast("double").alias("volume"), F.sum("amount").alias("amount")
    )


def read_store(spark: SparkSession, path: str, start: str | None = None, stop: str | None = None, symbols: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Stored bars of start <= dt < stop; symbols prune partitions, dates and fields reach the scan."""
    columns = fields or ["open", "high", "low", "close", "volume", "amount"]
    df = spark.read.schema("dt date, " + ", ".join(f"{c} double" for c in columns) + ", symbol string").parquet(path)
    if symbols:
        df = df.filter(F.col("symbol").isin(symbols))
    if start:
        df = df.filter(F.col("dt") >= F.lit(start).cast("date"))
    if stop:
        df = df.filter(F.col("dt") < F.lit(stop).cast("date"))
    return df.select("symbol", "dt", *columns)


def recent(df: DataFrame, until: str, days: int = 30) -> DataFrame:
    """The rows of so many days up to a day."""
    last = F.lit(until).cast("date")
    return df.filter((F.col("dt") > F.date_sub(last, days)) & (F.col("dt") <= last))


def prefixed(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose column starts with one of the prefixes."""
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(F.col(column), F.lit(p))
    return df.filter(found)


def row_slice(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows start <= place < stop of each symbol in order of dt, places from 0."""
    w = Window.partitionBy("symbol").orderBy("dt")
    return df.withColumn("__n", F.row_number().over(w) - 1).filter((F.col("__n") >= start) & (F.col("__n") < stop)).drop("__n")
