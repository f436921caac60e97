"""Writers: stored bars keyed by symbol and day, text files, chart tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def latest(df: DataFrame, key: list[str], version: Column) -> DataFrame:
    """Of rows with the same key that of the greatest version; of several such rows a hash of all columns picks one."""
    w = Window.partitionBy(*key).orderBy(version.desc(), F.xxhash64(*df.columns))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def write_bars(df: DataFrame, path: str, amount_scale: float = 1.0) -> None:
    """Stores bars by symbol; symbols that are there anew replace their old files, others stay."""
    df.withColumn("amount", F.col("amount") * amount_scale).repartition("symbol").sortWithinPartitions("symbol", "dt").write.partitionBy("symbol").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def is_stored(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upsert_bars(df: DataFrame, path: str) -> None:
    """Merges bars into a store, which the first batch creates: the rows of the symbols concerned are rewritten, new rows win."""
    spark = df.sparkSession
    new = df.withColumn("__v", F.lit(1))
    if is_stored(spark, path):
        old = spark.read.schema(df.schema).parquet(path).join(df.select("symbol").distinct(), "symbol", "left_semi").withColumn("__v", F.lit(0))
        new = old.unionByName(new)
    # The store is both read and written, so the result is kept apart first.
    write_bars(latest(new, ["symbol", "dt"], F.col("__v")).drop("__v").checkpoint(), path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)
