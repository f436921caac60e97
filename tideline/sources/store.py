"""A store of bars in versions: parts of a symbol and a month, each replaced as a whole by the batch that changes it.

    <path>/data/symbol=S/month=M/batch=B/...   what batch B wrote of a part
    <path>/commits/batch=B/...                 the parts that batch B wrote; one rename makes them valid

A reader takes each part from the last committed batch that wrote it. A batch writes its parts
beside the ones it reads, then its list of parts to a staging folder, and renames that: what a
killed batch has left is never read, and the batch writes it again when it is replayed. A batch
that is committed already does nothing. One writer at a time; commits of one store are small
tables of parts, not of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.sources.sinks import is_stored, latest

BAR_FIELDS = ["open", "high", "low", "close", "volume", "amount"]
_PART = ["symbol", "month"]
_COMMITS = "symbol string, month string, batch long"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _month() -> F.Column:
    return F.date_format("dt", "yyyy-MM")


def is_committed(spark: SparkSession, path: str, batch: int) -> bool:
    return is_stored(spark, f"{path}/commits/batch={batch}")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """symbol, month, batch: all parts that batches have written."""
    if not is_stored(spark, f"{path}/commits"):
        return spark.createDataFrame([], _COMMITS)
    return spark.read.schema(_COMMITS).option("basePath", f"{path}/commits").parquet(f"{path}/commits")


def current(spark: SparkSession, path: str) -> DataFrame:
    """symbol, month, batch: the batch that holds a part's rows."""
    return commits(spark, path).groupBy(*_PART).agg(F.max("batch").alias("batch"))


def read_bars(spark: SparkSession, path: str, parts: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """symbol, dt and the fields of stored bars; of the given parts only (of `current`, or fewer of it).

    The parts are joined on the folders' columns, so only their folders are read.
    """
    fields = fields or BAR_FIELDS
    schema = "dt date, " + ", ".join(f"{c} double" for c in fields) + ", symbol string, month string, batch long"
    if not is_stored(spark, f"{path}/data"):
        return spark.createDataFrame([], schema).select("symbol", "dt", *fields)
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(current(spark, path) if parts is None else parts, [*_PART, "batch"]).select("symbol", "dt", *fields)


def stage(bars: DataFrame, path: str, batch: int) -> str:
    """Writes the parts that the bars change, new rows winning, and returns the staging folder of the list of them."""
    spark = bars.sparkSession
    new = bars.select("symbol", "dt", *BAR_FIELDS).withColumn("__v", F.lit(1))
    touched = bars.select("symbol", _month().alias("month")).distinct()
    old = read_bars(spark, path, current(spark, path).filter(F.col("batch") < batch).join(touched, _PART, "left_semi")).withColumn("__v", F.lit(0))
    merged = latest(old.unionByName(new), ["symbol", "dt"], F.col("__v")).drop("__v")
    merged = merged.withColumns({"month": _month(), "batch": F.lit(batch)}).repartition(*_PART).sortWithinPartitions(*_PART, "dt")
    merged.write.partitionBy(*_PART, "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/data")
    staged = f"{path}/staged-{batch}"
    touched.write.mode("overwrite").parquet(staged)
    return staged


def commit(spark: SparkSession, path: str, batch: int, staged: str) -> None:
    """Makes a staged batch valid by one rename."""
    fs, folder = _fs(spark, f"{path}/commits")
    fs.mkdirs(folder)
    _, source = _fs(spark, staged)
    _, target = _fs(spark, f"{path}/commits/batch={batch}")
    if not fs.rename(source, target):
        raise OSError(f"can't commit batch {batch} of {path}")


def upsert(bars: DataFrame, path: str, batch: int) -> bool:
    """Merges bars into the store as a batch, which grows from batch to batch; False if it was committed before."""
    spark = bars.sparkSession
    if is_committed(spark, path, batch):
        return False
    commit(spark, path, batch, stage(bars, path, batch))
    return True


def store_stream(bars: DataFrame, path: str, checkpoint: str, **trigger):
    """Writes a stream's batches by their numbers, so that a replayed one changes nothing."""

    def put(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            upsert(rows, path, batch)

    writer = bars.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes folders of parts that later batches have replaced, and says how many; not while others read them."""
    fs, _ = _fs(spark, path)
    replaced = commits(spark, path).join(current(spark, path).withColumnRenamed("batch", "last"), _PART).filter("batch < last")
    n = 0
    for symbol, month, batch in replaced.select(*_PART, "batch").toLocalIterator():
        n += fs.delete(_fs(spark, f"{path}/data/symbol={symbol}/month={month}/batch={batch}")[1], True)
    return n


def write_bucketed(bars: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """A table bucketed and sorted by symbol: joins and groupings on symbol of such tables with as many buckets don't shuffle.

    Joins on symbol and day don't either where spark.sql.requireAllClusterKeysForCoPartition is
    false, which suits symbols that are many and alike.
    """
    writer = bars.repartition(buckets, "symbol").write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "dt")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def of_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of the universe's symbols, with its other columns; bars stored by symbol are pruned to these symbols at run time.

    The universe should be filtered, or small enough to be broadcast: its symbols reach the scan.
    """
    return bars.join(universe, "symbol")
