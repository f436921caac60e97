"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: list[str] = []
#: Tables written inside calls of `alone` that are under way.
_MEANWHILE: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or of setCheckpointDir; one of our own where both are unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="tideline-"))
    return "file://" + _OWN_FOLDER[0]


def _collected(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    It does so once the driver's JVM has collected the plans that refer to them, which may
    not happen by itself before a query ends, not while Python's own objects for them wait
    for a collection, and not while the scheduler's last job was theirs: so a small one follows.
    """
    spark.range(0, 1, 1, 1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    The files stay until `dropped` takes them away; those of a returned table stay for its reader.
    What was shuffled to make df goes with this step; see _collected.
    """
    path = f"{shared_folder(df.sparkSession)}/tideline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _collected(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tideline_path = path
    for tables in _MEANWHILE:
        tables.append(out)
    return out


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns as a table, without all tables that were written to make it."""
    tables: list[DataFrame] = []
    _MEANWHILE.append(tables)
    try:
        out = materialize(make())
    finally:
        _MEANWHILE.pop()
    dropped(*[t for t in tables if t is not out])
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no plan still to run reads."""
    for table in tables:
        spark, path = table.sparkSession, table.tideline_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        _collected(spark)
