"""Shuffle files of finished steps go."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from tideline.llm.storage import dropped, materialize


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in Path(str(d)).rglob("shuffle_*.data")}


def test_shuffle_files_go_with_the_table_that_they_made(spark):
    before = shuffle_files(spark)
    tables = [materialize(spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).count()) for _ in range(3)]
    dropped(*tables)
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left


def test_shuffle_files_go_before_the_next_table_is_made(spark):
    before, frames, left = shuffle_files(spark), [], []
    for _ in range(4):
        # The frame is still there, as it is in the step that goes on with its table.
        frames.append(spark.range(0, 400_000, 1, 8).groupBy((F.rand() * 1e9).cast("long").alias("k")).count())
        table = materialize(frames[-1])
        end = time.time() + 3
        while (files := shuffle_files(spark) - before) and time.time() < end:
            time.sleep(0.1)
        left.append(len(files))
        dropped(table)
    assert left == [0] * 4
