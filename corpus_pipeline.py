"""A corpus pipeline: filter by quality, dedup lines, keep one of near copies, decontaminate, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, jaccard_join, line_dedup, piece_codec, quality
from tideline.llm.storage import alone, dropped


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_group(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(docs)


STAGES = [("quality", _quality), ("line_dedup", _lines), ("near_copies", _near_copies), ("decontamination", _benchmark), ("encoding", _encode)]

#: SQL can't express the classifier, nor the search for benchmark items.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage is written as Parquet and read by the next.

    What a stage has written on its way goes when it is done, and its rows when the next one is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for _, stage in STAGES[:-1]:
        docs = alone(lambda: stage(spark, docs, sf_dir))  # noqa: B023
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
