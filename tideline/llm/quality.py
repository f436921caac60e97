"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL updates.

Documents are scored as sparse dot products of their n-gram frequencies with one
weight vector of fixed size (2**18 slots), the only thing that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tideline.llm.ftrl import BUCKETS, REPEAT, fit, ngrams, sigmoid
from tideline.llm.text import pieces, row_of, utf8

#: Labelled rows that training reads at most: a hash of doc_id picks them.
TRAINING_ROWS = 20_000
#: Models trained side by side on parts of the sample, then averaged.
SHARDS = 6
#: Frequencies are multiplied by this, so that the learning rate fits them.
SCALE = 16.0
#: The column that scoring adds; its name should clash with none.
SCORE = "__tideline_score"


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, y) to (doc_id, slots, values, y)."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i, j in pieces(offsets):
            one, two, pointer = ngrams(data, offsets[i : j + 1])
            slots, values = [], []
            for a, b in zip(pointer[:-1], pointer[1:], strict=True):
                at = np.concatenate([one[a:b], two[a:b]])
                at, count = np.unique(at[at >= 0], return_counts=True)
                slots.append(at.astype(np.int32))
                values.append((SCALE * count / max(1, b - a)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), batch.column("y").slice(i, j - i)],
                ["doc_id", "slots", "values", "y"],
            )


def sampled(rows: DataFrame, limit: int) -> DataFrame:
    """About limit rows at most, picked by a hash of doc_id: the same ones on every run."""
    share = min(1.0, limit / max(1, rows.count()))
    return rows if share == 1 else rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def train(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, epochs: int = 4) -> np.ndarray:
    """Weights for quality, from labelled rows that are not held out.

    Labels that are null, and rows whose doc_id is null, are not learnt from. Where a
    doc_id has several labels, the largest counts. Without any label the weights are
    all zero, and every score 0.5.
    """
    spark = documents.sparkSession
    marked = sampled(labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y")), limit)
    rows = documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id").mapInArrow(examples, "doc_id long, slots array<int>, values array<float>, y double")

    def shard(key, frame):
        import pandas as pd

        frame = frame.sort_values("doc_id")
        w = fit(zip(frame["slots"], frame["values"].map(np.float64), frame["y"], strict=True), BUCKETS + 1, epochs, int(key[0]), alpha=0.5, l1=0.02, l2=0.02)
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "w": w[at]})

    parts = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS))).groupBy("shard").applyInPandas(shard, "slot int, w double")
    weights = np.zeros(BUCKETS + 2)
    found = parts.groupBy("slot").agg((F.sum("w") / SHARDS).alias("w")).toPandas()
    weights[found["slot"].to_numpy(np.int64)] = found["w"].to_numpy(float)
    return weights.astype(np.float32)


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each row of a piece: the sigmoid of bias and mean n-gram weight."""
    one, two, pointer = ngrams(data, offsets)
    w = weights[one].astype(np.float64) + np.where(two >= 0, weights[two], 0)
    total = np.bincount(row_of(pointer), w, len(pointer) - 1)
    return sigmoid(float(weights[-1]) + SCALE * total / np.maximum(1, np.diff(pointer)))


def with_quality(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """documents with score (0 to 1) added at the end; null and empty texts get the bias alone."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = [scores(data, offsets[i : j + 1], shared.value) for i, j in pieces(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out or [np.zeros(0)]), pa.float64())], [*batch.schema.names, SCORE])

    return documents.mapInArrow(score, T.StructType([*documents.schema.fields, T.StructField(SCORE, T.DoubleType())]))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; each input row gives one row.

    Empty, null and very long texts are scored as they are; extra columns are ignored.
    A null doc_id is kept, with held_out false.
    """
    scored = with_quality(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select(
        "doc_id",
        F.coalesce(is_held_out(), F.lit(False)).alias("held_out"),
        F.col(SCORE).alias("score"),
        (F.col(SCORE) >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches threshold, with their own columns only."""
    kept = with_quality(documents, train(documents, labels)).filter(F.col(SCORE) >= threshold)
    return kept.select(*documents.columns)
