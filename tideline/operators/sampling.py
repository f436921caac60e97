"""Samples that merge: of each key the rows with the least k priorities, which follow from the rows alone.

A priority is drawn by a hash of a row's own columns and a seed, so the sample is the same for
any partitioning, batch or order; with weights it is an exponential waiting time, so that a row
is drawn in proportion to its weight, without replacement. Samples of parts of the rows, with
their priorities, merge to the sample of all rows. Each task keeps k rows of a key before
anything is shuffled, and nothing is sorted as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

PRIORITY = "priority"
_BITS = 52


def uniform(identity: list[str], seed: int) -> Column:
    """A number over 0 and under 1 by the row's identity, the same in every engine that has MD5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << _BITS)


def prioritised(df: DataFrame, identity: list[str], seed: int, weight: str | None = None) -> DataFrame:
    """Adds priority; rows of no positive weight have none and are never drawn."""
    u = uniform(identity, seed)
    return df.withColumn(PRIORITY, u if weight is None else F.when(F.col(weight) > 0, -F.ln(u) / F.col(weight)))


def least(df: DataFrame, k: int, key: list[str]) -> DataFrame:
    """Of each key the k rows of least priority (all rows are one key if key is empty); equal priorities by the rows' hashes."""
    df, order = df.filter(F.col(PRIORITY).isNotNull()), [F.col(PRIORITY), F.xxhash64(*df.columns)]
    if not key:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def bottom_k(df: DataFrame, k: int, identity: list[str], seed: int = 0, key: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """A sample of k rows of each key, with their priorities. identity tells rows apart: rows with equal identities are drawn together."""
    return least(prioritised(df, identity, seed, weight), k, key or [])


def merged(samples: list[DataFrame], k: int, key: list[str] | None = None) -> DataFrame:
    """The sample of all rows from samples of their parts, of k rows or more each, by the same identity and seed."""
    return least(reduce(lambda a, b: a.unionByName(b), samples), k, key or [])


def estimated_total(sample: DataFrame, k: int, key: list[str], value: str) -> DataFrame:
    """key, total: the sum of value over the rows that an unweighted sample of k a key was drawn from; exact for a key of fewer.

    With the greatest priority t of the k, each of the others stands for 1 / t rows.
    """
    w = Window.partitionBy(*key)
    df = sample.withColumns({"__t": F.max(PRIORITY).over(w), "__m": F.count(F.lit(1)).over(w)})
    part = F.when(F.col("__m") < k, F.col(value)).when(F.col(PRIORITY) < F.col("__t"), F.col(value) / F.col("__t")).otherwise(0.0)
    return df.groupBy(*key).agg(F.sum(part).alias("total"))
