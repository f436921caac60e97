"""Samples that merge, and look-ups that notice missing symbols."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.operators import sampling
from tideline.sources import lookups


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(5000).select("id", F.concat(F.lit("k"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7)).alias("key"), (F.col("id") % 10).cast("double").alias("value")).cache()


def test_a_sample_does_not_depend_on_partitions(rows):
    want = sorted(tuple(r) for r in sampling.bottom_k(rows, 20, ["id"], 1, ["key"]).collect())
    assert len(want) == 7 * 20
    for n in (1, 9):
        assert sorted(tuple(r) for r in sampling.bottom_k(rows.repartition(n, F.rand(n)), 20, ["id"], 1, ["key"]).collect()) == want
    assert {r.id for r in sampling.bottom_k(rows, 20, ["id"], 2, ["key"]).collect()} != {r[0] for r in want}


def test_samples_of_batches_merge(rows):
    parts = [sampling.bottom_k(rows.filter(F.col("id") % 4 == i), 30, ["id"], 5, ["key"], "value") for i in range(4)]
    want = sampling.bottom_k(rows, 30, ["id"], 5, ["key"], "value")
    assert sorted(tuple(r) for r in sampling.merged(parts, 30, ["key"]).collect()) == sorted(tuple(r) for r in want.collect())


def test_tasks_keep_k_rows_before_the_shuffle(rows):
    keyed, whole = (sampling.bottom_k(rows, 20, ["id"], 1, key)._jdf.queryExecution().executedPlan().toString() for key in (["key"], []))
    before, after = keyed.split("Exchange")[1], keyed.split("Exchange")[0]
    assert "WindowGroupLimit" in before and "WindowGroupLimit" in after and "rangepartitioning" not in keyed
    assert "TakeOrderedAndProject" in whole and "rangepartitioning" not in whole
    assert sampling.bottom_k(rows, 20, ["id"], 1).count() == 20
    assert sampling.bottom_k(rows.limit(0), 20, ["id"], 1).count() == 0


def test_weights_draw_in_proportion(spark):
    df = spark.range(400).select(F.col("id"), F.when(F.col("id") < 40, 9.0).when(F.col("id") < 60, 0.0).otherwise(1.0).alias("w"))
    hits = Counter()
    for seed in range(30):
        hits.update(r.id < 40 for r in sampling.bottom_k(df, 10, ["id"], seed, weight="w").collect())
        assert all(not 40 <= r.id < 60 for r in sampling.bottom_k(df, 400, ["id"], seed, weight="w").collect())
    # 360 of 700 of the weight.
    assert 0.4 < hits[True] / 300 < 0.62


def test_a_sample_estimates_totals(rows):
    want = {r.key: r.total for r in rows.groupBy("key").agg(F.sum("value").alias("total")).collect()}
    got = {r.key: r.total for r in sampling.estimated_total(sampling.bottom_k(rows, 200, ["id"], 3, ["key"]), 200, ["key"], "value").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] / want[k] - 1) < 0.25 for k in want)
    whole = sampling.estimated_total(sampling.bottom_k(rows, 5001, ["id"], 3, ["key"]), 5001, ["key"], "value")
    assert {r.key: r.total for r in whole.collect()} == want


DAY = dt.date(2024, 1, 2)


def test_look_ups_keep_the_order_and_notice_missing_symbols(spark):
    df = spark.createDataFrame([(s, DAY, float(i)) for i, s in enumerate("abcb")], "symbol string, dt date, close double")
    found = lookups.look_up(df, ["c", "b", "a"])
    assert [r.symbol for r in found.collected()] == ["c", "b", "b", "a"] and found.counts() == {"c": 1, "b": 2, "a": 1}
    missing = lookups.look_up(df, ["a", "x", "y"])
    with pytest.raises(lookups.MissingSymbols) as e:
        missing.collected()
    assert e.value.missing == ["x", "y"]
    with pytest.raises(ValueError):
        lookups.look_up(df, ["a", "a"])
    assert lookups.look_up(df, []).collected() == []


def test_look_ups_count_in_the_pass_that_writes(spark, tmp_path):
    df = spark.createDataFrame([("a", DAY, 1.0)], "symbol string, dt date, close double")
    checked = lookups.look_up(df, ["a", "z"], ordered=False)
    checked.rows.write.parquet(f"{tmp_path}/out")
    with pytest.raises(lookups.MissingSymbols):
        checked.verify()
