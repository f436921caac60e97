"""The versioned store: replays, kills, versions, pruning, and joins of bucketed tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.sources import store

SCHEMA = "symbol string, dt date, open double, high double, low double, close double, volume double, amount double"


def bars(spark, *rows):
    """Rows (symbol, day, close)."""
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), c, c, c, c, 1.0, 1.0) for s, d, c in rows], SCHEMA)


def closes(spark, path):
    return {(r.symbol, str(r.dt)): r.close for r in store.read_bars(spark, path).collect()}


FIRST = [("a", "2024-01-02", 1.0), ("a", "2024-02-01", 2.0), ("b", "2024-01-03", 3.0)]


def test_batches_replace_rows_and_replays_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert closes(spark, path) == {}
    assert store.upsert(bars(spark, *FIRST), path, 0)
    assert store.upsert(bars(spark, ("a", "2024-01-02", 9.0), ("a", "2024-01-05", 4.0)), path, 1)
    want = {("a", "2024-01-02"): 9.0, ("a", "2024-01-05"): 4.0, ("a", "2024-02-01"): 2.0, ("b", "2024-01-03"): 3.0}
    assert closes(spark, path) == want
    # The batch before comes again, with what it had and with other rows: it's committed.
    assert not store.upsert(bars(spark, *FIRST), path, 0)
    assert not store.upsert(bars(spark, ("a", "2024-01-02", 7.0)), path, 1)
    assert closes(spark, path) == want
    assert {(r.symbol, r.month): r.batch for r in store.current(spark, path).collect()} == {("a", "2024-01"): 1, ("a", "2024-02"): 0, ("b", "2024-01"): 0}


def test_a_kill_between_staging_and_commit(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    store.upsert(bars(spark, *FIRST), path, 0)
    before = closes(spark, path)
    change = bars(spark, ("a", "2024-01-02", 9.0), ("c", "2024-01-02", 5.0))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(change, path, 1)
    assert closes(spark, path) == before
    # Rows that the killed batch has left don't count either when it comes again without them.
    assert store.upsert(bars(spark, ("a", "2024-01-02", 8.0)), path, 1)
    assert closes(spark, path) == before | {("a", "2024-01-02"): 8.0}
    assert store.upsert(bars(spark, ("c", "2024-01-09", 6.0)), path, 2)
    assert closes(spark, path) == before | {("a", "2024-01-02"): 8.0, ("c", "2024-01-09"): 6.0}


def test_repeated_rows_of_a_batch_and_vacuum(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    for batch in range(3):
        store.upsert(bars(spark, ("a", "2024-01-02", float(batch)), ("a", "2024-01-02", float(batch)), ("b", "2024-01-02", 1.0)), path, batch)
    want = closes(spark, path)
    assert want == {("a", "2024-01-02"): 2.0, ("b", "2024-01-02"): 1.0}
    assert store.vacuum(spark, path) == 4
    assert store.vacuum(spark, path) == 0 and closes(spark, path) == want
    assert len(list((tmp_path / "s" / "data").rglob("batch=*"))) == 2


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    path, source, check = f"file://{tmp_path}/s", f"{tmp_path}/in", f"{tmp_path}/check"
    bars(spark, *FIRST).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    store.store_stream(stream(), path, check).awaitTermination()
    bars(spark, ("a", "2024-01-02", 9.0)).write.mode("append").parquet(source)
    store.store_stream(stream(), path, check).awaitTermination()
    want = closes(spark, path)
    assert want[("a", "2024-01-02")] == 9.0 and len(want) == 3
    # Spark replays a batch whose commit it has lost.
    (tmp_path / "check" / "commits" / "1").unlink()
    for crc in (tmp_path / "check" / "commits").glob(".1*"):
        crc.unlink()
    store.store_stream(stream(), path, check).awaitTermination()
    assert closes(spark, path) == want and store.commits(spark, path).count() == 4


def test_only_folders_of_the_parts_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.upsert(bars(spark, *FIRST), path, 0)
    few = store.read_bars(spark, path, store.current(spark, path).filter("symbol = 'a'"), ["close"])
    assert few.agg(F.sum("close")).first()[0] == 3.0
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "open" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    rows = bars(spark, *[(f"s{i % 7}", f"2024-01-{1 + i // 7:02}", float(i)) for i in range(140)])
    store.write_bucketed(rows, "bucketed_bars", 4, f"file://{tmp_path}/bars")
    store.write_bucketed(rows.select("symbol", "dt", (F.col("close") * 2).alias("twice")), "bucketed_other", 4, f"file://{tmp_path}/other")
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        joined = spark.table("bucketed_bars").join(spark.table("bucketed_other"), ["symbol", "dt"])
        grouped = joined.groupBy("symbol").agg(F.sum("twice").alias("t"))
        assert grouped.agg(F.sum("t")).first()[0] == 2 * sum(range(140))
        plan = grouped._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE bucketed_bars")
        spark.sql("DROP TABLE bucketed_other")


def test_a_universe_prunes_stored_symbols_at_run_time(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.upsert(bars(spark, *[(f"s{i}", "2024-01-02", float(i)) for i in range(20)]), path, 0)
    data = spark.read.parquet(f"{path}/data")
    names = spark.createDataFrame([("s3", "ETF", 0), ("s4", "ETF", 1), ("s5", "fund", 2)], "symbol string, kind string, ordinal int")
    names.write.parquet(f"{path}-names")
    got = store.of_universe(data, spark.read.parquet(f"{path}-names").filter("kind = 'ETF'"))
    assert sorted(r.close for r in got.collect()) == [3.0, 4.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
