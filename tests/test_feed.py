"""Feeds as data sources, and a day of polling with errors and an end."""

import datetime as dt
import json
import os
import time

import pytest

from tideline.sources import feed
from tideline.streaming import control


def put(path, number, *quotes):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{number}.tmp", "w") as file:
        json.dump([{"code": c, "close": x, "date": "2024-01-02"} for c, x in quotes], file)
    os.rename(f"{path}/{number}.tmp", f"{path}/{number}.json")


def test_snapshots_of_a_batch(spark, tmp_path):
    path = f"{tmp_path}/feed"
    os.makedirs(path)
    assert feed.read_feed(spark, feed.FolderFeed(path)).count() == 0
    for i in range(20):
        put(path, i, ("a", i), ("b", None if i % 2 else "n/a"))
    put(path, 25, ("late", 1.0))  # the ones before it are still to come
    df = feed.read_feed(spark, feed.FolderFeed(path))
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert len(rows) == 40 and sorted(r.close for r in rows if r.code == "a") == [float(i) for i in range(20)]
    assert all(r.close is None and r.open is None and r.date == "2024-01-02" for r in rows if r.code == "b")


def test_a_stream_restarts_at_its_offset(spark, tmp_path):
    path, out, check = f"{tmp_path}/feed", f"{tmp_path}/out", f"{tmp_path}/check"

    def run():
        q = feed.stream_feed(spark, feed.FolderFeed(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()

    put(path, 0, ("a", 1))
    put(path, 1, ("a", 2))
    run()
    assert sorted(r.close for r in spark.read.parquet(out).collect()) == [1.0, 2.0]
    put(path, 2, ("a", 3))
    run()
    run()
    assert sorted((r.number, r.close) for r in spark.read.parquet(out).collect()) == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_member_lists_are_read_page_by_page(spark, tmp_path):
    for index, n in (("i1", 7), ("i2", 0), ("i3", 4)):
        with open(f"{tmp_path}/{index}.json", "w") as file:
            json.dump([{"updateDate": "2024-01-02", "code": f"{index}.{k}", "code_name": f"n{k}", "other": 1} for k in range(n)], file)
    rows = feed.read_members(spark, feed.FolderMembers(str(tmp_path), 2)).collect()
    assert sorted((r.index_code, r.code) for r in rows) == sorted((i, f"{i}.{k}") for i, n in (("i1", 7), ("i3", 4)) for k in range(n))

    class Stuck(feed.FolderMembers):  # defined here, as workers don't see this module
        def page(self, index, cursor):
            return [{"code": "x"}], "same"

    with pytest.raises(Exception, match="doesn't move on"):
        feed.read_members(spark, Stuck(str(tmp_path))).collect()


class Clock:
    def __init__(self):
        self.now = dt.datetime(2024, 1, 2, 14, 0)

    def __call__(self):
        return self.now


def test_a_day_of_polling_with_a_failing_batch(spark, tmp_path):
    path, clock, seen, failures = f"{tmp_path}/feed", Clock(), [], [1, 1]

    def batch(df, number):
        rows = [r.close for r in df.collect()]
        if 2.0 in rows and failures:
            failures.pop()
            raise RuntimeError("the vendor is away")
        seen.append(rows)
        if 3.0 in rows:
            clock.now = dt.datetime(2024, 1, 2, 15, 1)
        elif rows:
            put(path, len(seen), ("a", float(len(seen)) + 1))

    put(path, 0, ("a", 1.0))
    start = control.poll(feed.stream_feed(spark, feed.FolderFeed(path)), batch, f"{tmp_path}/check", every=0.2)
    day = control.Day(start, retry=0.1, clock=clock)
    began = time.time()
    assert day.run(spark, look=0.2) == 3
    assert time.time() - began < 90
    assert [x for rows in seen for x in rows] == [1.0, 2.0, 3.0]
    assert len(day.errors) == 2 and "the vendor is away" in day.errors[0] and not day.query.isActive
    assert day.run(spark) == 0  # closed


def test_polling_gives_up_after_so_many_errors(spark, tmp_path):
    def batch(df, number):
        raise RuntimeError("always")

    put(f"{tmp_path}/feed", 0, ("a", 1.0))
    start = control.poll(feed.stream_feed(spark, feed.FolderFeed(f"{tmp_path}/feed")), batch, f"{tmp_path}/check", every=0.2)
    with pytest.raises(Exception, match="always"):
        control.Day(start, retry=0.1, attempts=2, clock=Clock()).run(spark, look=0.2)
