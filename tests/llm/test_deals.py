"""What line dedup deals once."""

import re

from tideline.llm import line_dedup
from tideline.llm.storage import dropped, materialize


def test_postings_of_small_groups_are_dealt_once_for_both_sides(spark):
    rows = [(i, " ".join(f"word{(i // 2 + k) % 40:02d}" for k in range(8)) + f" {i}") for i in range(80)]
    posted = materialize(line_dedup.postings(spark.createDataFrame(rows, "doc_id long, text string")))
    classes = line_dedup.numbered_classes(posted)
    shared = line_dedup.shared_neighbours(classes)
    few = shared.filter("few")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = line_dedup.candidates(few, few)
        assert pairs.count() and pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"ReusedExchange", plan)) == 1
    dropped(posted, classes, shared)


def test_lines_are_looked_up_document_by_document(spark):
    rows = [(i, "\n".join(f"w{i} x{i % 7} y{j} z" for j in range(30))) for i in range(20)] + [(0, "\n".join(f"w0 x0 y{j} z" for j in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    posted = materialize(line_dedup.postings(docs))
    classes = line_dedup.numbered_classes(posted)
    some = materialize(classes.select("id").filter("id % 3 = 0"))
    parts = line_dedup._class_lines(some, classes, docs)
    want = {r["id"]: r["n"] for r in classes.join(some, "id").collect()}
    found = [(r["id"], len(r["words"])) for part in parts for r in part.collect()]
    assert len(found) == len(want) > 100 and dict(found) == want
    dropped(posted, classes, some, *parts)
