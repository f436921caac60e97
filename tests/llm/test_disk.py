"""What line dedup and intermediate tables hold on disk at once."""

import gc
import time

from test_shuffle_files import shuffle_files

from tideline.llm import line_dedup
from tideline.llm.storage import dropped, materialize


def test_lines_of_classes_are_dealt_in_parts_of_the_documents(spark):
    rows = [(i, "\n".join(f"w{i} x{i % 7} y{j} z" for j in range(3))) for i in range(60)] + [(0, "w0 x0 y0 z\nw0 x0 y1 z\nw0 x0 y2 z"), (None, "only\nthis"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    posted = materialize(line_dedup.postings(docs))
    classes = line_dedup.numbered_classes(posted.filter("n > 0"))
    parts = line_dedup._class_lines(classes.select("id"), classes, docs)
    found = [[(r["id"], len(r["words"])) for r in part.collect()] for part in parts]
    assert len(parts) == line_dedup.PARTS > 1
    assert max(map(len, found)) < 0.8 * classes.count()
    assert sorted(x for part in found for x in part) == sorted((r["id"], r["n"]) for r in classes.collect())
    dropped(posted, classes, *parts)


def test_shuffle_files_go_though_python_holds_a_cycle(spark):
    before = shuffle_files(spark)
    gc.collect()
    gc.disable()
    try:
        counted = spark.range(20_000).selectExpr("id % 5000 AS k").groupBy("k").count()
        rows = counted.collect()
        holder = {"table": counted}
        holder["self"] = holder
        del counted, holder
        assert len(rows) == 5000
        end = time.time() + 20
        tables = []
        while (left := shuffle_files(spark) - before) and time.time() < end:
            tables.append(materialize(spark.range(1)))
            time.sleep(0.2)
        dropped(*tables)
        assert not left
    finally:
        gc.enable()
