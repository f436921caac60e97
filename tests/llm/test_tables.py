"""What queries leave behind in the shared folder: only tables that their results read."""

import os

import pytest

import corpus_pipeline
from tideline.llm import components, queries, storage


def tables(spark):
    folder = storage.shared_folder(spark).removeprefix("file://")
    return {n for n in os.listdir(folder) if n.startswith("tideline-")} if os.path.isdir(folder) else set()


@pytest.mark.parametrize(("name", "kept"), [("op8_ngram_jaccard_join", 2), ("op9_nearest_neighbours", 1), ("op10_decontamination", 1), ("op12_spelling_variants", 3), ("op6_substring_dedup", 1), ("pipeline", 1)])
def test_only_tables_that_the_result_reads_stay(spark, data, name, kept):
    before = tables(spark)
    df = {**queries.QUERIES, "pipeline": corpus_pipeline.run}[name](spark, data)
    stays = tables(spark) - before
    assert df.count() > 0
    assert len(stays) == kept


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2), (3, None)], [(1, 2), (2, 1), (5, 4), (4, 9)], [(i, i + 1) for i in range(200)] + [(500, 400), (400, 300)]])
def test_components_against_a_search(spark, edges):
    before = tables(spark)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {}
    for u, v in edges:
        if u is not None and v is not None and u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    assert got == want
    assert len(tables(spark) - before) == 1


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key long, `class` string"


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_rows_and_empty_tables(spark, tmp_path, empty):
    words = [f"{a}{b}" for a in ("ba", "de", "gi", "ko", "mu") for b in ("lan", "ner", "ris", "tol", "sum")]
    texts = [" ".join(words[(i * k + k) % 25] for k in range(60)) for i in range(1, 30)]
    texts[7] = " ".join(f"{a}{b}x" for a in words[:6] for b in words[6:16])  # words that not all documents have
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, " \t\n"), (None, texts[0]), (5, texts[5]), (103, "é " * 40 + "\U0001f600"), (104, " ".join(words) * 400)]
    docs = spark.createDataFrame([] if empty else [(i, t, "en", "web", None, 1, "x") for i, t in rows], DOCUMENTS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(i, int(i % 4 > 0), 0) for i in range(29)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if empty else [(1, texts[7]), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path))
        assert out.columns == docs.columns
        assert out.select("doc_id").distinct().subtract(docs.select("doc_id")).isEmpty()
        seen = storage.materialize(out)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == seen.count() and (got == []) == empty
    assert 7 not in {r["doc_id"] for r in got}
