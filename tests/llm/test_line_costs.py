"""What line dedup reads and keeps while it goes."""

from pathlib import Path

from tideline.llm import line_dedup
from tideline.llm.storage import shared_folder

DOCS = "doc_id long, text string"


def test_postings_count_nothing_first(spark):
    docs = spark.createDataFrame([(0, "a bb ccc bb\n\nä"), (1, None)], DOCS)
    spark.sparkContext.setJobGroup("postings", "postings")
    try:
        posted = line_dedup.postings(docs)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("postings")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["n"] for r in posted.collect()) == [0, 0, 1, 3]


def test_longest_words_come_first(spark):
    long = "x" * 300
    lines = ["a bb ccc dddd eeeee ffffff", f"{long} ä bb ccc dddd", f"dddd {long} eeeee"]
    alone = {w: r["low"] for w in (long, "ffffff", "eeeee", "dddd") for r in spark.createDataFrame([(w,)], "w string").select(line_dedup._code("w").alias("low")).collect()}
    got = {r["doc_id"]: list(r["prefix"]) for r in line_dedup.postings(spark.createDataFrame(list(enumerate(lines)), DOCS)).collect()}
    low = {w: (c & 0xFFFFFFFF) - (1 << 32) * (c >> 31 & 1) for w, c in alone.items()}
    assert got[0][:3] == [low["ffffff"], low["eeeee"], low["dddd"]] and got[1][:2] == [low[long], low["dddd"]] and got[2] == []


def test_tables_of_prefixes_go_before_pairs_are_verified(spark, monkeypatch):
    seen, similar = [], line_dedup._similar
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("tideline-*"))

    def watched(*args):
        seen.extend(spark.read.parquet(str(p)).columns for p in set(folder.glob("tideline-*")) - before)
        return similar(*args)

    monkeypatch.setattr(line_dedup, "_similar", watched)
    rows = [(i, "\n".join(f"w{i} x{i % 7} y{j} z" for j in range(3))) for i in range(30)]
    assert line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).count() == 30
    assert seen and not [c for c in seen if "prefix" in c]
    assert set(folder.glob("tideline-*")) - before


def test_groups_larger_than_few_lose_no_link(spark):
    # Most tokens are in more classes than FEW, and the earliest class of a token is often not similar to the others with it.
    few = line_dedup.FEW
    words = [f"w{i:02d}" for i in range(9)]
    rows = [(i, " ".join([*words[: 9 - i % 3], *(f"w{i // 4 % 7 + 20}" for _ in "x"), *(["zz"] if i % 5 == 0 else [])])) for i in range(6 * few)]
    sets = [frozenset(t.split()) for _, t in rows]
    want = {i for i, s in enumerate(sets) if any(10 * len(s & r) >= 8 * len(s | r) for r in sets[:i])}
    got = {r["doc_id"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect() if r["n_removed"]}
    assert got == want


def test_both_parities_bound_the_difference_of_sets(spark):
    lines = [" ".join(f"w{(i * k) % 31}" for k in range(1, 25)) for i in range(1, 12)]
    sets = [set(t.split()) for t in lines]
    got = {r["doc_id"]: (r["bits"], r["more"]) for r in line_dedup.postings(spark.createDataFrame(list(enumerate(lines)), DOCS)).collect()}
    apart = [0, 0]
    for i, s in enumerate(sets):
        for j, r in enumerate(sets):
            differ = [((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(got[i], got[j], strict=True)]
            assert max(differ) <= len(s ^ r)
            apart = [x + y for x, y in zip(apart, differ, strict=True)]
    assert min(apart) > 0 and any(x != y for x, y in got.values())
