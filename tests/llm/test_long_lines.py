"""Line dedup of long lines, which share frequent words."""

import random

from pyspark.sql import functions as F

from tideline.llm import line_dedup
from tideline.llm.storage import dropped, materialize

DOCS = "doc_id long, text string"


def lines_with_frequent_words(count, least, most, seed):
    """Lines of random words and of two long ones that all of them share."""
    r = random.Random(seed)
    return [" ".join([f"common{'x' * 40}{k}" for k in range(2)] + [f"w{r.randrange(10**9)}" for _ in range(r.randrange(least, most))]) for _ in range(count)]


def test_long_lines_that_share_frequent_words_make_few_pairs(spark):
    posted = materialize(line_dedup.postings(spark.createDataFrame(list(enumerate(lines_with_frequent_words(60, 140, 170, 1))), DOCS)))
    classes = line_dedup.numbered_classes(posted)
    shared = line_dedup.shared_neighbours(classes)
    assert shared.filter("NOT few").count() == 60
    many = shared.filter("NOT few")
    # Of 1,770 pairs none is similar.
    assert line_dedup.candidates(many, many).count() < 20
    dropped(posted, classes, shared)


def test_words_of_long_lines_are_not_dealt_to_each_pair(spark):
    texts = lines_with_frequent_words(40, 250, 270, 2)
    texts.append(" ".join(["other", *texts[0].split()[:-1]]))
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("words"))
    pairs = spark.createDataFrame([(a, b) for b in range(len(texts)) for a in range(b)], "a long, b long")
    assert [tuple(r) for r in line_dedup.likely(pairs, lines).collect()] == [(0, len(texts) - 1)]


def test_long_lines_against_brute_force(spark):
    # Numbers of words on both sides of powers of 2, similarities on both sides of the threshold.
    r = random.Random(3)
    texts = []
    for n in (150, 190, 200, 250, 262, 300, 500, 530):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts.append(" ".join(base))
        for change in (n // 20, n // 10, n // 9 - 1, n // 9, n // 9 + 1, n // 8, n // 6):
            texts.append(" ".join(base[change:] + [f"v{r.randrange(10**6)}" for _ in range(change)]))
            texts.append(" ".join(base[change:]))
            texts.append(" ".join(base + [f"u{r.randrange(10**6)}" for _ in range(2 * change)]))
    r.shuffle(texts)
    sets = [set(t.split()) for t in texts]
    want = {i for i, s in enumerate(sets) if any(10 * len(s & x) >= 8 * len(s | x) for x in sets[:i])}
    got = {x["doc_id"] for x in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect() if x["n_removed"]}
    assert got == want and 0 < len(want) < len(texts) - 8


def test_near_copies_that_are_not_similar_make_few_rows_and_lose_no_pair(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 15))) for _ in range(60)]
    rows = [(i, " ".join([w if r.random() > 0.08 else "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 15))) for w in base])) for i in range(80)]
    posted = materialize(line_dedup.postings(spark.createDataFrame(rows, DOCS)))
    classes = line_dedup.numbered_classes(posted)
    shared = line_dedup.shared_neighbours(classes)
    few, many = shared.filter("few"), shared.filter("NOT few")
    rows = {k: [tuple(x) for x in line_dedup.candidates(many, many, once=k).collect()] for k in (False, True)}
    others = {tuple(x) for x in line_dedup.candidates(few, few).collect()}
    assert {*rows[True], *others} == {*rows[False], *others}
    assert len({*rows[False]}) > 500 and len(rows[True]) < 0.6 * len(rows[False])
    dropped(posted, classes, shared)
