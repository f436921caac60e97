"""Line dedup deals slim postings, and keeps those that classes share."""

from tideline.llm import line_dedup
from tideline.llm.storage import dropped


def test_postings_of_one_class_carry_no_more_than_class_place_and_token(spark):
    # The first three lines share neighbours, the fourth shares words, but no neighbours, with none.
    lines = ["a b c d e f g h", "a b c d e f g i", "a b c d e f j k", "l m n o p q r s"]
    posted = line_dedup.postings(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    classes = line_dedup.numbered_classes(posted)
    each = line_dedup._neighbours(classes)
    assert each.columns == ["id", "place", "token"]
    shared = line_dedup.shared_neighbours(classes)
    by_token = {}
    for r in each.collect():
        by_token.setdefault(r["token"], []).append(r["id"])
    want = sorted((i, t, min(ids)) for t, ids in by_token.items() if len(ids) > 1 for i in ids)
    assert sorted((r["id"], r["token"], r["a"]) for r in shared.collect()) == want
    prefixes = {r["id"]: r["prefix"] for r in classes.collect()}
    assert all(r["before"] == (prefixes[r["id"]][r["place"] - 1] if r["place"] else None) for r in shared.collect())
    dropped(classes, shared)
