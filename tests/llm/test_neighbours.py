"""Nearest neighbours among vectors of several numbers of components, of unequal length, and beside brute force."""

import numpy as np
import pytest

from tideline.llm import ann

SCHEMA = "vec_id long, embedding array<double>"


def exact(vectors, q):
    """The nearest ids and distances of q among the others with as many components."""
    others = [(float(np.sqrt(((np.array(v) - np.array(vectors[q])) ** 2).sum())), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
    return [(i, d) for d, i in sorted(others)[: ann.NEIGHBOURS]]


def test_vectors_of_every_number_of_components_take_part(spark):
    r = np.random.default_rng(3)
    kinds = [(range(0, 400), 16), (range(400, 700), 5), (range(700, 706), 33), (range(800, 801), 2), (range(900, 903), 1)]
    vectors = {i: (r.standard_normal(n) + 1).tolist() for ids, n in kinds for i in ids}
    got = ann.nearest(spark.createDataFrame(list(vectors.items()), SCHEMA)).collect()
    hit = want = 0
    for q in range(0, 1000, 100):
        best = exact(vectors, q) if q in vectors else []
        own = sorted((g["rank"], g["vec_id"], g["score"]) for g in got if g["query_id"] == q)
        assert [o[0] for o in own] == list(range(1, len(best) + 1))
        assert all(len(vectors[i]) == len(vectors[q]) and np.isclose(d, np.linalg.norm(np.subtract(vectors[i], vectors[q])), rtol=1e-12) for _, i, d in own)
        hit, want = hit + len({o[1] for o in own} & {i for i, _ in best}), want + len(best)
        if len(best) < ann.NEIGHBOURS:
            assert [o[1] for o in own] == [i for i, _ in best]
    assert want == 7 * 10 + 5 + 0 + 2 and hit >= 0.9 * want


@pytest.mark.parametrize("sigma", [1.0, 2.0])
def test_recall_on_vectors_of_unequal_length(spark, sigma):
    r = np.random.default_rng(8)
    x = r.standard_normal((3000, 64))
    x *= (np.exp(sigma * r.standard_normal(3000)) / np.linalg.norm(x, axis=1))[:, None]
    got = ann.nearest(spark.createDataFrame(list(enumerate(x.tolist())), SCHEMA)).collect()
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(3000), d)).tolist() if i != q][:10]
        hit += len(set(best) & {g["vec_id"] for g in got if g["query_id"] == q})
    print(f"recall {hit / 300:.3f}")
    assert hit >= 0.9 * 300


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(i % 300, [float(i % 300), 1.0], 1, 2, 3, 4.0, "x") for i in range(600)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA + ", query_id int, rank int, bucket int, score double, table string")).collect()
    assert sorted((g["query_id"], g["rank"]) for g in got) == [(q, k) for q in (0, 100, 200) for k in range(1, 11)]
    assert [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == 100][:4] == [99, 101, 98, 102]
