"""Op10 sums rows of its tables by runs, and looks at passages that share words with an item only."""

import numpy as np
import pytest

from tideline.llm import decontaminate


@pytest.mark.parametrize("longest", [3, 40])
def test_sums_of_runs(longest):
    rng = np.random.default_rng(1)
    n = rng.integers(1, longest + 1, 200)
    table, index = rng.integers(0, 9, (50, 7)).astype(np.float32), rng.integers(0, 50, int(n.sum()))
    starts = np.cumsum(n) - n
    got = decontaminate.summed(table, index, starts)
    assert got.dtype == table.dtype
    assert np.array_equal(got, np.add.reduceat(table[index], starts))
    assert decontaminate.summed(table, index[:0], starts[:0]).shape == (0, 7)


def test_passages_that_share_few_words_with_items_are_not_multiplied(monkeypatch):
    rng = np.random.default_rng(2)
    items = [decontaminate.Item(i, rng.integers(1, 401, n), 0) for i, n in enumerate([3, 4, 7, 9, 12, 20, 47, 30])]
    latent = rng.standard_normal((400, 16)).astype(np.float32)
    rows = [rng.integers(0, 401, 400).astype(np.int32) for _ in range(30)] + [np.zeros(0, np.int32)]
    for i, item in enumerate(items):
        rows[i][50 : 50 + len(item.words)] = item.words
    multiplied, unit = [], decontaminate._unit

    def counted(x):
        multiplied.append(len(x))
        return unit(x)

    monkeypatch.setattr(decontaminate, "_unit", counted)

    def found():
        queries = decontaminate.queries_of(items, latent)
        multiplied.clear()
        return [set(decontaminate.candidates(rows, latent, q)) for q in queries], sum(multiplied)

    by_table, few = found()
    monkeypatch.setattr(decontaminate, "CELLS", 0)
    by_lists, many = found()
    assert by_table == by_lists
    assert {k for x in by_table for _, _, k in x} == set(range(len(items)))
    assert few < many / 3
