"""Periodic runs: stretches of words that repeat with some period, by matching aligned blocks.

At scale b (a power of two) every aligned block of b words is searched, by an automaton
over sequences of numbers, among the b places that are b to 2b - 1 words after it. A stretch
of period q with b <= q < 2b and at least 3q words holds an aligned block whose copy q words
on is in it too, so each such stretch has a seed at its own scale; a seed is extended both
ways, word by word.

Two things keep that linear, a logarithm aside, for any text. A block can only have a copy
there if each of its words comes again within 2b words; others aren't searched. And a block
with four or more copies is itself periodic with a third of its length at most, so it lies
in a run that smaller scales have found. Of its copies those in the same run tell nothing,
and of those in another run only the one as far from that run's end as the block is from its
own run's can lie in a longer period, as ends are repeated like everything else.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.text import pieces, utf8

#: A run has as many words at least, and as many periods.
LEAST = 6
TIMES = 4
#: Blocks of one automaton: its root has no more branches, which are looked through in a row.
BLOCKS = 64
#: Letters of a key: longer blocks are spelt in stretches of two, four, ... words, as the
#: automaton goes back over the prefixes of a key that end at a place, one by one.
DEPTH = 64
#: Periods after which runs are sure to be found.
_SURE = 3


def _recurrence(ids: np.ndarray) -> np.ndarray:
    """For each word how far on it comes again; the number of all words if it doesn't."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids))
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _pairs_named(names: np.ndarray, g: int) -> np.ndarray:
    """Numbers of all stretches of 2g words from those of g words: equal stretches have equal numbers."""
    both = names[: max(0, len(names) - g)].astype(np.int64) << 32 | names[g:]
    return np.unique(both, return_inverse=True)[1]


def _copies(names: np.ndarray, g: int, blocks: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of blocks (numbers of aligned ones) and of their copies b to 2b - 1 words on, by numbers of stretches of g words."""
    at, copy, last = [], [], b // g - 1
    for near in np.split(blocks, np.flatnonzero(np.diff(blocks) > 2) + 1):
        for k in range(0, len(near), BLOCKS):
            some = near[k : k + BLOCKS].tolist()
            keys: dict[tuple[int, ...], int] = {}
            key_of = {i: keys.setdefault(tuple(names[i * b : i * b + b : g].tolist()), len(keys)) for i in some}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for key, number in keys.items():
                automaton.add_word(key, number)
            automaton.make_automaton()
            low, high = (some[0] + 1) * b, (some[-1] + 3) * b - g
            for phase in range(low, low + g):
                for end, number in automaton.iter(tuple(names[phase:high:g].tolist())):
                    j = phase + (end - last) * g
                    i = j // b - 1
                    if key_of.get(i) == number:
                        at.append(i * b)
                        copy.append(j)
    return np.array(at, np.int64), np.array(copy, np.int64)


def _telling(at: np.ndarray, copy: np.ndarray, b: int, runs: dict[tuple[int, int], int]) -> np.ndarray:
    """Which copies can lie in a longer period than that of the run around the block, if there is one."""
    around = sorted((s, e) for (s, e), q in runs.items() if 3 * q <= b <= e - s)
    if not around:
        return np.ones(len(at), bool)
    # No two of these runs share as many as b words, so starts and ends are in the same order.
    starts, ends = np.array(around).T
    first, second = (np.searchsorted(starts, x, "right") - 1 for x in (at, copy))
    inside = (first >= 0) & (ends[first] >= at + b)
    return ~inside | ((first != second) & (copy - at == ends[second] - ends[first]))


def _equal_ahead(ids: np.ndarray, a: int, c: int) -> int:
    """How many words are equal from a and from c > a on."""
    done, step = 0, 16
    while c + done < len(ids):
        m = min(step, len(ids) - c - done)
        differ = ids[a + done : a + done + m] != ids[c + done : c + done + m]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + m, 2 * step
    return done


def _equal_behind(ids: np.ndarray, a: int, c: int) -> int:
    """How many words are equal before a and before c > a."""
    done, step = 0, 16
    while done < a:
        m = min(step, a - done)
        differ = (ids[a - done - m : a - done] != ids[c - done - m : c - done])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + m, 2 * step
    return done


def maximal_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers under 2**32, by start, then period.

    A run is a stretch with smallest period q, of `least` and of times * q words at least (times
    from 3 on), that no word beside it extends keeping the period.
    """
    if times < _SURE:
        raise ValueError("runs of fewer than three periods may have no seed")
    n = len(ids)
    again, names = _recurrence(ids), ids
    runs: dict[tuple[int, int], int] = {}
    b = g = 1
    while times * b <= n:
        blocks = np.flatnonzero((again[: n // b * b] < 2 * b).reshape(-1, b).all(axis=1))
        while len(blocks) and g * DEPTH < b:
            names, g = _pairs_named(names, g), 2 * g
        at, copy = _copies(names, g, blocks, b) if len(blocks) else (blocks, blocks)
        if len(at):
            keep = _telling(at, copy, b, runs)
            at, copy = at[keep], copy[keep]
        distance = copy - at
        order = np.lexsort((at, distance))
        before, end = 0, 0
        for i, q in zip(at[order].tolist(), distance[order].tolist(), strict=True):
            if q == before and i < end:
                continue  # in the stretch of the seed before it
            start = i - _equal_behind(ids, i, i + q)
            before, end = q, i + b + _equal_ahead(ids, i + b, i + b + q)
            # The same stretch with a smaller period was found before.
            if end - start + q >= _SURE * q:
                runs.setdefault((start, end + q), q)
        b *= 2
    return sorted((s, e - s, q) for (s, e), q in runs.items() if e - s >= max(least, times * q))


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one sequence of word numbers with a number of its own after each, and where each text starts."""
    numbers: dict[bytes, int] = {}
    ids, starts = [], [0]
    for words in texts:
        ids.extend([numbers.setdefault(w, len(numbers)) for w in words])
        ids.append(-1)
        starts.append(len(ids))
    out = np.array(ids, np.int64)
    ends = np.array(starts[1:], np.int64) - 1
    out[ends] = len(numbers) + np.arange(len(ends))
    return out, np.array(starts, np.int64)


def _find(least: int, times: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in pieces(offsets):
                texts = [data[offsets[r] : offsets[r + 1]].tobytes().split() for r in range(i, j)]
                ids, starts = _numbered(texts)
                runs = maximal_runs(ids, least, times)
                step = np.zeros(len(ids) + 1, np.int64)
                own: list[list[dict[str, int]]] = [[] for _ in texts]
                for s, length, q in runs:
                    step[s + q] += 1
                    step[s + length] -= 1
                    r = int(np.searchsorted(starts, s, "right")) - 1
                    own[r].append({"start": s - int(starts[r]), "length": length, "period": q})
                gone = np.cumsum(step) > 0
                kept = [b" ".join([w for w, out in zip(words, gone[starts[r] : starts[r + 1] - 1].tolist(), strict=True) if not out] if own[r] else words) for r, words in enumerate(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array([len(t) for t in texts], pa.int64()), pa.array(own, _RUNS), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "text"],
                )

    return find


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


def periodic_runs(documents: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), text: one row for each input row.

    Words are runs of anything but space and \\t to \\r, numbered from 0. text has the words joined
    by one space, without those that a run holds after its first period. Null, empty and blank
    texts have no words, no runs and an empty text; a null doc_id and repeated rows stay; other
    columns are ignored; an empty table gives an empty one. Nothing is shuffled: a task holds
    2 MB of texts at a time, or one longer text.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_find(least, times), _SCHEMA)
