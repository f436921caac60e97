"""Groups of spelling variants: words one letter apart, and the form that each is a variant of.

No pair of words is written out. For replacements a word enters one group for each position:
all words with the same letters before and after it. A group keeps its size and its two most
frequent words, of which each member takes the one that it isn't itself. For letters left out
or put in, the words without one of their letters meet the vocabulary's words in groups of
the same kind: of such a group the whole word (there is one at most) takes the size and the
top of the others, and each of the others the whole word.

Groups are keyed by 128 bits: sums of scrambled (position, letter), so that the keys of all
groups of a word cost its length only, and differ for different groups but for a chance of
some 1e-38 a pair. A group has no more members than the alphabet has letters, times the
places where one can be put in, so none is hot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.llm.storage import dropped, materialize
from tideline.llm.text import mix

#: Letters of a word, after A-Z have become a-z.
LETTERS = "a-zÀ-ÿ"
#: Letters and occurrences of a word that counts, and how many times as frequent its form is.
LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
#: Distinct words, and letters of them, that a task counts before it hands the counts on.
COUNTED = 200_000
COUNTED_LETTERS = 1 << 23
#: Letters of words whose group keys are made together.
TOGETHER = 1 << 18
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: The group of words without one of their letters; others have the position.
_WITHOUT = -1

Change = Callable[[object, str], str]


def _count(change: Change | None) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]+").findall
        seen: Counter[str] = Counter()
        size = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                # Lower-casing bytes leaves all but A-Z as they are.
                for word, n in Counter(runs((text.as_py() or "").encode().lower().decode())).items():
                    word = change(doc_id, word) if change else word
                    size += 0 if word in seen else len(word)
                    seen[word] += n
                if len(seen) > COUNTED or size > COUNTED_LETTERS:
                    yield rows()
                    seen, size = Counter(), 0
        yield rows()

    return count


def word_counts(documents: DataFrame, change: Change | None = None, least_letters: int = 1) -> DataFrame:
    """word, n: runs of letters of all texts, lower-cased in A-Z, of least_letters or more, and how often they occur.

    change(doc_id, word) may put another word in place of one. Null texts have no words; other
    columns are ignored.
    """
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_count(change), "word string, n long").filter(F.length("word") >= least_letters)
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def group_keys(words: list[str], least_letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of words: number of the word, position (_WITHOUT: one letter less), two halves of the key, whether the word is whole there."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in words], np.int64)
    last = np.cumsum(length) - 1
    number = np.repeat(np.arange(len(words)), length)
    position = np.arange(len(letters)) - np.repeat(last + 1 - length, length)
    next_differs = np.append(letters[1:] != letters[:-1], True)
    next_differs[last] = True
    # Of equal letters in a row any one may go: the last of them stands for all.
    without = next_differs & (np.repeat(length, length) > least_letters)
    keys = []
    for seed in _SEEDS:
        here, moved = (mix(mix(letters * seed + np.uint64(1)) + p.astype(np.uint64) * seed) for p in (position, position - 1))
        through, moved_through = np.cumsum(here), np.cumsum(moved)
        total = through[last] - np.concatenate([np.zeros(1, np.uint64), through[last[:-1]]])
        start = np.repeat(np.concatenate([np.zeros(1, np.uint64), through[last[:-1]]]), length)
        left = (through - here - start) + (np.repeat(moved_through[last], length) - moved_through)
        keys.append(np.concatenate([total[number] - here, left[without], total]))
    return (
        np.concatenate([number, number[without], np.arange(len(words))]),
        np.concatenate([position, np.full(int(without.sum()) + len(words), _WITHOUT)]),
        keys[0],
        keys[1],
        np.concatenate([np.zeros(len(number) + int(without.sum()), bool), np.ones(len(words), bool)]),
    )


def _keys(least_letters: int) -> Callable:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids, n = batch.column("word").to_pylist(), batch.column("id").to_numpy(), batch.column("n").to_numpy()
            size = np.cumsum([len(w) for w in words])
            i = 0
            while i < len(words):
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + TOGETHER, "right")))
                number, position, a, b, whole = group_keys(words[i:j], least_letters)
                number = number + i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(position.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids[number]), pa.array(n[number]), pa.array(whole)],
                    ["position", "a", "b", "id", "n", "whole"],
                )
                i = j

    return keys


def near_words(words: DataFrame, least_letters: int) -> DataFrame:
    """id, n_near and best (n, least: minus the id) of those of words (id in order of word, word, n) that have near words."""
    group = Window.partitionBy("position", "a", "b")
    ordered = group.orderBy(F.desc("whole"), F.desc("n"), "id")
    all_of_it = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top: Column = F.struct("n", (-F.col("id")).alias("least"), "whole")
    groups = words.mapInArrow(_keys(least_letters), "position int, a long, b long, id long, n long, whole boolean")
    groups = groups.select("id", "position", F.row_number().over(ordered).alias("place"), F.count(F.lit(1)).over(all_of_it).alias("size"), F.first(top).over(all_of_it).alias("first"), F.nth_value(top, 2).over(all_of_it).alias("second"))
    groups = groups.filter((F.col("size") > 1) & ((F.col("position") != _WITHOUT) | F.col("first.whole")))
    others = F.when((F.col("position") == _WITHOUT) & (F.col("place") > 1), 1).otherwise(F.col("size") - 1)
    best = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("first"))
    members = groups.select("id", others.cast("long").alias("others"), F.struct(best["n"].alias("n"), best["least"].alias("least")).alias("best"))
    return members.groupBy("id").agg(F.sum("others").alias("n_near"), F.max("best").alias("best"))


def followed(links: DataFrame) -> DataFrame:
    """id, to: the last of the links (id, to; one an id, no circles) from each id on. Each round doubles the way, so rounds grow with the logarithm of the longest."""
    links = materialize(links.select("id", "to"))
    while True:
        ahead = links.select(F.col("id").alias("to"), F.col("to").alias("ahead"))
        step = materialize(links.join(ahead, "to", "left").select("id", F.coalesce("ahead", "to").alias("to"), F.isnotnull("ahead").alias("moved")))
        dropped(links)
        links = step
        if links.filter("moved").isEmpty():
            return links


def variant_groups(counts: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of counts (word, n) with enough letters and occurrences.

    Near words differ by one letter put in, left out or replaced. form is the near word of
    largest n (ties: the least word in code-point order), if that is ratio times the word's n or
    more (ratio over 1), and form_n its n; else both are null. root is the end of the way
    from form to form, or the word itself. Null words are ignored, equal ones are added up; an
    empty table gives an empty one.
    """
    counts = counts.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.filter((F.length("word") >= least_letters) & (F.col("n") >= least_count))
    # Numbers in the order of words: they grow from each sorted partition to the next.
    words = materialize(counts.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = materialize(words.join(near_words(words, least_letters), "id").select("id", "n", "n_near", F.col("best.n").alias("form_n"), (-F.col("best.least")).alias("to")))
    forms = near.filter(F.col("form_n") >= ratio * F.col("n"))
    ends = followed(forms)
    named = forms.select("id", "to", "form_n").join(words.select(F.col("id").alias("to"), F.col("word").alias("form")), "to")
    roots = ends.select("id", "to").join(words.select(F.col("id").alias("to"), F.col("word").alias("root")), "to")
    named = named.drop("to").join(roots.drop("to"), "id")
    out = words.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
