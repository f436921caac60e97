"""Benchmark decontamination by latent semantic retrieval.

Passages (runs of words) of all documents are TF-IDF vectors over the words of the
benchmark. A randomised decomposition finds their leading right singular vectors: one
distributed pass multiplies a random matrix by the Gram matrix of all passages, and the
small product is factored on the driver (Nystroem). Passages and windows of benchmark
items meet in the whitened latent space; pairs of high cosine are candidates. Short items
are sought by shorter passages, so that what stands around them doesn't hide them. Each
candidate is then held against the words themselves: by the longest common subsequence
with the whole item and with its answer, the last sentence.

What grows with the benchmark, not with the corpus, is held by the driver and broadcast:
its words, their latent vectors (RANK floats each) and blocks of item windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.storage import alone, materialize
from tideline.llm.text import LETTERS_AND_DIGITS, hashes, pieces, tokens, utf8

#: Words of a passage and of the window that is judged; windows start at every STRIDE-th word of a document.
PASSAGE, STRIDE = 16, 8
class Scale(NamedTuple):
    """How items of at least so many words are sought; passages start at every half of their length."""

    item: int
    length: int  # words of a passage
    cosine: float
    known: float  # a passage near an item has this share of as many words of the item as the item has, or as fit into it


#: Thresholds come from the measured recall of planted paraphrases.
SCALES = (Scale(12, 16, 0.5, 0.5), Scale(6, 8, 0.4, 0.3), Scale(1, 4, 0.4, 0.3))
#: Latent dimensions, and columns of the random matrix.
RANK, SKETCH = 64, 72
#: A window leaks if this share of an item's words, in order, is in it; half of its answer must be among them, too, unless nearly all are.
COMMON, NEARLY_ALL, ANSWER = 0.7, 0.9, 0.5
#: Item windows that are broadcast at once; a larger benchmark takes more passes over the documents, with the same latent space.
WINDOWS = 20_000
SEED = 11
#: Cells of a table that says which item has which word; a larger benchmark is searched in sorted lists.
CELLS = 1 << 25
#: Rows that are summed one by one.
LONGEST_SUM = 16


class Item(NamedTuple):
    item_id: int
    words: np.ndarray  # places in the vocabulary, from 1
    answer: int  # the answer's first word


class Benchmark(NamedTuple):
    vocabulary: np.ndarray  # sorted hashes
    items: list[Item]


def read_items(rows: list[tuple[int, str]]) -> Benchmark:
    """Items without words are left out."""
    data, offsets = utf8(pa.array([t.lower() for _, t in rows], pa.string()))
    starts, ends, pointer = tokens(data, offsets, LETTERS_AND_DIGITS)
    h = hashes(data, starts, ends)
    vocabulary = np.unique(h)
    place, items = np.searchsorted(vocabulary, h) + 1, []
    for i, (item_id, _) in enumerate(rows):
        a, b = pointer[i], pointer[i + 1]
        if a < b:
            # The answer starts after the last full stop that words follow.
            stops = [k for k in range(int(a) + 1, int(b)) if ord(".") in data[ends[k - 1] : starts[k]]]
            items.append(Item(item_id, place[a:b], stops[-1] - int(a) if stops else 0))
    return Benchmark(vocabulary, items)


def _places(vocabulary: np.ndarray) -> Callable:
    """Texts to the places of their words in the vocabulary (0: not there), 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (vocabulary >> np.uint64(44)).astype(np.int64)
        may = np.zeros(1 << 20, bool)
        may[low] = True
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in pieces(offsets):
                starts, ends, pointer = tokens(data, offsets[i : j + 1], LETTERS_AND_DIGITS)
                h = hashes(data, starts, ends)
                place = np.zeros(len(h), np.int32)
                some = np.flatnonzero(may[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(vocabulary, h[some]), len(vocabulary) - 1)
                place[some] = np.where(vocabulary[at] == h[some], at + 1, 0)
                words = [place[a:b].tobytes() for a, b in zip(pointer[:-1], pointer[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(words, pa.binary())], ["key", "doc_id", "words"])

    return run


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of some rows, and the first of each row's passages (disjoint ones), some rows at a time."""
    waiting, size = [], 0
    for words in column:
        w = np.frombuffer(words.as_py(), np.int32)
        waiting.append(w)
        size += len(w)
        if size > 1 << 17:
            yield _joined(waiting)
            waiting, size = [], 0
    if waiting:
        yield _joined(waiting)


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) for w in rows])
    firsts = [np.arange(e - len(w), e, PASSAGE) for w, e in zip(rows, ends, strict=True)]
    return np.concatenate(rows), np.concatenate(firsts).astype(np.int64)


def _passages(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The known words, from 0, and their passages."""
    at = np.flatnonzero(words)
    return words[at] - 1, np.searchsorted(first, at, "right") - 1


def summed(table: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of a table that each run of index names: np.add.reduceat(table[index], starts), by whole rows at a time."""
    n = np.diff(np.append(starts, len(index)))
    if n.max(initial=0) > LONGEST_SUM:
        # Parts of long runs first, so that few rows are left.
        parts = -(-n // LONGEST_SUM)
        first = np.cumsum(parts) - parts
        cuts = np.repeat(starts, parts) + (np.arange(int(parts.sum())) - np.repeat(first, parts)) * LONGEST_SUM
        return np.add.reduceat(summed(table, index, cuts), first, dtype=table.dtype)
    order = np.argsort(-n, kind="stable")
    first, n = starts[order], n[order]
    sums = table.take(index[first], axis=0)
    for k in range(1, int(n.max(initial=0))):
        m = int(np.searchsorted(-n, -k))  # runs that have more rows than k
        sums[:m] += table.take(index[first[:m] + k], axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _frequencies(size: int) -> Callable:
    """In how many passages each word occurs; the word -1 stands for any passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for words, first in _blocks(batch.column("words")):
                word, passage = _passages(words, first)
                df += np.bincount(np.unique(passage * size + word) % size, minlength=size)
                n += len(first)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], ["word", "n"])

    return run


def random_matrix(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, SKETCH)).astype(np.float32)


def _sketch(idf: np.ndarray) -> Callable:
    """The task's share of (A'A)R for the matrix A of its passages, of unit length, and the random matrix R."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = random_matrix(len(idf)) * idf[:, None]
        out, seen = np.zeros((len(idf), SKETCH)), np.zeros(len(idf), bool)
        for batch in batches:
            for words, first in _blocks(batch.column("words")):
                word, passage = _passages(words, first)
                if not len(word):
                    continue
                starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
                square = np.add.reduceat(idf[word] ** 2, starts)
                y = summed(weighted, word, starts) / np.maximum(square, 1e-9)[:, None]
                order = np.argsort(word.astype(np.min_scalar_type(len(idf))), kind="stable")  # short numbers sort faster
                row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(word))))
                starts = np.flatnonzero(np.append(True, np.diff(word[order]) != 0))
                here = word[order][starts]
                out[here] += summed(y, row[order], starts) * idf[here][:, None]
                seen[here] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(out[at, k]) for k in range(SKETCH))], ["word", *(f"y{k}" for k in range(SKETCH))])

    return run


def whitened(sketch: np.ndarray) -> np.ndarray:
    """Leading right singular vectors over the roots of their singular values, from (A'A)R.

    Whitened in full, what parts of one item differ in would weigh as much as what they share.
    """
    r = random_matrix(len(sketch)).astype(float)
    shift = 1e-9 * max(1e-30, np.linalg.norm(sketch))
    shifted = sketch + shift * r
    core = r.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-10
    root = shifted @ (vectors[:, good] / np.sqrt(values[good]))
    left, singular, _ = np.linalg.svd(root, full_matrices=False)
    singular = np.sqrt(np.maximum(singular[:RANK] ** 2 - shift, 0))
    keep = singular > singular.max(initial=0) * 1e-4
    return (left[:, :RANK][:, keep] / np.sqrt(singular[keep])).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)


class Query(NamedTuple):
    """The windows of some items that are sought by passages of one length."""

    scale: Scale
    least: int  # known words of a passage
    vectors: np.ndarray  # one column a window
    owner: np.ndarray  # item of each
    own: np.ndarray  # the items
    has: np.ndarray | None  # for each word and each of these items 1 if it has the word, in CELLS at most
    words: np.ndarray  # sorted: item times the vocabulary's size and each of its words
    needed: np.ndarray  # words of each item that a passage near it has


def queries_of(items: list[Item], latent: np.ndarray) -> list[Query]:
    out = []
    for scale in SCALES:
        length = scale.length
        own = [i for i, x in enumerate(items) if next(k for k in SCALES if k.item <= len(x.words)) is scale]
        vectors, owner = [], []
        for i in own:
            words = items[i].words
            last = max(0, len(words) - length)
            for a in sorted({*range(0, last + 1, max(1, length // 4)), last}):
                vectors.append(latent[words[a : a + length] - 1].sum(0))
                owner.append(i)
        if own:
            needed = np.array([np.ceil(scale.known * min(len(x.words), length)) for x in items], np.int64)
            words = np.unique(np.concatenate([i * (len(latent) + 1) + items[i].words for i in own]))
            has = np.zeros((len(latent), len(own)), np.uint8) if len(latent) * len(own) <= CELLS else None
            if has is not None:
                for column, i in enumerate(own):
                    has[items[i].words - 1, column] = 1
            out.append(Query(scale, int(needed[own].min()), _unit(np.array(vectors, np.float32)).T, np.array(owner), np.array(own), has, words, needed))
    return out


def common(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit for each word of item."""
    bits: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        bits[w] = bits.get(w, 0) | 1 << i
    row, full = 0, (1 << len(item)) - 1
    for w in text.tolist():
        x = row | bits.get(w, 0)
        row = x & ~(x - (row << 1 | 1)) & full
    return row.bit_count()


def enough(item: Item, near: np.ndarray, seen: np.ndarray) -> bool:
    """Whether the share COMMON of an item's words is in a run of words, in any order.

    seen has a False for each place in the vocabulary, before and after the call.
    """
    seen[near] = True
    there = np.count_nonzero(seen[item.words])
    seen[near] = False
    return there / len(item.words) >= COMMON


def judge(item: Item, words: np.ndarray, start: int, seen: np.ndarray) -> tuple[float, float]:
    """Shares of the item and of its answer that the document has, in order, around a passage."""
    n = len(item.words)
    near = words[max(0, start - n) : start + PASSAGE + n]
    if not enough(item, near, seen):
        return 0.0, 0.0
    answer = item.words[item.answer :]
    near = near[near > 0]
    return common(item.words, near) / n, common(answer, near) / len(answer)


def leaks(share: float, answer: float) -> bool:
    return share >= NEARLY_ALL or share >= COMMON and answer >= ANSWER


def _search(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, latent, queries = shared.value
        seen = np.zeros(len(latent) + 1, bool)
        for batch in batches:
            keys, doc_ids, out, done = batch.column("key").to_numpy(), batch.column("doc_id"), [], 0
            for rows in _together(batch.column("words")):
                near = set()
                for q in queries:
                    for r, start, k in candidates(rows, latent, q):
                        n, end = len(items[k].words), start + q.scale.length
                        # All windows that meet the passage lie in here; most passages fail by what is there.
                        if enough(items[k], rows[r][max(0, start - PASSAGE - n) : end + PASSAGE + n], seen):
                            near.update((r, s, k) for s in around(start, q.scale.length, len(rows[r])))
                leaking = [x for x in near if leaks(*judge(items[x[2]], rows[x[0]], x[1], seen))]
                # The window with most of an item may be further from the passage.
                for r, s, k in sorted({(r, t, k) for r, s, k in leaking for t in around(s - len(items[k].words), PASSAGE + 2 * len(items[k].words), len(rows[r]))}):
                    share, answer = judge(items[k], rows[r], s, seen)
                    if leaks(share, answer):
                        out.append((done + r, items[k].item_id, share, answer))
                done += len(rows)
            r = [x[0] for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(keys[r]), doc_ids.take(pa.array(r, pa.int64())), *(pa.array([x[k] for x in out], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64())))], ["key", "doc_id", "item_id", "lcs", "answer"])

    return run


def _together(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The words of some rows at a time."""
    waiting, size = [], 0
    for words in column:
        w = np.frombuffer(words.as_py(), np.int32)
        waiting.append(w)
        size += len(w)
        if size > 1 << 16:
            yield waiting
            waiting, size = [], 0
    if waiting:
        yield waiting


def around(start: int, length: int, n: int) -> range:
    """Starts of the windows of a row of n words whose passages meet a run of words."""
    return range(max(0, (start - PASSAGE) // STRIDE + 1) * STRIDE, min(n, start + length), STRIDE)


def _of_strides(table: np.ndarray, strides: np.ndarray) -> np.ndarray:
    """Sums of the rows of a table for the known words of each stride."""
    words = strides.ravel()
    at = np.flatnonzero(words)
    owners = at // strides.shape[1]
    starts = np.flatnonzero(np.append(True, np.diff(owners) != 0)) if len(at) else at
    out = np.zeros((len(strides), table.shape[1]), table.dtype)
    out[owners[starts]] = summed(table, words[at] - 1, starts)
    return out


def candidates(rows: list[np.ndarray], latent: np.ndarray, query: Query) -> Iterator[tuple[int, int, int]]:
    """(row, first word of the passage, item) of high cosine; of overlapping passages each is given."""
    # Rows are cut into strides; a passage is two strides of a row, so each row ends with an empty one.
    stride = query.scale.length // 2
    n = np.array([-(-len(w) // stride) for w in rows])
    first = np.concatenate([[0], np.cumsum(n + 1)])
    padded = np.zeros(int(first[-1]) * stride, np.int32)
    for a, w in zip(first, rows, strict=False):
        padded[a * stride : a * stride + len(w)] = w
    strides = padded.reshape(-1, stride)
    known = np.count_nonzero(strides, axis=1)
    full = np.flatnonzero(known[:-1] + known[1:] >= query.least)
    shares = None
    if query.has is not None:
        # Most passages share too few words with any item to be looked at.
        counts = _of_strides(query.has, strides)
        shares = counts[full] + counts[full + 1] >= query.needed[query.own]
        some = np.flatnonzero(shares.any(axis=1))
        full, shares = full[some], shares[some]
    for i in range(0, len(full), 4096):
        p = full[i : i + 4096]
        met = np.zeros(p[-1] - p[0] + 2, bool)
        met[p - p[0]] = met[p - p[0] + 1] = True
        place = np.cumsum(met) - 1
        sums = _of_strides(latent, strides[p[0] : p[-1] + 2][met])
        z = _unit(sums[place[p - p[0]]] + sums[place[p - p[0] + 1]])
        x, y = np.divmod(np.flatnonzero(z @ query.vectors >= query.scale.cosine), len(query.owner))
        if shares is not None:
            both = np.flatnonzero(shares[i + x, np.searchsorted(query.own, query.owner)[y]])
            x, y = x[both], y[both]
        s, k = np.divmod(np.unique(p[x] * len(query.needed) + query.owner[y]), len(query.needed))
        if shares is None:
            there = np.concatenate([strides[s], strides[s + 1]], axis=1) + k[:, None] * (len(latent) + 1)
            shared = np.count_nonzero(query.words[np.minimum(np.searchsorted(query.words, there), len(query.words) - 1)] == there, axis=1)
            s, k = s[shared >= query.needed[k]], k[shared >= query.needed[k]]
        r = np.searchsorted(first, s, "right") - 1
        yield from zip(r.tolist(), (np.maximum(0, s - first[r]) * stride).tolist(), k.tolist(), strict=True)


def _items_in_blocks(items: list[Item]) -> Iterator[list[Item]]:
    waiting, size = [], 0
    for item in items:
        waiting.append(item)
        size += -(-len(item.words) // 4)
        if size >= WINDOWS:
            yield waiting
            waiting, size = [], 0
    if waiting:
        yield waiting


def _leaked(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, doc_id, item_id, lcs, answer of each window that leaks; key is a hash of doc_id and text."""
    spark = documents.sparkSession
    docs = documents.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    schema = "key long, doc_id long, item_id long, lcs double, answer double"
    asked = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    known = read_items(sorted(tuple(r) for r in asked.collect()))
    found, size = spark.createDataFrame([], schema), len(known.vocabulary)
    if not known.items:
        return found
    words = materialize(docs.mapInArrow(_places(known.vocabulary), "key long, doc_id long, words binary"))
    counts = dict(words.select("words").mapInArrow(_frequencies(size), "word int, n long").groupBy("word").agg(F.sum("n")).collect())
    total = counts.pop(-1, 0)
    df = np.zeros(size)
    df[list(counts)] = list(counts.values())
    idf = np.log((1 + total) / (1 + df)).astype(np.float32)
    names = [f"y{k}" for k in range(SKETCH)]
    sums = words.select("words").mapInArrow(_sketch(idf), "word int, " + ", ".join(f"{n} double" for n in names)).groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    sketch = np.zeros((size, SKETCH))
    sketch[sums["word"].to_numpy(int)] = sums[names].to_numpy()
    if sketch.any():
        latent = np.ascontiguousarray(whitened(sketch) * idf[:, None])  # rows are gathered
        for items in _items_in_blocks(known.items):
            found = found.union(words.mapInArrow(_search(spark.sparkContext.broadcast((items, latent, queries_of(items, latent)))), schema))
    return found


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs, answer: one row for each document and item that leaks into it.

    lcs and answer are the largest shares of the item's and its answer's words that stand,
    in order, near one passage; they are exact, but windows in which no passage comes near
    an item in the latent space are not looked at. Words are runs of letters and digits, in lower case. Null
    and empty texts have no passages; items that are null or without words are not looked
    for; without items the result is empty. Rows that repeat a doc_id count together.
    """
    return _leaked(documents, benchmark).groupBy("doc_id", "item_id").agg(F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaks, with their own columns."""
    bad = alone(lambda: _leaked(documents, benchmark).select(F.col("key").alias("__tideline_key")).distinct())
    return documents.withColumn("__tideline_key", F.xxhash64("doc_id", "text")).join(bad, "__tideline_key", "left_anti").select(*documents.columns)
