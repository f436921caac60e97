"""N-gram Jaccard join of documents, with Bayesian pruning of candidate pairs.

Documents with the same set of word shingles form a class, and only classes are joined.
Classes that agree in a band of MinHash values are candidates. Their values are compared
step by step; a pair goes as soon as the posterior probability that its similarity
reaches the threshold is under a tolerance. What is left is verified on the shingles.

A band shared by many classes is cut into blocks, and each pair of blocks is one bounded
unit of work; pairs stay inside their unit, which gives out sums and a spanning star
only, so that a group of near copies makes no rows for its pairs. A pair is looked at in
the first band that it shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.components import connected_components
from tideline.llm.storage import dropped, materialize
from tideline.llm.substring_dedup import _only, key_map
from tideline.llm.text import WORDS, hashes, mix, pair, pieces, tokens, utf8

SHINGLE = 5
THRESHOLD = 0.8
#: 20 bands of 3 values: a pair at the threshold is missed with probability 6e-7.
BANDS, ROWS = 20, 3
VALUES = 64
STEPS = (16, 32, 48, VALUES)
TOLERANCE = 1e-6
#: Classes of a block; a unit of work has two blocks at most.
BLOCK = 512
_FACTORS = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each step the fewest matches with which P(similarity >= threshold), from a uniform prior, reaches tolerance."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in STEPS:
        for m in range(n + 1):
            density = np.exp(m * np.log(x / threshold) + (n - m) * np.log((1 - x) / (1 - threshold)))
            if density[x >= threshold].sum() >= tolerance * density.sum():
                out.append(m)
                break
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of each row the sorted distinct hashes of its shingles; a text of fewer words than a shingle is one itself."""
    starts, ends, pointer = tokens(data, offsets, WORDS)
    h = hashes(data, starts, ends)
    two = pair(h[:-1], h[1:])
    grams = pair(pair(two[:-2], two[2:])[:-1], h[4:]) if len(h) > 4 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(pointer[:-1], pointer[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(np.array([np.bitwise_xor.reduce(mix(h[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)))])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(shingles: np.ndarray) -> int | None:
    if not len(shingles):
        return None
    return int((mix(shingles).sum() ^ mix(np.array([len(shingles)], np.uint64))[0]).view(np.int64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES MinHash values of each set (all ones for an empty one)."""
    out = np.full((len(sets), VALUES), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat(((values * _FACTORS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i, j in pieces(offsets):
            sets = shingle_sets(data, offsets[i : j + 1])
            values = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array([class_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())],
                ["key", "doc_id", "class", "n_shingles", "values"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.uint32).reshape(-1, VALUES).astype(np.uint64)
        classes = batch.column("class").to_numpy()
        for b in range(BANDS):
            h = np.full(len(values), b + 1, np.uint64)
            for k in range(b * ROWS, b * ROWS + ROWS):
                h = pair(h, values[:, k])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), b, np.int32)), pa.array(classes)], ["band", "at", "class"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i, j in pieces(offsets):
            sets = [s for s in shingle_sets(data, offsets[i : j + 1]) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])


def _units(work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Callable:
    """Calls work with whole units (rows that agree in band, low, high; rows come sorted), some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            starts = _starts(table)
            last = int(starts[-1])
            rest = table.slice(last)
            if last:
                yield work(table.slice(0, last).combine_chunks(), starts)
        if rest is not None and len(rest):
            yield work(rest.combine_chunks(), np.array([0, len(rest)]))

    return run


def _starts(table: pa.Table) -> np.ndarray:
    """First rows of units; the last of them may be incomplete."""
    names = np.stack([table.column(c).to_numpy() for c in ("band", "low", "high")])
    return np.concatenate([[0], np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1])


def _pairs(table: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a unit: between its blocks, or inside its only one."""
    block = table.column("block").to_numpy()[a:b]
    low, high = table.column("low")[a].as_py(), table.column("high")[a].as_py()
    if low == high:
        left, right = np.triu_indices(b - a, 1)
        return left + a, right + a
    x, y = np.flatnonzero(block == low) + a, np.flatnonzero(block == high) + a
    return np.repeat(x, len(y)), np.tile(y, len(x))


def surviving(values: np.ndarray, left: np.ndarray, right: np.ndarray, band: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs share this band first and pass every step of the comparison."""
    out = np.zeros(len(left), bool)
    for i in range(0, len(left), 1 << 16):
        x, y = left[i : i + (1 << 16)], right[i : i + (1 << 16)]
        alive, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        for n, m in zip(STEPS, least, strict=True):
            matches[alive] += (values[x[alive], done:n] == values[y[alive], done:n]).sum(1)
            alive, done = alive[matches[alive] >= m], n
        same = values[x[alive], : BANDS * ROWS] == values[y[alive], : BANDS * ROWS]
        first = same.reshape(len(alive), BANDS, ROWS).all(2).argmax(1)
        out[i + alive[first == band[x[alive]]]] = True
    return out


def _prune(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint32).reshape(-1, VALUES)
    band, classes = table.column("at").to_numpy(), table.column("class").to_numpy()
    starts = np.append(starts[starts < len(table)], len(table))
    least, left, right = least_matches(), [], []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if waiting:
            x, y = (np.concatenate(z) for z in zip(*waiting, strict=True))
            keep = surviving(values, x, y, band, least)
            left.append(x[keep])
            right.append(y[keep])
            waiting.clear()

    size = 0
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        waiting.append(_pairs(table, int(a), int(b)))
        size += len(waiting[-1][0])
        if size > 1 << 18:
            flush()
            size = 0
    flush()
    x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    used = np.union1d(x, y)
    bounds = np.append(np.searchsorted(x, used), len(x)).astype(np.int32)
    partners = pa.ListArray.from_arrays(pa.array(bounds), pa.array(classes[y]))
    kept = table.select(["band", "low", "high", "class"]).take(pa.array(used))
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in kept.columns), partners], ["band", "low", "high", "class", "partners"])


def _verify(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    classes, sizes = table.column("class").to_numpy(), table.column("size").to_numpy()
    partners, shingles = table.column("partners").combine_chunks(), table.column("shingles").combine_chunks()
    starts = np.append(starts[starts < len(table)], len(table))
    links, root = np.zeros(len(table), np.int64), classes.copy()
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        row = {int(c): i for i, c in enumerate(classes[a:b])}
        sets = [np.frombuffer(shingles[i].as_py(), np.uint64) for i in range(int(a), int(b))]
        n = np.array([len(s) for s in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(n)])
        mark, parent = np.zeros(len(codes) and int(codes.max()) + 1, bool), list(range(b - a))

        def top(i: int, parent: list[int] = parent) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(b - a):
            others = [row[c] for c in partners[int(a) + i].as_py()]
            if not others:
                continue
            own = codes[first[i] : first[i + 1]]
            mark[own] = True
            shared = np.array([np.count_nonzero(mark[codes[first[j] : first[j + 1]]]) for j in others])
            mark[own] = False
            near = shared >= THRESHOLD * (n[i] + n[others] - shared) - 1e-9
            for j in np.array(others)[near]:
                links[a + i] += sizes[a + j]
                links[a + j] += sizes[a + i]
                x, y = top(i), top(int(j))
                if x != y:
                    low, high = (x, y) if classes[a + x] < classes[a + y] else (y, x)
                    parent[high] = low
        for i in range(b - a):
            root[a + i] = classes[a + top(i)]
    return pa.RecordBatch.from_arrays([pa.array(classes), pa.array(links), pa.array(root)], ["class", "links", "root"])


def _by_unit(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "class")


def near_copies(documents: DataFrame) -> DataFrame:
    """key, doc_id, class_id, group_id, n_links, n_shingles: one row for each input row.

    class_id is the least doc_id with the same set of shingles, n_links the number of
    other documents at THRESHOLD or above (those of the class included), group_id the
    least doc_id that is reached over links. Texts without words (null, empty) have no
    shingles and no links: they are a class and a group of their own. key is a hash of
    doc_id and text. Null doc_ids are as others, but smallest ids ignore them.
    """
    docs = documents.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = materialize(docs.mapInArrow(_read, "key long, doc_id long, class long, n_shingles long, values binary"))
    classes = materialize(members.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size"), F.first("values").alias("values")))
    bands = classes.select("class", "values").mapInArrow(_bands, "band long, at int, class long")
    many = materialize(bands.groupBy("band").count().filter("count > 1"))
    shared = bands.join(many, "band").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    units = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "at", "class", "block").join(classes.select("class", "values"), "class")
    pruned = materialize(_by_unit(units).mapInArrow(_units(_prune), "band long, low int, high int, class long, partners array<long>"))
    wanted = key_map(pruned.select(F.col("class").alias("key")))
    texts = docs.mapInArrow(_shingles, "key long, shingles binary").mapInArrow(_only(wanted), "key long, shingles binary")
    texts = texts.groupBy(F.col("key").alias("class")).agg(F.first("shingles").alias("shingles"))
    verified = materialize(_by_unit(pruned.join(classes.select("class", "size"), "class").join(texts, "class")).mapInArrow(_units(_verify), "class long, links long, root long"))
    links = verified.groupBy("class").agg(F.sum("links").alias("links"))
    component = connected_components(verified.select(F.col("class").alias("u"), F.col("root").alias("v")))
    groups = component.select(F.col("node").alias("class"), "component")
    known = classes.select("class", "class_id", "size").join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = known.groupBy("component").agg(F.min("class_id").alias("group_id"))
    out = materialize(known.join(least, "component").join(links, "class", "left").select("class", "class_id", "group_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    dropped(classes, many, pruned, verified, component)
    return members.select("key", "doc_id", "class", "n_shingles").join(out, "class", "left").select(
        "key",
        "doc_id",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "n_shingles",
    )


def jaccard_join(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, group_id, n_links, n_shingles of every document (see near_copies)."""
    return near_copies(documents).drop("key")


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The documents without those that another of their group stands for: its row of least doc_id stays.

    Rows without words or without a doc_id all stay. Of rows equal in doc_id and text one stays.
    """
    stays = near_copies(documents).filter("n_shingles = 0 OR doc_id IS NULL OR doc_id = group_id").select(F.col("key").alias("__tideline_key")).distinct()
    keyed = documents.withColumn("__tideline_key", F.xxhash64("doc_id", "text"))
    return keyed.join(stays, "__tideline_key").dropDuplicates(["__tideline_key"]).select(*documents.columns)
