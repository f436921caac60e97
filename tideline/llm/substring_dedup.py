"""Substring dedup: words covered by a window of words that occurs more than once.

Windows grow level by level, each about twice as long as the one before (9, 18, 35). Of
the shorter lengths only those places count that are least, by hash, among all places of
a full window that they fit in: equal windows have equal least places, so a full window
can only be repeated if its least place is. A place whose sequence occurs once ends its
windows; the others are extended. At the full length every candidate is counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tideline.llm.storage import dropped, materialize
from tideline.llm.text import WORDS, hashes, mix, pair, pieces, tokens, utf8

#: Words of a window.
WINDOW = 35
LEVELS = (9, 18, WINDOW)
#: Bits of the map of documents that still have candidates: 4 MB, whatever the input.
MAP_BITS = 1 << 25
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def extend(h: np.ndarray, length: int, to: int) -> np.ndarray:
    """Hashes of windows of `to` words (at most twice `length`) from those of `length` words."""
    return pair(h[: max(0, len(h) - (to - length))], h[to - length :])


def windows(h: np.ndarray, to: int) -> np.ndarray:
    """Hashes of windows of `to` words from those of single words, by doubling."""
    length = 1
    while length < to:
        step = min(2 * length, to)
        h, length = extend(h, length, step), step
    return h


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest of each `width` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = best(values[: len(values) - step], values[step:])
        have += step
    return values


def candidates(h: np.ndarray, level: int | None, repeated: np.ndarray) -> np.ndarray:
    """Which full windows have a least place of that level among the repeated ones (level None: all have)."""
    n = max(0, len(h) - WINDOW + 1)
    if level is None or not n:
        return np.ones(n, bool)
    at = windows(h, level)
    known = np.full(len(at), _MOST)
    repeated = repeated[repeated < len(at)]
    known[repeated] = at[repeated]
    width = WINDOW - level + 1
    return sliding(known, width, np.minimum) == sliding(at, width, np.minimum)


def places(h: np.ndarray, level: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least places of that level of the wanted full windows, and their hashes."""
    at, width = windows(h, level), WINDOW - level + 1
    if not wanted.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = np.where(wanted, sliding(at, width, np.minimum), np.uint64(0))
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    where = np.flatnonzero(sliding(around, width, np.maximum) == at)
    return where, at[where]


def _emit(level: int, before: int | None) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = batch.column("key").to_numpy()
            found = batch.column("places") if before else None
            for i, j in pieces(offsets):
                starts, ends, pointer = tokens(data, offsets[i : j + 1], WORDS)
                h, out = hashes(data, starts, ends), []
                for r in range(i, j):
                    own = h[pointer[r - i] : pointer[r - i + 1]]
                    if len(own) >= WINDOW:
                        repeated = found[r].values.to_numpy() if before else np.zeros(0, np.int64)
                        at, value = places(own, level, candidates(own, before, repeated))
                        out.append((np.full(len(at), keys[r]), at, value, pair(value, windows(mix(own), level)[at]) if level == WINDOW else value))
                key, at, value, second = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32) if level == WINDOW else np.zeros(len(at), np.int32)), pa.array(key.astype(np.int64)), pa.array(at.astype(np.int32))],
                    ["hash", "more", "key", "place"],
                )

    return emit


def repeated_places(found: DataFrame) -> DataFrame:
    """key, places (sorted) of what `_emit` found more than once."""
    found = materialize(found)
    many = materialize(found.groupBy("hash", "more").count().filter("count > 1").select("hash", "more"))
    out = materialize(found.join(many, ["hash", "more"], "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("places")))
    dropped(found, many)
    return out


def key_map(keys: DataFrame) -> Broadcast:
    """A bit for each remainder of a key in MAP_BITS: which keys may be there. It fills up, but doesn't grow."""
    bit = F.pmod(F.col("key"), F.lit(MAP_BITS)) + 1
    rows = keys.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for bucket, bits in rows:
        at = (bucket - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(bits), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def _may_be_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys % MAP_BITS
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def _only(shared: Broadcast) -> Callable:
    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_may_be_in(shared.value, batch.column("key").to_numpy())))

    return only


def _kept(words: list[bytes], covered: np.ndarray | None) -> tuple[int, int, str]:
    if covered is not None:
        words = [w for w, gone in zip(words, covered, strict=True) if not gone]
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def _covered(n: int, at: np.ndarray) -> np.ndarray:
    """Words under the windows at these places."""
    step = np.zeros(n + 1, np.int64)
    at = at[at <= n - WINDOW]
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return np.cumsum(step[:n]) > 0


def _words(data: np.ndarray, offsets: np.ndarray, i: int) -> list[bytes]:
    return data[offsets[i] : offsets[i + 1]].tobytes().split()


def _finish(shared: Broadcast) -> Callable:
    """Results of documents that have no repeated window for sure; the others keep their texts."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            later = _may_be_in(shared.value, batch.column("key").to_numpy())
            rows = [(None, None) if wait else _kept(_words(data, offsets, i), None) for i, wait in enumerate(later)]
            text = pa.compute.if_else(pa.array(later), batch.column("text"), pa.scalar(None, batch.column("text").type))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), text, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["key", "doc_id", "text", "n_words", "kept_sha256"])

    return finish


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        n_words, sha = batch.column("n_words").to_pylist(), batch.column("kept_sha256").to_pylist()
        removed, at = [0] * len(n_words), batch.column("places")
        for i, n in enumerate(n_words):
            if n is None:
                words = _words(data, offsets, i)
                places_ = at[i].values
                covered = _covered(len(words), places_.to_numpy()) if places_ is not None and len(places_) else None
                left, sha[i] = _kept(words, covered)
                n_words[i], removed[i] = len(words), len(words) - left
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_windows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with a key each, and key, places: where their repeated windows of WINDOW words start.

    The key is a 64-bit hash of doc_id and text, so that rows with equal or no doc_ids stay apart.
    """
    docs = documents.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "hash long, more int, key long, place int"
    found = repeated_places(docs.select("key", "text").mapInArrow(_emit(LEVELS[0], None), schema))
    for before, level in zip(LEVELS, LEVELS[1:], strict=False):
        texts = docs.select("key", "text").mapInArrow(_only(key_map(found)), "key long, text string")
        before_it, found = found, repeated_places(texts.join(found, "key").mapInArrow(_emit(level, before), schema))
        dropped(before_it)
    return docs, found


def substring_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each input row.

    A word goes if a window of WINDOW consecutive words that covers it starts anywhere
    else too, judged on the input. Null texts have no words. A row that occurs twice
    repeats all its windows. Texts under WINDOW words lose none; extra columns are ignored.
    """
    docs, found = repeated_windows(documents)
    texts = docs.mapInArrow(_finish(key_map(found)), "key long, doc_id long, text string, n_words long, kept_sha256 string")
    return texts.join(found, "key", "left").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")
