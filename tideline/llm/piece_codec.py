"""SentencePiece encoding and decoding with exact N-best segmentations.

The pieces of a text form a lattice. Forward Viterbi scores are the exact cost of the
way still to go for an A-star search from the end backwards, so that segmentations come
out in order of score. No piece goes over a word's start (or over a character that only
stands alone), so the lattice falls apart at those places: each distinct part is searched
once by a worker, and the N best of a text combine the best few alternatives of parts.

As the heuristic is exact, the first segmentation that the search takes off its agenda is
the way back over the Viterbi scores; for many parts at once that way is followed in
arrays, and the agenda is opened for the parts whose other segmentations can matter.
Of a BPE model the scores are ranks of merges, so its best segmentations need not be what
merging gives.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tideline.llm.text import mix, pieces, utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 3
#: Bytes of texts whose parts are looked up together, code points of new parts that are searched together, and of the longest of those.
TOGETHER, SEARCHED, LONG = 1 << 20, 1 << 16, 64
#: Rows of an output batch.
ROWS = 256
#: Parts whose segmentations a worker remembers.
REMEMBERED = 60_000
#: A character without a piece scores this less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Pieces that score no more than this are for other uses and don't set that.
NEVER = -1e8

Segmentation = tuple[float, tuple[int, ...]]


class Pieces(NamedTuple):
    """A vocabulary with spaces for the marks of word starts."""

    scores: list[float]
    surface: list[bytes]  # of each id; empty for control pieces
    known: dict[str, int]  # prefix of a piece to its id, or -1 where it is none itself
    bytes_: list[int]  # ids of the 256 single bytes; empty: no fallback
    unknown: int
    penalty: float  # score of a character without a piece
    parts: str  # pattern of the parts into which texts fall


def load(path: str = VOCABULARY) -> Pieces:
    """Reads a model file on the driver; the result is what is broadcast (the vocabulary's size, whatever the input)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known: dict[str, int] = {}
    scores, surface, single = [], [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).replace("▁", " ")
        scores.append(model.get_score(i))
        surface.append(b"")
        if model.is_byte(i):
            single[int(piece[3:5], 16)] = i
            surface[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            surface[i] = piece.encode()
            known[piece] = i
    for piece in list(known):
        for n in range(1, len(piece)):
            known.setdefault(piece[:n], -1)
    own = [p for p, i in known.items() if i >= 0]
    parts = r"\n|[^\n]+" if not any("\n" in p and len(p) > 1 for p in own) else r"(?s:.+)"
    if not any(" " in p.lstrip(" ") for p in own):
        parts = parts.replace(r"[^\n]+", r" *[^ \n]+| +").replace(r"(?s:.+)", r" *[^ ]+| +")
    return Pieces(scores, surface, known, [single[b] for b in range(256)] if len(single) == 256 else [], model.unk_id(), min(scores[i] for i in known.values() if i >= 0 and scores[i] > NEVER) - UNKNOWN_PENALTY, parts)


def lattice(pieces: Pieces, part: str) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
    """Forward Viterbi scores of the places of a part, and for each place the pieces that end there."""
    known, scores, n = pieces.known.get, pieces.scores, len(part)
    best = [0.0] + [-1e300] * n
    edges: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        here, alone = best[i], True
        for j in range(i + 1, n + 1):
            p = known(part[i:j])
            if p is None:
                break
            if p >= 0:
                if j == i + 1:
                    alone = False
                score = scores[p]
                edges[j].append((i, score, (p,)))
                if here + score > best[j]:
                    best[j] = here + score
        if alone:
            ids = tuple(pieces.bytes_[b] for b in part[i].encode()) if pieces.bytes_ else (pieces.unknown,)
            edges[i + 1].append((i, pieces.penalty, ids))
            if here + pieces.penalty > best[i + 1]:
                best[i + 1] = here + pieces.penalty
    return best, edges


def segmentations(pieces: Pieces, part: str, count: int) -> list[Segmentation]:
    """The `count` best segmentations of a part by score, best first; fewer if there are fewer.

    Equal scores come in the order in which the search meets them, which is the same every time.
    """
    best, edges = lattice(pieces, part)
    out: list[Segmentation] = []
    order = itertools.count(1)
    agenda: list[tuple[float, int, int, float, tuple]] = [(-best[-1], 0, len(part), 0.0, ())]
    while agenda and len(out) < count:
        _, _, i, done, tail = heapq.heappop(agenda)
        if i == 0:
            ids: list[int] = []
            while tail:
                ids.extend(tail[0])
                tail = tail[1]
            out.append((done, tuple(ids)))
        for k, score, ids_ in edges[i]:
            heapq.heappush(agenda, (-(best[k] + score + done), next(order), k, done + score, (ids_, tail)))
    return out


def best_and_gap(pieces: Pieces, part: str) -> tuple[float, float, bytes]:
    """Score of the best segmentation, what the next best scores less (infinite: there is none), and the best ids.

    Any other segmentation has a piece off the best path, so the best one through such a piece is the next best.
    """
    best, edges = lattice(pieces, part)
    n = len(part)
    on_path, ids, i = {}, [], n
    while i:
        for e in edges[i]:
            if best[e[0]] + e[1] == best[i]:
                break
        on_path[i] = e
        ids.append(e[2])
        i = e[0]
    after = [-1e300] * n + [0.0]
    other = -1e300
    for j in range(n, 0, -1):
        rest = after[j]
        if rest > -1e299:
            path = on_path.get(j)
            for e in edges[j]:
                i, score, _ = e
                score += rest
                if score > after[i]:
                    after[i] = score
                if e is not path and best[i] + score > other:
                    other = best[i] + score
    flat = [x for piece in reversed(ids) for x in piece]
    return best[n], max(0.0, best[n] - other) if other > -1e299 else np.inf, np.array(flat, np.int32).tobytes()


class PieceTable:
    """Looks up many strings of code points among the pieces and their prefixes at once, by 64-bit hashes."""

    def __init__(self, pieces: Pieces) -> None:
        self.longest = max(len(p) for p, i in pieces.known.items() if i >= 0)
        n = np.fromiter(map(len, pieces.known), np.int64)
        chars = np.frombuffer("".join(pieces.known).encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = np.zeros(len(n), np.uint64)
        for k in range(int(n.max(initial=0))):
            on = np.flatnonzero(n > k)
            h[on] = self.step(h[on], chars[(np.cumsum(n) - n)[on] + k])
        order = np.argsort(h)
        # Strings with the same upper bits follow one another; the numbers at the end keep the last ones in range.
        buckets = (h[order] >> np.uint64(44)).astype(np.int64)
        counts = np.bincount(buckets, minlength=1 << 20)
        self.most = int(counts.max(initial=0))
        self.first, self.filled = (np.cumsum(counts) - counts).astype(np.int32), counts > 0
        self.hashes = np.append(h[order], np.zeros(self.most, np.uint64))
        self.ids = np.append(np.fromiter(pieces.known.values(), np.int32)[order], np.full(self.most, -2, np.int32))
        self.scores = np.array(pieces.scores)

    @staticmethod
    def step(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return mix(h + chars + np.uint64(1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids; -1 of strings that only begin pieces, and -2 of all others."""
        out = np.full(len(h), -2, np.int32)
        bucket = (h >> np.uint64(44)).astype(np.int64)
        some = np.flatnonzero(self.filled[bucket])
        h, at = h[some], self.first[bucket[some]]
        for k in range(self.most):
            same = self.hashes[at + k] == h
            out[some[same]] = self.ids[(at + k)[same]]
        return out


class Found(NamedTuple):
    """best_and_gap of many parts, in their order."""

    score: np.ndarray
    gap: np.ndarray
    size: np.ndarray  # how many ids
    ids: np.ndarray  # of all parts, one after another


def many_best_and_gap(pieces: Pieces, table: PieceTable, parts: list[str]) -> Found:
    """best_and_gap of parts, by the same rules, for many of them at once.

    Place j of a part has the cell of its first place plus j; the pieces are met in the order of
    the place where they end, then of that where they start, in all parts at once.
    """
    m = len(parts)
    n = np.fromiter(map(len, parts), np.int64, m)
    first = np.cumsum(n + 1) - (n + 1)
    last = first + n
    chars = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le"), np.uint32).astype(np.uint64)
    part = np.repeat(np.arange(m), n + 1)
    place = np.arange(len(chars)) - first[part]
    left = n[part] - place
    start, size, piece = [], [], []
    at = np.flatnonzero(left)
    h, alone = np.zeros(len(at), np.uint64), np.zeros(m, bool)
    for k in range(1, table.longest + 1):
        h = table.step(h, chars[at + (k - 1)])
        ids = table.find(h)
        if k == 1:
            alone[part[at[ids < 0]]] = True
            ids[alone[part[at]]] = -2
        here = np.flatnonzero(ids >= 0)
        start.append(at[here])
        size.append(np.full(len(here), k))
        piece.append(ids[here])
        on = np.flatnonzero((ids > -2) & (left[at] > k))
        at, h = at[on], h[on]
    start, size, piece = np.concatenate(start), np.concatenate(size), np.concatenate(piece)
    key = (place[start] + size) * (int(n.max(initial=0)) + 1) + place[start]
    order = np.argsort(key.astype(np.min_scalar_type(int(key.max(initial=0)))), kind="stable")  # short numbers sort faster
    key, start, piece = key[order], start[order], piece[order]
    end = start + size[order]
    score = table.scores[piece]
    edges = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
    groups = [slice(a, b) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(key)], strict=False)]
    best, via = np.full(len(chars), -1e300), np.zeros(len(chars), np.int64)
    best[first] = 0
    for g in groups:
        to, total = end[g], best[start[g]] + score[g]
        better = np.flatnonzero(total > best[to])
        to = to[better]
        best[to], via[to] = total[better], better + g.start
    on_path, at = np.zeros(len(chars), bool), last[~alone & (n > 0)]
    while len(at):
        on_path[at] = True
        at = start[via[at]]
        at = at[place[at] > 0]
    after = np.full(len(chars), -1e300)
    after[last] = 0
    for g in reversed(groups):
        of = start[g]
        after[of] = np.maximum(after[of], score[g] + after[end[g]])
    rest = score + after[end] + best[start]
    rest[on_path[end] & (via[end] == np.arange(len(end)))] = -1e300
    other = np.full(m, -1e300)
    np.maximum.at(other, part[start], rest)
    path = np.flatnonzero(on_path)
    out = Found(best[last], np.where(other > -1e299, np.maximum(0.0, best[last] - other), np.inf), np.bincount(part[path], minlength=m), piece[via[path]])
    if not alone.any():
        return out
    ids = np.split(out.ids, np.cumsum(out.size)[:-1])
    for k in np.flatnonzero(alone).tolist():  # a character without a piece
        out.score[k], out.gap[k], own = best_and_gap(pieces, parts[k])
        ids[k] = np.frombuffer(own, np.int32)
        out.size[k] = len(ids[k])
    return out._replace(ids=np.concatenate(ids))


class Store:
    """Parts and their best segmentations: numbers in arrays, which take less than an object for each."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.score, self.gap, self.end, self.ids = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, parts: list[str], found: Found) -> None:
        self.place.update(zip(parts, range(len(self.place), len(self.place) + len(parts)), strict=True))
        self.end = np.append(self.end, len(self.ids) + np.cumsum(found.size))
        self.score, self.gap, self.ids = np.append(self.score, found.score), np.append(self.gap, found.gap), np.append(self.ids, found.ids.astype(np.int32))

    def get(self, at: np.ndarray) -> Found:
        end = self.end[at]
        size = end - np.where(at > 0, self.end[at - 1], 0)
        to = np.cumsum(size)
        return Found(self.score[at], self.gap[at], size, self.ids[np.repeat(end - to, size) + np.arange(int(size.sum()))])


class Encoder:
    """Encodes texts, remembering the parts it has met: up to REMEMBERED new ones and as many older."""

    def __init__(self, pieces: Pieces, count: int = NBEST) -> None:
        self.pieces, self.count, self.part, self.table = pieces, count, re.compile(pieces.parts), PieceTable(pieces)
        self.new, self.old = Store(), Store()
        self.others: dict[str, list[Segmentation]] = {}

    def _search(self, parts: list[str]) -> None:
        """Remembers new parts; those of like length are searched together."""
        parts = sorted(parts, key=len)
        at = np.fromiter(map(self.old.place.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        older = np.flatnonzero(at >= 0)
        if len(older):
            self.new.add([parts[k] for k in older.tolist()], self.old.get(at[older]))
            parts = [parts[k] for k in np.flatnonzero(at < 0).tolist()]
        waiting, size = [], 0
        for part in parts:
            if len(part) > LONG:
                score, gap, ids = best_and_gap(self.pieces, part)
                self.new.add([part], Found(np.array([score]), np.array([gap]), np.array([len(ids) // 4]), np.frombuffer(ids, np.int32)))
                continue
            waiting.append(part)
            size += len(part)
            if size > SEARCHED:
                self.new.add(waiting, many_best_and_gap(self.pieces, self.table, waiting))
                waiting, size = [], 0
        if waiting:
            self.new.add(waiting, many_best_and_gap(self.pieces, self.table, waiting))

    def prepare(self, parts: list[str]) -> Found:
        """What is known of each of these parts, once the new ones among them are searched."""
        at = np.fromiter(map(self.new.place.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        unknown = [parts[k] for k in np.flatnonzero(at < 0).tolist()]
        missing = dict.fromkeys(unknown)
        if missing and len(self.new.place) + len(missing) > REMEMBERED:
            self.old, self.new = self.new, Store()
            at[:] = -1
            unknown, missing = parts, dict.fromkeys(parts)
        if missing:
            self._search(list(missing))
            at[at < 0] = np.fromiter(map(self.new.place.__getitem__, unknown), np.int64, len(unknown))
        return self.new.get(at)

    def split(self, text: str) -> list[str]:
        return self.part.findall(" " + text) if text else []

    def _others(self, part: str, best: np.ndarray) -> list[Segmentation]:
        found = self.others.get(part)
        if found is None:
            first = tuple(best.tolist())
            found = [s for s in segmentations(self.pieces, part, self.count + 1) if s[1] != first][: self.count - 1]
            if len(self.others) >= REMEMBERED // 8:
                self.others.clear()
            self.others[part] = found
        return found

    def encode(self, texts: list[list[str]]) -> Iterator[tuple[list[float], list[np.ndarray]]]:
        """Of the parts of each text: scores and ids of its best segmentations.

        Of the parts only those with the count - 1 smallest gaps can differ in one of the `count` best.
        """
        known = self.prepare(list(itertools.chain.from_iterable(texts)))
        ends, low = np.cumsum(known.size), 0
        for parts in texts:
            high = low + len(parts)
            score, gaps, end, size = known.score[low:high], known.gap[low:high], ends[low:high], known.size[low:high]
            a, b = (int(end[0] - size[0]), int(end[-1])) if parts else (0, 0)
            best: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
            if self.count > 1 and parts:
                some = np.argpartition(gaps, self.count - 2)[: self.count - 1] if len(gaps) >= self.count else np.arange(len(gaps))
                for i in sorted(some[np.isfinite(gaps[some])].tolist()):
                    others = self._others(parts[i], known.ids[end[i] - size[i] : end[i]])
                    more = [(loss + float(score[i]) - other, {**ways, i: way}) for other, way in others for loss, ways in best]
                    best = heapq.nsmallest(self.count, best + more, key=lambda x: x[0])
            out = []
            for _, ways in best:
                own, done = [], a
                for i in sorted(ways):
                    own += [known.ids[done : end[i] - size[i]], np.array(ways[i], np.int32)]
                    done = int(end[i])
                out.append(np.concatenate([*own, known.ids[done:b]]))
            total = sum(score.tolist())
            yield [total - loss for loss, _ in best], out
            low = high


def nbest(pieces: Pieces, text: str, count: int) -> list[Segmentation]:
    """The `count` best segmentations of a whole text."""
    encoder = Encoder(pieces, count)
    ((scores, ids),) = encoder.encode([encoder.split(text)])
    return [(score, tuple(x.tolist())) for score, x in zip(scores, ids, strict=True)]


def decode(pieces: Pieces, ids: list[int]) -> str:
    """The text of some ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(pieces.surface[i] for i in ids)[1:].decode(errors="replace")


def _tables(surface: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in surface])
    return np.frombuffer(b"".join(surface), np.uint8), np.cumsum(size) - size, size


def decoded(tables: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Bytes of many ids at once, with the space before the first word."""
    data, start, size = tables
    n = size[ids]
    return data[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


_ENCODERS: dict[str, Encoder] = {}


def _lists(ids: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _encode(shared, name: str, count: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(name)
        if encoder is None:
            encoder = _ENCODERS[name] = Encoder(shared.value, count)
        tables = _tables(encoder.pieces.surface)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in pieces(offsets, TOGETHER):
                texts = [encoder.split(data[offsets[r] : offsets[r + 1]].tobytes().decode()) for r in range(i, j)]
                encodings = encoder.encode(texts)
                for k in range(i, j, ROWS):
                    ids, scores, same, others, counts = [], [], [], [], [0]
                    for r in range(k, min(j, k + ROWS)):
                        score, best = next(encodings)
                        ids.append(best[0])
                        others += best[1:]
                        counts.append(len(others))
                        scores.append(score)
                        same.append(np.array_equal(decoded(tables, best[0])[1:], data[offsets[r] : offsets[r + 1]]))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(k, len(ids)) for c in batch.columns[:-1]), _lists(ids), pa.array([len(x) for x in ids], pa.int32()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), _lists(others)), pa.array(scores, pa.list_(pa.float64())), pa.array(same)],
                        [*batch.schema.names[:-1], "pieces", "n_pieces", "other_pieces", "nbest_scores", "round_trip"],
                    )

    return run


def encoded(documents: DataFrame, vocabulary: str = VOCABULARY, count: int = NBEST) -> DataFrame:
    """doc_id, pieces (ids of the best segmentation), n_pieces, other_pieces, nbest_scores, round_trip of each row.

    nbest_scores are those of the `count` best segmentations of the whole text, best first;
    other_pieces has the ids of all of them but the best.
    round_trip says that the ids decode to the text itself. Null and empty texts have no
    pieces, the only score 0 and no others, and round_trip true. Every input row gives one row, repeated
    ones and null doc_ids too; extra columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load(vocabulary))
    schema = "doc_id long, pieces array<int>, n_pieces int, other_pieces array<array<int>>, nbest_scores array<double>, round_trip boolean"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(_encode(shared, f"{vocabulary} {count}", count), schema)


def with_text(encodings: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds decoded_text, decoded from pieces (null: empty), at the end of the columns."""
    shared = encodings.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(shared.value, ids or []) for ids in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded_text"])

    return encodings.mapInArrow(run, T.StructType([*encodings.schema.fields, T.StructField("decoded_text", T.StringType())]))
