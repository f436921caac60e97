"""Vectorised tokens and token hashes over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21

# White space of the word contract: [\x20\x09-\x0D].
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, *range(0x09, 0x0E)]] = 0

# Word characters (1) against runs of punctuation (2); control characters and space separate.
WORDS_AND_PUNCTUATION = np.full(256, 2, np.uint8)
WORDS_AND_PUNCTUATION[0x80:] = 1
WORDS_AND_PUNCTUATION[: 0x21] = 0
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    WORDS_AND_PUNCTUATION[ord(_first) : ord(_last) + 1] = 1

LETTERS_AND_DIGITS = (WORDS_AND_PUNCTUATION == 1).astype(np.uint8)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 256)
        with np.errstate(over="ignore"):
            _POWERS[0] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]))
    return _POWERS[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its two parts."""
    return mix(a * _BASE + (b ^ np.uint64(0xD1B54A32D192ED03)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one non-zero class: their starts, ends and, for each row and the end, its first token."""
    low, high = int(offsets[0]), int(offsets[-1])
    kind = classes[data[low:high]]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    change = np.empty(len(kind), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    rows = offsets[(offsets < high)] - low
    change[rows] = True
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], len(kind))
    keep = kind[edges] != 0
    starts, ends = edges[keep] + low, ends[keep] + low
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each token."""
    out = np.empty(len(starts), np.uint64)
    size = np.cumsum(ends - starts)
    i = 0
    while i < len(starts):
        done = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, done + PIECE_BYTES, "right")))
        lengths = ends[i:j] - starts[i:j]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at = np.arange(int(lengths.sum()))
        within = at - np.repeat(first, lengths)
        values = data[np.repeat(starts[i:j], lengths) + within].astype(np.uint64) + np.uint64(1)
        values *= _powers(int(lengths.max()) + 1)[within]
        out[i:j] = mix(np.add.reduceat(values, first) ^ (lengths.astype(np.uint64) << np.uint64(56)))
        i = j
    return out


def row_of(pointer: np.ndarray) -> np.ndarray:
    """For each token the row it belongs to."""
    return np.repeat(np.arange(len(pointer) - 1), np.diff(pointer))
