"""Byte-level BPE encoding and decoding through a sentencepiece model written from a rank file.

A sentencepiece BPE model merges, again and again, the leftmost pair of neighbours whose
union has the greatest score. With the negative rank as the score of a piece that is the
order of byte-pair merges. Sentencepiece works on characters, so each byte stands as a
letter of its own; normalisation is the identity, and nothing is added or stripped.
Texts are cut by a pattern first, and each match is encoded separately.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm.text import pieces, utf8

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Matches whose ids a worker remembers from text to text (and as many older ones), and the letters of the longest of them.
REMEMBERED = 200_000
REMEMBERED_LETTERS = 48
#: Rows of an output batch.
ROWS = 512

#: Bytes as letters: printable ASCII as it is, the others as letters from U+0100 on.
LETTERS = {b: b if 0x21 <= b <= 0x7E else 0x100 + b for b in range(256)}
BYTES = {c: b for b, c in LETTERS.items()}
#: The piece of unknown letters, which no text of LETTERS has.
UNKNOWN = "⁇"

# Wire types of protocol buffers, field numbers and values of the model format.
VARINT, SIZED, FIXED = 0, 2, 5
MODEL_PIECE, MODEL_TRAINER, MODEL_NORMALISER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TYPE_NORMAL, TYPE_UNKNOWN = 1, 2
TRAINER_MODEL_TYPE, TRAINER_VOCABULARY_SIZE, TRAINER_UNKNOWN_ID = 3, 4, 40
MODEL_TYPE_BPE = 2
NORMALISER_NAME, NORMALISER_ADD_PREFIX, NORMALISER_REMOVE_SPACES, NORMALISER_ESCAPE_SPACES = 1, 3, 4, 5


class Vocabulary(NamedTuple):
    """What workers get: the vocabulary's size, whatever the input."""

    model: bytes  # a serialised sentencepiece model; piece i has rank ranks[i]
    ranks: list[int]
    pattern: str


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | SIZED) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | FIXED) + struct.pack("<f", value)
    return _varint(number << 3 | VARINT) + _varint(value)


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate(LETTERS)


def serialised(tokens: list[bytes], ranks: list[int]) -> bytes:
    """A sentencepiece model whose piece i is token i, scored by its negative rank; the last piece is the unknown one."""
    out = []
    for token, rank in zip(tokens, ranks, strict=True):
        out.append(_field(MODEL_PIECE, _field(PIECE_TEXT, letters(token).encode()) + _field(PIECE_SCORE, -float(rank)) + _field(PIECE_TYPE, TYPE_NORMAL)))
    out.append(_field(MODEL_PIECE, _field(PIECE_TEXT, UNKNOWN.encode()) + _field(PIECE_SCORE, 0.0) + _field(PIECE_TYPE, TYPE_UNKNOWN)))
    out.append(_field(MODEL_TRAINER, _field(TRAINER_MODEL_TYPE, MODEL_TYPE_BPE) + _field(TRAINER_VOCABULARY_SIZE, len(tokens) + 1) + _field(TRAINER_UNKNOWN_ID, len(tokens))))
    out.append(_field(MODEL_NORMALISER, _field(NORMALISER_NAME, b"identity") + _field(NORMALISER_ADD_PREFIX, 0) + _field(NORMALISER_REMOVE_SPACES, 0) + _field(NORMALISER_ESCAPE_SPACES, 0)))
    return b"".join(out)


def load(path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    """Reads a rank file (a token in base64 and its rank a line) on the driver."""
    with open(path, "rb") as file:
        rows = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in file if line.strip()))
    return Vocabulary(serialised([t for _, t in rows], [r for r, _ in rows]), [r for r, _ in rows], pattern)


class Codec:
    """Encodes and decodes by a vocabulary; keeps the ids of short matches that it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        self.ranks = vocabulary.ranks
        self.matches = regex.compile(vocabulary.pattern).findall
        surface = [bytes(map(BYTES.__getitem__, map(ord, self.model.id_to_piece(i)))) for i in range(len(self.ranks))]
        self.bytes_of = dict(zip(self.ranks, surface, strict=True))
        # A match that is a token is that token, also where merging wouldn't lead to it.
        self.tokens = {s: (r,) for s, r in zip(surface, self.ranks, strict=True)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _learn(self, new: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of matches."""
        out = {w: self.older[w] for w in new if w in self.older}
        new = [w for w in new if w not in out]
        raw = [w.encode() for w in new]
        out.update((w, self.tokens[b]) for w, b in zip(new, raw, strict=True) if b in self.tokens)
        rest = [(w, b) for w, b in zip(new, raw, strict=True) if w not in out]
        if rest:
            ids = self.model.encode([letters(b) for _, b in rest], num_threads=1)
            out.update((w, tuple([self.ranks[i] for i in own])) for (w, _), own in zip(rest, ids, strict=True))
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids (ranks) of a text, as unsigned 32-bit integers."""
        words = self.matches(text)
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known = self.known, {}
            new = list(set(words))
        if new:
            self.known.update(self._learn(new))
        out = np.fromiter(itertools.chain.from_iterable(map(self.known.__getitem__, words)), np.uint32)
        for w in new:
            if len(w) > REMEMBERED_LETTERS:
                del self.known[w]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; raises KeyError for one that is no rank."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_CODECS: dict[int, Codec] = {}


def _codec(vocabulary: Vocabulary) -> Codec:
    key = hash((vocabulary.model, vocabulary.pattern))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


Batches = Iterator[pa.RecordBatch]


def _encoded(codec: Codec, batches: Batches) -> Batches:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i, j in pieces(offsets):
            for a in range(i, j, ROWS):
                b = min(j, a + ROWS)
                ids = [codec.encode(data[offsets[r] : offsets[r + 1]].tobytes().decode()) for r in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], _lists(ids)], ["doc_id", "ids"])


def _decoded(codec: Codec, batches: Batches) -> Batches:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            ids = part.column("ids")
            data = [None if own is None else codec.decode(own.to_numpy()) for own in (x.values for x in ids)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(data, pa.binary())], ["doc_id", "ids", "data"])


def _with_codec(spark: SparkSession, path: str, pattern: str, work: Callable[[Codec, Batches], Batches]) -> Callable[[Batches], Batches]:
    shared = spark.sparkContext.broadcast(load(path, pattern))
    return lambda batches: work(_codec(shared.value), batches)


def encoded(documents: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids: the ranks of each text's tokens, one row for each input row.

    path names a rank file and pattern what is encoded separately. Null and empty texts have
    no ids; a null doc_id and repeated rows stay; other columns are ignored. An empty table
    gives an empty one. A match of any length is merged as a whole.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_with_codec(documents.sparkSession, path, pattern, _encoded), "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids, data: the bytes that ids stand for; null ids give null. Bytes needn't be whole characters."""
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_with_codec(tokens.sparkSession, path, pattern, _decoded), "doc_id long, ids array<int>, data binary")


def round_trip(documents: DataFrame, then: Callable[[Batches], Batches] | None = None, schema: str = "doc_id long, ids array<int>, data binary", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids, data: each text's ids and what they decode to, by one worker and one vocabulary in memory.

    then makes other rows, of the given schema, of these batches before they leave the worker.
    Odd rows as in `encoded`.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def both(codec: Codec, batches: Batches) -> Batches:
        rows = _decoded(codec, _encoded(codec, batches))
        return then(rows) if then else rows

    return texts.mapInArrow(_with_codec(documents.sparkSession, path, pattern, both), schema)
