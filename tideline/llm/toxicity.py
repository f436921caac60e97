"""Toxicity: a classifier chain of linear models over hashed word n-grams and word beginnings.

Categories are predicted in a fixed order, the kinds of toxicity before toxicity itself.
The model of a category sees the n-grams of the text and the probabilities of the
categories before it; when it is trained, those probabilities come from models that have
not seen the row (out of fold). A row is toxic by the last probability of the chain, to
which all others go; the cut is the best one out of fold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tideline.llm.ftrl import BITS, BUCKETS, fit, ngrams, sigmoid
from tideline.llm.quality import is_held_out, sampled
from tideline.llm.storage import dropped, materialize
from tideline.llm.text import LETTERS_AND_DIGITS, LOWER, hashes, mix, pieces, row_of, tokens, utf8

#: Labelled rows that training reads at most: a hash of doc_id picks them.
TRAINING_ROWS = 12_000
FOLDS = 3
#: Rows of a category are rare: each is learnt from so many times.
POSITIVE_WEIGHT = 4
#: Bytes of the beginnings of words that have slots of their own, after those of the n-grams: stems with many endings.
BEGINNINGS = (6, 8)
SLOTS = 2 * BUCKETS + 1
#: Category and its label in SQL, in the order of the chain: toxicity by where it stands, then of any kind.
CATEGORIES = [
    ("toxic_prose", "toxic = 1 AND coalesce(quality, 1) = 1"),
    ("toxic_junk", "toxic = 1 AND quality = 0"),
    ("toxic", "toxic = 1"),
]


def beginnings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and slots of the beginnings of words."""
    low = int(offsets[0])
    piece = LOWER[data[low : int(offsets[-1])]]
    starts, ends, pointer = tokens(piece, offsets - low, LETTERS_AND_DIGITS)
    row, rows, slots = row_of(pointer), [], []
    for n in BEGINNINGS:
        at = np.flatnonzero(ends - starts >= n)
        h = mix(hashes(piece, starts[at], starts[at] + n) ^ np.uint64(n))
        rows.append(row[at])
        slots.append(BUCKETS + 1 + (h >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(slots)


def presence(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and slots of the distinct n-grams and beginnings (of wanted slots) of each row, by row."""
    one, two, pointer = ngrams(data, offsets, lower=True)
    rows, slots = beginnings(data, offsets)
    rows, slots = np.concatenate([np.tile(row_of(pointer), 2), rows]), np.concatenate([one, two, slots])
    keep = slots >= 0 if wanted is None else (slots >= 0) & wanted[slots]
    found = np.unique(rows[keep] * SLOTS + slots[keep])
    return found // SLOTS, found % SLOTS


class _Examples:
    """The examples of one category for fit, each made when it is asked for."""

    def __init__(self, slots: list, before: list, y: np.ndarray, c: int) -> None:
        self.slots, self.before, self.y, self.extra = slots, before, y, SLOTS + np.arange(c)
        self.at = np.repeat(np.arange(len(y)), np.where(y > 0, POSITIVE_WEIGHT, 1))

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, float]:
        i = self.at[i]
        slots = self.slots[i]
        return np.concatenate([slots, self.extra]), np.concatenate([np.ones(len(slots)), self.before[i]]), self.y[i]


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The score from which on rows count as toxic with the best F1; 0.5 where no row is toxic."""
    if not y.any():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    found = np.cumsum(y[order])
    f1 = 2 * found / (np.arange(1, len(y) + 1) + y.sum())
    # Rows of one score are on one side.
    f1[:-1][scores[order][:-1] == scores[order][1:]] = 0
    return float(scores[order][np.argmax(f1)])


def packed(slots: np.ndarray) -> bytes:
    """Sorted slots as compressed differences, as each row goes to several models."""
    return zlib.compress(np.diff(slots, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int32)


def chained(models: list[np.ndarray], slots: np.ndarray, fold: int) -> np.ndarray:
    """A row's probabilities by the models, one array a category, that have not seen its fold."""
    p = np.zeros(len(models))
    for c, w in enumerate(models):
        p[c] = sigmoid(w[fold, slots].sum() + w[fold, SLOTS : SLOTS + c] @ p[:c] + w[fold, -1])
    return p


def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i, j in pieces(offsets):
            rows, slots = presence(data, offsets[i : j + 1])
            bounds = np.searchsorted(rows, np.arange(j - i + 1)).astype(np.int32)
            lists = pa.array([packed(slots[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists, batch.column("y").slice(i, j - i)], ["doc_id", "slots", "y"])


def train(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, epochs: int = 6) -> tuple[np.ndarray, float]:
    """Weights, one row a category: slots, then the probabilities before it, then the bias; and the cut.

    Rows with a null doc_id or toxic label and held-out rows are not learnt from; of
    several labels of a doc_id the largest counts. Without labels all weights are zero.
    """
    spark, k = documents.sparkSession, len(CATEGORIES)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    y = F.array(*[F.coalesce(F.expr(c), F.lit(False)).cast("double") for _, c in CATEGORIES])
    marked = sampled(known, limit).select("doc_id", y.alias("y"))
    rows = documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id").mapInArrow(examples, "doc_id long, slots binary, y array<double>")
    rows = materialize(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(FOLDS)).cast("int")))
    weights, seen = np.zeros((k, SLOTS + k + 1)), []

    def model_of(c, shared):
        def learnt(model, slots, folds, y):
            before = [chained(shared.value, x, f) for x, f in zip(slots, folds, strict=True)]
            w = fit(_Examples(slots, before, np.array(y, float), c), SLOTS + k, epochs, model, alpha=1.0, l1=4.0, l2=0.0)
            at = np.flatnonzero(w)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model, np.int32)), pa.array(at.astype(np.int32)), pa.array(w[at])], ["model", "slot", "w"])

        def run(batches):
            # The rows of a model stand together; of a batch only slot numbers, 4 bytes each, are kept.
            held, slots, folds, y = None, [], [], []
            for batch in batches:
                for model, row, fold, label in zip(*(batch.column(n) for n in ("model", "slots", "fold", "y")), strict=True):
                    if model.as_py() != held:
                        if slots:
                            yield learnt(held, slots, folds, y)
                        held, slots, folds, y = model.as_py(), [], [], []
                    slots.append(unpacked(row.as_py()))
                    folds.append(fold.as_py())
                    y.append(label[c].as_py())
            if slots:
                yield learnt(held, slots, folds, y)

        return run

    for c in range(k):
        # Model m leaves out fold m; the model FOLDS learns from all rows. Each has the bounded sample at most.
        models = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in range(FOLDS + 1)]))).filter("model != fold")
        models = models.repartitionByRange(FOLDS + 1, "model").sortWithinPartitions("model", "doc_id")
        found = models.mapInArrow(model_of(c, spark.sparkContext.broadcast(list(seen))), "model int, slot int, w double").toPandas()
        fitted = np.zeros((FOLDS + 1, weights.shape[1]))
        fitted[found["model"].to_numpy(int), found["slot"].to_numpy(int)] = found["w"].to_numpy(float)
        weights[c] = fitted[FOLDS]
        seen.append(fitted[:FOLDS].astype(np.float32))
    shared = spark.sparkContext.broadcast(seen)

    def out_of_fold(batches):
        for batch in batches:
            p = [chained(shared.value, unpacked(s.as_py()), f.as_py())[-1] for s, f in zip(batch.column("slots"), batch.column("fold"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64()), pa.array([y[-1].as_py() for y in batch.column("y")], pa.float64())], ["p", "y"])

    # At most the bounded sample.
    judged = rows.select("slots", "y", "fold").mapInArrow(out_of_fold, "p double, y double").toPandas()
    dropped(rows)
    return weights.astype(np.float32), best_cut(judged["p"].to_numpy(float), judged["y"].to_numpy(float))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """doc_id, held_out, toxic (1 if p_toxic, the last of the chain, reaches threshold, or else the cut of training), p_<category>.

    One row for each input row, also for null doc_ids and for null or empty texts, which
    get the bias alone. Whole texts are read; extra columns are ignored.
    """
    weights, cut = train(documents, labels)
    threshold = cut if threshold is None else threshold
    shared = documents.sparkSession.sparkContext.broadcast((weights, (weights[:, :SLOTS] != 0).any(0)))
    names = [f"p_{name}" for name, _ in CATEGORIES]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            w, wanted = shared.value
            p = np.zeros((len(names), len(offsets) - 1))
            for i, j in pieces(offsets):
                rows, slots = presence(data, offsets[i : j + 1], wanted)
                for c in range(len(names)):
                    logit = np.bincount(rows, w[c, slots], j - i) + w[c, SLOTS : SLOTS + c].astype(float) @ p[:c, i:j] + float(w[c, -1])
                    p[c, i:j] = sigmoid(logit)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, p)], ["doc_id", *names])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    scored = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, schema)
    return scored.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), (F.col(names[-1]) >= threshold).cast("int").alias("toxic"), *names)
