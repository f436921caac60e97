"""Approximate nearest neighbours: multiprobe cross-polytope hashing, then exact reranking.

A vector of unit length is turned by fast Hadamard pseudo-rotations and hashed to the
nearest signed axis; two such hashes name a bucket of a table. Vectors of another number of
components have tables of their own. Queries also look into the
buckets that are next best. Buckets meet their queries by a shuffle; large ones are cut
into blocks. Each task keeps the best candidates of each query it has seen, so that
candidates make no rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.storage import dropped, materialize

NEIGHBOURS = 10
TABLES = 24
PROBES = 256
#: Rows of a bucket that one unit of work holds.
BLOCK = 4096
#: Twice what rounding does to a squared distance, a dimension, relative to the squared lengths.
ROUNDING = 1e-15
SEED = 7


def signs(dimension: int) -> np.ndarray:
    """Signs of the pseudo-rotations: for each table two hashes of three rounds."""
    size = 1 << max(1, dimension - 1).bit_length()
    return np.random.default_rng(SEED).choice(np.array([-1.0, 1.0], np.float32), (TABLES, 2, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
        h *= 2
    return x / np.float32(np.sqrt(x.shape[1]))


def turned(vectors: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    x = np.zeros((len(vectors), rounds.shape[-1]), np.float32)
    x[:, : vectors.shape[1]] = vectors / np.sqrt((vectors**2).sum(1, keepdims=True))
    for s in rounds:
        x = hadamard(x * s)
    return x


def bucket(x: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: twice the axis, plus 1 if positive."""
    axis = np.abs(x).argmax(1)
    return 2 * axis + (x[np.arange(len(x)), axis] > 0)


def probes(x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """Of one vector, the best pairs of signed axes for its two turned forms."""
    losses, names = [], []
    for v in (x, y):
        both = np.stack([-v, v], 1).ravel()
        loss = (np.abs(v).max() - both) ** 2
        best = np.argsort(loss, kind="stable")[: min(len(loss), 24)]
        losses.append(loss[best])
        names.append(best)
    total = losses[0][:, None] + losses[1][None]
    best = np.argsort(total.ravel(), kind="stable")[:count]
    a, b = np.divmod(best, total.shape[1])
    return names[0][a] * 2 * len(x) + names[1][b]


class _Vectors:
    """The vectors of an Arrow list column, which may differ in length from row to row."""

    def __init__(self, column: pa.Array) -> None:
        self.values = column.flatten().to_numpy()
        starts = column.offsets.to_numpy()
        self.starts = starts - starts[0]
        self.sizes = np.diff(starts)

    def rows(self, a: int, b: int) -> np.ndarray:
        """Rows a to b, all of one length."""
        return self.values[self.starts[a] : self.starts[b]].reshape(b - a, -1).astype(np.float64)

    def of_size(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of this length, and their vectors."""
        at = np.flatnonzero(self.sizes == size)
        return at, self.values[self.starts[at][:, None] + np.arange(size)].astype(np.float64)


def _hash(query: bool) -> Callable:
    """Rows of table, bucket, vec_id, embedding; the tables of vectors of n components start at n * TABLES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rounds: dict[int, np.ndarray] = {}
        for batch in batches:
            column = _Vectors(batch.column("embedding"))
            for size in np.unique(column.sizes).tolist():
                if size not in all_rounds:
                    all_rounds[size] = signs(size)
                at, vectors = column.of_size(size)
                for t, (a, b) in enumerate(all_rounds[size]):
                    x, y = turned(vectors, a), turned(vectors, b)
                    names = [probes(p, q, PROBES) for p, q in zip(x, y, strict=True)] if query else (bucket(x) * 2 * x.shape[1] + bucket(y))[:, None]
                    n = len(names[0])
                    take = pa.array(np.repeat(at, n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n * len(at), size * TABLES + t, np.int64)), pa.array(np.concatenate(names).astype(np.int64)), batch.column("vec_id").take(take), batch.column("embedding").take(take)], ["table", "bucket", "vec_id", "embedding"])

    return run


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(1))


class _Best:
    """The nearest candidates of each query so far, by distance, then id.

    rough are squared distances by products; slack bounds what rounding does to them and
    grows with the vectors, so that no true neighbour is passed over.
    """

    def __init__(self) -> None:
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, query_id: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rough: np.ndarray, slack: float) -> None:
        have = self.of.get(query_id)
        near = ids != query_id
        if have is not None and len(have[0]) >= NEIGHBOURS:
            near &= rough <= have[1][-1] ** 2 + slack
        if near.sum() > NEIGHBOURS:
            near &= rough <= np.partition(rough[near], NEIGHBOURS - 1)[NEIGHBOURS - 1] + 2 * slack
        ids, score = ids[near], distances(query, vectors[near])
        if have is not None:
            ids, score = np.concatenate([have[0], ids]), np.concatenate([have[1], score])
        ids, first = np.unique(ids, return_index=True)
        order = np.lexsort((ids, score[first]))[:NEIGHBOURS]
        self.of[query_id] = ids[order], score[first][order]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by table, bucket and block, candidates (kind 0) before queries (kind 1)."""
    best, unit, ids, vectors = _Best(), None, [], []
    for batch in batches:
        if not len(batch):
            continue
        names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("table", "bucket", "block", "kind")])
        edges = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1), len(batch)]
        all_ids, column = batch.column("vec_id").to_numpy(), _Vectors(batch.column("embedding"))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            here = tuple(names[:3, a])
            if here != unit:
                unit, ids, vectors = here, [], []
            if names[3, a] == 0:
                ids.append(all_ids[a:b])
                vectors.append(column.rows(a, b))
            elif ids:
                if len(ids) > 1:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                # Differences from one of them: vectors far from the origin are near one another.
                centre = vectors[0][0]
                moved = vectors[0] - centre
                squares = (moved**2).sum(1)
                for i in range(a, b, 256):
                    q = column.rows(i, min(b, i + 256))
                    own = q - centre
                    lengths = (own**2).sum(1)
                    rough = lengths[:, None] + squares[None] - 2 * own @ moved.T
                    slack = ROUNDING * own.shape[1] * (lengths + squares.max())
                    for k in range(len(q)):
                        best.add(int(all_ids[i + k]), q[k], ids[0], vectors[0], rough[k], float(slack[k]))
    if best.of:
        n = [len(x[0]) for x in best.of.values()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.fromiter(best.of, np.int64), n)), pa.array(np.concatenate([x[0] for x in best.of.values()])), pa.array(np.concatenate([x[1] for x in best.of.values()]))], ["query_id", "vec_id", "score"])


def _meet(rows: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best candidates of queries from rows of the same table and bucket, as each task has found them, and a table that this reads."""
    counts = rows.groupBy("table", "bucket").count().select("table", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    counts = materialize(counts)
    candidates = rows.join(counts, ["table", "bucket"]).select("table", "bucket", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "embedding")
    asking = queries.join(counts, ["table", "bucket"]).select("table", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "embedding")
    key = ["table", "bucket", "block"]
    return candidates.union(asking).repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(_search, "query_id long, vec_id long, score double"), counts


def _ranked(found: DataFrame) -> DataFrame:
    """The nearest of each query; a task gives NEIGHBOURS rows of a query at most."""
    from pyspark.sql import Window

    each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEIGHBOURS)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part.

    Those that are null, empty, zero, or hold a null or non-finite component don't, nor do rows
    without vec_id. Of rows with the same vec_id the least vector counts.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    some = F.exists("embedding", lambda x: x != 0)
    kind = "array<float>" if dict(embeddings.dtypes).get("embedding") == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the NEIGHBOURS nearest found of each vector whose id is divisible by `every`.

    All other vectors with as many components are candidates (between others there is no
    distance); score is the Euclidean distance. Hashing sees directions only, which suits
    vectors of like length. A query that finds fewer than NEIGHBOURS is compared with all
    its candidates, in blocks, so it gets as many as there are.
    """
    rows = materialize(usable(embeddings))
    queries = rows.filter(F.col("vec_id") % every == 0)
    schema = f"table long, bucket long, vec_id long, embedding {dict(rows.dtypes)['embedding']}"
    met, counts = _meet(rows.mapInArrow(_hash(False), schema), queries.mapInArrow(_hash(True), schema))
    found = materialize(_ranked(met))
    dropped(counts)
    size = F.size("embedding").alias("size")
    sizes = rows.groupBy(size).count().select("size", F.least(F.lit(NEIGHBOURS), F.col("count") - 1).alias("there"))
    has = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("has"))
    short = materialize(queries.withColumn("size", size).join(sizes, "size").join(has, "vec_id", "left").filter(F.coalesce("has", F.lit(0)) < F.col("there")).select("vec_id", "embedding"))
    if short.isEmpty():
        dropped(rows, short)
    else:
        # One bucket a length, which is cut into blocks as any other.
        one, asking = (df.select((-F.size("embedding")).cast("long").alias("table"), F.lit(0).cast("long").alias("bucket"), "vec_id", "embedding") for df in (rows, short))
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "vec_id", "score", "rank").union(_ranked(_meet(one, asking)[0]).select("query_id", "vec_id", "score", "rank"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
