"""Centroid clustering with n-simplex projections.

The distances of every vector to a few pivots are taken once and kept beside it. In each round they become the
coordinates of an apex over the simplex of the pivots; the distance of two apexes, and that of one to the mirror
image of the other, are a lower and an upper bound of the true distance. A centroid whose lower bound lies above
the least upper bound can't be the nearest; those left are compared in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from provena.llm import common

CENTROIDS, ROUNDS, COMPONENTS, SCALE = 16, 3, 64, 64
PIVOTS, POOL = 8, 64
# Components up to here keep every squared distance within a long; rounding of the bounds stays far below SLACK.
LARGEST, SLACK = 1 << 27, 1e-9
_ROWS = 8192


def quantized(vector: str, scale: int, components: int) -> Column:
    """floor(scale * x) of each component; null for vectors of another length, and where a component is null, not
    finite or too large for squared distances in a long."""
    x_of = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) * scale >= float(LARGEST))
    right = F.col(vector).isNotNull() & (F.size(vector) == components)
    return F.when(right & ~F.exists(vector, bad), F.transform(vector, lambda x: x_of(x).cast("bigint")))


def pick_pivots(pool: np.ndarray, count: int) -> np.ndarray:
    """Rows of the pool that span a well-conditioned simplex: each next one has the greatest altitude over the last."""
    rest = pool.astype(np.float64) - pool[0]
    chosen, height = [0], np.einsum("ij,ij->i", rest, rest)
    enough = height.max() * 1e-4
    while len(chosen) < count and height.max() > max(enough, 0.0):
        best = int(height.argmax())
        chosen.append(best)
        axis = rest[best] / np.linalg.norm(rest[best])
        rest -= np.outer(rest @ axis, axis)
        height = np.einsum("ij,ij->i", rest, rest)
    return pool[chosen]


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``left`` to all of ``right``."""
    out = np.empty((len(left), len(right)), np.int64)
    for j, row in enumerate(right):
        gap = left - row
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


class Simplex:
    """Base vertices of the pivots, and apexes over them."""

    def __init__(self, pivots: np.ndarray):
        gaps = squared(pivots, pivots).astype(np.float64)
        gram = (gaps[0][:, None] + gaps[0][None] - gaps)[1:, 1:] / 2
        self.base = np.linalg.cholesky(gram) if len(pivots) > 1 else np.zeros((0, 0))
        self.norms = gaps[0, 1:]

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates from squared distances to the pivots; the last one is the altitude."""
        d = distances.astype(np.float64)
        flat = np.linalg.solve(self.base, ((d[:, :1] - d[:, 1:] + self.norms) / 2).T).T if len(self.base) else d[:, 1:]
        height = np.sqrt(np.maximum(d[:, 0] - np.einsum("ij,ij->i", flat, flat), 0))
        return np.column_stack([flat, height])

    def candidates(self, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Which centres may be nearest to which rows; both by their squared distances to the pivots."""
        a, b = self.apexes(rows), self.apexes(centres)
        flat = sum(((a[:, i : i + 1] - b[None, :, i]) ** 2 for i in range(a.shape[1] - 1)), np.zeros((len(a), len(b))))
        lower, upper = flat + (a[:, -1:] - b[None, :, -1]) ** 2, flat + (a[:, -1:] + b[None, :, -1]) ** 2
        slack = SLACK * (rows[:, :1] + centres[None, :, 0] + self.norms.max(initial=0) + 1)
        return lower - slack <= (upper + slack).min(axis=1, keepdims=True)


def nearest(vectors: np.ndarray, distances: np.ndarray, centres: np.ndarray, pivots: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centre of each vector, ties to the smaller number."""
    keep = simplex.candidates(distances, squared(centres, pivots))
    best, at = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int64)
    for number, centre in enumerate(centres):
        rows = np.flatnonzero(keep[:, number])
        gap = vectors[rows] - centre
        own = np.einsum("ij,ij->i", gap, gap)
        less = own < best[rows]
        best[rows[less]], at[rows[less]] = own[less], number
    return at, best


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _measured(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = squared(_matrix(batch.column("v"), pivots.shape[1]), pivots)
        yield common.batch_of(["vec_id", "v", "pivots"], [batch.column("vec_id"), batch.column("v"), common.as_lists(pa.array(own.ravel()), np.full(len(own), len(pivots)))])


def _assigned(batches: Iterator[pa.RecordBatch], centres: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    simplex = Simplex(pivots)
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            vectors = _matrix(part.column("v"), centres.shape[1])
            at, best = nearest(vectors, _matrix(part.column("pivots"), len(pivots)), centres, pivots, simplex)
            yield part, vectors, at, best


def _sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and componentwise sums of a partition by centre; the sums hold for 2^36 rows a partition."""
    total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
    for _, vectors, at, _ in _assigned(batches, centres, pivots):
        count += np.bincount(at, minlength=len(centres))
        for number in np.unique(at):
            total[number] += vectors[at == number].sum(axis=0)
    used = np.flatnonzero(count)
    width = centres.shape[1]
    yield common.batch_of(
        ["cluster", "place", "n", "total"],
        [np.repeat(used, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(used)), np.repeat(count[used], width), total[used].ravel()],
    )


def _labelled(batches: Iterator[pa.RecordBatch], centres: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, _, at, best in _assigned(batches, centres, pivots):
        yield common.batch_of(["vec_id", "cluster", "distance"], [part.column("vec_id"), at.astype(np.int32), best])


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """Integer k-means from hashed starts, each round with the exact nearest centroid of every vector.

    Takes vectors(vec_id long, embedding array); other columns are ignored. Components become floor(scale * x). The
    centroids 0, 1, ... start as the vectors with the smallest sha256 of ``1:<vec_id>``; each of ``rounds`` rounds
    assigns all vectors (ties to the smaller number) and replaces non-empty centroids by the floor of their mean;
    then vectors are assigned once more. Returns ``vec_id, cluster, distance`` (squared), ``cluster_inertia,
    inertia`` and ``centroid_sha256``.

    Vectors take no part (no row) if they are null, have another length, or hold a component that is null, not finite
    or of 2^27 or more after scaling, as its squared distances would leave a long. Every other row counts, also
    one that repeats an id or a vector; a row without id is assigned, but starts a centroid only where rows with ids
    run out. With fewer vectors than centroids there are as many centroids as vectors. An empty table gives no rows.
    The driver holds ``centroids`` rows and 64 candidates for pivots.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantized("embedding", scale, components).alias("v")).where(F.col("v").isNotNull())
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = [r["v"] for r in kept.orderBy(F.asc_nulls_last(order), "v").limit(max(centroids, POOL)).select("v").collect()]
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    pool = np.array(first, np.int64)
    centres, fixed = pool[:centroids].copy(), pick_pivots(pool, pivots)
    table = common.written(kept.mapInArrow(lambda b: _measured(b, fixed), "vec_id bigint, v array<bigint>, pivots array<bigint>"))
    for _ in range(rounds):
        now = centres.copy()
        sums = table.mapInArrow(lambda b, c=now: _sums(b, c, fixed), "cluster int, place int, n bigint, total bigint")
        for row in sums.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            centres[row["cluster"], row["place"]] = int(row["total"]) // int(row["n"])
    labelled = common.written(table.mapInArrow(lambda b: _labelled(b, centres, fixed), "vec_id bigint, cluster int, distance bigint"))
    common.discard(table)
    inertia = {r["cluster"]: int(r["d"]) for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    long = lambda x: x if x < 1 << 63 else None
    named = spark.createDataFrame([(c, long(d), digests[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, centroid_sha256 string")
    total = F.lit(long(sum(inertia.values()))).cast("long")
    return labelled.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
