"""Centroid clustering in integers, with centroids filtered by PCA-rotated coordinates.

Vectors become integers, floor(SCALE * x) of each component, and everything that decides is done on those.
The rotation comes from the covariance of all vectors: tasks add up outer products, Spark adds up the
tasks, and the eigenvectors of the 64 by 64 sum turn each vector so that the first LEADING coordinates
hold most of its length.  Stored once are the integers, these leading coordinates and the norm of the rest.

In each round a centroid is turned the same way.  The squared distance of the leading coordinates plus the
squared difference of the two residual norms is no more than the squared distance of vector and centroid.
The centroid with the least bound is measured exactly; every other one whose bound does not exceed that is
measured too, in integers, and the nearest of them wins, the smaller number on a tie.  A margin far above
what floating point can lose keeps a bound from ruling out the true centroid.

A round is one pass over the stored table.  Tasks give sums for each cluster and component, Spark adds them
up, and the driver gets at most CLUSTERS times (DIM + 1) of them.

Kept are vectors of exactly DIM components, none null, NaN or infinite; all others, and null vectors, have
no row in the result.  Repeated rows are clustered once for each; a repeated id starts two centroids if its
hash is among the least, ordered by their components.  A null id is hashed as null, and comes last there.
With fewer vectors than CLUSTERS there are fewer centroids; an empty table gives no rows.  A component of
LARGEST or more in absolute value would make squared distances that a long can't hold: it is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transhume.llm import shared, spans

DIM = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
LEADING = 16
#: 64 squares of differences below 2^28 stay below 2^63.
LARGEST = 1 << 27
#: What a bound gives way of the squared lengths; doubles lose less than a tenth of that.
MARGIN = 1e-6
#: Vectors worked on at once.
AT_ONCE = 1 << 13

STORED = "vec_id BIGINT, cells BINARY, leading BINARY, residual DOUBLE"
SUMS = "cluster INT, dim INT, total BIGINT"
PLACED = "vec_id BIGINT, cluster INT, distance BIGINT"


def kept(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, cells) of the vectors that take part, as integers."""
    x = F.col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    floors = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    rows = vectors.where((F.size(x) == dim) & sound).select(F.col(key).cast("long").alias("vec_id"), floors.alias("cells"))
    wide = F.exists("cells", lambda v: F.abs(v) >= LARGEST)
    message = F.lit(f"a component reaches {LARGEST}: its squared distance does not fit a long")
    return rows.select("vec_id", F.when(wide, F.raise_error(message)).otherwise(F.col("cells")).alias("cells"))


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids have the least hashes, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    order = [name.asc_nulls_last(), F.col("cells")]
    chosen = rows.orderBy(*order).limit(k).select("cells").collect()
    return np.array([row["cells"] for row in chosen], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of products of a task's vectors, as (place, total)."""
    total = None
    for batch in batches:
        if not len(batch):
            continue
        found = _matrix(batch.column(0)).astype(np.float64)
        wide = np.hstack([np.ones((len(found), 1)), found])
        total = wide.T @ wide if total is None else total + wide.T @ wide
    flat = np.zeros(0) if total is None else total.ravel()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["place", "total"])


class Rotation:
    """Turns vectors to their principal axes."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leading coordinates, norm of the rest) of each vector."""
        centred = found - self.mean
        leading = centred @ self.axes
        rest = (centred**2).sum(1) - (leading**2).sum(1)
        return leading, np.sqrt(np.maximum(rest, 0))


def rotation(rows: DataFrame, dim: int = DIM, leading: int = LEADING) -> Rotation:
    """The leading eigenvectors of the covariance of all vectors; (dim + 1)^2 sums reach the driver."""
    parts = rows.select("cells").mapInArrow(spans.tidy(_moments), "place INT, total DOUBLE")
    sums = np.zeros((dim + 1) ** 2)
    for row in parts.groupBy("place").agg(F.sum("total").alias("total")).collect():
        sums[row["place"]] = row["total"]
    sums = sums.reshape(dim + 1, dim + 1)
    n = max(sums[0, 0], 1.0)
    mean = sums[0, 1:] / n
    spread = sums[1:, 1:] / n - np.outer(mean, mean)
    _, axes = np.linalg.eigh(spread)  # the largest come last
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1][:, :leading]))


def _storer(turn: Rotation):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found = _matrix(batch.column(1))
            leading, rest = turn(found.astype(np.float64))
            columns = [
                batch.column(0),
                pa.array([v.tobytes() for v in found.astype("<i4")], pa.binary()),
                pa.array([v.tobytes() for v in leading.astype("<f8")], pa.binary()),
                pa.array(rest),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cells", "leading", "residual"])

    return store


def _block(column: pa.Array, kind: str) -> np.ndarray:
    """Binaries of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class Nearest:
    """The nearest centroid of each vector."""

    def __init__(self, centroids: np.ndarray, turn: Rotation):
        self.centroids = centroids
        self.leading, self.rest = turn(centroids.astype(np.float64))

    def bounds(self, leading: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """What each squared distance is at least, less a margin for rounding."""
        near = ((leading[:, None, :] - self.leading[None]) ** 2).sum(2)
        far = (rest[:, None] - self.rest[None]) ** 2
        lengths = (leading**2).sum(1) + rest**2
        mine = (self.leading**2).sum(1) + self.rest**2
        return near + far - MARGIN * (lengths[:, None] + mine[None] + 1)

    def __call__(self, cells: np.ndarray, leading: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each vector, and how many distances were measured."""
        least = self.bounds(leading, rest)
        rows = np.arange(len(cells))
        best = least.argmin(1)
        distance = ((cells - self.centroids[best]) ** 2).sum(1)
        measured = len(cells)
        # the bound is a float and the distance an integer: one above it is ruled out, an equal one is not
        open_ = least <= distance[:, None]
        open_[rows, best] = False
        for c in range(len(self.centroids)):
            at = np.flatnonzero(open_[:, c])
            d = ((cells[at] - self.centroids[c]) ** 2).sum(1)
            measured += len(at)
            wins = (d < distance[at]) | ((d == distance[at]) & (c < best[at]))
            best[at[wins]], distance[at[wins]] = c, d[wins]
        return best.astype(np.int32), distance, measured


def _parts(batches: Iterator[pa.RecordBatch], nearest: Nearest):
    """(ids, cells, clusters, distances) of each few vectors."""
    for batch in batches:
        for lo in range(0, len(batch), AT_ONCE):
            part = batch.slice(lo, AT_ONCE)
            cells = _block(part.column(1), "<i4").astype(np.int64)
            cluster, distance, _ = nearest(cells, _block(part.column(2), "<f8"), part.column(3).to_numpy())
            yield part.column(0), cells, cluster, distance


def _adder(nearest: Nearest):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = nearest.centroids.shape
        total = np.zeros((k, dim + 1), np.int64)  # the last column counts
        for _, cells, cluster, _ in _parts(batches, nearest):
            for c in np.unique(cluster):
                mine = cells[cluster == c]
                total[c, :dim] += mine.sum(0)
                total[c, dim] += len(mine)
        full = np.flatnonzero(total[:, dim])
        columns = [
            pa.array(np.repeat(full, dim + 1).astype(np.int32)),
            pa.array(np.tile(np.arange(dim + 1, dtype=np.int32), len(full))),
            pa.array(total[full].ravel()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "dim", "total"])

    return add


def _placer(nearest: Nearest):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _parts(batches, nearest):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return place


def moved(stored: DataFrame, centroids: np.ndarray, turn: Rotation) -> np.ndarray:
    """The centroids after one round: exact floors of the means, empty clusters as they were."""
    dim = centroids.shape[1]
    parts = stored.mapInArrow(spans.tidy(_adder(Nearest(centroids, turn))), SUMS)
    rows = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = {(row["cluster"], row["dim"]): int(row["total"]) for row in rows}
    out = centroids.copy()
    for c in {c for c, _ in sums}:
        n = sums[c, dim]
        out[c] = [sums[c, d] // n for d in range(dim)]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
    dim: int = DIM, scale: int = SCALE, seed: int = SEED, leading: int = LEADING,
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, the final centroids)."""
    spark = vectors.sparkSession
    rows = kept(vectors, key, vector, dim, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], PLACED), centroids
    turn = rotation(rows, dim, leading)
    stored = shared.written(rows.mapInArrow(spans.tidy(_storer(turn)), STORED), "clustering-rotated")
    for _ in range(rounds):
        centroids = moved(stored, centroids, turn)
    placed = shared.written(stored.mapInArrow(spans.tidy(_placer(Nearest(centroids, turn))), PLACED), "clustering-placed")
    shared.drop_table(stored)
    return placed, centroids


def report(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The placed vectors with the inertia of their cluster and of all, and a digest of the centroid."""
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).cast("long")
    # a row for each centroid at most
    totals = {row["cluster"]: row["s"] for row in placed.groupBy("cluster").agg(exact.alias("s")).collect()}
    rows = [(c, totals[c], sum(totals.values()), digest(centroids[c])) for c in sorted(totals)]
    about = placed.sparkSession.createDataFrame(
        rows, "cluster INT, cluster_inertia BIGINT, inertia BIGINT, centroid_sha256 STRING"
    )
    joined = placed.join(F.broadcast(about), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
