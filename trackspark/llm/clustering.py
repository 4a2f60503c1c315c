"""Exact k-means over whole numbers, with Hamerly's bounds kept from round to round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import materialise

#: Components are at most so large, so that squared distances of 64 of them fit in a long.
MOST = 1 << 27
#: Share by which bounds are kept too wide, far above the error of floating point.
SLACK = 1e-12

STATE = "id {kind}, v array<int>, cluster int, upper double, lower double, scans int, distance long"


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per vector and a column per centroid."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = v - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def above(squared: np.ndarray) -> np.ndarray:
    """Roots of exact squares, never too small."""
    return np.sqrt(squared.astype(float)) * (1 + SLACK)


def below(squared: np.ndarray) -> np.ndarray:
    """Roots of exact squares, never too large."""
    return np.sqrt(squared.astype(float)) * (1 - SLACK)


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (of equals the first), and bounds of the two least distances."""
    d = distances(v, centroids)
    best = d.argmin(1)
    rows = np.arange(len(v))
    nearest = d[rows, best]
    if len(centroids) == 1:
        return best, above(nearest), np.full(len(v), np.inf)
    d[rows, best] = np.iinfo(np.int64).max
    return best, above(nearest), below(d.min(1))


class Move:
    """What the bounds need to know of a move of the centroids."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.new = new
        gone = old - new
        #: How far each centroid went, and the others of it at most.
        self.drift = above((gone * gone).sum(1))
        k = len(new)
        self.others = np.array([max([0.0, *np.delete(self.drift, i)]) for i in range(k)])
        #: Half the distance of each centroid to the nearest other one.
        apart = distances(new, new)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.half = below(apart.min(1)) / 2 if k > 1 else np.full(k, np.inf)


def reassign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scans: np.ndarray, move: Move):
    """cluster, upper, lower, scans after a move of the centroids.

    Where the upper bound of the own distance stays below the lower bound of
    all others the assignment is certain, and no tie. Where not, the own
    distance is worked out, and only if that is not enough all of them are.
    """
    upper = (upper + move.drift[cluster]) * (1 + SLACK)
    lower = lower - move.others[cluster]
    lower = np.where(lower > 0, lower * (1 - SLACK), lower * (1 + SLACK)) - SLACK * move.others[cluster]
    bound = np.maximum(lower, move.half[cluster])
    doubt = np.flatnonzero(upper >= bound)
    if len(doubt):
        d = v[doubt] - move.new[cluster[doubt]]
        upper[doubt] = above(np.einsum("ij,ij->i", d, d))
        doubt = doubt[upper[doubt] >= bound[doubt]]
    if len(doubt):
        cluster, scans = cluster.copy(), scans.copy()
        cluster[doubt], upper[doubt], lower[doubt] = scan(v[doubt], move.new)
        scans[doubt] += 1
    return cluster, upper, lower, scans


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dim)


def _batch(batch: pa.RecordBatch, *values: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int64())
    arrays = [pa.array(x, k) for x, k in zip(values, kinds)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "v", "cluster", "upper", "lower", "scans", "distance"])


def _distance(v: np.ndarray, cluster: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = v - centroids[cluster]
    return np.einsum("ij,ij->i", d, d)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the componentwise means; a cluster without vectors keeps its centroid.

    Each task sums its own vectors first; the driver gets a row for each centroid.
    """
    dim = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)])
    out = centroids.copy()
    for r in sums.collect():  # one row per centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def kept_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id and v: whole vectors of finite numbers, as floors of ``scale`` times each."""

    def whole(x):
        q = F.floor(x.cast("double") * scale)
        return F.when(F.abs(q) <= MOST, q.cast("int")).otherwise(
            F.raise_error(F.lit("a component is too large for distances in a long")).cast("int")
        )

    def fine(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    found = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")).filter(F.size("x") == dim)
    return found.filter(F.forall("x", fine)).select("id", F.transform("x", whole).alias("v"))


def cluster_vectors(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dim: int = 64,
    scale: int = 64,
    seed: int = 1,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector kept: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, scans.

    Vectors of ``dim`` finite numbers are kept, as floors of ``scale`` times
    each component, so that all sums and distances are exact. The first
    centroids are the vectors whose id has the smallest SHA-256 after the seed.
    Each round assigns all vectors and moves the centroids to the floors of the
    means; then all are assigned once more.

    A table in the shared folder keeps for each vector its cluster, an upper
    bound of the distance to its centroid and a lower one of that to any other.
    A round loosens both by how far the centroids went; only vectors whose
    bounds overlap are scanned against all centroids, in whole numbers
    (``scans`` counts how often that was). Vectors stay in their partitions: a
    round moves one row of sums per task and cluster, and the centroids, k rows,
    are all that the driver holds. A cluster of most vectors is no hot key.

    Edge cases: null or short vectors, and those with null, NaN or infinite
    components, have no row; a component beyond 2^27 after scaling fails, as
    its distances do not fit in a long; fewer vectors than ``k`` are as many
    centroids; a null id comes last among the first centroids; repeated ids are
    rows of their own, equal vectors have equal results (of centroids at one
    distance the first counts); an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, dim, scale, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    out = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans"]
    if not first:
        kinds = ("int", "long", "long", "long", "string", "int")
        return spark.createDataFrame([], f"`{id_col}` {kind}, " + ", ".join(map(" ".join, zip(out, kinds))))
    centroids = np.array([r["v"] for r in first], np.int64)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column(1), dim)
            cluster, upper, lower = scan(v, centroids)
            yield _batch(batch, cluster, upper, lower, np.ones(len(v), int), _distance(v, cluster, centroids))

    def again(move: Move):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _vectors(batch.column(1), dim)
                old = [batch.column(i).to_numpy().copy() for i in (2, 3, 4, 5)]
                cluster, upper, lower, scans = reassign(v, *old, move)
                yield _batch(batch, cluster, upper, lower, scans, _distance(v, cluster, move.new))

        return step

    schema = STATE.format(kind=kind)
    state = materialise(rows.mapInArrow(begin, schema), "bounds")
    for _ in range(rounds):
        moved = means(state, centroids)
        state = materialise(state.mapInArrow(again(Move(centroids, moved)), schema), "bounds")
        centroids = moved

    own = state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # one row per centroid
    total = sum(r["s"] for r in own)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame(
        [(r["cluster"], r["s"], total, digest[r["cluster"]]) for r in own],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return state.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), *out)
