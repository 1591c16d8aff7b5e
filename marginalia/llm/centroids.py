"""Exact centroid clustering of whole-number vectors with bounds from the history of the centroids.

A vector remembers the squared distances to its own and to the next nearest centroid and the
rounds in which they were taken. Later its own centroid can be no further off than then plus the
distance between that centroid's place then and now, and no other nearer than the next one was
less the furthest that any other centroid has moved since: the norm of the total displacement
between two rounds of the history, not the sum over the rounds between. If the first stays below
the second, the assignment stands; if not, the distance to its own centroid is taken anew, and if
that fails as well, those to all centroids.

Distances are exact integers; only the bounds are rounded, always to the safe side, and equality
counts as a failure, so that ties go to the smaller number as in a full scan.

Each round reads one written table and writes the next. Tasks send sums of the vectors that changed
their centroid, at most one row per centroid; the driver holds centroids only, all rounds of them.

Vectors with another number of components, or with null, NaN or infinite ones, are left out.
Repeated rows are vectors of their own; among the first centroids equal hashes are ordered by their
components, and rows without an id come last. With fewer vectors than centroids every vector starts
one. Empty clusters keep their centroid. An empty table gives an empty result. Distances and sums
beyond 64 bits are given as the largest long. Columns but id and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut_lineage, temporary_tables

CLUSTERS = 40
ROUNDS = 5
COMPONENTS = 64
SCALE = 256
# Vectors that are compared with all centroids at a time.
AT_ONCE = 4096

# Sums of products of whole numbers up to this size are exact in double precision (64 components).
_EXACT = 1 << 22
# Sums of a batch of whole numbers up to this size fit 64 bits.
_SHORT = 1 << 40
_LARGEST = (1 << 63) - 1
_STATE = ["cluster", "was", "own", "own_round", "other", "other_round"]
_STATE_TYPES = "cluster int, was int, own double, own_round int, other double, other_round int"
# Bounds are rounded by more than the errors of a square root and a few sums.
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9


def _small(*arrays: np.ndarray) -> bool:
    return all(-_EXACT <= a.min(initial=0) and a.max(initial=0) <= _EXACT for a in arrays)


def squared_to_all(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids; exact, as Python integers where doubles would not be."""
    if _small(vectors, centroids):
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (v @ c.T)).astype(np.int64)
    wide = vectors.astype(object)
    return np.stack([((wide - c) ** 2).sum(axis=1) for c in centroids.astype(object)], axis=1)


def squared_to_own(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The squared distance of each vector to the centroid in the same row; exact."""
    kind = np.int64 if _small(vectors, centroids) else object
    apart = vectors.astype(kind) - centroids.astype(kind)
    return (apart * apart).sum(axis=1)


def _norm(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def displacements(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """From every earlier round to the last: how far each centroid has moved, and the furthest of all others."""
    moved = np.stack([_norm(squared_to_own(then, history[-1])) for then in history]) * _UP
    if moved.shape[1] < 2:
        return moved, np.zeros_like(moved)
    two = np.sort(moved, axis=1)[:, -2:]
    # For the centroid that has moved the most, the second counts.
    return moved, np.where(moved >= two[:, 1:], two[:, :1], two[:, 1:])


def assign(vectors: np.ndarray, state: dict[str, np.ndarray] | None, history: list[np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The state of the vectors after the last round of ``history``, and which were compared with all centroids."""
    now, n, centroids = len(history) - 1, len(vectors), history[-1]
    if state is None:
        cluster, own, other = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
        own_round, other_round = np.zeros(n, np.int32), np.zeros(n, np.int32)
        fails = np.ones(n, bool)
    else:
        cluster, own, own_round, other, other_round = (state[c].copy() for c in ("cluster", "own", "own_round", "other", "other_round"))
        moved, furthest = displacements(history)
        least = other * _DOWN - furthest[other_round, cluster]
        fails = ~(own * _UP + moved[own_round, cluster] < least)
        near = _norm(squared_to_own(vectors[fails], centroids[cluster[fails]]))
        own[fails], own_round[fails] = near, now
        fails[fails] = ~(near * _UP < least[fails])
    was = cluster.copy()
    at = np.flatnonzero(fails)
    for start in range(0, len(at), AT_ONCE):
        part = at[start : start + AT_ONCE]
        squared = squared_to_all(vectors[part], centroids)
        cluster[part] = squared.argmin(axis=1)
        ordered = np.partition(squared, 1, axis=1) if squared.shape[1] > 1 else squared
        own[part], own_round[part] = _norm(ordered[:, 0]), now
        # A lone centroid has no rival.
        other[part] = _norm(ordered[:, 1]) if squared.shape[1] > 1 else np.inf
        other_round[part] = now
    return dict(zip(_STATE, (cluster, was, own, own_round, other, other_round))), fails


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), components)


def whole_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``, the components as ``floor(scale x)``, of the vectors that can be compared."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_x"))
    finite = ~F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.size("_x") == components) & finite)
    return rows.select("vec_id", F.transform("_x", lambda x: F.floor(x * scale)).alias("v"))


def first_centroids(rows: DataFrame, clusters: int, seed: int, components: int = COMPONENTS) -> np.ndarray:
    """The vectors of the smallest hashes of seed and id; every task sends at most ``clusters`` rows."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(mark.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.array([r.v for r in first], np.int64).reshape(-1, components)


def _after_round(rows: DataFrame, history: list[np.ndarray], measured: bool = False) -> DataFrame:
    """The vectors with their state after the last round of ``history``, or with cluster and distance if ``measured``."""
    shared, components = rows.sparkSession.sparkContext.broadcast(history), history[0].shape[1]
    known = "cluster" in rows.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch["v"], components)
            state = {c: batch[c].to_numpy(zero_copy_only=False) for c in _STATE} if known else None
            after, _ = assign(vectors, state, shared.value)
            if measured:
                distance = np.minimum(squared_to_own(vectors, shared.value[-1][after["cluster"]]), _LARGEST).astype(np.int64)
                columns, names = [batch["vec_id"], pa.array(after["cluster"]), pa.array(distance)], ["vec_id", "cluster", "distance"]
            else:
                columns, names = [batch["vec_id"], batch["v"], *map(pa.array, after.values())], ["vec_id", "v", *_STATE]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(scan, "vec_id bigint, cluster int, distance bigint" if measured else f"vec_id bigint, v array<bigint>, {_STATE_TYPES}")


def _changes(rows: DataFrame, components: int) -> DataFrame:
    """What the vectors that changed their cluster add to and take from its sums: (cluster, place, total); place -1 counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = _matrix(batch["v"], components)
            kind = np.int64 if max(-int(vectors.min(initial=0)), int(vectors.max(initial=0))) <= _SHORT else object
            counted = np.hstack([np.ones((len(vectors), 1), np.int64), vectors]).astype(kind)
            for column, sign in (("cluster", 1), ("was", -1)):
                cluster = batch[column].to_numpy(zero_copy_only=False)
                for c in np.unique(cluster[cluster >= 0]).tolist():
                    total = counted[cluster == c].sum(axis=0).astype(object) * sign
                    totals[c] = totals[c] + total if c in totals else total
        for c, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c] * len(total), pa.int32()),
                    pa.array(range(-1, components), pa.int32()),
                    pa.array([Decimal(int(x)) for x in total], pa.decimal128(38, 0)),
                ],
                ["cluster", "place", "total"],
            )

    moved = rows.where("cluster <> was").select("v", "cluster", "was")
    return moved.mapInArrow(add, "cluster int, place int, total decimal(38,0)").groupBy("cluster", "place").agg(F.sum("total").alias("total"))


def _moved_centroids(rows: DataFrame, sums: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bring ``sums`` up to date, in place, and give the floors of the means; an empty cluster stays where it was."""
    components = last.shape[1]
    # At most one number per centroid and component.
    for r in _changes(rows, components).collect():
        sums[r.cluster, r.place + 1] += int(r.total)
    means = [[x // total[0] for x in total[1:]] if total[0] else own for total, own in zip(sums.tolist(), last.tolist())]
    return np.array(means, np.int64).reshape(-1, components)


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = 2
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` for every usable vector."""
    spark = vectors.sparkSession
    with temporary_tables(spark):
        rows = cut_lineage(whole_vectors(vectors, components, scale))
        history = [first_centroids(rows, clusters, seed, components)]
        if not len(history[0]):
            return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        sums = np.zeros((len(history[0]), components + 1), object)
        for _ in range(rounds):
            rows = cut_lineage(_after_round(rows, history))
            history.append(_moved_centroids(rows, sums, history[-1]))
        found = cut_lineage(_after_round(rows, history, measured=True), outlive=True)
    per_cluster = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = min(sum(per_cluster.values()), _LARGEST)
    told = [
        (c, min(total, _LARGEST), whole, hashlib.sha256(",".join(map(str, history[-1][c].tolist())).encode()).hexdigest())
        for c, total in per_cluster.items()
    ]
    # One row per centroid.
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
