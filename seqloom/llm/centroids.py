"""Centroid clustering: Lloyd rounds with exponion search over whole-number vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import keep, only_kept

#: Components are whole numbers within this bound, so that squared distances of up to 127 of them fit 64 bits.
MOST = 1 << 27
#: Rows for which distances are held at a time.
ROWS = 4096
#: By so much bounds in floating point are taken wider than they are.
SLACK = 1 + 1e-9


def whole_vectors(vectors: DataFrame, id_column: str, column: str, dim: int, scale: int) -> DataFrame:
    """vec_id, v (array<bigint> of floor(scale * x)) of the rows whose vector has exactly dim components, none
    null or not finite; others go.  A component beyond MOST is an error that names its row."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    fault = F.raise_error(F.concat(F.lit("a component is too large: "), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))
    fits = F.forall(x, lambda c: F.abs(c.cast("double") * scale) <= MOST)
    kept = vectors.where((F.size(x) == dim) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(id_column).alias("vec_id"), F.when(fits, scaled).otherwise(fault).alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors (fewer, if there are fewer rows) with the smallest sha256 of salt and vec_id; equal hashes by
    vector, null ids last.  A top-k, so only k rows reach the driver."""
    order = [F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("v").asc()]
    return np.array([r["v"] for r in rows.orderBy(*order).limit(k).collect()], np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class _Rings:
    """Centroids with, for each, all of them sorted by their distance to it (itself first)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, k = centroids, len(centroids)
        self.near = np.empty((k, k), np.int64)
        self.far = np.empty((k, k))
        for j in range(k):
            d = np.sqrt(_squares(centroids, centroids[j]).astype(float))
            d[j] = -1.0  # first, whatever equals it
            self.near[j] = np.argsort(d, kind="stable")
            d[j] = 0.0
            self.far[j] = d[self.near[j]]

    def search(self, x: np.ndarray, cluster: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, lower bound of the distance to all others) of each row, and how many
        distances to other centroids were taken.

        The distance u to the row's own centroid is taken first.  If every other centroid is surely
        farther, by the bound carried or by half the distance to the nearest other centroid, the row
        stays.  Else the nearest centroid, and the second nearest, lie within 2 u plus the distance
        to that nearest one around its own: they are a prefix of the sorted list.  The radius is
        inclusive, and of equally near centroids the smaller number wins."""
        own = _squares(x, self.centroids[cluster])
        if len(self.centroids) == 1:
            return cluster, own, np.full(len(x), np.inf), 0
        u = np.sqrt(own.astype(float))
        half = self.far[cluster, 1] / 2
        bound = np.maximum(lower, half)
        search = np.flatnonzero(u * SLACK >= bound)
        out, best, low, taken = cluster.copy(), own.copy(), bound.copy(), 0
        for a in np.unique(cluster[search]):
            rows = search[cluster[search] == a]
            radius = (2 * u[rows] + self.far[a, 1]) * SLACK
            many = np.searchsorted(self.far[a] , radius, "right")
            for m in np.unique(many):  # rows whose ball holds the same centroids
                these = rows[many == m]
                ring = np.sort(self.near[a, :m])
                d = np.stack([_squares(x[these], self.centroids[j]) for j in ring], axis=1)
                taken += d.size - len(these)
                at = d.argmin(1)  # the first of equals
                out[these], best[these] = ring[at], d[np.arange(len(these)), at]
                d[np.arange(len(these)), at] = np.iinfo(np.int64).max
                low[these] = np.sqrt(d.min(1).astype(float)) / SLACK
        return out, best, low, taken


def assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """state (vec_id, v, cluster, lower) with each row's nearest of the centroids: cluster, distance (squared), lower,
    looked_at (distances to other centroids that its batch took).

    moved: how far each centroid went since lower was right, or None for rows that have no cluster yet,
    which start at centroid 0 with no bound."""
    rings = _Rings(centroids)
    top = None if moved is None else np.sort(moved)[::-1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, len(batch), ROWS):
                part = batch.slice(b, ROWS)
                x = part.column(1).flatten().to_numpy().reshape(len(part), -1)
                cluster, lower = np.zeros(len(part), np.int64), np.zeros(len(part))
                if moved is not None:
                    cluster = part.column(2).to_numpy().astype(np.int64)
                    others = np.where(moved[cluster] == top[0], top[min(1, len(top) - 1)], top[0])  # the farthest move of another
                    lower = np.maximum((part.column(3).to_numpy() - others * SLACK) / SLACK, 0.0)
                cluster, distance, lower, taken = rings.search(x, cluster, lower)
                looked = np.zeros(len(part), np.int64)
                looked[0] = taken
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster, pa.int32()), pa.array(lower, pa.float64()), pa.array(distance, pa.int64()), pa.array(looked, pa.int64())], names=["vec_id", "v", "cluster", "lower", "distance", "looked_at"])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.select("vec_id", "v", "cluster", "lower").mapInArrow(search, f"vec_id {kind}, v array<bigint>, cluster int, lower double, distance long, looked_at long")


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each non-empty centroid replaced by the exact floor of its vectors' mean: one partial sum a cluster and task."""
    dim = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(dim))).alias("s")).collect()
    out = centroids.copy()
    for r in sums:
        out[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, salt: str = "1:", id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for every usable row of
    vectors (vec_id, embedding).

    Components become floor(scale * x).  Centroids start as the first k vectors by hash; each round
    assigns all rows and moves the centroids, and rows are assigned once more.  Every assignment
    is one pass over a kept table of vectors with their cluster and bound; k * dim numbers are all that
    meets on the driver or is sent to tasks.

    Rows with a vector of another length, or a null or non-finite component, give no row.  Repeated
    rows and ids give a row each; a null vec_id is kept and never a first centroid before others.
    Fewer usable rows than k: as many centroids.  No rows, no result; other columns are ignored.
    """
    with only_kept(vectors.sparkSession) as stay:
        rows = keep(whole_vectors(vectors, id_column, column, dim, scale))
        centroids, moved = first_centroids(rows, k, salt), None
        state = rows.select("*", F.lit(0).alias("cluster"), F.lit(0.0).alias("lower"))
        for _ in range(rounds if len(centroids) else 0):
            state = keep(assign(state, centroids, moved))
            new = moved_centroids(state, centroids)
            moved, centroids = np.sqrt(_squares(new, centroids).astype(float)), new
        if len(centroids):
            state = keep(assign(state, centroids, moved))
        else:
            state = state.withColumn("distance", F.lit(0).cast("long"))
        sums = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
        digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

        def of(values: list) -> Column:
            return F.get(F.array(*map(F.lit, values)), F.col("cluster")) if values else F.lit(None)

        return stay(state.select(
            "vec_id", "cluster", "distance", of([sums.get(i, 0) for i in range(len(digests))]).cast("long").alias("cluster_inertia"),
            F.lit(sum(sums.values())).cast("long").alias("inertia"), of(digests).cast("string").alias("centroid_sha256"),
        ))
