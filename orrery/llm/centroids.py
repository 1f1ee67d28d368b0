"""Lloyd's clustering of integer vectors with an incremental distance matrix.

Each vector keeps its exact dot products with all centroids. A round changes a dot product only by the components of a
centroid that have changed, times the vector's own; squared distances follow from the dot products and the norms, and
their argmin is taken anew. Sums of clusters are kept the same way: only vectors that change their cluster add to the
new one's and take from the old one's. A round reads the state of the one before and writes its own as a table, which
takes that one's place; what reaches the driver are the sums, one row for each cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import dropped, written

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
SEED = "3"
#: Largest squared norm of a vector: distances of any two such vectors fit in 64 bits.
LARGEST = 1 << 60


def _floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of components as integers. Vectors beyond ``LARGEST`` have no distance in 64 bits: an error."""
    scaled = np.floor(values * float(scale))
    if len(scaled) and (scaled * scaled).sum(axis=1).max() > LARGEST:
        raise ValueError(f"a vector's squared norm, components times {scale}, is beyond 2**60: distances don't fit in 64 bits")
    return scaled.astype(np.int64)


def _quantized(size: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _floors(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(q.astype(np.int32))], names=["vec_id", "q"])

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), flat)


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of vectors with exactly ``size`` components, none null or non-finite."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    good = (F.size(F.col(embedding)) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(vec_id).alias("vec_id"), v.alias("v")).mapInArrow(_quantized(size, scale), "vec_id long, q array<int>")


def starting(held: DataFrame, centroids: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest sha256, in that order; null ids come last, repeated ids by components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = held.select(digest.alias("digest"), "q").orderBy(F.col("digest").asc_nulls_last(), "q").limit(centroids).collect()
    return np.array([r["q"] for r in rows], np.int64)


def _round(old: np.ndarray | None, new: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """State after a change of the centroids from ``old`` to ``new``; without ``old`` the dot products are made."""
    changes = new if old is None else new - old
    norms = (new * new).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, new.shape[1])
            if old is None:
                dots, before = np.zeros((len(q), len(new)), np.int64), np.full(len(q), -1, np.int32)
            else:
                dots = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(new)).copy()
                before = batch.column(3).to_numpy(zero_copy_only=False)
            for k, change in enumerate(changes):
                at = np.flatnonzero(change)
                if len(at):
                    dots[:, k] += q[:, at].astype(np.int64) @ change[at]
            own = np.einsum("ij,ij->i", q, q, dtype=np.int64)
            far = own[:, None] - 2 * dots + norms
            cluster = far.argmin(axis=1).astype(np.int32)  # of equal distances the smaller number
            distance = far[np.arange(len(far)), cluster]
            arrays = [batch.column(0), batch.column(1), _lists(dots), pa.array(cluster), pa.array(before), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "q", "dots", "cluster", "before", "distance"])

    return run


_STATE = "vec_id long, q array<int>, dots array<long>, cluster int, before int, distance long"


def _sums(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per batch (cluster, count, sums) of vectors that came into a cluster, less those that left it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)
            to, before = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            numbers = np.unique(np.concatenate([to, before[before >= 0]]))
            n = np.array([(to == k).sum() - (before == k).sum() for k in numbers])
            total = np.array([q[to == k].sum(axis=0) - q[before == k].sum(axis=0) for k in numbers]).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(n, pa.int64()), _lists(total)], names=["cluster", "n", "sums"])

    return run


def _moved(state: DataFrame, size: int) -> list:
    """(cluster, change of its count, change of its sums): exact, as decimals beyond 64 bits, one row for each cluster."""
    parts = state.filter("cluster <> before").select("q", "cluster", "before").mapInArrow(_sums(size), "cluster int, n long, sums array<long>")
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    return parts.groupBy("cluster").agg(F.sum("n"), F.array(*[wide(F.col("sums")[i]) for i in range(size)])).collect()


def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, the final centroids).

    A round assigns vectors to the nearest centroid (squared Euclidean distance, of equals the smaller number) and sets
    every centroid that has vectors to the floor of their mean; at the end vectors are assigned once more. Once no
    centroid changes the rounds to come would change nothing and are left out. Vectors that aren't kept (null, of
    another length, with null or non-finite components) have no row. Repeated rows and rows with a null id are vectors
    like others. With fewer vectors than centroids there are as many centroids as vectors, and of an empty table no rows.
    Components times ``scale`` must keep a squared norm of 2**60, else the job fails and says so. Other columns don't matter.
    """
    held = written(quantized(vectors, vec_id, embedding, size, scale), "centroid-vectors")
    now = starting(held, centroids, seed)
    if not len(now):
        return held.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    state = written(held.mapInArrow(_round(None, now), _STATE), "centroid-state")
    dropped(held)
    counts, sums = [0] * len(now), [[0] * size for _ in now]
    for _ in range(rounds):
        for k, n, own in _moved(state, size):
            counts[k] += n
            sums[k] = [a + int(b) for a, b in zip(sums[k], own, strict=True)]
        after = np.array([[s // n for s in own] if n else list(c) for n, own, c in zip(counts, sums, now.tolist(), strict=True)], np.int64)
        if (after == now).all():
            break
        held, state = state, written(state.mapInArrow(_round(now, after), _STATE), "centroid-state")
        dropped(held)
        now = after
    return state.select("vec_id", "cluster", "distance"), now


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256; one row for each cluster is gathered for that."""
    own = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1) if values else F.lit(None).cast(kind)
    return assigned.select(
        "vec_id", "cluster", "distance", pick([own.get(k, 0) for k in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(sum(own.values())).cast("long").alias("inertia"),
        pick(digest, "string").alias("centroid_sha256"),
    )
