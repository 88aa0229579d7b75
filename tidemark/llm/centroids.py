"""Centroid clustering over zone maps: vectors in Hilbert order, blocks with boxes, exact integer rounds.

Vectors are quantised and ordered along a Hilbert curve once.  Runs of the curve are written as blocks: ids,
a matrix and the least and largest value of every component.  In each round a block compares its vectors
only with the centroids that its box can't rule out: those whose least distance to the box is at most the
smallest of all largest distances, and that no other centroid is nearer than in every corner of the box.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import stored

DIMS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
#: Vectors of a block at most.
BLOCK = 256
#: Bits of each component in the curve's key.
BITS = 4
#: Components beyond this (after scaling) have distances that a long can't hold.
LARGEST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys, ``bits * dims / 8`` bytes each, of points on a grid of 2**bits cells a side.

    Every level of the curve turns the cube below it: lower bits are swapped or flipped, a
    bit of all points at a time, then a Gray code runs over the components.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            set_ = (x[d] & high) != 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_, low, swap)
            if d:
                x[d] ^= swap
    x[1:] = np.bitwise_xor.accumulate(x, axis=0)[1:]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    planes = np.stack([(x[d] >> level) & 1 for level in range(bits - 1, -1, -1) for d in range(dims)], 1)
    return np.packbits(planes.astype(np.uint8), axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _keys(low: list[int], high: list[int], bits: int):
    lo, span = np.array(low, np.int64), np.array(high, np.int64) - np.array(low, np.int64) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_x"), len(lo))
            key = hilbert_keys(((x - lo) << bits) // span, bits)
            yield pa.record_batch({"_id": batch.column("_id"), "_x": batch.column("_x"),
                                   "_key": pa.array([k.tobytes() for k in key], pa.binary())})
    return run


def _blocks(dims: int, size: int):
    """Runs of a partition's vectors, at most ``size`` each, with their boxes."""
    longs = pa.list_(pa.int64())

    def block(ids: list, x: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"ids": pa.array([ids], longs), "x": pa.array([x.astype("<i4").tobytes()], pa.binary()),
                                "low": pa.array([x.min(0).tolist()], longs), "high": pa.array([x.max(0).tolist()], longs)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for batch in batches:
            x = _matrix(batch.column("_x"), dims)
            more = batch.column("_id").to_pylist()
            for a in range(0, len(more), size):
                ids, parts = ids + more[a:a + size], [*parts, x[a:a + size]]
                if len(ids) >= size:
                    whole = np.concatenate(parts)
                    yield block(ids[:size], whole[:size])
                    ids, parts = ids[size:], [whole[size:]]
        if ids:
            yield block(ids, np.concatenate(parts))
    return run


def candidates(low: np.ndarray, high: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Centroids that may be nearest to some point of the box, ascending; ties keep both."""
    below, above = low - centers, centers - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
    largest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1)
    near = np.flatnonzero(least <= largest.min())
    if len(near) < 2:
        return near
    # |x - c|^2 - |x - best|^2 is linear in x, so a corner of the box has its least value
    c, best = centers[near], centers[near[np.argmin(least[near] + largest[near])]]
    slope = 2 * (best - c)
    corner = np.where(slope > 0, slope * low, slope * high).sum(1)
    return near[corner + (c ** 2).sum(1) - (best ** 2).sum() <= 0]


def nearest(x: np.ndarray, centers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each vector among ``at``; ties go to the smaller number, all exact."""
    c = centers[at]
    most = max(int(np.abs(x).max()), int(np.abs(c).max()))
    if 4 * x.shape[1] * most * most < 1 << 53:  # then every sum is a whole number that a double holds
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        d = (xf ** 2).sum(1)[:, None] - 2 * xf @ cf.T + (cf ** 2).sum(1)
    else:
        d = np.stack([((x - one) ** 2).sum(1) for one in c], 1)
    best = np.argmin(d, axis=1)
    return at[best], d[np.arange(len(x)), best].astype(np.int64)


def _assign(batches: Iterator[pa.RecordBatch], centers: np.ndarray):
    for batch in batches:
        for ids, x, low, high in zip(*(batch.column(c) for c in ("ids", "x", "low", "high"))):
            x = np.frombuffer(x.as_buffer(), "<i4").astype(np.int64).reshape(-1, centers.shape[1])
            box = (np.array(v.as_py(), np.int64) for v in (low, high))
            yield ids, x, *nearest(x, centers, candidates(*box, centers))


def _sums(centers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centers.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x, cluster, _ in _assign(batches, centers):
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            total[cluster[order][first]] += np.add.reduceat(x[order], first, axis=0)
        full = np.flatnonzero(n)
        yield pa.record_batch({"cluster": pa.array(full, pa.int32()), "n": pa.array(n[full], pa.int64()),
                               "total": pa.array(total[full].tolist(), pa.list_(pa.int64()))})
    return run


def _assigned(centers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _assign(batches, centers):
            yield pa.record_batch({"_id": ids.values, "cluster": pa.array(cluster, pa.int32()),
                                   "distance": pa.array(distance, pa.int64())})
    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS,
              scale: int = SCALE) -> DataFrame:
    """(_id, _x) of the vectors with ``dims`` components, none null or not finite: floor(scale * component)."""
    x = F.col("_v")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    wide = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    fine = wide.filter((F.size(x) == dims) & F.forall(x, finite))
    fits = fine.filter(F.forall(x, lambda v: F.abs(v) < LARGEST // scale))
    return fits.select("_id", F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("_x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``, in its order: k rows come to the driver."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    picked = rows.withColumn("_h", F.sha2(name, 256)).orderBy("_h", "_x").limit(k).collect()
    return np.array([r["_x"] for r in picked], np.int64)


def zone_blocks(rows: DataFrame, dims: int, bits: int = BITS, size: int = BLOCK) -> DataFrame:
    """(ids, x, low, high): runs of the Hilbert order, written to the shared folder.

    A range of the curve is a partition; rows of one key are told apart by their id and place, so that
    a vector that occurs very often fills many blocks of many partitions.
    """
    span = rows.agg(*[f(F.col("_x")[d]).alias(f"{f.__name__}{d}") for f in (F.min, F.max) for d in range(dims)]).first()
    run = _keys(list(span[:dims]), list(span[dims:]), bits)
    keyed = rows.mapInArrow(run, "_id long, _x array<long>, _key binary").withColumn("_row", F.monotonically_increasing_id())
    order = ["_key", "_id", "_row"]
    return stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_x")
                  .mapInArrow(_blocks(dims, size), "ids array<long>, x binary, low array<long>, high array<long>"), "zones")


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTROIDS,
                    rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE,
                    bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """A row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components are taken as floor(scale * x).  ``rounds`` times, every vector goes to its nearest centroid
    (squared Euclidean distance; ties: smaller number) and every centroid that has vectors becomes their
    componentwise floor of sum / count; then vectors are assigned once more.  All of it is exact.

    Left out: vectors that are null, of another length, with a null or non-finite component, or with one
    beyond 2**27 after scaling, whose distances no long holds.  Fewer than k vectors make as many centroids;
    an empty table has no rows.  Repeated rows count each, equal centroids keep the smaller number, a null
    id counts as empty text in the first choice; other columns aren't read.
    """
    rows = stored(quantised(vectors, id_col, vec_col, dims, scale), "quantised")
    centers = first_centroids(rows, k, seed)
    if not len(centers):
        empty = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    zones = zone_blocks(rows, dims, bits, block)
    for _ in range(rounds):
        parts = zones.mapInArrow(_sums(centers), "cluster int, n long, total array<long>")
        sums = parts.groupBy("cluster").agg(F.sum("n"), F.array(*[F.sum(F.col("total")[d].cast("decimal(38,0)")) for d in range(dims)]))
        centers = centers.copy()
        for number, n, total in sums.collect():  # one row a centroid
            centers[number] = [int(t) // n for t in total]
    assigned = stored(zones.mapInArrow(_assigned(centers), "_id long, cluster int, distance long"), "assigned")
    digest = F.element_at(F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centers.tolist()]),
                          F.col("cluster") + 1)
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    own: Column = F.element_at(F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centers))]), F.col("cluster") + 1)
    return assigned.select(F.col("_id").alias(id_col), "cluster", "distance", own.alias("cluster_inertia"),
                           F.lit(sum(inertia.values())).cast("long").alias("inertia"), digest.alias("centroid_sha256"))
