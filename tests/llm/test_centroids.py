"""Centroid clustering: SQL oracle, brute force with whole numbers, curve keys and box bounds."""

import hashlib
import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import centroids
from tidemark.llm.queries import ORACLE, QUERIES
from tools.oracle_check import duck, rows_of

SF = "/root/testdata/sf0.001"


def test_oracle(spark):
    df = QUERIES["op13_centroid_clustering"](spark, SF)
    res = duck(SF).execute(ORACLE["op13_centroid_clustering"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in res.description], res.fetchall())


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * v) for v in x]) for i, x in rows
            if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centers = [x for _, _, x in sorted((name(i), x, x) for i, x in kept)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers)) for _, x in kept]
    for _ in range(rounds):
        at = [j for _, j in assign()]
        for j in range(len(centers)):
            own = [x for (_, x), a in zip(kept, at) if a == j]
            if own:
                centers[j] = [sum(v) // len(own) for v in zip(*own)]
    best = assign()
    inertia = [sum(d for d, j in best if j == c) for c in range(len(centers))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, inertia[j], sum(inertia), digest[j]) for (i, _), (d, j) in zip(kept, best)), key=repr)


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) + 3 * (i % 4)).tolist()) for i in range(400)]
    rows += [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0, None, 0.0, 0.0, 0.0]), (904, [float("nan")] + [0.0] * 4),
             (905, [float("inf")] + [0.0] * 4), (906, [float("-inf")] + [0.0] * 4), (None, [0.5] * 5), (None, [0.25] * 5)]
    rows += [(1000 + i, [2.0, -1.0, 0.0, 0.5, 0.001]) for i in range(300)] + [(7, [9.0] * 5)] * 3
    rows += [(2000, [400_000.0, -400_000.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, 0, "c") for i, x in rows], "vec_id long, embedding array<double>, cluster int, _x string")
    for k, block, bits in [(6, 16, 3), (40, 1, 8)]:
        out = centroids.cluster_vectors(df.repartition(5), k=k, dims=5, block=block, bits=bits)
        assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows, k, 5, 5)
    few = df.filter("vec_id in (3, 4, 900)")
    assert sorted(map(tuple, centroids.cluster_vectors(few, dims=5).collect())) == brute([r for r in rows if r[0] in (3, 4, 900)], 40, 5, 5)
    assert centroids.cluster_vectors(df.limit(0), dims=5).count() == 0
    assert centroids.cluster_vectors(df.filter("vec_id = 901"), dims=5).count() == 0


def test_curve_visits_neighbours():
    for dims, bits in [(2, 3), (3, 2), (4, 2)]:
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = [k.tobytes() for k in centroids.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_candidates_keep_every_nearest():
    rng = np.random.default_rng(5)
    fewer = 0
    for _ in range(200):
        centers = rng.integers(-40, 40, (12, 4))
        centers[3] = centers[7]
        x = rng.integers(-40, 40, 4) + rng.integers(-6, 7, (30, 4))
        near = centroids.candidates(x.min(0), x.max(0), centers)
        d = ((x[:, None] - centers[None]) ** 2).sum(2)
        cluster, distance = centroids.nearest(x, centers, near)
        assert np.array_equal(cluster, d.argmin(1)) and np.array_equal(distance, d.min(1))
        fewer += len(near) < 12
    assert fewer > 150


def test_large_components_are_exact():
    x, centers = np.array([[1 << 27, -(1 << 27), 3]]), np.array([[-(1 << 27), 1 << 27, 0], [-(1 << 27), 1 << 27, 1]])
    cluster, distance = centroids.nearest(x, centers, np.array([0, 1]))
    assert cluster.tolist() == [1] and distance.tolist() == [2 * (1 << 28) ** 2 + 4]


def test_a_hot_vector_fills_many_blocks(spark):
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.5)] * 64).alias("embedding"))
    zones = centroids.zone_blocks(centroids.quantised(df), 64)
    assert zones.count() >= 8 and zones.agg(F.max(F.size("ids"))).first()[0] <= 256
