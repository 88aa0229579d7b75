"""Exact k-NN imputation vs a brute-force numpy implementation of the same rule."""

import math
import random

import numpy as np
import pytest

from tidemark.operators.clean import impute_knn


def brute(rows, cols, k):
    X = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], dtype=float)
    ids = [r[0] for r in rows]
    mu = np.nanmean(X, axis=0)
    sd = np.nanstd(X, axis=0, ddof=1)
    Z = (X - mu) / np.where(sd > 0, sd, 1.0)
    Z = np.where(sd > 0, Z, X)
    out = Z.copy()
    p = len(cols)
    for ci in range(p):
        donors = [i for i in range(len(rows)) if not np.isnan(Z[i, ci])]
        col_mean = np.nanmean(Z[:, ci])
        for i in range(len(rows)):
            if not np.isnan(Z[i, ci]):
                continue
            cand = []
            for d in donors:
                common = ~np.isnan(Z[i]) & ~np.isnan(Z[d])
                if common.sum() == 0:
                    continue
                dist = math.sqrt(p / common.sum() * np.sum((Z[i, common] - Z[d, common]) ** 2))
                cand.append((math.floor(dist * 1e9 + 0.5), ids[d], Z[d, ci]))
            cand.sort()
            out[i, ci] = np.mean([c[2] for c in cand[:k]]) if cand else col_mean
    return {ids[i]: out[i] for i in range(len(rows))}


@pytest.mark.parametrize("seed,bucket", [(1, 8), (3, 64)])
def test_knn_matches_bruteforce(spark, seed, bucket):
    rnd = random.Random(seed)
    cols = ["a", "b", "c"]
    rows = []
    for i in range(200):
        vals = [rnd.gauss(0, 1), float(rnd.randint(0, 6)), rnd.random() * 50]
        vals = [None if rnd.random() < 0.15 else v for v in vals]
        rows.append((i, *vals))
    rows.append((1000, None, None, None))               # no common coordinate -> column mean
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r["id"]: [r[c] for c in cols] for r in impute_knn(df, "id", cols, k=5, bucket_size=bucket).collect()}
    exp = brute(rows, cols, 5)
    for i, e in exp.items():
        assert np.allclose(got[i], e, rtol=0, atol=1e-9), (i, got[i], e)


def test_knn_work_follows_near_cells(spark, monkeypatch):
    """Columns of few values: a missing value is compared with the rows of near cells, not with a share of the table."""
    import tidemark.operators.neighbours as nb
    rnd = random.Random(5)
    rows = [(i, float(rnd.randint(0, 9)), rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(6000)]
    rows = [(i, a, None if i % 30 == 0 else b, c) for i, a, b, c in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    seen = []
    keep = nb.stored
    monkeypatch.setattr(nb, "stored", lambda d, name: seen.append((name, keep(d, name))) or seen[-1][1])
    got = {r["id"]: [r[c] for c in "abc"] for r in impute_knn(df, "id", ["a", "b", "c"], bucket_size=64).collect()}
    exp = brute(rows, ["a", "b", "c"], 5)
    assert all(np.allclose(got[i], e, rtol=0, atol=1e-9) for i, e in exp.items())
    found = {name: d.count() for name, d in seen}
    assert found["knn-near"] == 200 * 5 and found["knn-far"] < 200 * 5 * 15     # of about 100 cells


def test_knn_cells_are_cut_along_known_columns(spark, monkeypatch):
    """Rows that lack several columns find their donors in cells cut along the ones they have, not in all slices of the others."""
    import tidemark.operators.neighbours as nb
    rnd = random.Random(7)
    rows = [(i, *(rnd.gauss(0, 1) for _ in range(5))) for i in range(1500)]
    rows = [(*r[:3], None, None, None) if r[0] % 30 == 0 else r for r in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double")
    seen = {}
    keep = nb.stored
    monkeypatch.setattr(nb, "stored", lambda d, name: seen.setdefault(name, keep(d, name)))
    got = {r["id"]: [r[c] for c in "abcde"] for r in impute_knn(df, "id", [*"abcde"], bucket_size=16).collect()}
    assert all(np.allclose(got[i], e, rtol=0, atol=1e-9) for i, e in brute(rows, [*"abcde"], 5).items())
    assert seen["knn-near"].count() == 50 * 3 * 5 and seen["knn-far"].count() < 50 * 3 * 5 * 4     # of about 100 cells


def test_knn_trees_are_searched_from_their_roots():
    """All near leaves are found, and a row is compared with few nodes of the tree, not with every cell."""
    import tidemark.operators.neighbours as nb
    x = np.random.default_rng(3).normal(size=(4000, 3))
    every, asked = (np.packbits(b).tobytes() for b in ([1, 1, 1], [1, 1, 0]))
    forest = nb.Forest(x, [(every, len(x))], [asked], 16, 16)
    leaf = forest.leaf(x, np.full(len(x), forest.roots[0][every]))
    forest.bound([{"_leaf": int(v), "_c": int((leaf == v).sum()), **{f"{k}{i}": f(x[leaf == v, i]) for i in range(3)
                   for k, f in (("n", len), ("l", np.min), ("h", np.max))}} for v in np.unique(leaf)], 3, 16)
    ask = np.column_stack([x[:200, :2], np.full(200, np.nan)])
    pairs, least = [], forest.least
    forest.least = lambda x, col, row, node: pairs.append(len(row)) or least(x, col, row, node)
    got = sorted((int(r), int(v)) for rows, leaves in forest.within(ask, np.full(200, 2), np.full(200, 0.1)) for r, v in zip(rows, leaves))
    far = np.sqrt(1.5 * ((ask[:, None, :2] - x[None, :, :2]) ** 2).sum(2))
    assert {(i, int(leaf[j])) for i, j in zip(*np.nonzero(far <= 0.1))} <= set(got) and len(set(got)) == len(got)
    assert sum(pairs) < 200 * 60 and len(np.unique(leaf)) > 250
