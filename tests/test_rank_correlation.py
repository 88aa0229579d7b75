"""Rank correlations against plain loops, with ties, nulls, hot values and forced blocks."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import rank_correlation as rc


def plain(x, y, method):
    keep = [(a, b) for a, b in zip(x, y) if a is not None and b is not None and a == a and b == b]
    if not keep:
        return None
    a, b = np.array(keep).T
    if method == "spearman":
        a, b = pd.Series(a).rank().to_numpy(), pd.Series(b).rank().to_numpy()
        return float(np.corrcoef(a, b)[0, 1]) if a.std() and b.std() else None
    sx, sy = np.sign(a[:, None] - a[None]), np.sign(b[:, None] - b[None])
    d = np.sqrt(float((sx != 0).sum()) * float((sy != 0).sum()))
    return float((sx * sy).sum() / d) if d else None


def test_inversions():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50):
        x, y, w = rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float), rng.integers(1, 5, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
        assert rc.inversions(x, y, w) == want
        if n == 50:  # beyond 64 bits
            assert rc.inversions(x, y, w * 10 ** 11) == want * 10 ** 22


@pytest.mark.parametrize("method,block", [("spearman", rc.BLOCK), ("kendall", rc.BLOCK), ("kendall", 12)])
def test_matrix(spark, method, block):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(220):
        a = float(rng.normal())
        b = None if i % 11 == 0 else float(round(a + rng.normal(), 1))
        c = 7 if i % 3 == 0 else int(rng.integers(-4, 5))        # one value holds over a third
        d = float("nan") if i % 50 == 0 else float(rng.integers(0, 3)) - a
        rows.append((a, b, c, d, 1.0, None, i))
    cols = ["a", "b", "c", "d", "same", "none"]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, same double, none double, x long")
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in rc.rank_correlation_matrix(df, cols, method, block=block).collect()}
    assert len(got) == len(cols) ** 2
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            want = plain([r[i] for r in rows], [r[j] for r in rows], method)
            assert (got[a, b] is None and want is None) or abs(got[a, b] - want) < 1e-9, (a, b)


def test_empty(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert [r["r"] for r in rc.rank_correlation_matrix(df, ["a", "b"], "kendall").collect()] == [None] * 4
    assert rc.rank_correlation_matrix(df, ["a"], "spearman", upper_only=True).count() == 0
    with pytest.raises(ValueError):
        rc.rank_correlation_matrix(df, ["a", "b"], "pearson")
