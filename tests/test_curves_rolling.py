"""Curve areas against sorted trapezoids, rolling means in blocks against the plain window, seeded draws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import longitudinal as lg
from tidemark.operators import metrics as mt
from tidemark.operators import splits as sp
from tidemark.sources.policy import policy


def areas(pairs):
    """Areas by the trapezoid rule over points sorted by falling score."""
    P, N = sum(y for _, y in pairs), sum(1 - y for _, y in pairs)
    points, pr = [(0.0, 0.0)], [(0.0, 1.0)]
    for s in sorted({s for s, _ in pairs}, reverse=True):
        tp, fp = sum(y for x, y in pairs if x >= s), sum(1 - y for x, y in pairs if x >= s)
        points.append((fp / N if N else np.nan, tp / P if P else np.nan))
        pr.append((tp / P if P else np.nan, tp / (tp + fp)))
    trapezoid = lambda xy: sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(xy, xy[1:]))
    return points, trapezoid(points), trapezoid(pr)


def test_areas_per_class_and_model(spark):
    rng = random.Random(1)
    data = {(m, c): [(round(rng.random(), 2 - (m == "b")), int(rng.random() < 0.3 + 0.1 * c)) for _ in range(200)] for m in "ab" for c in (1, 2)}
    data["a", 3] = [(0.5, 0), (0.7, 0)]
    data["b", 3] = [(0.5, 1), (0.5, 1)]
    rows = [(m, c, s, c if y else 0) for (m, c), pairs in data.items() for s, y in pairs]
    df = spark.createDataFrame(rows, "model string, cls long, p double, y_true long")
    got = {(r["model"], r["cls"]): r for r in mt.curve_areas(df, "p", "y_true", "cls", ["model"]).collect()}
    for key, pairs in data.items():
        points, roc, pr = areas(pairs)
        both = {y for _, y in pairs} == {0, 1}
        assert got[key]["roc_area"] == (pytest.approx(roc) if both else None)
        assert got[key]["pr_area"] == (pytest.approx(pr) if any(y for _, y in pairs) else None)
        if key == ("a", 1):
            curve = mt.roc_points(df.filter("model = 'a' and cls = 1"), "p", "y_true", "cls").collect()
            assert np.allclose(sorted((r["fpr"], r["tpr"]) for r in curve), sorted(points))
            assert [(r["fpr"], r["tpr"]) for r in curve if r["threshold"] is None] == [(0.0, 0.0)]
            assert len(mt.roc_points(df, "p", "y_true", "cls", ["model"]).filter("model = 'a' and cls = 1").collect()) == len(curve)
    assert mt.curve_areas(df.limit(0), "p", "y_true", "cls", ["model"]).count() == 0


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_rolling_in_blocks(spark, window):
    rng = random.Random(window)
    rows = [(i, t, None if rng.random() < 0.1 else rng.random()) for i, n in enumerate([100, 41, 40, 7, 3, 1]) for t in rng.sample(range(1000), n)]
    rows += [(99, 5, float(k)) for k in range(30)] + [(None, t, 1.0 * t) for t in range(50)]  # equal times; a null id
    df = spark.createDataFrame(rows, "id long, t long, v double")
    for fn in (lg.rolling_mean_centered, lg.rolling_mean_trailing):
        plain = fn(df, "id", "t", "v", window, hot_rows=None).filter("id is not null")
        for hot in (6, 40):
            split = fn(df.repartition(7), "id", "t", "v", window, hot_rows=hot).filter("id is not null")
            key = lambda r: (r["id"], r["t"], -1 if r["v"] is None else r["v"])
            a, b = sorted(plain.collect(), key=key), sorted(split.collect(), key=key)
            assert [key(r) for r in a] == [key(r) for r in b]
            assert [r["rolling_mean"] for r in a] == pytest.approx([r["rolling_mean"] for r in b], nan_ok=True)
    assert lg.rolling_mean_centered(df.limit(0), "id", "t", "v", 3).count() == 0


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 4).alias("y_true"), (F.col("id") % 7 % 4).alias("y_pred"))
    moved = df.repartition(9, F.rand(1))
    a, b = (sorted(map(tuple, sp.bootstrap_sample(d, "row_id").collect())) for d in (df, moved))
    assert a == b and abs(len(a) - 4000) < 5 * 4000 ** 0.5 and max(r[-1] for r in a) >= 3
    assert a != sorted(map(tuple, sp.bootstrap_sample(df, "row_id", 1).collect()))
    one, two = (mt.bootstrap_metric_ci(d, policy("code"), n_boot=40) for d in (df, moved))
    assert sorted(map(tuple, one[0].collect())) == sorted(map(tuple, two[0].collect()))
    accuracy = df.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int"))).first()[0]
    summary = {r["metric"]: r for r in one[1].collect()}
    spread = (accuracy * (1 - accuracy) / 4000) ** 0.5
    assert abs(summary["accuracy"]["mean"] - accuracy) < 4 * spread and 0.5 * spread < summary["accuracy"]["std"] < 2 * spread
