"""Evaluation aggregates vs brute force on small hand-made inputs."""

import itertools
import random

import numpy as np
import pytest

from tidemark.operators import labels as lb
from tidemark.operators import metrics as mt
from tidemark.operators import thresholds as th
from tidemark.sources.policy import policy

POL = policy("code")


def test_absent_class_gives_zero_cells(spark):
    df = spark.createDataFrame([(0, 0), (0, 3), (3, 3), (3, 3)], "y_true long, y_pred long")
    ovr = {r["cls"]: r for r in mt.one_vs_rest_counts(df).collect()}
    assert set(ovr) == {0, 3}
    assert (ovr[0]["tp"], ovr[0]["fn"], ovr[0]["fp"], ovr[0]["tn"]) == (1, 1, 0, 2)
    assert (ovr[3]["tp"], ovr[3]["fn"], ovr[3]["fp"], ovr[3]["tn"]) == (2, 0, 1, 1)
    u = mt.clinical_utility(df, POL).first()
    # class 0 high risk: fn 1 x 10; class 3 moderate: fp 1 x 2; max = 4*10 + 4*5
    assert u["total_cost"] == 12.0 and u["max_possible_cost"] == 60.0
    assert abs(u["utility_score"] - (1 - 12 / 60)) < 1e-12


def test_tie_scores_first_class_wins(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, [0.25, 0.25, 0.25, 0.25])], "row_id long, proba array<double>")
    assert df.select(lb.argmax_expr(F.col("proba")).alias("c")).first()["c"] == 0
    long = spark.createDataFrame([(1, c, 0.25) for c in range(4)], "row_id long, cls long, p double")
    assert lb.argmax_long(long).first()["y_pred"] == 0


def test_apply_thresholds_priority_order(spark):
    from pyspark.sql import functions as F
    # class 2 (high, tau .30) and class 6 (low, tau .50) both pass: high risk wins
    p = [0.0, 0.0, 0.31, 0.0, 0.0, 0.0, 0.69, 0.0]
    df = spark.createDataFrame([(1, p)], "row_id long, proba array<double>")
    assert df.select(lb.apply_thresholds_expr(F.col("proba"), POL).alias("y")).first()["y"] == 2
    # nothing passes -> argmax
    p2 = [0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.3, 0.1]
    df2 = spark.createDataFrame([(1, p2)], "row_id long, proba array<double>")
    assert df2.select(lb.apply_thresholds_expr(F.col("proba"), POL).alias("y")).first()["y"] == 6


def _auc_brute(pos, neg):
    s = 0.0
    for a, b in itertools.product(pos, neg):
        s += 1.0 if a > b else (0.5 if a == b else 0.0)
    return s / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [0, 1])
def test_auc_matches_pair_counting(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(300):
        y = rnd.randint(0, 2)
        for c in range(3):
            rows.append((i, y, c, round(rnd.random(), 2) + (0.2 if c == y else 0.0)))
    df = spark.createDataFrame(rows, "row_id long, y_true long, cls long, p double")
    got = {r["cls"]: r["auc"] for r in mt.auc_per_class(df).collect()}
    for c in range(3):
        pos = [p for (_, y, cc, p) in rows if cc == c and y == c]
        neg = [p for (_, y, cc, p) in rows if cc == c and y != c]
        assert abs(got[c] - _auc_brute(pos, neg)) < 1e-12


def test_prefix_sums_many_buckets(spark):
    rnd = random.Random(3)
    rows = [(k, float(v), rnd.randint(1, 5)) for k in range(2) for v in rnd.sample(range(10000), 500)]
    df = spark.createDataFrame(rows, "k long, o double, v long")
    got = {(r["k"], r["o"]): r["v_before"] for r in mt.prefix_sums(df, ["k"], "o", ["v"], n_buckets=16).collect()}
    for k in range(2):
        acc = 0
        for (kk, o, v) in sorted([r for r in rows if r[0] == k], key=lambda r: r[1]):
            assert got[(k, o)] == acc
            acc += v


def test_sweep_counts_sum_to_n_and_match_bruteforce(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 1), round(rnd.random(), 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, y_true long, score double")
    grid = th.grid()
    sw = {r["threshold"]: r for r in th.threshold_sweep(df, fn_cost=10, fp_cost=1).collect()}
    assert len(sw) == 100
    for t in grid:
        r = sw[t]
        assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == 400
        tp = sum(1 for _, y, s in rows if y == 1 and s >= t)
        fp = sum(1 for _, y, s in rows if y == 0 and s >= t)
        assert (r["tp"], r["fp"]) == (tp, fp)
    best = th.optimal_threshold(th.threshold_sweep(df, fn_cost=10, fp_cost=1)).first()
    costs = [(10 * sw[t]["fn"] + sw[t]["fp"], t) for t in grid]
    assert best["optimal_threshold"] == min(costs)[1]


def fbeta_ref(tp, fp, fn, b):
    d = (1 + b * b) * tp + b * b * fn + fp
    return (1 + b * b) * tp / d if d else 0.0


def test_weighted_f_score_bruteforce(spark):
    y = [0, 0, 1, 1, 2, 6, 7, 7]
    p = [0, 1, 1, 1, 2, 7, 7, 6]
    df = spark.createDataFrame(list(zip(y, p)), "y_true long, y_pred long")
    got = mt.weighted_f_score(df, POL, 2.0).first()["weighted_f_score"]
    exp = 0.0
    for c in sorted(set(y) | set(p)):
        lvl = POL.risk_of(c)
        b = 3.0 if lvl == "high_risk" else (1.5 if lvl == "low_risk" else 2.0)
        tp = sum(1 for a, q in zip(y, p) if a == c and q == c)
        fp = sum(1 for a, q in zip(y, p) if a != c and q == c)
        fn = sum(1 for a, q in zip(y, p) if a == c and q != c)
        exp += fbeta_ref(tp, fp, fn, b) * sum(1 for a in y if a == c) / len(y)
    assert abs(got - exp) < 1e-12
    hr = mt.high_risk_recall(df, POL).first()["high_risk_recall"]
    assert abs(hr - (1 + 2 + 1) / 5) < 1e-12


def test_bootstrap_ci_is_distribution(spark):
    rows = [(i, i % 3, (i * 7) % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, y_true long, y_pred long")
    per, summ = mt.bootstrap_metric_ci(df, POL, n_boot=50)
    assert per.count() == 50
    acc = {r["metric"]: r for r in summ.collect()}["accuracy"]
    assert acc["ci_lower"] <= acc["mean"] <= acc["ci_upper"]
    assert np.isfinite(acc["std"])
