"""Evaluation loops: AUC and class scores of a fold against its own predictions, class mix per period."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as md
from tidemark.operators import splits as sp
from tidemark.operators import validation as va
from tidemark.sources.policy import policy

POL = policy("code")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = [(i, (y := rng.choice([0, 0, 1, 5])) + rng.gauss(0, 2), rng.gauss(0, 1), y, 2000 + i % 5) for i in range(400)]
    return spark.createDataFrame(out, "row_id long, a double, b double, label long, year long").persist()


def test_fold_scores(rows):
    got = va.cross_validate(rows, ["a", "b"], POL, "decision_tree", k=2, maxDepth=3)
    per = {r["fold"]: r for r in got.per.collect()}
    classes = {(r["fold"], r["cls"]): r for r in got.classes.collect()}
    folds = sp.risk_stratified_kfold(rows, "row_id", POL, "label", 2)
    for f in (0, 1):
        b = md.fit_cost_sensitive(folds.where(F.col("fold") != f).drop("fold"), ["a", "b"], POL, "decision_tree",
                                  optimise_thresholds=False, maxDepth=3)
        pred = md.predict_labels(b, folds.where(F.col("fold") == f), POL).select("label", "y_pred", "proba").collect()
        weighted = total = 0
        for c in (0, 1, 5):
            pos, neg = ([r["proba"][c] for r in pred if (r["label"] == c) == own] for own in (True, False))
            auc = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / (len(pos) * len(neg))
            tp = sum(r["label"] == r["y_pred"] == c for r in pred)
            said = sum(r["y_pred"] == c for r in pred)
            one = classes[f, c]
            assert one["auc"] == pytest.approx(auc) and one["support"] == len(pos)
            assert one["recall"] == pytest.approx(tp / len(pos)) and one["precision"] == pytest.approx(tp / said if said else 0)
            assert one["f1"] == pytest.approx(2 * tp / (said + len(pos)))
            weighted, total = weighted + auc * len(pos), total + len(pos)
        assert per[f]["weighted_auc"] == pytest.approx(weighted / total)
    assert {r["metric"] for r in got.summary.collect()} >= {"weighted_auc", "risk_adjusted_auc", "utility_score"}


def test_class_mix_per_period(rows):
    got = va.temporal_cross_validate(rows, ["a", "b"], POL, "year", "decision_tree", min_train_periods=3, maxDepth=2)
    year = [(r["year"] - 2000, r["label"]) for r in rows.collect()]
    mix = {(r["split_id"], r["cls"]): (r["n_train"], r["n_test"]) for r in got.mix.collect()}
    assert mix == {(s, c): (sum(y < s and k == c for y, k in year), sum(y == s and k == c for y, k in year)) for s in (3, 4) for c in (0, 1, 5)}
    assert {r["split_id"]: (r["n_train"], r["n_test"]) for r in got.per.collect()} == {3: (240, 80), 4: (320, 80)}
    assert va.temporal_cross_validate(rows.filter("label = 0"), ["a"], POL, "year", "decision_tree") is None


def test_bootstrap_summary(rows):
    got = va.bootstrap_evaluation(rows.filter("row_id < 300"), rows.filter("row_id >= 300"), ["a", "b"], POL, n_boot=2,
                                  kind="decision_tree", maxDepth=2)
    per = got.per.collect()
    s = {r["metric"]: r for r in got.summary.collect()}
    assert len(per) == 2 and s["weighted_auc"]["mean"] == pytest.approx(sum(r["weighted_auc"] for r in per) / 2)
    assert {r["replicate"] for r in got.classes.collect()} == {0, 1}
