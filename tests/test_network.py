"""The weighted perceptron: gradient, rows that count several times, and that rows aren't copied for its passes."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from tidemark.operators import models as md
from tidemark.operators import network as nw
from tidemark.operators import splits as sp
from tidemark.sources.policy import policy

POL = policy("code")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 512)
    out = [(i, float(rng.normal(3 * c, 2)), float(rng.normal(-c, 1)), int(c), int(1 + 3 * (c == 2))) for i, c in enumerate(y)]
    return spark.createDataFrame(out, "row_id long, a double, b double, label long, w int").coalesce(1).persist()


def test_gradient():
    rng = np.random.default_rng(1)
    layers = [3, 4, 2]
    rows = np.vstack([rng.normal(size=(3, 20)), rng.integers(0, 2, 20), rng.integers(1, 5, 20)]).astype(float)
    weights = rng.normal(size=3 * 4 + 4 + 4 * 2 + 2)
    got = nw.loss_and_gradient(weights, layers, rows)
    assert got[0] == rows[-1].sum()
    for i in range(len(weights)):
        step = np.eye(len(weights))[i] * 1e-6
        up, down = (nw.loss_and_gradient(weights + s, layers, rows)[1] for s in (step, -step))
        assert got[2 + i] == pytest.approx((up - down) / 2e-6, abs=1e-4)
    halves = nw.loss_and_gradient(weights, layers, rows[:, :7]) + nw.loss_and_gradient(weights, layers, rows[:, 7:])
    assert np.allclose(halves, got)


def test_a_row_counts_as_often_as_its_weight(rows):
    d = md.assemble(rows, ["a", "b"])
    copies = d.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("w"))))
    params = {"layers": [2, 4, 3], "maxIter": 30}
    one = md.make_classifier("mlp", weight_col="w", **params).fit(d)
    many = md.make_classifier("mlp", weight_col=None, **params).fit(copies)
    assert np.allclose(one.stages[-1].weights.toArray(), many.stages[-1].weights.toArray(), rtol=1e-4, atol=1e-5)
    # Spark's own network on the copies
    scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True)
    net = MultilayerPerceptronClassifier(featuresCol="_scaled", seed=md.SEED, blockSize=1, **params)
    spark_own = Pipeline(stages=[scaler, net]).fit(copies.select("features", "label"))
    got, want = (np.array([r[0].toArray() for r in m.transform(d).orderBy("row_id").select("probability").collect()]) for m in (one, spark_own))
    assert np.abs(got - want).max() < 1e-3


def test_rows_are_not_copied_for_the_passes(spark, rows, monkeypatch):
    """Weights of thousands make no more packed rows."""
    seen, own = [], nw.minimise

    def minimise(f, x, max_iter, tol):
        seen.append(f(x)[0])
        return own(f, x, max_iter, tol)

    monkeypatch.setattr(nw, "minimise", minimise)
    d = md.assemble(rows, ["a", "b"]).withColumn("heavy", F.col("w") * 1000)
    model = md.fit_weighted(md.make_classifier("mlp", weight_col="heavy", layers=[2, 3, 3], maxIter=2), d, "mlp", "heavy")
    assert len(seen) == 1 and np.isfinite(seen[0]) and model.transform(d).count() == 512


def test_labels_outside_the_network_are_refused(rows):
    with pytest.raises(Exception, match="whole numbers from 0 to 1"):
        md.make_classifier("mlp", weight_col=None, layers=[2, 2], maxIter=1).fit(md.assemble(rows, ["a", "b"]))


def test_split_of_a_fit_is_kept(rows, monkeypatch):
    """The passes of the fit that thresholds are chosen on read a cached split, which is given back."""
    parts, kept, split, fit = [], [], sp.train_test_split, md.fit_weighted
    monkeypatch.setattr(sp, "train_test_split", lambda *a, **k: parts.append(split(*a, **k)) or parts[-1])
    monkeypatch.setattr(md, "fit_weighted", lambda *a, **k: kept.append(parts[0].storageLevel.useMemory) or fit(*a, **k))
    md.fit_cost_sensitive(rows, ["a", "b"], POL, "decision_tree", maxDepth=2)
    assert kept == [True, False]
