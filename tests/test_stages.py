"""Fitted stages: state survives saving, the engineering chain and the feature selector by their rules."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidemark.operators import clean as cl
from tidemark.operators import features as fe
from tidemark.operators import selection as sl
from tidemark.operators.selector import FeatureSelector, FeatureSelectorModel, choose, elimination_order
from tidemark.session import scratch_path


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, float(rng.exponential(5)), float(rng.normal(i % 3, 0.5)), float(rng.normal()), float(i % 3 + rng.normal(0, 3)),
             None if i % 17 == 0 else "xyz"[i % 3 if i % 2 else 0], None if i % 11 == 0 else float(rng.integers(1, 7)))
            for i in range(300)]
    return spark.createDataFrame(rows, "row_id long, label long, skewed double, strong double, noise double, weak double, "
                                       "kind string, `P1: Delusions` double").persist()


def same(a, b):
    x, y = (sorted(map(tuple, d.collect()), key=repr) for d in (a, b))
    assert a.columns == b.columns and x == y


def test_saved_pipeline_gives_the_same_rows(spark, table):
    fitted = Pipeline(stages=[cl.MedianModeImputer(), fe.FeatureEngineer(passThrough=["row_id", "label"])]).fit(table)
    path = scratch_path(spark, "stages-")
    fitted.write().save(path)
    again = PipelineModel.load(path)
    same(fitted.transform(table), again.transform(table))
    out = again.transform(table)
    assert out.columns[:2] == ["row_id", "label"] and {"kind_y", "kind_z", "PANSS_P_Total"} <= set(out.columns)
    assert again.stages[0].state["medians"].keys() == {"row_id", "label", "skewed", "strong", "noise", "weak", "P1: Delusions"}
    assert sorted(r["row_id"] for r in out.select("row_id").collect()) == list(range(300))
    # a single row is scored by the fitted values, not by its own
    one = again.transform(table.filter("row_id = 7")).first()
    assert one == out.filter("row_id = 7").first()


def test_chain_against_pandas(table):
    model = fe.FeatureEngineer(passThrough=["row_id", "label"], interact=False).fit(table)
    p = table.toPandas()
    num = ["skewed", "strong", "noise", "weak", "P1: Delusions"]
    p["P1: Delusions"] = np.cbrt(p["P1: Delusions"]) if p["P1: Delusions"].skew() > 0.5 else p["P1: Delusions"]
    for c in num:
        if abs(p[c].skew()) > 0.5:
            p[c] = np.cbrt(p[c])
    got = model.transform(table).toPandas().sort_values("row_id")
    for c in num:
        q1, q2, q3 = p[c].quantile([0.25, 0.5, 0.75])
        out = ((p[c] > q3 + 1.5 * (q3 - q1)) | (p[c] < q1 - 1.5 * (q3 - q1))).any()
        want = (p[c] - q2) / (q3 - q1) if out else (p[c] - p[c].mean()) / p[c].std(ddof=0)
        assert np.allclose(got[c].astype(float), want, equal_nan=True)
    assert set(model.state["skewed"]) >= {"skewed"} and "row_id" in got and (got["label"] == p["label"]).all()
    off = fe.engineer_features(table, "label", keep=["row_id"], transform=False, skew=False, interact=False, encode=False, scale=False)
    same(off, table)


def test_item_transformer_by_parameter(spark, table):
    model = fe.SkewItemTransformer(method="sqrt", threshold=-9.0, derived=False).fit(table)
    path = scratch_path(spark, "items-")
    model.write().save(path)
    again = fe.SkewItemModel.load(path)
    assert again.state == {"items": ["P1: Delusions"], "skewed": ["P1: Delusions"], "method": "sqrt", "derived": False}
    same(model.transform(table), again.transform(table))


def test_choose():
    scores = {"a": 1.0, "b": 3.0, "c": 3.0, "d": None, "e": 2.0}
    assert choose(scores, 2.0, 1) == ["b", "c", "e"]
    assert choose(scores, None, 1) == ["b"] and choose(scores, None, 3) == ["b", "c", "e"] and choose(scores, None, 9) == list(scores)
    assert choose(scores, None, None) == list(scores)


NUM = ["skewed", "strong", "noise", "weak"]


def test_chain_of_methods(spark, table):
    selector = FeatureSelector(methods=["variance", "statistical"], inputCols=NUM, labelCol="label", nFeatures=3)
    path = scratch_path(spark, "chain-")
    selector.write().save(path + "-unfitted")
    model = FeatureSelector.load(path + "-unfitted").fit(table)
    var = {r["feature"]: r["variance"] for r in sl.variance_table(table, NUM).collect()}
    first = choose(var, None, 3)
    f = {r["feature"]: r["f_score"] for r in sl.anova_f(table, first, "label").collect()}
    assert model.selected == choose({c: f[c] for c in first}, None, 3) == first == ["skewed", "strong", "weak"]
    model.write().save(path)
    again = FeatureSelectorModel.load(path)
    assert again.state == model.state and again.transform(table).columns == [
        "row_id", "label", *[c for c in NUM if c in first], "kind", "P1: Delusions"]
    same(again.transform(table), model.transform(table))


@pytest.mark.parametrize("method", ["importance", "statistical", "mutual_info", "rfe"])
def test_each_method_finds_the_strong_column(table, method):
    s = FeatureSelector(methods=[method], inputCols=NUM, labelCol="label", nFeatures=1, model="decision_tree", modelParams={"maxDepth": 3})
    assert s.fit(table).selected == ["strong"]


def test_rfe_chooses_its_size_on_folds(table):
    s = FeatureSelector(methods=["rfe"], inputCols=["strong", "noise"], labelCol="label", threshold=0.9, model="decision_tree",
                        modelParams={"maxDepth": 2}, folds=3)
    assert s.fit(table).selected == ["strong"]
    order, accuracy = elimination_order(table, NUM, "label", "decision_tree", {"maxDepth": 3}, scored=table)
    assert len(order) == 3 and "strong" not in order and set(accuracy) == {1, 2, 3, 4}


def test_components_replace_columns(spark, table):
    model = FeatureSelector(methods=["variance", "pca"], inputCols=NUM, labelCol="label", nFeatures=2).fit(table)
    out = model.transform(table.select("row_id", *NUM))
    assert out.columns == ["row_id", "PC1", "PC2"]
    cols = model.state["steps"][0]["selected"]
    x = table.select(cols).toPandas().to_numpy()
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = out.orderBy("row_id").toPandas()[["PC1", "PC2"]].to_numpy()
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ vt[:2].T))
    with pytest.raises(ValueError):
        FeatureSelector(methods=["magic"], inputCols=NUM, labelCol="label").fit(table)
    assert FeatureSelector(methods=["variance"], inputCols=NUM, labelCol="label").fit(table).selected == NUM
    assert model.transform(table.filter(F.lit(False))).count() == 0
