"""The training path: boosting, the L1 path's optimality conditions, searches, saved state."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from tidemark.operators import metrics as mt
from tidemark.operators import models as md
from tidemark.operators import packed_boosting as pb
from tidemark.operators import search as se
from tidemark.operators import tree_search as ts
from tidemark.operators.labels import attach_sample_weight
from tidemark.operators.logistic_path import L1LogisticPath
from tidemark.session import scratch_path
from tidemark.sources.policy import policy

POL = policy("code")
X = ["a", "b", "flat", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    out = []
    for i in range(600):
        y = int(rng.choice([0, 1, 3], p=[0.5, 0.3, 0.2]))
        out.append((i, 100.0 * y + float(rng.normal(0, 80)), float(rng.normal(-y, 1)), 7.0, float(rng.normal()), y))
    return spark.createDataFrame(out, "row_id long, a double, b double, flat double, noise double, label long").persist()


def numpy_rows(df, weights=True):
    d = attach_sample_weight(df, POL, "label").collect()
    x = np.array([[r[c] for c in X] for r in d])
    return x, np.array([r["label"] for r in d]), np.array([r["sample_weight"] for r in d]) if weights else np.ones(len(d))


def test_path_meets_its_optimality_conditions(rows):
    cs = [1e-4, 1e-2, 1.0, 100.0]
    d = md.assemble(attach_sample_weight(rows, POL, "label"), X).repartition(5)
    for C in cs:
        model = L1LogisticPath(Cs=[C], weightCol="sample_weight", tol=1e-9).fit(d)
        x, y, w = numpy_rows(rows)
        assert model.state["classes"] == [0, 1, 3] and model.state["violation"] <= 1e-9
        for c, beta, b0 in zip(model.state["classes"], model.state["coefficients"], model.state["intercepts"]):
            beta = np.array(beta)
            p = 1 / (1 + np.exp(-(x @ beta + b0)))
            grad = C * (x.T @ (w * (p - (y == c))))
            scale = x.std(0) + (x.std(0) == 0)
            assert abs((w * (p - (y == c))).sum()) < 1e-5 * w.sum()
            for j, g in enumerate(grad):
                if X[j] == "flat":
                    assert beta[j] == 0
                elif beta[j]:
                    assert abs(g + np.sign(beta[j])) <= 1e-6 * C * w.sum() * scale[j] + 1e-9
                else:
                    assert abs(g) <= 1 + 1e-6 * C * w.sum() * scale[j]
        if C == 1e-4:
            assert all(v == 0 for r in model.state["coefficients"] for v in (r[1], r[3]))


def test_penalties_advance_together_as_alone(rows):
    d = md.assemble(rows, X)
    folds = d.withColumn("fold", F.col("row_id") % 4)
    cs = [1e-3, 1e-2, 1e-1, 10.0]
    whole = L1LogisticPath(Cs=cs, foldCol="fold", tol=1e-10).fit(folds)
    assert whole.state["passes"] < 40
    for i, C in enumerate(cs):
        alone = L1LogisticPath(Cs=[C], tol=1e-10).fit(d)
        assert np.allclose(np.array(whole.state["path"])[:, i], alone.state["coefficients"], rtol=1e-4, atol=1e-7)
    accuracy = np.zeros((3, len(cs)))
    for f in range(4):
        held = folds.filter(F.col("fold") == f)
        part = L1LogisticPath(Cs=cs, tol=1e-10).fit(folds.filter(F.col("fold") != f))
        x, y, _ = numpy_rows(held)
        for i in range(len(cs)):
            one = L1LogisticPath(Cs=[cs[i]], tol=1e-10).fit(folds.filter(F.col("fold") != f)) if f == 0 else None
            beta = np.array(part.state["path"])[:, i]
            if one is not None:
                margin = x @ np.array(one.state["coefficients"]).T + one.state["intercepts"]
                accuracy[:, i] = [((margin[:, k] > 0) == (y == c)).mean() for k, c in enumerate([0, 1, 3])]
                assert np.allclose(beta, one.state["coefficients"], rtol=1e-4, atol=1e-7)
    assert whole.state["C"] == [cs[int(np.argmax(a))] for a in whole.state["accuracy"]]


@pytest.mark.parametrize("kind,params", [("logistic", {"Cs": [0.1]}), ("gbt", {"maxIter": 3, "maxDepth": 2}),
                                         ("mlp", {"layers": [4, 5, 4], "maxIter": 20}), ("decision_tree", {"maxDepth": 3})])
def test_one_path_for_every_kind(spark, rows, kind, params):
    b = md.fit_cost_sensitive(rows, X, POL, kind, **params)
    grid = np.linspace(0.1, 0.9, 50)
    assert all(t == POL.threshold(c) or np.isclose(grid, t).any() for c, t in b["thresholds"].items())
    assert b["history"]["n_samples"] == 600 and b["history"]["optimised"]
    few = md.fit_cost_sensitive(rows.limit(40), X, POL, kind, **params)
    assert not few["history"]["optimised"] and few["thresholds"] == {c: POL.threshold(c) for c in POL.classes}
    path = md.save_model(b, scratch_path(spark, "bundle-"))
    again = md.load_model(path)
    one, two = (md.predict_labels(m, rows, POL).orderBy("row_id").collect() for m in (b, again))
    assert [r["y_pred"] for r in one] == [r["y_pred"] for r in two]
    assert np.allclose([r["proba"] for r in one], [r["proba"] for r in two])
    proba = np.array([r["proba"] for r in one])
    assert proba.shape == (600, 4) and np.allclose(proba.sum(1), 1) and (proba >= 0).all()
    if kind != "mlp":
        assert (proba[:, 2] == 0).all()  # no row has label 2
    assert (proba.argmax(1) == [r["label"] for r in one]).mean() > 0.6
    assert len(md.model_importance(b)) == 4 and set(again["thresholds"]) == set(b["thresholds"])
    assert [r for r in one[0].asDict()] == [*rows.columns, "proba", "y_pred"]


def test_boosting_uses_weights(rows):
    d = md.assemble(rows, X).withColumn("w", F.when(F.col("label") == 3, 50.0).otherwise(1.0))
    plain, heavy = (md.make_classifier("gbt", weight_col=w, maxIter=3, maxDepth=2).fit(d) for w in (None, "w"))
    share = [m.transform(d).agg(F.avg((F.col("prediction") == 3).cast("int"))).first()[0] for m in (plain, heavy)]
    assert share[1] > share[0] + 0.2
    one = md.make_classifier("gbt", weight_col=None, maxIter=2).fit(d.filter("label = 1"))
    assert one.transform(d).select("probability").first()[0].toArray().tolist() == [0.0, 1.0]


def test_candidates():
    grid = se.grid_candidates({"x": [1, 2], "y": ["a", "b", "c"]})
    assert len(grid) == 6 and grid[0] == {"x": 1, "y": "a"} and grid[1] == {"x": 1, "y": "b"}
    draws = se.random_candidates(md.BOOSTING_CHOICES, 20)
    assert len({tuple(d.items()) for d in draws}) == 20 and draws == se.random_candidates(md.BOOSTING_CHOICES, 20)
    assert all(d[k] in v for d in draws for k, v in md.BOOSTING_CHOICES.items())
    assert len(se.random_candidates({"x": [1, 2]}, 20)) == 2


def brute_auc(y, p):
    out = n = 0
    for c in set(y):
        pos, neg = [s[c] for s, t in zip(p, y) if t == c], [s[c] for s, t in zip(p, y) if t != c]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        out, n = out + len(pos) * (wins / (len(pos) * len(neg)) if neg else 0.5), n + len(pos)
    return out / n


def test_search_scores_are_out_of_fold(spark, rows):
    candidates = [{"maxDepth": 1}, {"maxDepth": 4}]
    found = se.search_params(rows, X, POL, "decision_tree", candidates, folds=3)
    assert found["best_params"] == {"maxDepth": 4}
    from tidemark.operators import splits as sp
    d = md.assemble(sp.risk_stratified_kfold(attach_sample_weight(rows, POL, "label"), "row_id", POL, "label", 3), X)
    got = {(r["candidate"], r["fold"]): r["weighted_ovr_auc"] for r in found["scores"].collect()}
    assert len(got) == 6
    for f in (0, 2):
        model = md.make_classifier("decision_tree", maxDepth=4).fit(d.filter(F.col("fold") != f))
        held = model.transform(d.filter(F.col("fold") == f))
        r = held.collect()
        want = brute_auc([x["label"] for x in r], [x["probability"].toArray() for x in r])
        assert got[1, f] == pytest.approx(want)
        assert se.WeightedOvrAucEvaluator().evaluate(held) == pytest.approx(want)
    cv = CrossValidator(estimator=DecisionTreeClassifier(weightCol="sample_weight", maxDepth=4, minInstancesPerNode=5, seed=md.SEED),
                        estimatorParamMaps=[{}], evaluator=se.WeightedOvrAucEvaluator(), foldCol="fold", numFolds=3)
    assert cv.fit(d.withColumn("fold", F.col("fold").cast("int"))).avgMetrics[0] == pytest.approx(found["results"][1]["mean"])


def test_trees_of_a_search_are_grown_together(rows, monkeypatch):
    """No candidate is fitted alone; bins, splits, depths and merged leaves are those of Spark's trees."""
    from tidemark.operators import splits as sp
    candidates = se.grid_candidates({"maxDepth": [0, 2, 4], "minInstancesPerNode": [5, 60, 200]})
    alone = []
    with monkeypatch.context() as m:
        m.setattr(md, "fit_weighted", lambda *a: alone.append(a))
        m.setattr(ts, "CELLS", 1)   # a node a pass
        got = {(r[0], r[1]): r[2] for r in se.fold_scores(rows, X, POL, "decision_tree", candidates, folds=2).collect()}
    assert not alone and len(got) == 18
    d = md.assemble(sp.risk_stratified_kfold(attach_sample_weight(rows, POL, "label"), "row_id", POL, "label", 2), X).persist()
    for at, fold in ((0, 0), (3, 1), (4, 0), (6, 0), (7, 1), (8, 1)):
        model = md.make_classifier("decision_tree", **candidates[at]).fit(d.filter(F.col("fold") != fold))
        assert got[at, fold] == pytest.approx(se.WeightedOvrAucEvaluator().evaluate(model.transform(d.filter(F.col("fold") == fold))), abs=1e-12)
    d.unpersist()


def test_sampled_bins_count_all_rows(rows, monkeypatch):
    from tidemark.operators import splits as sp
    monkeypatch.setattr(ts, "SAMPLE", 100)
    d = md.assemble(sp.risk_stratified_kfold(attach_sample_weight(rows, POL, "label"), "row_id", POL, "label", 3), X)
    held = ts.held_out_scores(d, [(2, 5, 0.0), (4, 5, 0.0)], 3).persist()
    want = {(r["y_true"], r["fold"]): r["count"] for r in d.groupBy(F.col("label").alias("y_true"), "fold").count().collect()}
    for at in (0, 1):
        own = held.where(f"candidate = {at} and cls = 0").groupBy("y_true", "fold").agg(F.sum("n").alias("n")).collect()
        assert {(r["y_true"], r["fold"]): r["n"] for r in own} == want
    assert mt.weighted_ovr_auc(held, group_cols=["candidate"], count_col="n").agg(F.min("weighted_ovr_auc")).first()[0] > 0.7


@pytest.mark.parametrize("broken", ["cast('nan' as double) as a, b, label", "a, b, label - 1 as label", "a, b, cast(null as long) as label"])
def test_trees_of_a_search_take_finite_features_and_labels_from_0(rows, broken):
    d = rows.where("row_id < 60").selectExpr("row_id", *broken.split(", "))
    with pytest.raises(Exception, match="have to be"):
        se.fold_scores(d, ["a", "b"], POL, "decision_tree", [{"maxDepth": 2}], folds=2)


def test_auc_of_counted_rows(spark):
    own = [(0, 0, 0.2, 3), (1, 0, 0.2, 1), (0, 0, 0.7, 2), (1, 0, 0.1, 4), (0, 1, 0.8, 3), (1, 1, 0.8, 1), (0, 1, 0.3, 2), (1, 1, 0.9, 4)]
    long = spark.createDataFrame(own, "y_true long, cls long, p double, n long")
    each = spark.createDataFrame([r[:3] for r in own for _ in range(r[3])], "y_true long, cls long, p double")
    assert mt.weighted_ovr_auc(long, count_col="n").first()[0] == pytest.approx(mt.weighted_ovr_auc(each).first()[0], abs=1e-15)


def test_grouped_auc(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 3, 90), np.round(rng.random((90, 3)), 1)
    long = spark.createDataFrame([(i % 2, int(y[i]), c, float(p[i, c])) for i in range(90) for c in range(3)],
                                 "g int, y_true long, cls long, p double")
    got = {r["g"]: r["weighted_ovr_auc"] for r in mt.weighted_ovr_auc(long, group_cols=["g"], n_buckets=4).collect()}
    assert got == {g: pytest.approx(brute_auc(y[g::2].tolist(), p[g::2])) for g in (0, 1)}


def test_ensemble_rows_are_assembled_once(spark, monkeypatch):
    """The boosters share one cached table of training rows, which is given back; all test rows are scored."""
    from tidemark.plans import q_inventory as qi
    rows = [(i, *(float((i * k) % 17) for k in range(1, len(qi.NUM) + 1)), i % 8) for i in range(240)]
    df = spark.createDataFrame(rows, ", ".join(["row_id long", *(f"{c} double" for c in qi.NUM), "label long"]))
    monkeypatch.setattr(qi, "_train_test", lambda *a: (df.filter("row_id % 3 > 0"), df.filter("row_id % 3 = 0")))
    calls, assemble = [], md.assemble
    monkeypatch.setattr(md, "assemble", lambda *a, **k: calls.append(a) or assemble(*a, **k))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = qi.q_hr_ensemble(spark, "").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert sorted(r["row_id"] for r in out) == list(range(0, 240, 3)) and all(r["y_pred"] in range(8) for r in out)
    assert len(calls) == 4  # the main model's fit and scores, the boosters' rows, the rows they score


def test_packed_boosters_are_sparks(rows, monkeypatch):
    """The trees grown on rows sent whole give the scores, importances and search results of Spark's learner."""
    d = md.assemble(attach_sample_weight(rows, POL, "label"), X).persist()
    for params in ({"maxIter": 6, "maxDepth": 3, "stepSize": 0.3}, {"maxIter": 4, "maxDepth": 5, "minInstancesPerNode": 9}):
        own = md.make_classifier("gbt", **params).fit(d)
        with monkeypatch.context() as m:
            m.setattr(pb, "VALUES", 0)
            sparks = md.make_classifier("gbt", **params).fit(d)
        assert own.state["trees"] and not own.boosters and sparks.boosters and not sparks.state["trees"]
        one, two = (np.array([r[0].toArray() for r in m.transform(d).orderBy("row_id").select("probability").collect()]) for m in (own, sparks))
        assert np.allclose(one, two, atol=1e-9)
        assert np.allclose(own.featureImportances.toArray(), sparks.featureImportances.toArray(), atol=1e-9)
    d.unpersist()
    candidates = [{"maxIter": 2, "maxDepth": 2}, {"maxIter": 5, "maxDepth": 3, "minInstancesPerNode": 20}]
    got = {(r[0], r[1]): r[2] for r in se.fold_scores(rows, X, POL, "gbt", candidates, folds=2).collect()}
    with monkeypatch.context() as m:
        m.setattr(pb, "VALUES", 0)
        want = {(r[0], r[1]): r[2] for r in se.fold_scores(rows, X, POL, "gbt", candidates, folds=2).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} and len(got) == 4


def test_row_samples_are_seeded_and_chunks_add_up(rows, monkeypatch):
    d = md.assemble(attach_sample_weight(rows, POL, "label"), X)
    fits = []
    for parts, chunk in ((1, 65_536), (3, 7)):
        monkeypatch.setattr(pb, "CHUNK", chunk)
        table = pb.collected(d.repartition(parts), "features", "label", "sample_weight")
        bins = table.bins(edges := table.edges(table.y >= 0))
        fits.append(pb.boosted(bins, np.array([len(e) for e in edges]), np.where(table.y == 3, 1.0, -1.0), table.w, np.arange(600),
                               {"maxIter": 5, "maxDepth": 3, "stepSize": 0.5, "subsamplingRate": 0.5, "minInstancesPerNode": 2}, [1]))
    assert np.allclose(*fits, atol=1e-9) and np.unique(fits[0]).size > 8


def own_split(spark, monkeypatch, qm):
    rng = np.random.default_rng(4)
    made = [(i, *(float(v) for v in rng.normal(i % 8, 3, len(qm.FEATS))), i % 8) for i in range(240)]
    df = spark.createDataFrame(made, ", ".join(["row_id long", *(f"{c} double" for c in qm.FEATS), "label long"]))
    monkeypatch.setattr(qm, "_train_test", lambda *a: (df.filter("row_id % 3 > 0"), df.filter("row_id % 3 = 0")))


def test_the_booster_is_searched(spark, monkeypatch):
    """``fit_gradient_boosting`` draws 20 candidates from all choices, judges them on 5 folds and fits the best one whole."""
    from tidemark.plans import q_models as qm
    own_split(spark, monkeypatch, qm)
    asked, fits = [], []
    monkeypatch.setattr(se, "search_params", lambda tr, x, p, kind, c, folds=5, **k: asked.append((kind, c, folds)) or {"best_params": c[3]})
    keep = md.fit_cost_sensitive
    monkeypatch.setattr(md, "fit_cost_sensitive", lambda *a, **k: fits.append(k) or keep(*a, **{**k, "maxIter": 2, "maxDepth": 2}))
    out = qm.q_fit_gbt(spark, "").collect()
    (kind, candidates, folds), = asked
    assert kind == "gbt" and folds == 5 and len(candidates) == 20 and min(c["maxIter"] for c in candidates) >= 100
    assert all(c.keys() == md.BOOSTING_CHOICES.keys() for c in candidates) and fits == [candidates[3]]
    assert all(r["p_total"] == pytest.approx(1) for r in out) and len(out) == 80


def test_the_tree_is_searched_over_its_whole_grid(spark, monkeypatch):
    from tidemark.plans import q_models as qm
    own_split(spark, monkeypatch, qm)
    asked = []
    monkeypatch.setattr(se, "search_params", lambda tr, x, p, kind, c, folds=5, **k: asked.append((kind, c, folds)) or {"best_params": c[0]})
    assert qm.q_fit_tree(spark, "").count() == 80
    assert asked == [("decision_tree", [{"maxDepth": d, "minInstancesPerNode": n} for d in range(2, 8) for n in range(5, 55, 5)], 5)]


def test_the_report_searches_its_models(spark, monkeypatch):
    """No model of ``train_report`` is cut short: the tree and the booster are searched, the regression runs to its own end."""
    from tidemark.plans import q_models as qm
    own_split(spark, monkeypatch, qm)
    asked, fits, keep = {}, {}, md.fit_cost_sensitive

    def search(tr, x, p, kind, candidates, folds=5, **k):
        asked[kind] = candidates, folds
        return {"best_params": candidates[-1]}

    def fit(tr, x, p, kind, *a, **k):
        fits[kind] = {n: v for n, v in k.items() if n != "optimise_thresholds"}
        return keep(tr, x, p, kind, *a, **{**k, **({"maxIter": 2, "maxDepth": 2} if kind == "gbt" else {})})

    monkeypatch.setattr(se, "search_params", search)
    monkeypatch.setattr(md, "fit_cost_sensitive", fit)
    got = {r["model"]: r for r in qm.q_train_report(spark, "").collect()}
    assert list(got) == list(fits) == ["multinomial", "decision_tree", "gbt"] and all(r["n_test"] == 80 for r in got.values())
    assert fits["multinomial"] == {} and {k: (len(c), f) for k, (c, f) in asked.items()} == {"decision_tree": (12, 5), "gbt": (10, 5)}
    assert fits["decision_tree"] == {"maxDepth": 5, "minInstancesPerNode": 25} and fits["gbt"]["maxIter"] >= 100
    assert all(r["weighted_ovr_auc"] > 0.6 and 0 <= r["accuracy"] <= 1 for r in got.values())
