"""Cost-sensitive classifiers (pyspark.ml stages) and probability-combination rules.

Training uses Spark ML estimators with ``weightCol`` (class weights from the policy);
decision thresholds are chosen by the one-pass cost sweep and applied in clinical
priority order.  Ensemble combination rules are pure array expressions over the
``proba`` vector (converted with ``vector_to_array``), so they stay inside codegen.
"""

from __future__ import annotations

import json
import time
from typing import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics as mt
from tidemark.operators.boosting import MultiClassBoosting
from tidemark.operators.labels import apply_thresholds_expr, attach_sample_weight
from tidemark.operators.logistic_path import L1LogisticPath
from tidemark.operators.network import WeightedNetwork
from tidemark.sources.policy import Policy

SEED = 42


# ---------------------------------------------------------------------------
# probability combination rules (array expressions)
# ---------------------------------------------------------------------------

def _renorm(arr: Column) -> Column:
    tot = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return F.transform(arr, lambda x: x / tot)


def _set(arr: Column, idx: int, value: Column) -> Column:
    return F.transform(arr, lambda x, i: F.when(i == idx, value).otherwise(x))


def high_risk_boost(df: DataFrame, proba_col: str, boosters: Mapping[int, Column], order: Sequence[int],
                    threshold: float = 0.7, cap: float = 0.99) -> DataFrame:
    """Sequential in ``order``: where booster_c >= threshold,
    p_c <- min(0.7*booster_c + 0.3*p_c, cap), then renormalise the row.

    One projection per class: each step reads the previous step's array column, so the
    expression tree stays linear (nesting the steps would grow it exponentially).
    """
    out = df.withColumns({f"_hr{c}": boosters[c] for c in order if c in boosters})
    for c in order:
        if c not in boosters:
            continue
        p, hr = F.col(proba_col), F.col(f"_hr{c}")
        boosted = _set(p, c, F.least(F.lit(0.7) * hr + F.lit(0.3) * F.element_at(p, c + 1), F.lit(cap)))
        out = out.withColumn(proba_col, F.when(hr >= F.lit(threshold), boosted).otherwise(p))
        out = out.withColumn(proba_col, F.when(hr >= F.lit(threshold), _renorm(F.col(proba_col)))
                             .otherwise(F.col(proba_col)))
    return out.drop(*[f"_hr{c}" for c in order if c in boosters])


def stacked_boost(proba: Column, booster: Column, threshold: float = 0.7, cls_index: int = 0) -> Column:
    """One binary booster, strict > threshold, class index 0, no cap, renormalise."""
    boosted = _renorm(_set(proba, cls_index, F.lit(0.7) * booster + F.lit(0.3) * F.element_at(proba, cls_index + 1)))
    return F.when(booster > F.lit(threshold), boosted).otherwise(proba)


def time_decay_adjust(df: DataFrame, proba_col: str, t: Column, max_time: float, high_risk: Sequence[int],
                      decay: float = 0.9) -> DataFrame:
    """w = decay^(t/max t); each high-risk p <- p + (1-p)(1-w)*0.2, renormalising after each class.

    Note: as written, later times get *larger* adjustments (w falls with t).
    ``max_time`` is a frozen scalar from training.  One projection per class.
    """
    nt = t / F.lit(float(max_time)) if max_time > 0 else t
    out = df.withColumn("_w", F.pow(F.lit(float(decay)), nt))
    for c in high_risk:
        p = F.col(proba_col)
        pc = F.element_at(p, c + 1)
        out = out.withColumn(proba_col, _set(p, c, pc + (F.lit(1.0) - pc) * (F.lit(1.0) - F.col("_w")) * F.lit(0.2)))
        out = out.withColumn(proba_col, _renorm(F.col(proba_col)))
    return out.drop("_w")


def soft_vote(probas: Sequence[Column], weights: Sequence[float] = (0.7, 0.3)) -> Column:
    tot = float(sum(weights))
    acc = F.transform(probas[0], lambda x: x * F.lit(weights[0] / tot))
    for pr, w in zip(probas[1:], weights[1:]):
        acc = F.zip_with(acc, pr, lambda a, b: a + b * F.lit(w / tot))
    return acc


def label_vote(labels: Sequence[Column], weights: Sequence[float] = (0.7, 0.3)) -> Column:
    """Weighted mean of labels rounded half-to-even."""
    tot = float(sum(weights))
    s = None
    for lab, w in zip(labels, weights):
        term = lab.cast("double") * F.lit(w)
        s = term if s is None else s + term
    return F.bround(s / F.lit(tot), 0).cast("long")


# ---------------------------------------------------------------------------
# training and scoring
# ---------------------------------------------------------------------------

def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


#: The parameter values that each kind is searched over (grid of the tree, random draws of the booster).
TREE_GRID = {"maxDepth": list(range(2, 8)), "minInstancesPerNode": list(range(5, 55, 5))}
BOOSTING_CHOICES = {
    "stepSize": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
    "maxDepth": list(range(3, 8)),
    "maxIter": list(range(100, 150, 10)),
    "subsamplingRate": [0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "minInstancesPerNode": list(range(1, 10)),
}


def make_classifier(kind: str, label_col: str = "label", weight_col: str | None = "sample_weight", **params):
    """Unfitted estimator of a kind; ``params`` are its Spark ML parameters.

    logistic: one-against-rest L1 path; multinomial: Spark's softmax regression; decision_tree;
    random_forest; gbt: a weighted booster per class; mlp: scaled inputs, whole weights (``fit_weighted`` rounds).
    """
    common = dict(featuresCol="features", labelCol=label_col)
    if kind == "logistic":
        est = L1LogisticPath(**common, **params)
    elif kind == "multinomial":
        est = LogisticRegression(family="multinomial", **{"elasticNetParam": 1.0, "regParam": 0.01, **params}, **common)
    elif kind == "decision_tree":
        est = DecisionTreeClassifier(seed=SEED, **{"minInstancesPerNode": 5, **params}, **common)
    elif kind == "random_forest":
        est = RandomForestClassifier(seed=SEED, **{"numTrees": 100, **params}, **common)
    elif kind == "gbt":
        est = MultiClassBoosting(**common, **params)
    elif kind == "mlp":
        est = WeightedNetwork(seed=SEED, **common, **params)
    else:
        raise ValueError(kind)
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def fit_weighted(est, d: DataFrame, kind: str, weight_col: str = "sample_weight"):
    """Fitted model; a kind with whole weights only (mlp) counts rows about as often as their weight says."""
    if kind == "mlp":
        return est.copy().setWeightCol("_copies").fit(copy_counts(d, weight_col))
    return est.fit(d)


def fit_cost_sensitive(train: DataFrame, features: Sequence[str], policy: Policy, kind: str = "logistic",
                       label_col: str = "label", optimise_thresholds: bool = True, id_col: str = "row_id",
                       validation: float = 0.3, min_rows: int = 50, folds: int = 0, **params) -> dict:
    """One training path for every kind: weights -> (thresholds on held-out rows) -> fit on all rows.

    Thresholds: the model is fitted on the other rows of a label-stratified split, ``validation`` of the
    rows are scored, and the cost sweep on these picks each class's threshold; below ``min_rows`` rows
    the policy's are kept.  Sample weights are kept in every fit.  ``folds`` > 0 adds risk-stratified folds
    that the logistic path chooses its penalties on.
    """
    from tidemark.operators import splits as sp
    from tidemark.operators.thresholds import choose_thresholds
    t0 = time.time()
    d = attach_sample_weight(train, policy, label_col)
    if folds and kind == "logistic":
        d = sp.risk_stratified_kfold(d, id_col, policy, label_col, folds)
        params = {"foldCol": "fold", **params}
    d = assemble(d, features).persist()
    try:
        counts = {r[0]: int(r[1]) for r in d.groupBy(F.col(label_col).cast("long")).count().collect()}   # K rows
        est = make_classifier(kind, label_col, **params)
        thresholds = {c: policy.threshold(c) for c in policy.classes}
        if optimise_thresholds and sum(counts.values()) >= min_rows:
            part = sp.train_test_split(d, id_col, label_col, validation).persist()   # the passes of a fit don't rank again
            try:
                model = fit_weighted(est, part.filter("split = 'train'"), kind)
                held = proba_long(model.transform(part.filter("split = 'test'")), label_col)
                chosen = choose_thresholds(held, policy).collect()          # one row per class
                thresholds.update({int(r["cls"]): float(r["threshold"]) for r in chosen})
            finally:
                part.unpersist()
        model = fit_weighted(est, d, kind)
    finally:
        d.unpersist()
    return {"model": model, "features": list(features), "thresholds": thresholds, "kind": kind,
            "history": {"fit_seconds": time.time() - t0, "n_samples": sum(counts.values()), "class_counts": counts,
                        "optimised": bool(optimise_thresholds and sum(counts.values()) >= min_rows)}}


def proba_long(scored: DataFrame, label_col: str = "label", id_col: str | None = None) -> DataFrame:
    """(row id?, y_true, cls, p) long form from a ``probability`` vector, keyed by class index."""
    keep = [F.col(label_col).cast("long").alias("y_true")] + ([F.col(id_col)] if id_col else [])
    arr = vector_to_array(F.col("probability"))
    return scored.select(*keep, F.posexplode(arr).alias("cls", "p")).withColumn("cls", F.col("cls").cast("long"))


def score_proba(bundle: dict, df: DataFrame) -> DataFrame:
    """Adds ``proba`` (array<double> by class index)."""
    scored = bundle["model"].transform(assemble(df, bundle["features"]))
    return scored.withColumn("proba", vector_to_array(F.col("probability"))).drop(
        "features", "_scaled", "rawPrediction", "probability", "prediction")


def predict_labels(bundle: dict, df: DataFrame, policy: Policy, out: str = "y_pred") -> DataFrame:
    s = score_proba(bundle, df)
    return s.withColumn(out, apply_thresholds_expr(F.col("proba"), policy, bundle["thresholds"],
                                                   missing="default"))


def copy_counts(df: DataFrame, weight_col: str, seed: int = SEED, out: str = "_copies") -> DataFrame:
    """Adds how often a row counts: its weight, rounded up or down by a hash draw.  Rows that don't count are left out."""
    u = (F.pmod(F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    k = F.greatest(F.floor(F.col(weight_col)), F.lit(0)) + F.when(u < F.col(weight_col) - F.floor(F.col(weight_col)), 1).otherwise(0)
    return df.withColumn(out, k.cast("int")).where(F.col(out) > 0)


def weighted_resample(df: DataFrame, weight_col: str, seed: int = SEED) -> DataFrame:
    """For learners without weights: replicate rows ~weight times, no driver loop."""
    return copy_counts(df, weight_col, seed, "_k").withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k", "_rep")


def save_model(bundle: dict, path: str) -> str:
    """PipelineModel (Spark format) + a JSON metadata file (features, thresholds, kind),
    both written through Spark so ``path`` may be any shared filesystem URI."""
    spark = bundle["model"].sparkSession if hasattr(bundle["model"], "sparkSession") else None
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    PipelineModel(stages=[bundle["model"]]).write().overwrite().save(f"{path}/spark")
    meta = json.dumps({"features": bundle["features"], "kind": bundle.get("kind"),
                       "thresholds": {str(k): v for k, v in bundle["thresholds"].items()}})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return path


def _read_meta(spark, path: str) -> dict:
    rows = spark.read.text(f"{path}/meta").collect()          # one line
    if not rows:
        raise FileNotFoundError(path)
    return json.loads(rows[0][0])


def load_model(path: str) -> dict:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    try:
        meta = _read_meta(spark, path)
    except Exception as e:  # noqa: BLE001 - a missing path raises, as the reference does
        raise FileNotFoundError(path) from e
    pm = PipelineModel.load(f"{path}/spark")
    return {"model": pm.stages[0], "features": meta["features"], "kind": meta.get("kind"),
            "thresholds": {int(k): v for k, v in meta["thresholds"].items()}}


def load_model_registry(folder: str) -> dict[str, dict]:
    """Every saved model directly under ``folder`` (found through their metadata files),
    keyed by a prettified name."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    try:
        metas = spark.read.text(f"{folder.rstrip('/')}/*/meta").select(F.input_file_name().alias("f")).distinct()
        dirs = sorted({r["f"].rsplit("/meta/", 1)[0] for r in metas.collect()})     # one row per model
    except Exception:  # noqa: BLE001 - empty or missing folder
        dirs = []
    out = {}
    for d in dirs:
        name = d.rstrip("/").rsplit("/", 1)[-1]
        out[name.replace("_", " ").title()] = load_model(d)
    return out


def train_report(train: DataFrame, test: DataFrame, features: Sequence[str], policy: Policy,
                 kinds: Mapping[str, dict] | Sequence[str] = ("logistic", "decision_tree", "gbt"), label_col="label",
                 folder: str | None = None) -> DataFrame:
    """Fits a model of each kind (with its parameters), saves it under ``folder`` and measures it on the test rows.

    Of a kind's ``candidates`` (parameters) the best on 5 folds is fitted.  One row a kind: test rows, accuracy, weighted one-vs-rest AUC and, where saved, the path.
    """
    from tidemark.operators.search import search_params
    params = kinds if isinstance(kinds, Mapping) else {k: {} for k in kinds}
    rows = []
    for kind, own in params.items():
        if "candidates" in own:
            found = search_params(train, features, policy, kind, own["candidates"], label_col=label_col)
            own = {k: v for k, v in own.items() if k != "candidates"} | found["best_params"]
        bundle = fit_cost_sensitive(train, features, policy, kind, label_col, optimise_thresholds=False, **own)
        path = save_model(bundle, f"{folder.rstrip('/')}/{kind}_model") if folder else None
        pred = predict_labels(bundle, test, policy).select(label_col, "proba", "y_pred").persist()
        n, accuracy = pred.agg(F.count("*"), F.avg((F.col("y_pred") == F.col(label_col)).cast("double"))).first()
        long = pred.select(F.col(label_col).cast("long").alias("y_true"), F.posexplode("proba").alias("cls", "p"))
        auc = mt.weighted_ovr_auc(long).first()[0]
        pred.unpersist()
        rows.append((kind, n, accuracy, auc, path))
    return train.sparkSession.createDataFrame(
        rows, "model string, n_test long, accuracy double, weighted_ovr_auc double, path string")


def linear_contributions(bundle: dict, df: DataFrame, cls: int, id_col: str, top: int = 3) -> DataFrame:
    """Per entity signed contributions coef_j * x_j for one class of a linear model, ranked by sign."""
    coefs = bundle["model"].coefficientMatrix.toArray()[cls]
    feats = bundle["features"]
    x = df.select(id_col, *[(F.col(f) * F.lit(float(c))).alias(f) for f, c in zip(feats, coefs)])
    long = x.unpivot(id_col, feats, "feature", "contribution")
    from pyspark.sql import Window
    side = F.when(F.col("contribution") >= 0, F.lit("risk")).otherwise(F.lit("protective"))
    w = Window.partitionBy(id_col, side).orderBy(F.abs("contribution").desc(), "feature")
    return long.withColumn("side", side).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def model_importance(bundle: dict) -> list[tuple[str, float]]:
    m = bundle["model"]
    feats = bundle["features"]
    if hasattr(m, "coefficientMatrix"):
        import numpy as np
        imp = np.abs(m.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(m, "featureImportances"):
        imp = m.featureImportances.toArray()
    else:
        import numpy as np
        net = m.stages[-1]  # behind its scaler
        w = np.array(net.weights.toArray())
        n_in, n_h = len(feats), net.getLayers()[1]
        imp = np.abs(w[: n_in * n_h].reshape(n_in, n_h)).mean(axis=1)
    return sorted(zip(feats, [float(v) for v in imp]), key=lambda t: -t[1])
