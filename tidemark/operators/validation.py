"""Model validation loops: K-fold, temporal and bootstrap evaluation.

Fits are inherently one Spark ML job chain per fold / split / replicate (a driver loop
over *models*, not rows); every fold's predictions are unioned and all metrics are then
computed in one grouped aggregation keyed by fold.  Training frames are persisted for
the loop and released after.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics as mt
from tidemark.operators import models as md
from tidemark.operators import splits as sp
from tidemark.operators.labels import attach_sample_weight
from tidemark.session import scratch_path
from tidemark.sources.policy import Policy

#: Buckets that a class's scores are ranked in, side by side for all folds.
AUC_BUCKETS = 16


class Evaluation(NamedTuple):
    """Metrics per fold (period, replicate), their summary, class scores per fold, and for periods the class mix."""

    per: DataFrame
    summary: DataFrame
    classes: DataFrame
    mix: DataFrame | None = None


def _scored(bundle: dict, df: DataFrame, policy: Policy, label_col: str, key: str, value: int) -> DataFrame:
    pred = md.predict_labels(bundle, df, policy)
    return pred.select(F.lit(value).cast("long").alias(key), F.col(label_col).cast("long").alias("label"), "y_pred", "proba")


def _stored(parts: Sequence[DataFrame]) -> DataFrame:
    """All folds' predictions in one table of the shared folder, so that every metric reads them, not the models again."""
    spark = parts[0].sparkSession
    path = scratch_path(spark, "predictions-")
    reduce(DataFrame.unionByName, parts).write.parquet(path)
    return spark.read.parquet(path)


def _fold_auc(pred: DataFrame, key: str) -> DataFrame:
    long = pred.select(key, F.col("label").alias("y_true"), F.posexplode("proba").alias("cls", "p"))
    return mt.auc_per_class(long, group_cols=[key], n_buckets=AUC_BUCKETS)


def _fold_metrics(pred: DataFrame, policy: Policy, key: str, auc: DataFrame | None = None) -> DataFrame:
    """Utility, high-risk recall, accuracy, macro F1 and both mean AUCs (by support, by risk level) of each fold."""
    u = mt.clinical_utility(pred, policy, "label", "y_pred", [key]).select(key, "utility_score")
    r = mt.high_risk_recall(pred, policy, "label", "y_pred", [key])
    a = mt.accuracy_macro(pred, "label", "y_pred", [key]).select(key, "accuracy", "f1_macro")
    level = policy.risk_expr("cls", "moderate_risk")
    w = F.when(level == "high_risk", 3.0).when(level == "low_risk", 1.0).otherwise(2.0)
    seen = (_fold_auc(pred, key) if auc is None else auc).where("n_pos > 0")
    c = seen.groupBy(key).agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("weighted_auc"),
                              (F.sum(F.col("auc") * w) / F.sum(w)).alias("risk_adjusted_auc"))
    return u.join(r, key, "left").join(a, key, "left").join(c, key, "left")


def class_scores(pred: DataFrame, key: str, auc: DataFrame | None = None) -> DataFrame:
    """(key, cls, precision, recall, f1, support, auc) for every class that a fold has or predicts."""
    o = mt.one_vs_rest_counts(pred, "label", "y_pred", [key])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scores = o.select(key, "cls", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                      ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "support")
    return scores.join((_fold_auc(pred, key) if auc is None else auc).select(key, "cls", "auc"), [key, "cls"], "left")


def _evaluated(parts: Sequence[DataFrame], policy: Policy, key: str) -> tuple[DataFrame, DataFrame]:
    pred = _stored(parts)
    return _fold_metrics(pred, policy, key), class_scores(pred, key)


def summarize(per: DataFrame, key: str) -> DataFrame:
    """mean and population std per metric, nulls skipped (folds with null kept as rows)."""
    cols = [c for c in per.columns if c != key]
    long = per.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(key, cols, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.count("value").alias("n"))


def cross_validate(df: DataFrame, features: Sequence[str], policy: Policy, kind: str = "multinomial", k: int = 5,
                   id_col: str = "row_id", label_col: str = "label", **params) -> Evaluation:
    """Risk-stratified K-fold: per-fold metrics and class scores, and the metrics' mean / pop std."""
    folds = sp.risk_stratified_kfold(df, id_col, policy, label_col, k).persist()
    try:
        parts = []
        for f in range(k):
            b = md.fit_cost_sensitive(folds.where(F.col("fold") != f).drop("fold"), features, policy, kind, label_col,
                                      optimise_thresholds=False, **params)
            parts.append(_scored(b, folds.where(F.col("fold") == f), policy, label_col, "fold", f))
        per, classes = _evaluated(parts, policy, "fold")
    finally:
        folds.unpersist()
    return Evaluation(per, summarize(per, "fold"), classes)


def temporal_cross_validate(df: DataFrame, features: Sequence[str], policy: Policy, time_col: str,
                            kind: str = "multinomial", min_train_periods: int = 3, step: int = 1,
                            max_train_periods: int | None = None, label_col: str = "label", **params) -> Evaluation | None:
    """Expanding-window evaluation over distinct periods: per test period metrics, class scores, sizes and the class
    mix of its training and test rows; nan-skipping mean / std.  None if no period has two classes to train on."""
    tagged = sp.temporal_split(df, time_col, min_train_periods, step, max_train_periods).persist()
    try:
        mix = tagged.groupBy("split_id", F.col(label_col).cast("long").alias("cls")).agg(
            F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))
        counts = mix.collect()   # periods x classes rows
        parts = []
        for s in sorted({r["split_id"] for r in counts}):
            if sum(r["split_id"] == s and r["n_train"] > 0 for r in counts) < 2:
                continue
            own = tagged.where(F.col("split_id") == s)
            b = md.fit_cost_sensitive(own.where("role = 'train'").drop("split_id", "role"), features, policy, kind, label_col,
                                      optimise_thresholds=False, **params)
            parts.append(_scored(b, own.where("role = 'test'").drop("split_id", "role"), policy, label_col, "split_id", s))
        if not parts:
            return None
        per, classes = _evaluated(parts, policy, "split_id")
    finally:
        tagged.unpersist()
    rows = [tuple(r) for r in counts]
    mix = df.sparkSession.createDataFrame(rows, "split_id long, cls long, n_train long, n_test long")
    sizes = mix.groupBy("split_id").agg(F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"))
    summary = summarize(per, "split_id")
    return Evaluation(per.join(sizes, "split_id", "left"), summary, classes, mix)


def bootstrap_evaluation(train: DataFrame, test: DataFrame, features: Sequence[str], policy: Policy,
                         n_boot: int = 10, kind: str = "multinomial", id_col: str = "row_id", label_col: str = "label",
                         seed: int = 42, **params) -> Evaluation:
    """B refits on Poisson-bootstrap weights (weight x class weight - no row duplication), each scored on the
    test set; per-replicate metrics and class scores, and the metrics' mean / pop std / 2.5-97.5%."""
    base = attach_sample_weight(train, policy, label_col).persist()
    parts = []
    try:
        for r in range(n_boot):
            k = sp.poisson_draw(id_col, F.lit(r), seed)
            tr = base.withColumn("_k", k).where("_k > 0").withColumn("sample_weight", F.col("sample_weight") * F.col("_k")).drop("_k")
            model = md.fit_weighted(md.make_classifier(kind, label_col, **params), md.assemble(tr, features), kind)
            b = {"model": model, "features": list(features), "thresholds": {c: policy.threshold(c) for c in policy.classes}}
            parts.append(_scored(b, test, policy, label_col, "replicate", r))
        per, classes = _evaluated(parts, policy, "replicate")
    finally:
        base.unpersist()
    cols = [c for c in per.columns if c != "replicate"]
    long = per.select("replicate", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        "replicate", cols, "metric", "value")
    summ = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.percentile("value", 0.025).alias("ci_lower"),
                                      F.percentile("value", 0.975).alias("ci_upper"))
    return Evaluation(per, summ, classes)


def batch_score_table(df: DataFrame, score: F.Column, id_col: str, time_col: str, keep: int = 10) -> DataFrame:
    """Score every row and keep each entity's latest ``keep`` rows (top-k per id by time)."""
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    w = Window.partitionBy(id_col).orderBy(F.col(time_col).desc(), tie)
    return df.withColumn("score", score).withColumn("_r", F.row_number().over(w)) \
             .where(F.col("_r") <= keep).drop("_r")
