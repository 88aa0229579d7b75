"""Cost-aware evaluation aggregates.

Foundation: ``confusion_counts`` = ``groupBy(groups, y_true, y_pred).count()`` - a partial
aggregation to at most K^2 rows per group.  Every class metric derives from that tiny
table without touching the data again.  Curve metrics (AUC, ROC, PR) use a two-phase
prefix sum (``prefix_sums``) so no single task ever holds a whole class.
"""

from __future__ import annotations

import hashlib
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import safe_div
from tidemark.sources.policy import Policy

LEVEL_AUC_WEIGHT = {"high_risk": 3.0, "moderate_risk": 2.0, "low_risk": 1.0}


def _z(c) -> Column:
    return F.coalesce(c, F.lit(0))


def _ratio0(a, b) -> Column:
    """a / b with 0 on zero division (sklearn zero_division=0)."""
    return F.coalesce(safe_div(a, F.nullif(b, F.lit(0))), F.lit(0.0))


def confusion_counts(df: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols, F.col(true_col).cast("long").alias("y_true"),
                      F.col(pred_col).cast("long").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred",
                     group_cols: Sequence[str] = (), normalize: bool = False) -> DataFrame:
    """(y_true, y_pred, n[, share of the true row]) - long form of the matrix."""
    cm = confusion_counts(df, true_col, pred_col, group_cols)
    if normalize:
        w = Window.partitionBy(*group_cols, "y_true")
        cm = cm.withColumn("share", F.col("n") / F.sum("n").over(w))
    return cm


def one_vs_rest_counts(df: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred",
                       group_cols: Sequence[str] = ()) -> DataFrame:
    """tp/fp/fn/tn and support per class over labels present in either column."""
    return one_vs_rest_from_cm(confusion_counts(df, true_col, pred_col, group_cols), group_cols)


def one_vs_rest_from_cm(cm: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Same, from a (groups, y_true, y_pred, n) confusion table (n may be weighted)."""
    g = list(group_cols)
    t = cm.groupBy(*g, F.col("y_true").alias("cls")).agg(
        F.sum("n").alias("n_true"), F.sum(F.when(F.col("y_pred") == F.col("y_true"), F.col("n"))).alias("tp"))
    p = cm.groupBy(*g, F.col("y_pred").alias("cls")).agg(F.sum("n").alias("n_pred"))
    j = t.join(p, g + ["cls"], "full")
    tot = Window.partitionBy(*g) if g else Window.partitionBy()
    tp, nt, npred = _z(F.col("tp")), _z(F.col("n_true")), _z(F.col("n_pred"))
    n = F.sum(nt).over(tot)
    return j.select(*g, "cls", tp.cast("long").alias("tp"), (npred - tp).cast("long").alias("fp"),
                    (nt - tp).cast("long").alias("fn"), (n - nt - npred + tp).cast("long").alias("tn"),
                    nt.cast("long").alias("support"), n.cast("long").alias("n"))


def _with_costs(ovr: DataFrame, policy: Policy) -> DataFrame:
    lvl = policy.risk_expr("cls", "moderate_risk")
    return ovr.withColumn("risk_level", lvl) \
              .withColumn("fn_cost", policy.level_cost_expr(F.col("risk_level"), "fn")) \
              .withColumn("fp_cost", policy.level_cost_expr(F.col("risk_level"), "fp"))


def clinical_utility_detail(df: DataFrame, policy: Policy, true_col="y_true", pred_col="y_pred",
                            group_cols: Sequence[str] = ()) -> DataFrame:
    o = _with_costs(one_vs_rest_counts(df, true_col, pred_col, group_cols), policy)
    return o.withColumn("class_cost", F.col("fn") * F.col("fn_cost") + F.col("fp") * F.col("fp_cost")) \
            .withColumn("class_max_cost", F.col("n") * F.greatest("fn_cost", "fp_cost"))


def clinical_utility(df: DataFrame, policy: Policy, true_col="y_true", pred_col="y_pred",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """1 - sum(fn*fn_cost + fp*fp_cost) / sum(N * max(fn_cost, fp_cost)) per group."""
    d = clinical_utility_detail(df, policy, true_col, pred_col, group_cols)
    g = d.groupBy(*group_cols).agg(F.sum("class_cost").alias("total_cost"),
                                   F.sum("class_max_cost").alias("max_possible_cost"))
    return g.withColumn("utility_score", 1 - safe_div("total_cost", "max_possible_cost"))


def error_costs(df: DataFrame, policy: Policy, true_col="y_true", pred_col="y_pred",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """FN and FP cost per risk level (levels without classes are absent)."""
    d = clinical_utility_detail(df, policy, true_col, pred_col, group_cols)
    return d.groupBy(*group_cols, "risk_level").agg(
        F.sum(F.col("fn") * F.col("fn_cost")).alias("false_neg_cost"),
        F.sum(F.col("fp") * F.col("fp_cost")).alias("false_pos_cost"))


def weighted_f_score(df: DataFrame, policy: Policy, beta: float = 2.0, true_col="y_true", pred_col="y_pred",
                     group_cols: Sequence[str] = (), per_class: bool = False) -> DataFrame:
    """F-beta per class (beta x1.5 high risk, x0.75 low risk), weighted by true share."""
    o = one_vs_rest_counts(df, true_col, pred_col, group_cols).withColumn(
        "risk_level", policy.risk_expr("cls", "moderate_risk"))
    b = F.when(F.col("risk_level") == "high_risk", F.lit(beta * 1.5)) \
         .when(F.col("risk_level") == "low_risk", F.lit(beta * 0.75)).otherwise(F.lit(float(beta)))
    b2 = b * b
    f = _ratio0((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp"))
    o = o.withColumn("f_beta", f).withColumn("weight", F.col("support") / F.col("n"))
    if per_class:
        return o.select(*group_cols, "cls", "risk_level", "f_beta", "weight")
    return o.groupBy(*group_cols).agg(F.sum(F.col("f_beta") * F.col("weight")).alias("weighted_f_score"))


def time_weighted_error(df: DataFrame, true_col="y_true", pred_col="y_pred", time_col="t_days",
                        discount: float = 0.9, max_time: float | None = None) -> DataFrame:
    """mean(err * d^(t / max t)).  ``max_time`` is a frozen scalar (computed once if absent)."""
    if max_time is None:
        max_time = float(df.agg(F.max(time_col)).first()[0])
    err = F.when(F.col(true_col) != F.col(pred_col), F.lit(1.0)).otherwise(F.lit(0.0))
    w = F.pow(F.lit(float(discount)), F.col(time_col) / F.lit(max_time))
    return df.agg(F.avg(err * w).alias("time_weighted_error"))


def high_risk_recall(df: DataFrame, policy: Policy, true_col="y_true", pred_col="y_pred",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """Support-weighted recall over high-risk classes present in either column; null if none."""
    o = one_vs_rest_counts(df, true_col, pred_col, group_cols)
    hr = o.where(F.col("cls").isin(*policy.high_risk_classes))
    return hr.groupBy(*group_cols).agg(
        safe_div(F.sum("tp"), F.nullif(F.sum("support"), F.lit(0))).alias("high_risk_recall"))


def class_metrics(df: DataFrame, policy: Policy, true_col="y_true", pred_col="y_pred",
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, specificity, F1, F2 (risk-adjusted beta), support, costs."""
    o = _with_costs(one_vs_rest_counts(df, true_col, pred_col, group_cols), policy)
    prec = _ratio0(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _ratio0(F.col("tp"), F.col("tp") + F.col("fn"))
    spec = _ratio0(F.col("tn"), F.col("tn") + F.col("fp"))
    o = o.withColumns({"precision": prec, "recall": rec, "specificity": spec})
    o = o.withColumn("f1_score", _ratio0(2 * F.col("precision") * F.col("recall"),
                                         F.col("precision") + F.col("recall")))
    b = F.when(F.col("risk_level") == "high_risk", F.lit(3.0)).when(F.col("risk_level") == "low_risk", F.lit(1.5)) \
         .otherwise(F.lit(2.0))
    b2 = b * b
    o = o.withColumn("f2_score", _ratio0((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp")))
    return o.select(*group_cols, "cls", "precision", "recall", "specificity", "f1_score", "f2_score",
                    "support", "risk_level", "fn_cost", "fp_cost")


def accuracy_macro(df: DataFrame, true_col="y_true", pred_col="y_pred", group_cols: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro precision / recall / F1 (0 on zero division)."""
    o = one_vs_rest_counts(df, true_col, pred_col, group_cols)
    prec = _ratio0(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _ratio0(F.col("tp"), F.col("tp") + F.col("fn"))
    o = o.withColumns({"prec": prec, "rec": rec})
    o = o.withColumn("f1", _ratio0(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")))
    return o.groupBy(*group_cols).agg(
        (F.sum("tp") / F.max("n")).alias("accuracy"), F.avg("prec").alias("precision_macro"),
        F.avg("rec").alias("recall_macro"), F.avg("f1").alias("f1_macro"))


def class_distribution(df: DataFrame, label_col: str = "label", group_cols: Sequence[str] = ()) -> DataFrame:
    c = df.groupBy(*group_cols, F.col(label_col).alias("cls")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    return c.withColumn("share", F.col("count") / F.sum("count").over(w))


# ---------------------------------------------------------------------------
# exact curve metrics via two-phase prefix sums
# ---------------------------------------------------------------------------

#: Of the sorted edges of buckets, every so many are looked through first.
EDGE_STEP = 16


def _edges_below(n_buckets: int, value: Column) -> Column:
    """How many of the sorted edges ``_e`` lie below a value: first by every ``EDGE_STEP``-th (``_coarse``), then by those up to the next."""
    if n_buckets <= 2 * EDGE_STEP:
        return F.size(F.filter("_e", lambda e: e < value))
    first = F.size(F.filter("_coarse", lambda e: e < value)) * EDGE_STEP
    return first + F.size(F.filter(F.slice("_e", first + 1, F.lit(EDGE_STEP)), lambda e: e < value))


def prefix_sums(df: DataFrame, keys: Sequence[str], order_col: str, value_cols: Sequence[str],
                n_buckets: int = 256) -> DataFrame:
    """Add ``<v>_before``: sum of v over rows with a strictly smaller ``order_col`` in ``keys``.

    ``order_col`` must be unique within ``keys`` (aggregate first).  Phase 1 cuts each key's
    order range into ``n_buckets`` approximate-quantile buckets and totals them (a table of
    |keys| x n_buckets rows, broadcast); phase 2 runs the running sum inside each (key,
    bucket).  A key with billions of distinct values is thus spread over n_buckets tasks.
    """
    keys = list(keys)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    edges = df.groupBy(*keys).agg(F.percentile_approx(order_col, probs, 10000).alias("_e"))
    edges = edges.withColumn("_coarse", F.filter("_e", lambda e, i: i % EDGE_STEP == EDGE_STEP - 1))
    x = df.join(F.broadcast(edges), keys, "inner") \
          .withColumn("_b", _edges_below(n_buckets, F.col(order_col))).drop("_e", "_coarse")
    bt = x.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_bt_{v}") for v in value_cols])
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*keys, "_b", *[F.coalesce(F.sum(f"_bt_{v}").over(wb), F.lit(0)).alias(f"_bo_{v}")
                                  for v in value_cols])
    x = x.join(F.broadcast(bt), keys + ["_b"], "inner")
    wl = Window.partitionBy(*keys, "_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = x.select(*[c for c in x.columns if not c.startswith("_bo_") and c != "_b"],
                   *[(F.col(f"_bo_{v}") + F.coalesce(F.sum(v).over(wl), F.lit(0))).alias(f"{v}_before")
                     for v in value_cols])
    return out


def score_counts(p_long: DataFrame, cls_col="cls", score_col="p", true_col="y_true", group_cols: Sequence[str] = (),
                 count_col: str | None = None) -> DataFrame:
    """(groups, cls, score, n_pos, n_neg) per distinct score - partial aggregation.  A row may stand for ``count_col`` rows."""
    pos = F.col(true_col).cast("long") == F.col(cls_col).cast("long")
    count = F.count_if if count_col is None else lambda which: F.sum(F.when(which, F.col(count_col)).otherwise(0))
    return p_long.groupBy(*group_cols, F.col(cls_col).cast("long").alias("cls"), F.col(score_col).alias("score")).agg(
        count(pos).cast("long").alias("n_pos"), count(~pos).cast("long").alias("n_neg"))


def with_totals(sc: DataFrame, keys: Sequence[str] = ("cls",)) -> tuple[DataFrame, Column, Column]:
    """Scores with their class's positives and negatives: one row per class, summed with partial
    aggregates and broadcast, so that a class isn't gathered for a window or a join."""
    totals = sc.groupBy(*keys).agg(F.sum("n_pos").alias("_P"), F.sum("n_neg").alias("_N"))
    return sc.join(F.broadcast(totals), list(keys)), F.col("_P"), F.col("_N")


def auc_per_class(p_long: DataFrame, cls_col="cls", score_col="p", true_col="y_true", group_cols: Sequence[str] = (),
                  n_buckets: int = 256, count_col: str | None = None) -> DataFrame:
    """Exact tie-aware one-vs-rest ROC AUC per class; 0.5 if a class lacks positives or negatives.

    With ``group_cols`` (folds, candidates, replicates) one pass yields every group's AUC.  ``count_col``: rows a row stands for.
    """
    keys = [*group_cols, "cls"]
    sc = prefix_sums(score_counts(p_long, cls_col, score_col, true_col, group_cols, count_col), keys, "score", ["n_neg"], n_buckets)
    g = sc.groupBy(*keys).agg(
        F.sum(F.col("n_pos") * (F.col("n_neg_before") + 0.5 * F.col("n_neg"))).alias("_u"),
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).otherwise(F.lit(0.5))
    return g.select(*keys, auc.alias("auc"), "n_pos", "n_neg")


def weighted_ovr_auc(p_long: DataFrame, cls_col="cls", score_col="p", true_col="y_true", group_cols: Sequence[str] = (),
                     n_buckets: int = 256, count_col: str | None = None) -> DataFrame:
    """Mean of the one-vs-rest AUCs weighted by how many rows each class has: one row a group."""
    a = auc_per_class(p_long, cls_col, score_col, true_col, group_cols, n_buckets, count_col).where("n_pos > 0")
    return a.groupBy(*group_cols).agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("weighted_ovr_auc"))


def risk_adjusted_auc(p_long: DataFrame, policy: Policy, cls_col="cls", score_col="p", true_col="y_true",
                      classes_from_truth: bool = True) -> DataFrame:
    """Weighted mean of per-class AUC with weights 3/2/1 by risk level (unknown -> moderate).

    Classes are those present in y_true (the reference default); probabilities are keyed
    by class label, never by position.
    """
    a = auc_per_class(p_long, cls_col, score_col, true_col)
    if classes_from_truth:
        a = a.where(F.col("n_pos") > 0)
    lvl = policy.risk_expr("cls", "moderate_risk")
    w = F.when(lvl == "high_risk", F.lit(3.0)).when(lvl == "low_risk", F.lit(1.0)).otherwise(F.lit(2.0))
    return a.agg((F.sum(F.col("auc") * w) / F.sum(w)).alias("risk_adjusted_auc"))


def _curve(scored: DataFrame, score_col: str, true_col: str, cls_col: str | None, group_cols: Sequence[str]):
    """Cumulative counts at every distinct score (``_tp``, ``_fp``) and at the next higher one (``_tp1``, ``_fp1``)."""
    cls = F.lit(1) if cls_col is None else F.col(cls_col)
    base = scored.select(*group_cols, cls.cast("long").alias("cls"), F.col(score_col).alias("p"), F.col(true_col).cast("long").alias("y_true"))
    keys = [*group_cols, "cls"]
    sc, P, N = with_totals(prefix_sums(score_counts(base, group_cols=group_cols), keys, "score", ["n_pos", "n_neg"]), keys)
    tp, fp = P - F.col("n_pos_before"), N - F.col("n_neg_before")
    return sc.select(*keys, "score", P.alias("_P"), N.alias("_N"), tp.alias("_tp"), fp.alias("_fp"),
                     (tp - F.col("n_pos")).alias("_tp1"), (fp - F.col("n_neg")).alias("_fp1"))


def roc_points(scored: DataFrame, score_col="score", true_col="y_true", cls_col: str | None = None,
               group_cols: Sequence[str] = ()) -> DataFrame:
    """FPR/TPR at every distinct score threshold (p >= s predicted positive), and (0, 0) with a null threshold.

    ``cls_col`` given -> one curve per class of a long-form frame; else binary 0/1 labels.
    ``group_cols`` (models) have curves of their own.
    """
    sc = _curve(scored, score_col, true_col, cls_col, group_cols)
    point = F.struct(F.col("score").alias("threshold"), safe_div(F.col("_fp"), F.col("_N")).alias("fpr"),
                     safe_div(F.col("_tp"), F.col("_P")).alias("tpr"))
    start = F.struct(F.lit(None).cast(sc.schema["score"].dataType).alias("threshold"),
                     safe_div(F.lit(0), F.col("_N")).alias("fpr"), safe_div(F.lit(0), F.col("_P")).alias("tpr"))
    top = (F.col("_tp1") == 0) & (F.col("_fp1") == 0)  # nothing scores higher
    points = F.when(top, F.array(point, start)).otherwise(F.array(point))
    return sc.select(*group_cols, "cls", F.inline(points))


def curve_areas(scored: DataFrame, score_col="score", true_col="y_true", cls_col: str | None = None,
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Areas under the ROC and the precision-recall curve by trapezoids, per class and group.

    A row knows its own point and, as its score's counts are its own, the next higher one, so trapezoids across
    buckets need no neighbour: one aggregate.  The precision-recall curve ends at recall 0 and precision 1.
    Null where a class has no positives (or, for ROC, no negatives).
    """
    sc = _curve(scored, score_col, true_col, cls_col, group_cols)
    P, N = F.col("_P"), F.col("_N")
    ratio = lambda a, b: a.cast("double") / b
    roc = ratio(F.col("_fp") - F.col("_fp1"), N) * (ratio(F.col("_tp"), P) + ratio(F.col("_tp1"), P)) / 2
    above = F.col("_tp1") + F.col("_fp1")
    ahead = F.when(above == 0, F.lit(1.0)).otherwise(ratio(F.col("_tp1"), F.nullif(above, F.lit(0))))
    pr = ratio(F.col("_tp") - F.col("_tp1"), P) * (ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")) + ahead) / 2
    return sc.groupBy(*group_cols, "cls").agg(
        F.sum(F.when((P > 0) & (N > 0), roc)).alias("roc_area"), F.sum(F.when(P > 0, pr)).alias("pr_area"),
        F.max(safe_div(P, P + N)).alias("baseline"))


def pr_points(scored: DataFrame, score_col="score", true_col="y_true") -> DataFrame:
    """Precision/recall at every distinct score threshold (binary), prevalence as baseline."""
    sc = _curve(scored, score_col, true_col, None, ())
    P, N, tp, fp = (F.col(c) for c in ("_P", "_N", "_tp", "_fp"))
    return sc.select(F.col("score").alias("threshold"), safe_div(tp, tp + fp).alias("precision"),
                     safe_div(tp, P).alias("recall"), safe_div(P, P + N).alias("baseline"))


def precision_at_level(p_long: DataFrame, level: float = 0.3, cls_col="cls", score_col="p",
                       true_col="y_true") -> DataFrame:
    """Per class: precision / recall at the observed score nearest ``level`` (lowest on ties)."""
    sc = prefix_sums(score_counts(p_long, cls_col, score_col, true_col), ["cls"], "score", ["n_pos", "n_neg"])
    sc, P, N = with_totals(sc)
    tp, fp = P - F.col("n_pos_before"), N - F.col("n_neg_before")
    x = sc.select("cls", "score", safe_div(tp, tp + fp).alias("precision"), safe_div(tp, P).alias("recall"),
                  F.abs(F.col("score") - F.lit(level)).alias("dist"), P.alias("P"))
    x = x.where(F.col("P") > 0)
    best = x.groupBy("cls").agg(F.min(F.struct("dist", "score", "precision", "recall")).alias("b"))
    return best.select("cls", F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"),
                       F.col("b.score").alias("threshold"))


def calibration_bins(scored: DataFrame, score_col="score", true_col="y_true", n_bins: int = 10,
                     normalize: bool = False) -> DataFrame:
    """Bins on [0, 1+1e-8] (digitize), empty bins dropped: mean predicted, positive rate, count."""
    edges = np.linspace(0.0, 1.0 + 1e-8, n_bins + 1)
    arr = F.array(*[F.lit(float(e)) for e in edges])
    b = (F.size(F.filter(arr, lambda e: e <= F.col(score_col))) - 1).cast("long")
    g = scored.groupBy(b.alias("bin")).agg(
        F.avg(score_col).alias("prob_pred"), F.avg(F.col(true_col).cast("double")).alias("prob_true"),
        F.count(F.lit(1)).alias("count"))
    if normalize:
        g = g.withColumn("count", F.col("count") / F.sum("count").over(Window.partitionBy()))
    return g


def calibration_curve(scored: DataFrame, score_col="score", true_col="y_true", n_bins: int = 10) -> DataFrame:
    """Every bin of [0, 1] in equal widths: centre, mean predicted, positive rate and count, 0 where a bin is empty.

    A score on an edge belongs to the bin above, 1 to the last bin; scores beyond [0, 1] go to the nearest bin, and
    null scores or labels are left out.
    """
    edges = np.linspace(0.0, 1.0, n_bins + 1)
    arr = F.array(*[F.lit(float(e)) for e in edges])
    b = F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), F.size(F.filter(arr, lambda e: e <= F.col(score_col))) - 1))
    g = scored.where(F.col(score_col).isNotNull() & F.col(true_col).isNotNull()).groupBy(b.cast("long").alias("bin")).agg(
        F.avg(score_col).alias("prob_pred"), F.avg(F.col(true_col).cast("double")).alias("prob_true"),
        F.count(F.lit(1)).alias("count"))
    centres = scored.sparkSession.createDataFrame(
        [(i, float(c)) for i, c in enumerate((edges[:-1] + edges[1:]) / 2)], "bin long, center double")
    return centres.join(F.broadcast(g), "bin", "left").select(
        "bin", "center", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("prob_pred", "prob_true", "count")])


def clinical_report(df: DataFrame, policy: Policy, p_long: DataFrame, true_col="y_true", pred_col="y_pred",
                    cls_col="cls", score_col="p") -> tuple[DataFrame, DataFrame]:
    """(overall, classes): the report's overall block as (metric, value) rows, and the class block with its AUC.

    The class AUC is 0 for a class that has no true rows.  ``df`` is read once for all counts: every metric follows from
    its confusion table.
    """
    o = _with_costs(one_vs_rest_counts(df, true_col, pred_col), policy)
    b = F.when(F.col("risk_level") == "high_risk", F.lit(3.0)).when(F.col("risk_level") == "low_risk", F.lit(1.5)).otherwise(F.lit(2.0))
    f2 = _ratio0((1 + b * b) * F.col("tp"), (1 + b * b) * F.col("tp") + b * b * F.col("fn") + F.col("fp"))
    high = F.col("cls").isin(*policy.high_risk_classes)
    counts = o.agg(
        (1 - F.sum(F.col("fn") * F.col("fn_cost") + F.col("fp") * F.col("fp_cost"))
         / F.sum(F.col("n") * F.greatest("fn_cost", "fp_cost"))).alias("clinical_utility"),
        F.sum(f2 * F.col("support") / F.col("n")).alias("weighted_f2_score"),
        safe_div(F.sum(F.when(high, F.col("tp"))), F.nullif(F.sum(F.when(high, F.col("support"))), F.lit(0))).alias("high_risk_recall"))
    overall = counts.unpivot([], ["clinical_utility", "weighted_f2_score", "high_risk_recall"], "metric", "value").unionByName(
        risk_adjusted_auc(p_long, policy, cls_col, score_col, true_col).select(
            F.lit("risk_adjusted_auc").alias("metric"), F.col("risk_adjusted_auc").alias("value")))
    auc = auc_per_class(p_long, cls_col, score_col, true_col).where("n_pos > 0").select("cls", "auc")
    classes = class_metrics(df, policy, true_col, pred_col).join(F.broadcast(auc), "cls", "left")  # a row per class
    return overall, classes.withColumn("auc", F.coalesce("auc", F.lit(0.0)))


def compare_model_utilities(df: DataFrame, policy: Policy, model_col: str = "model",
                            true_col="y_true", pred_col="y_pred") -> DataFrame:
    """Per model: utility, FN rate per risk level, FN/FP cost per level, total cost (one job)."""
    d = clinical_utility_detail(df, policy, true_col, pred_col, [model_col])
    per = d.groupBy(model_col).agg(
        (1 - F.sum("class_cost") / F.sum("class_max_cost")).alias("utility_score"),
        F.sum("class_cost").alias("total_cost"),
        *[e for L in ("high_risk", "moderate_risk", "low_risk") for e in (
            _ratio0(F.sum(F.when(F.col("risk_level") == L, F.col("fn"))),
                    F.sum(F.when(F.col("risk_level") == L, F.col("support")))).alias(f"fn_rate_{L}"),
            F.coalesce(F.sum(F.when(F.col("risk_level") == L, F.col("fn") * F.col("fn_cost"))), F.lit(0.0))
             .alias(f"fn_cost_{L}"),
            F.coalesce(F.sum(F.when(F.col("risk_level") == L, F.col("fp") * F.col("fp_cost"))), F.lit(0.0))
             .alias(f"fp_cost_{L}"))])
    return per


def _cell_draws(seed: int):
    """Multiplicity of a confusion cell in a replicate: the sum of n Poisson(1) weights is Poisson(n)."""
    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("rep", "y_true", "y_pred", "n")]
            drawn = [int(np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{r}:{t}:{p}".encode()).digest()[:8], "big")).poisson(n))
                     for r, t, p, n in zip(*cols)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(drawn, pa.int64())],
                                  names=["rep", "y_true", "y_pred", "n"])
    return run


def bootstrap_metric_ci(df: DataFrame, policy: Policy, n_boot: int = 200, seed: int = 42,
                        true_col="y_true", pred_col="y_pred") -> tuple[DataFrame, DataFrame]:
    """Bootstrap distribution and CI of utility and accuracy without refitting.

    The metrics depend on the confusion table only, and under the Poisson bootstrap a cell of n rows has a Poisson(n)
    multiplicity: rows are counted once, then K^2 x B draws are made, each seeded by its cell and replicate, so
    the result is the same after any repartition.  Returns (per-replicate table, summary table).
    """
    cells = df.groupBy(F.col(true_col).cast("long").alias("y_true"), F.col(pred_col).cast("long").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    reps = cells.select(F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"), "y_true", "y_pred", "n")
    cm = reps.mapInArrow(_cell_draws(seed), "rep int, y_true long, y_pred long, n long").filter("n > 0")
    ovr = _with_costs(one_vs_rest_from_cm(cm, ["rep"]), policy)
    per = ovr.groupBy("rep").agg(
        (1 - F.sum(F.col("fn") * F.col("fn_cost") + F.col("fp") * F.col("fp_cost"))
         / F.sum(F.col("n") * F.greatest("fn_cost", "fp_cost"))).alias("utility_score"),
        (F.sum("tp") / F.max("n")).alias("accuracy"))
    long = per.unpivot("rep", ["utility_score", "accuracy"], "metric", "value")
    summ = long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.percentile("value", 0.5).alias("median"),
        F.percentile("value", 0.025).alias("ci_lower"), F.percentile("value", 0.975).alias("ci_upper"))
    return per, summ


def _poisson_cdf(kmax: int):
    import math
    out, acc = [], 0.0
    for k in range(kmax):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out
