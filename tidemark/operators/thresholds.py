"""Cost-based decision-threshold optimisation in one pass over the scores.

Each score is bucketed by the number of grid thresholds <= score (a literal array), the
data is reduced to (class, bucket, label) counts - at most classes x (G+1) x 2 rows -
and every threshold's confusion cells come from a cumulative window over that tiny
table.  The grid is never joined against the data.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import safe_div
from tidemark.sources.policy import Policy


def grid(n: int = 100, lo: float = 0.01, hi: float = 0.99) -> list[float]:
    return [float(x) for x in np.linspace(lo, hi, n)]


def _ratio0(a, b) -> Column:
    return F.coalesce(safe_div(a, F.nullif(b, F.lit(0))), F.lit(0.0))


def sweep_counts(scored: DataFrame, thresholds: Sequence[float], score_col: str, pos: Column,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups, threshold, tp, fp, tn, fn) for every grid threshold (p >= tau positive)."""
    arr = F.array(*[F.lit(float(t)) for t in thresholds])
    bucket = F.size(F.filter(arr, lambda t: t <= F.col(score_col)))
    g = list(group_cols)
    cnt = scored.groupBy(*g, bucket.alias("_b")).agg(
        F.count_if(pos).cast("long").alias("_pos"), F.count_if(~pos).cast("long").alias("_neg"))
    # every threshold index j needs the sum over buckets > j: add an empty row per grid point
    # (generated with explode over the distinct groups - groups x G rows, no join)
    if g:
        keys = cnt.select(*g).distinct()
    else:
        keys = scored.sparkSession.range(1).select()
    ext = keys.select(*g, F.posexplode(arr).alias("j", "threshold")).select(
        *g, (F.col("j") + 1).alias("_b"), F.lit(0).cast("long").alias("_pos"),
        F.lit(0).cast("long").alias("_neg"), F.col("threshold"))
    allb = cnt.withColumn("threshold", F.lit(None).cast("double")).unionByName(ext)
    allb = allb.groupBy(*g, "_b").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"),
                                      F.max("threshold").alias("threshold"))
    w = Window.partitionBy(*g).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*g)
    x = allb.select(*g, "_b", "threshold", F.sum("_pos").over(w).alias("tp"), F.sum("_neg").over(w).alias("fp"),
                    F.sum("_pos").over(tot).alias("_P"), F.sum("_neg").over(tot).alias("_N"))
    x = x.where(F.col("threshold").isNotNull())
    return x.select(*g, "threshold", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                    (F.col("_N") - F.col("fp")).cast("long").alias("tn"),
                    (F.col("_P") - F.col("tp")).cast("long").alias("fn"))


def _metrics(x: DataFrame, fn_cost: Column, fp_cost: Column) -> DataFrame:
    return x.withColumns({
        "false_neg_cost": F.col("fn") * fn_cost,
        "false_pos_cost": F.col("fp") * fp_cost,
    }).withColumns({
        "total_cost": F.col("false_neg_cost") + F.col("false_pos_cost"),
        "sensitivity": _ratio0(F.col("tp"), F.col("tp") + F.col("fn")),
        "specificity": _ratio0(F.col("tn"), F.col("tn") + F.col("fp")),
        "precision": _ratio0(F.col("tp"), F.col("tp") + F.col("fp")),
        "npv": _ratio0(F.col("tn"), F.col("tn") + F.col("fn")),
    })


def threshold_sweep(scored: DataFrame, score_col: str = "score", true_col: str = "y_true",
                    fn_cost: float = 10.0, fp_cost: float = 1.0, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Binary sweep: per threshold confusion cells, costs, sensitivity, specificity, precision, NPV."""
    th = grid() if thresholds is None else list(thresholds)
    x = sweep_counts(scored, th, score_col, F.col(true_col).cast("long") == 1)
    return _metrics(x, F.lit(float(fn_cost)), F.lit(float(fp_cost)))


def optimal_threshold(sweep: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """First (lowest) threshold of minimum total cost per group."""
    return sweep.groupBy(*group_cols).agg(
        F.min(F.struct("total_cost", "threshold")).alias("_m")).select(
        *group_cols, F.col("_m.threshold").alias("optimal_threshold"), F.col("_m.total_cost").alias("min_total_cost"))


def threshold_sweep_multiclass(p_long: DataFrame, policy: Policy, thresholds: Sequence[float] | None = None,
                               cls_col="cls", score_col="p", true_col="y_true") -> DataFrame:
    """Per class one-vs-rest sweep with the policy's FN/FP costs - one pass for all classes."""
    th = grid() if thresholds is None else list(thresholds)
    pos = F.col(true_col).cast("long") == F.col(cls_col).cast("long")
    base = p_long.select(F.col(cls_col).cast("long").alias("cls"), F.col(score_col).alias("_s"), pos.alias("_pos"))
    x = sweep_counts(base, th, "_s", F.col("_pos"), ["cls"])
    lvl = policy.risk_expr("cls", "moderate_risk")
    x = x.withColumn("risk_level", lvl)
    return _metrics(x, policy.level_cost_expr(F.col("risk_level"), "fn"),
                    policy.level_cost_expr(F.col("risk_level"), "fp"))


def optimal_thresholds_multiclass(p_long: DataFrame, policy: Policy, thresholds: Sequence[float] | None = None,
                                  **kw) -> DataFrame:
    return optimal_threshold(threshold_sweep_multiclass(p_long, policy, thresholds, **kw), ["cls"])


def choose_thresholds(p_long: DataFrame, policy: Policy, n_rows: int | None = None, min_rows: int = 50,
                      min_change: float = 0.1, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Keep the policy default unless the cost-optimal threshold differs by more than ``min_change``.

    Below ``min_rows`` labelled rows the defaults are returned unchanged.  Thresholds use
    the training grid (50 points in [0.1, 0.9]).
    """
    th = grid(50, 0.1, 0.9) if thresholds is None else list(thresholds)
    spark = p_long.sparkSession
    defaults = spark.createDataFrame([(c, policy.threshold(c)) for c in policy.classes],
                                     "cls bigint, default_threshold double")
    if n_rows is not None and n_rows < min_rows:
        return defaults.withColumn("threshold", F.col("default_threshold"))
    opt = optimal_thresholds_multiclass(p_long, policy, th)
    j = defaults.join(opt, "cls", "left")
    keep = F.col("optimal_threshold").isNull() | (F.abs(F.col("optimal_threshold") - F.col("default_threshold")) <= min_change)
    return j.select("cls", "default_threshold", "optimal_threshold",
                    F.when(keep, F.col("default_threshold")).otherwise(F.col("optimal_threshold")).alias("threshold"))


def value_at_nearest_threshold(sweep: DataFrame, selected: float, metric: str,
                               group_cols: Sequence[str] = ()) -> DataFrame:
    """Metric value at the grid threshold nearest ``selected`` (lower threshold on ties)."""
    d = F.abs(F.col("threshold") - F.lit(float(selected)))
    return sweep.groupBy(*group_cols).agg(F.min(F.struct(d.alias("d"), F.col("threshold"), F.col(metric)))
                                          .alias("_m")).select(*group_cols, F.col("_m.threshold").alias("threshold"),
                                                               F.col(f"_m.{metric}").alias(metric))


def threshold_policy_table(spark: SparkSession, policy: Policy, current: dict | None = None) -> DataFrame:
    """class, level, default 0.5, current tau, goal text by level."""
    goals = {"high_risk": "Maximise sensitivity (catch every case)",
             "moderate_risk": "Balance sensitivity and specificity",
             "low_risk": "Limit over-treatment (favour specificity)"}
    rows = []
    for c in policy.priority_order():
        lvl = policy.risk_of(c)
        cur = (current or {}).get(c, policy.threshold(c))
        rows.append((c, lvl, 0.5, float(cur) if cur is not None else None, goals.get(lvl)))
    return spark.createDataFrame(rows, "cls bigint, risk_level string, default_threshold double, "
                                       "current_threshold double, goal string")
