"""Report tables: the data behind every chart (histograms, strata, composition, rankings).

All are aggregations to small results or projections; per-metric normalisation uses
windows over metric tables that have one row per (model, metric).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import safe_div
from tidemark.functions.stats import exact_quantiles


def score_distribution(df: DataFrame, score_col: str = "score", by: str | None = "y_true",
                       n_bins: int = 20) -> DataFrame:
    """Equal-width histogram on [min, max] (max falls in the last bin), optionally by class."""
    mm = df.agg(F.min(score_col).alias("lo"), F.max(score_col).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin bigint, bin_lo double, bin_hi double, count bigint")
    width = (hi - lo) / n_bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(score_col) - F.lit(lo)) / F.lit(width)).cast("long"), F.lit(n_bins - 1))
    keys = [b.alias("bin")] + ([F.col(by)] if by else [])
    g = df.where(F.col(score_col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("bin_lo", F.lit(lo) + F.col("bin") * F.lit(width)) \
            .withColumn("bin_hi", F.lit(lo) + (F.col("bin") + 1) * F.lit(width))


def class_separation(df: DataFrame, score_col: str = "score", true_col: str = "y_true") -> DataFrame:
    """Mean and population std of the score per class and (mu1-mu0)/((sd1+sd0)/2)."""
    pos = F.col(true_col) == 1
    g = df.agg(F.avg(F.when(pos, F.col(score_col))).alias("mean_pos"),
               F.avg(F.when(~pos, F.col(score_col))).alias("mean_neg"),
               F.stddev_pop(F.when(pos, F.col(score_col))).alias("std_pos"),
               F.stddev_pop(F.when(~pos, F.col(score_col))).alias("std_neg"))
    return g.withColumn("separation", safe_div(F.col("mean_pos") - F.col("mean_neg"),
                                               F.nullif((F.col("std_pos") + F.col("std_neg")) / 2, F.lit(0.0))))


def score_quantiles(df: DataFrame, score_col: str = "score",
                    probs: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)) -> DataFrame:
    """Exact quantiles (bounded-memory refinement) plus count/mean/std/min/max, one row."""
    qs = exact_quantiles(df, [score_col], list(probs))[score_col]
    base = df.agg(F.count(score_col).alias("count"), F.avg(score_col).alias("mean"),
                  F.stddev_samp(score_col).alias("std"), F.min(score_col).alias("min"), F.max(score_col).alias("max"))
    return base.select("*", *[F.lit(v).cast("double").alias(f"p{int(round(p * 100))}") for p, v in zip(probs, qs)])


def strata_labels(n: int) -> list[str]:
    """Stratum names by number of strata."""
    if n == 2:
        return ["Low Risk", "High Risk"]
    if n == 3:
        return ["Low Risk", "Moderate Risk", "High Risk"]
    if n == 4:
        return ["Low Risk", "Moderate Risk", "High Risk", "Very High Risk"]
    return [f"Stratum {i + 1}" for i in range(n)]


def stratum_expr(score: Column, cuts: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """[lo, hi) strata from sorted inner cut points; outer bounds open."""
    cuts = sorted(cuts)
    labels = list(labels) if labels else strata_labels(len(cuts) + 1)
    e = None
    for c, lab in zip(cuts, labels):
        e = F.when(score < F.lit(float(c)), F.lit(lab)) if e is None else e.when(score < F.lit(float(c)), F.lit(lab))
    last = F.lit(labels[len(cuts)])
    return last if e is None else e.otherwise(last)


def risk_strata(df: DataFrame, cuts: Sequence[float], score_col: str = "score", true_col: str = "y_true",
                labels: Sequence[str] | None = None) -> DataFrame:
    """count, share, positives and positive rate per stratum."""
    s = stratum_expr(F.col(score_col), cuts, labels)
    order = {lab: i for i, lab in enumerate(list(labels) if labels else strata_labels(len(cuts) + 1))}
    ordm = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    g = df.groupBy(s.alias("stratum")).agg(F.count(F.lit(1)).alias("count"),
                                          F.sum(F.col(true_col).cast("long")).alias("positives"))
    return g.select(F.element_at(ordm, F.col("stratum")).cast("long").alias("stratum_order"), "stratum", "count",
                    (F.col("count") / F.sum("count").over(Window.partitionBy()) * 100).alias("percentage"),
                    "positives", safe_div(F.col("positives"), F.col("count")).alias("positive_rate"))


def risk_composition(df: DataFrame, id_col: str, feature_cols: Sequence[str], top_n: int = 3,
                     rank_by: str = "mean_abs", normalize: bool = False) -> DataFrame:
    """Top-n features by mean|x| / max|x| / variance, the rest folded into 'Other';
    per-id mean contribution per group (optionally row-normalised by sum |.|)."""
    long = df.select(id_col, *feature_cols).unpivot(id_col, list(feature_cols), "feature", "value")
    stat = {"mean_abs": F.avg(F.abs("value")), "max_abs": F.max(F.abs("value")),
            "variance": F.var_samp("value")}[rank_by]
    rank = long.groupBy("feature").agg(stat.alias("_s"))
    rank = rank.withColumn("_r", F.row_number().over(Window.orderBy(F.col("_s").desc_nulls_last(), "feature")))
    # one row per feature (p rows), broadcast back
    long = long.join(F.broadcast(rank.select("feature", "_r")), "feature")
    grp = F.when(F.col("_r") <= top_n, F.col("feature")).otherwise(F.lit("Other"))
    per = long.groupBy(id_col, grp.alias("group")).agg(F.avg("value").alias("mean_contribution"))
    if normalize:
        tot = F.sum(F.abs("mean_contribution")).over(Window.partitionBy(id_col))
        per = per.withColumn("mean_contribution", safe_div(F.col("mean_contribution"), tot))
    return per


def unpivot_metrics(df: DataFrame, id_cols: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    """Wide -> long (id..., metric, value)."""
    return df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in metric_cols]) \
             .unpivot(list(id_cols), list(metric_cols), "metric", "value")


LOWER_IS_BETTER = {"total_cost", "false_neg_cost", "false_pos_cost", "time_weighted_error",
                   "fn_rate_high_risk", "fn_rate_moderate_risk", "fn_rate_low_risk", "brier", "log_loss"}


def compare_models_table(metrics_long: DataFrame, metric: str, model_col: str = "model") -> DataFrame:
    """Models ordered by one metric in its better direction (rank 1 = best)."""
    better_low = metric in LOWER_IS_BETTER
    m = metrics_long.where(F.col("metric") == metric)
    order = F.col("value").asc_nulls_last() if better_low else F.col("value").desc_nulls_last()
    return m.select(model_col, "metric", "value",
                    F.row_number().over(Window.partitionBy("metric").orderBy(order, model_col)).cast("long").alias("rank"))


def metric_vs_baseline(metrics_long: DataFrame, baseline: DataFrame, model_col: str = "model") -> DataFrame:
    """difference = value - baseline; improved respects the metric's direction."""
    b = baseline.select(F.col("metric"), F.col("value").alias("baseline"))
    j = metrics_long.join(F.broadcast(b), "metric", "left")   # baseline: one row per metric
    diff = F.col("value") - F.col("baseline")
    low = F.col("metric").isin(*sorted(LOWER_IS_BETTER))
    imp = F.when(low, diff < 0).otherwise(diff > 0)
    return j.select(model_col, "metric", "value", "baseline", diff.alias("difference"),
                    F.when(imp, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("improved"))


def minmax_normalise_metrics(metrics_long: DataFrame) -> DataFrame:
    """Per metric (x - min) / (max - min); all equal -> 0.5."""
    w = Window.partitionBy("metric")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return metrics_long.withColumn("normalized", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(F.lit(0.5)))


def rank_models(metrics_long: DataFrame, weights: Mapping[str, float] | None = None, model_col: str = "model") -> DataFrame:
    """min-max per metric, flipped when lower is better, weighted sum, ranked desc."""
    n = minmax_normalise_metrics(metrics_long)
    low = F.col("metric").isin(*sorted(LOWER_IS_BETTER))
    score = F.when(low, 1 - F.col("normalized")).otherwise(F.col("normalized"))
    if weights:
        wm = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        wt = F.coalesce(F.try_element_at(wm, F.col("metric")), F.lit(0.0))
    else:
        wt = F.lit(1.0)
    g = n.groupBy(model_col).agg(F.sum(score * wt).alias("score"))
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.col("score").desc())).cast("long"))


def metric_pairs(metrics_long: DataFrame, metric_x: str, metric_y: str, model_col: str = "model") -> DataFrame:
    """Models having both metrics: (model, x, y)."""
    m = metrics_long.where(F.col("metric").isin(metric_x, metric_y))
    g = m.groupBy(model_col).agg(F.max(F.when(F.col("metric") == metric_x, F.col("value"))).alias(metric_x),
                                 F.max(F.when(F.col("metric") == metric_y, F.col("value"))).alias(metric_y))
    return g.where(F.col(metric_x).isNotNull() & F.col(metric_y).isNotNull())


def class_catalog(policy_df: DataFrame, labels: DataFrame, label_col: str = "y_pred") -> DataFrame:
    """Class, description, level and whether the class occurs in ``labels``."""
    present = labels.select(F.col(label_col).cast("long").alias("cls")).distinct().withColumn("_p", F.lit(1))
    j = policy_df.join(present, "cls", "left")
    return j.select("cls", "description", "risk_level",
                    F.when(F.col("_p").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("in_model"))


def probability_table(p_long: DataFrame, policy_df: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Outcome probabilities per row with description, rank by probability and an above-tau flag."""
    j = p_long.join(F.broadcast(policy_df.select("cls", "description")), "cls", "left")
    w = Window.partitionBy("row_id").orderBy(F.col("p").desc(), F.col("cls"))
    return j.select("row_id", "cls", "description", "p", F.row_number().over(w).cast("long").alias("rank"),
                    F.when(F.col("p") >= threshold, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("above_threshold"))


def threshold_effects(sweep: DataFrame, metrics: Sequence[str], id_cols: Sequence[str] = ("cls",)) -> DataFrame:
    """Long table (threshold, id..., metric, value)."""
    return unpivot_metrics(sweep, list(id_cols) + ["threshold"], metrics)


def cost_breakdown(model_utilities: DataFrame, model_col: str = "model") -> DataFrame:
    """Stacked FN/FP cost per risk level and model plus per-model subtotal rows."""
    cols = [c for c in model_utilities.columns if c.startswith(("fn_cost_", "fp_cost_"))]
    long = model_utilities.select(model_col, *cols).unpivot(model_col, cols, "cell", "cost")
    long = long.select(model_col, F.regexp_extract("cell", r"^(fn|fp)_cost_(.*)$", 2).alias("risk_level"),
                       F.when(F.col("cell").startswith("fn"), F.lit("false_negative")).otherwise(F.lit("false_positive"))
                       .alias("error_type"), "cost")
    sub = long.groupBy(model_col).agg(F.sum("cost").alias("cost")).select(
        model_col, F.lit("all").alias("risk_level"), F.lit("subtotal").alias("error_type"), "cost")
    return long.unionByName(sub)


def risk_map(df: DataFrame, x: str, y: str, risk: str, label: str, threshold: float) -> DataFrame:
    return df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(risk).alias("risk"), F.col(label).alias("label"),
                     F.when(F.col(risk) >= threshold, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("highlight"))


def experiment_summary(spark, name: str, runtime_s: float, metrics: Mapping[str, float],
                       params: Mapping[str, str] | None = None) -> DataFrame:
    """One run record (name, time, runtime, metrics map, params map) to append to a runs table."""
    import datetime
    row = [(name, datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), float(runtime_s),
            {k: float(v) for k, v in metrics.items()}, {k: str(v) for k, v in (params or {}).items()})]
    return spark.createDataFrame(row, "name string, ts timestamp, runtime_s double, "
                                      "metrics map<string,double>, params map<string,string>")
