"""Registered report-table queries (the data behind charts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels as lb
from tidemark.operators import metrics as mt
from tidemark.operators import reports as rp
from tidemark.operators import thresholds as th
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rounded, with_fixtures
from tidemark.plans.q_labels import POL, _risk_case
from tidemark.plans.q_metrics import MC_SWEEP, _cmu_sql, _grid_sql, _mc_sweep_sql, _models
from tidemark.sources import tables as tb

METRICS = ["utility_score", "total_cost", "fn_rate_high_risk", "fn_rate_moderate_risk", "fn_rate_low_risk"]


def _B(spark, sf):
    return tb.scored_binary(spark, sf)


def _metrics_long(spark, sf):
    cmu = mt.compare_model_utilities(_models(spark, sf), POL)
    return rp.unpivot_metrics(cmu, ["model"], METRICS)


ML_SQL = " union all ".join(f"select model, '{m}' as metric, cast({m} as double) as value from CMU" for m in METRICS)
ML_CTES = [("CMU", _cmu_sql(raw=True)), ("ML", ML_SQL)]


@register("score_distribution", rounded(with_fixtures(
    """select b, y_true, count, lo + b * w as bin_lo, lo + (b + 1) * w as bin_hi from (
         select cast(least(floor((score - lo) / w), 19) as bigint) as b, y_true, count(*) as count, lo, w
         from B, (select min(score) as lo, case when max(score) > min(score) then (max(score) - min(score)) / 20
                  else 1.0 end as w from B) m group by 1, 2, lo, w) x""".replace("select b,", "select b as bin,"),
    "B"), ["bin_lo", "bin_hi"]))
def q_score_dist(spark, sf):
    return rp.score_distribution(_B(spark, sf), "score", "y_true", 20)


@register("class_separation", rounded(with_fixtures(
    """select *, (mean_pos - mean_neg) / nullif((std_pos + std_neg) / 2, 0) as separation from (
         select avg(score) filter (where y_true = 1) as mean_pos, avg(score) filter (where y_true <> 1) as mean_neg,
                stddev_pop(score) filter (where y_true = 1) as std_pos,
                stddev_pop(score) filter (where y_true <> 1) as std_neg from B) x""", "B"),
    ["mean_pos", "mean_neg", "std_pos", "std_neg", "separation"]))
def q_separation(spark, sf):
    return rp.class_separation(_B(spark, sf))


_QP = [0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]


@register("score_quantiles", rounded(with_fixtures(
    "select count(score) as count, avg(score) as mean, stddev_samp(score) as std, min(score) as min, max(score) as max, "
    + ", ".join(f"quantile_cont(score, {p}) as p{int(round(p * 100))}" for p in _QP) + " from B", "B"),
    ["mean", "std", "min", "max"] + [f"p{int(round(p * 100))}" for p in _QP]))
def q_quantiles(spark, sf):
    return rp.score_quantiles(_B(spark, sf), "score", _QP)


@register("risk_strata", rounded(with_fixtures(
    """select stratum_order, stratum, count, count * 100.0 / sum(count) over () as percentage, positives,
              positives / count as positive_rate from (
         select case when score < 0.2 then 0 when score < 0.3 then 1 else 2 end as stratum_order,
                case when score < 0.2 then 'Low Risk' when score < 0.3 then 'Moderate Risk' else 'High Risk' end as stratum,
                count(*) as count, cast(sum(y_true) as bigint) as positives from B group by 1, 2) x""", "B"),
    ["percentage", "positive_rate"]))
def q_strata(spark, sf):
    cuts = [POL.config["stratification_thresholds"]["moderate_risk"], POL.config["stratification_thresholds"]["high_risk"]]
    return rp.risk_strata(_B(spark, sf), cuts)


_SYM = tb.SYMPTOMS_L


@register("risk_composition", rounded(with_fixtures(
    """select patient_id, grp as "group", avg(value) as mean_contribution from (
         select u.patient_id, u.value, case when r.rk <= 3 then u.feature else 'Other' end as grp from U u
         join (select feature, row_number() over (order by avg(abs(value)) desc nulls last, feature) as rk
               from U group by feature) r on u.feature = r.feature) x group by 1, 2""", "L",
    extra=[("U", " union all ".join(f"select patient_id, '{s}' as feature, {s} as value from L" for s in _SYM))]),
    ["mean_contribution"]))
def q_composition(spark, sf):
    return rp.risk_composition(tb.longitudinal(spark, sf), "patient_id", _SYM, top_n=3)


@register("melt_metrics", rounded(with_fixtures("select * from ML", extra=ML_CTES), ["value"]))
def q_melt(spark, sf):
    return _metrics_long(spark, sf)


@register("compare_models_table", rounded(with_fixtures(
    """select model, metric, value, cast(row_number() over (partition by metric order by value asc nulls last, model) as bigint)
       as rank from ML where metric = 'total_cost'""", extra=ML_CTES), ["value"]))
def q_compare_models(spark, sf):
    return rp.compare_models_table(_metrics_long(spark, sf), "total_cost")


_LOW = ", ".join(f"'{m}'" for m in sorted(rp.LOWER_IS_BETTER))


@register("metric_vs_baseline", rounded(with_fixtures(
    f"""select m.model, m.metric, m.value, b.value as baseline, m.value - b.value as difference,
              cast(case when (m.metric in ({_LOW}) and m.value - b.value < 0)
                          or (m.metric not in ({_LOW}) and m.value - b.value > 0) then 1 else 0 end as bigint) as improved
       from ML m left join (select metric, value from ML where model = 'argmax') b on m.metric = b.metric""",
    extra=ML_CTES), ["value", "baseline", "difference"]))
def q_vs_baseline(spark, sf):
    ml = _metrics_long(spark, sf)
    return rp.metric_vs_baseline(ml, ml.where(F.col("model") == "argmax"))


@register("minmax_normalise_metrics", rounded(with_fixtures(
    """select *, case when max(value) over (partition by metric) > min(value) over (partition by metric)
                 then (value - min(value) over (partition by metric)) /
                      (max(value) over (partition by metric) - min(value) over (partition by metric))
                 else 0.5 end as normalized from ML""", extra=ML_CTES), ["value", "normalized"]))
def q_minmax_metrics(spark, sf):
    return rp.minmax_normalise_metrics(_metrics_long(spark, sf))


@register("rank_models", rounded(with_fixtures(
    f"""select model, score, cast(rank() over (order by score desc) as bigint) as rank from (
         select model, sum(case when metric in ({_LOW}) then 1 - normalized else normalized end) as score from (
           select *, case when max(value) over (partition by metric) > min(value) over (partition by metric)
                 then (value - min(value) over (partition by metric)) /
                      (max(value) over (partition by metric) - min(value) over (partition by metric))
                 else 0.5 end as normalized from ML) n group by model) s""", extra=ML_CTES), ["score"]))
def q_rank_models(spark, sf):
    return rp.rank_models(_metrics_long(spark, sf))


@register("metric_pairs", rounded(with_fixtures(
    """select model, max(value) filter (where metric = 'utility_score') as utility_score,
              max(value) filter (where metric = 'total_cost') as total_cost from ML group by model
       having utility_score is not null and total_cost is not null""", extra=ML_CTES), ["utility_score", "total_cost"]))
def q_metric_pairs(spark, sf):
    return rp.metric_pairs(_metrics_long(spark, sf), "utility_score", "total_cost")


def _policy_sql():
    rows = ", ".join(f"({c}::bigint, '{POL.config['class_definitions'][str(c)]}', '{POL.risk_of(c)}')"
                     for c in POL.classes)
    return f"select * from (values {rows}) p(cls, description, risk_level)"


@register("class_catalog", with_fixtures(
    """select p.cls, p.description, p.risk_level, cast(case when d.cls is not null then 1 else 0 end as bigint) as in_model
       from POLT p left join (select distinct y_pred as cls from PRED) d on p.cls = d.cls""", "P",
    extra=[("POLT", _policy_sql()),
           ("PRED", "select row_id, cast(arg_max(cls, (p, -cls)) as bigint) as y_pred from P group by row_id")]))
def q_class_catalog(spark, sf):
    w = tb.scored_multiclass_wide(spark, sf)
    pred = w.select(lb.argmax_expr(F.col("proba")).alias("y_pred"))
    return rp.class_catalog(POL.to_df(spark), pred)


@register("probability_table", rounded(with_fixtures(
    """select P.row_id, P.cls, POLT.description, P.p,
              cast(row_number() over (partition by P.row_id order by P.p desc, P.cls) as bigint) as rank,
              cast(case when P.p >= 0.2 then 1 else 0 end as bigint) as above_threshold
       from P left join POLT on P.cls = POLT.cls""", "P", extra=[("POLT", _policy_sql())]), ["p"]))
def q_prob_table(spark, sf):
    return rp.probability_table(tb.scored_multiclass(spark, sf), POL.to_df(spark), 0.2)


@register("threshold_effects", rounded(with_fixtures(
    """select cls, threshold, 'sensitivity' as metric, sensitivity as value from SW
       union all select cls, threshold, 'specificity', specificity from SW""", "P",
    extra=[("G", _grid_sql()), ("MS", _mc_sweep_sql()), ("SW", MC_SWEEP)]), ["threshold", "value"]))
def q_threshold_effects(spark, sf):
    sw = th.threshold_sweep_multiclass(tb.scored_multiclass(spark, sf), POL)
    return rp.threshold_effects(sw, ["sensitivity", "specificity"], ["cls"])


_LV = ("high_risk", "moderate_risk", "low_risk")


@register("cost_breakdown", rounded(with_fixtures(
    " union all ".join(f"select model, '{L}' as risk_level, '{'false_negative' if k == 'fn' else 'false_positive'}' "
                       f"as error_type, {k}_cost_{L} as cost from CMU" for L in _LV for k in ("fn", "fp"))
    + " union all select model, 'all', 'subtotal', " + " + ".join(f"{k}_cost_{L}" for L in _LV for k in ("fn", "fp"))
    + " from CMU", extra=[("CMU", _cmu_sql(raw=True))]), ["cost"]))
def q_cost_breakdown(spark, sf):
    return rp.cost_breakdown(mt.compare_model_utilities(_models(spark, sf), POL))


@register("risk_map", rounded(with_fixtures(
    """select cast(row_id as double) as x, cast(y_true as double) as y, score as risk, y_true as label,
              cast(case when score >= 0.3 then 1 else 0 end as bigint) as highlight from B""", "B"),
    ["x", "y", "risk"]))
def q_risk_map(spark, sf):
    b = _B(spark, sf).select(F.col("row_id").cast("double").alias("rx"), F.col("y_true").cast("double").alias("ry"),
                             "score", "y_true")
    return rp.risk_map(b, "rx", "ry", "score", "y_true", 0.3)


@register("risk_level_of_predictions", with_fixtures(
    f"""select risk_level, count(*) as n from (select {_risk_case('y_pred')} as risk_level from PRED) x group by 1""",
    "P", extra=[("PRED", "select row_id, cast(arg_max(cls, (p, -cls)) as bigint) as y_pred from P group by row_id")]))
def q_pred_levels(spark, sf):
    """Predicted risk-level mix (class_to_risk over argmax predictions)."""
    w = tb.scored_multiclass_wide(spark, sf)
    pred = w.select(lb.argmax_expr(F.col("proba")).alias("y_pred"))
    return lb.class_to_risk(pred, POL, "y_pred").groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
