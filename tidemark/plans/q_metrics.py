"""Registered evaluation and threshold queries over the scored fixtures P and B."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels as lb
from tidemark.operators import metrics as mt
from tidemark.operators import thresholds as th
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rounded, with_fixtures
from tidemark.plans.q_labels import PRED_SQL, POL, _risk_case
from tidemark.sources import tables as tb

PRED = ("PRED", PRED_SQL)


def _pred(spark, sf):
    w = tb.scored_multiclass_wide(spark, sf)
    return w.select("row_id", "y_true", "t_days", lb.argmax_expr(F.col("proba")).alias("y_pred"))


def _fn_cost(level_col):
    c = POL.config["error_costs"]["false_negative"]
    return "case " + level_col + " " + " ".join(f"when '{k}' then {v}" for k, v in c.items()) + " end"


def _fp_cost(level_col):
    c = POL.config["error_costs"]["false_positive"]
    return "case " + level_col + " " + " ".join(f"when '{k}' then {v}" for k, v in c.items()) + " end"


OVR_SQL = """select cls, cast(tp as bigint) as tp, cast(n_pred - tp as bigint) as fp, cast(n_true - tp as bigint) as fn,
       cast(n - n_true - n_pred + tp as bigint) as tn, cast(n_true as bigint) as support, cast(n as bigint) as n from (
  select coalesce(t.cls, p.cls) as cls, coalesce(t.tp, 0) as tp, coalesce(t.n_true, 0) as n_true,
         coalesce(p.n_pred, 0) as n_pred, (select count(*) from PRED) as n
  from (select y_true as cls, count(*) as n_true, count(*) filter (where y_pred = y_true) as tp from PRED group by 1) t
  full join (select y_pred as cls, count(*) as n_pred from PRED group by 1) p on t.cls = p.cls) x"""

COST_SQL = f"""select *, {_fn_cost('risk_level')} as fn_cost, {_fp_cost('risk_level')} as fp_cost
               from (select *, {_risk_case('cls')} as risk_level from OVR) o"""

CTES = [PRED, ("OVR", OVR_SQL), ("C", COST_SQL)]


def q(body, fixtures=("P",), extra=(), dbl=()):
    return rounded(with_fixtures(body, *fixtures, extra=list(CTES) + list(extra)), dbl)


@register("confusion_matrix", q("""select y_true, y_pred, count(*) as n,
        count(*) / sum(count(*)) over (partition by y_true) as share from PRED group by 1, 2""", dbl=["share"]))
def q_confusion(spark, sf):
    return mt.confusion_matrix(_pred(spark, sf), normalize=True)


@register("one_vs_rest_counts", q("select * from OVR"))
def q_ovr(spark, sf):
    return mt.one_vs_rest_counts(_pred(spark, sf))


@register("clinical_utility", q("""select sum(fn * fn_cost + fp * fp_cost) as total_cost,
        sum(n * greatest(fn_cost, fp_cost)) as max_possible_cost,
        1 - sum(fn * fn_cost + fp * fp_cost) / sum(n * greatest(fn_cost, fp_cost)) as utility_score from C""",
                                dbl=["total_cost", "max_possible_cost", "utility_score"]))
def q_utility(spark, sf):
    return mt.clinical_utility(_pred(spark, sf), POL)


@register("error_costs", q("""select risk_level, sum(fn * fn_cost) as false_neg_cost, sum(fp * fp_cost) as false_pos_cost
        from C group by risk_level""", dbl=["false_neg_cost", "false_pos_cost"]))
def q_error_costs(spark, sf):
    return mt.error_costs(_pred(spark, sf), POL)


_BETA = "(case when risk_level = 'high_risk' then 3.0 when risk_level = 'low_risk' then 1.5 else 2.0 end)"
_FB = (f"coalesce((1 + {_BETA}*{_BETA}) * tp / nullif((1 + {_BETA}*{_BETA}) * tp + {_BETA}*{_BETA} * fn + fp, 0), 0.0)")


@register("weighted_f_score", q(f"select sum({_FB} * support / n) as weighted_f_score from C",
                                dbl=["weighted_f_score"]))
def q_wf(spark, sf):
    return mt.weighted_f_score(_pred(spark, sf), POL, beta=2.0)


@register("time_weighted_error", q("""select avg(case when y_true <> y_pred then 1.0 else 0.0 end
        * pow(0.9, t_days / (select max(t_days) from PRED))) as time_weighted_error from PRED""",
                                   dbl=["time_weighted_error"]))
def q_twe(spark, sf):
    return mt.time_weighted_error(_pred(spark, sf), time_col="t_days", discount=POL.time_discount)


@register("high_risk_recall", q(f"""select sum(tp) / nullif(sum(support), 0) as high_risk_recall from OVR
        where cls in ({', '.join(str(c) for c in POL.high_risk_classes)})""", dbl=["high_risk_recall"]))
def q_hrr(spark, sf):
    return mt.high_risk_recall(_pred(spark, sf), POL)


@register("clinical_report", q(f"""select cls, precision, recall, specificity,
        coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) as f1_score,
        {_FB} as f2_score, support, risk_level, fn_cost, fp_cost from (
        select *, coalesce(tp / nullif(tp + fp, 0), 0.0) as precision, coalesce(tp / nullif(tp + fn, 0), 0.0) as recall,
               coalesce(tn / nullif(tn + fp, 0), 0.0) as specificity from C) x""",
                               dbl=["precision", "recall", "specificity", "f1_score", "f2_score", "fn_cost", "fp_cost"]))
def q_report(spark, sf):
    return mt.class_metrics(_pred(spark, sf), POL)


_CLASS_SQL = f"""select cls, precision, recall, specificity,
        coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) as f1_score,
        {_FB} as f2_score, support, risk_level, fn_cost, fp_cost from (
        select *, coalesce(tp / nullif(tp + fp, 0), 0.0) as precision, coalesce(tp / nullif(tp + fn, 0), 0.0) as recall,
               coalesce(tn / nullif(tn + fp, 0), 0.0) as specificity from C) x"""


@register("accuracy_macro", q("""select sum(tp) / max(n) as accuracy, avg(pr) as precision_macro, avg(rc) as recall_macro,
        avg(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0)) as f1_macro from (
        select *, coalesce(tp / nullif(tp + fp, 0), 0.0) as pr, coalesce(tp / nullif(tp + fn, 0), 0.0) as rc from OVR) x""",
                              dbl=["accuracy", "precision_macro", "recall_macro", "f1_macro"]))
def q_acc(spark, sf):
    return mt.accuracy_macro(_pred(spark, sf))


@register("class_distribution", rounded(with_fixtures(
    """select label as cls, count(*) as count, count(*) / sum(count(*)) over () as share from T group by label""",
    "T"), ["share"]))
def q_class_dist(spark, sf):
    return mt.class_distribution(tb.tabular(spark, sf), "label")


AUC_SQL = """select cls, case when n_pos > 0 and n_neg > 0 then u / (cast(n_pos as double) * n_neg) else 0.5 end as auc,
        n_pos, n_neg from (
        select cls, sum(n_pos * (coalesce(neg_before, 0) + 0.5 * n_neg)) as u,
               cast(sum(n_pos) as bigint) as n_pos, cast(sum(n_neg) as bigint) as n_neg from (
            select *, sum(n_neg) over (partition by cls order by score rows between unbounded preceding and 1 preceding) as neg_before
            from (select cls, p as score, count(*) filter (where y_true = cls) as n_pos,
                         count(*) filter (where y_true <> cls) as n_neg from P group by cls, p) s) w
        group by cls) g"""


@register("auc_per_class", q(AUC_SQL, dbl=["auc"]))
def q_auc(spark, sf):
    return mt.auc_per_class(tb.scored_multiclass(spark, sf))


@register("risk_adjusted_auc", q(f"""select sum(auc * w) / sum(w) as risk_adjusted_auc from (
        select auc, case {_risk_case('cls')} when 'high_risk' then 3.0 when 'low_risk' then 1.0 else 2.0 end as w
        from AUCT where n_pos > 0) x""", extra=[("AUCT", AUC_SQL)], dbl=["risk_adjusted_auc"]))
def q_raauc(spark, sf):
    return mt.risk_adjusted_auc(tb.scored_multiclass(spark, sf), POL)


@register("clinical_report_classes", q(
    """select r.*, coalesce(a.auc, 0.0) as auc from R r left join (select cls, auc from AUCT where n_pos > 0) a on r.cls = a.cls""",
    extra=[("R", _CLASS_SQL), ("AUCT", AUC_SQL)],
    dbl=["precision", "recall", "specificity", "f1_score", "f2_score", "fn_cost", "fp_cost", "auc"]))
def q_report_classes(spark, sf):
    return mt.clinical_report(_pred(spark, sf), POL, tb.scored_multiclass(spark, sf))[1]


@register("clinical_report_overall", q(f"""
        select 'clinical_utility' as metric, 1 - sum(fn * fn_cost + fp * fp_cost) / sum(n * greatest(fn_cost, fp_cost)) as value from C
        union all select 'weighted_f2_score', sum({_FB} * support / n) from C
        union all select 'high_risk_recall', sum(tp) / nullif(sum(support), 0) from OVR
            where cls in ({', '.join(str(c) for c in POL.high_risk_classes)})
        union all select 'risk_adjusted_auc', sum(auc * w) / sum(w) from (
            select auc, case {_risk_case('cls')} when 'high_risk' then 3.0 when 'low_risk' then 1.0 else 2.0 end as w
            from AUCT where n_pos > 0) x""", extra=[("AUCT", AUC_SQL)], dbl=["value"]))
def q_report_overall(spark, sf):
    return mt.clinical_report(_pred(spark, sf), POL, tb.scored_multiclass(spark, sf))[0]


_CURVE_B = """select score, n_pos, n_neg,
       coalesce(sum(n_pos) over (order by score rows between unbounded preceding and 1 preceding), 0) as pos_before,
       coalesce(sum(n_neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as neg_before,
       sum(n_pos) over () as PP, sum(n_neg) over () as NN
       from (select score, count(*) filter (where y_true = 1) as n_pos, count(*) filter (where y_true <> 1) as n_neg
             from B group by score) s"""


@register("roc_points", rounded(with_fixtures(
    """select cast(1 as bigint) as cls, score as threshold, (NN - neg_before) / nullif(NN, 0) as fpr,
              (PP - pos_before) / nullif(PP, 0) as tpr from CB
       union all select 1, null, 0 / nullif(max(NN), 0), 0 / nullif(max(PP), 0) from CB having count(*) > 0""",
    "B", extra=[("CB", _CURVE_B)]),
    ["threshold", "fpr", "tpr"]))
def q_roc(spark, sf):
    return mt.roc_points(tb.scored_binary(spark, sf))


_AREAS = """
    with s as (select model, cls, p, count(*) filter (where y_true = cls) as a, count(*) filter (where y_true <> cls) as b
               from M group by model, cls, p),
    c as (select *, sum(a) over w as tp, sum(b) over w as fp, sum(a) over (partition by model, cls) as PP,
                 sum(b) over (partition by model, cls) as NN from s window w as (partition by model, cls order by p desc)),
    e as (select *, coalesce(lag(tp) over w, 0) as tp1, coalesce(lag(fp) over w, 0) as fp1,
                 lag(tp / (tp + fp)) over w as prec1 from c window w as (partition by model, cls order by p desc))
    select model, cls, sum((fp / NN - fp1 / NN) * (tp / PP + tp1 / PP) / 2) as roc_area,
           sum((tp / PP - tp1 / PP) * (tp / (tp + fp) + coalesce(prec1, 1)) / 2) as pr_area, max(PP / (PP + NN)) as baseline
    from e group by model, cls"""


@register("curve_areas", rounded(with_fixtures("select * from AREAS", "P", extra=[
    ("M", "select 'main' as model, cls, p, y_true from P union all "
          "select 'even', cls, round(p * 20) / 20, y_true from P"), ("AREAS", _AREAS)]), ["roc_area", "pr_area", "baseline"]))
def q_areas(spark, sf):
    """ROC and precision-recall areas per class of two models: the scores, and the scores in steps of a twentieth."""
    p = tb.scored_multiclass(spark, sf).select("cls", "p", "y_true")
    even = p.withColumn("p", F.round(F.col("p") * 20) / 20)
    both = p.withColumn("model", F.lit("main")).unionByName(even.withColumn("model", F.lit("even")))
    return mt.curve_areas(both, "p", "y_true", "cls", ["model"])


@register("pr_points", rounded(with_fixtures(
    """select score as threshold, (PP - pos_before) / nullif((PP - pos_before) + (NN - neg_before), 0) as precision,
              (PP - pos_before) / nullif(PP, 0) as recall, PP / nullif(PP + NN, 0) as baseline from CB""",
    "B", extra=[("CB", _CURVE_B)]), ["threshold", "precision", "recall", "baseline"]))
def q_pr(spark, sf):
    return mt.pr_points(tb.scored_binary(spark, sf))


@register("precision_at_level", q("""select cls, arg_min(precision, (dist, score)) as precision,
        arg_min(recall, (dist, score)) as recall, arg_min(score, (dist, score)) as threshold from (
        select cls, score, tp / nullif(tp + fp, 0) as precision, tp / nullif(PP, 0) as recall,
               abs(score - 0.3) as dist, PP from (
          select *, PP - coalesce(pos_before, 0) as tp, NN - coalesce(neg_before, 0) as fp from (
            select *, sum(n_pos) over (partition by cls order by score rows between unbounded preceding and 1 preceding) as pos_before,
                      sum(n_neg) over (partition by cls order by score rows between unbounded preceding and 1 preceding) as neg_before,
                      sum(n_pos) over (partition by cls) as PP, sum(n_neg) over (partition by cls) as NN
            from (select cls, p as score, count(*) filter (where y_true = cls) as n_pos,
                         count(*) filter (where y_true <> cls) as n_neg from P group by cls, p) s) w) v) z
        where PP > 0 group by cls""", dbl=["precision", "recall", "threshold"]))
def q_prec_level(spark, sf):
    return mt.precision_at_level(tb.scored_multiclass(spark, sf), 0.3)


def _edges_sql(n_bins=10, top=1.0 + 1e-8):
    import numpy as np
    e = np.linspace(0.0, top, n_bins + 1)
    return " + ".join(f"(case when {float(x)!r}::double <= score then 1 else 0 end)" for x in e)


@register("calibration_bins", rounded(with_fixtures(
    f"""select cast({_edges_sql()} - 1 as bigint) as bin, avg(score) as prob_pred, avg(cast(y_true as double)) as prob_true,
               count(*) as count from B group by 1""", "B"), ["prob_pred", "prob_true"]))
def q_calibration(spark, sf):
    return mt.calibration_bins(tb.scored_binary(spark, sf), n_bins=10)


@register("calibration_curve", rounded(with_fixtures(
    f"""select cast(i as bigint) as bin, (i + 0.5) / 10 as center, coalesce(prob_pred, 0) as prob_pred,
               coalesce(prob_true, 0) as prob_true, coalesce(n, 0) as count
        from range(10) t(i) left join (
          select greatest(0, least(9, {_edges_sql(top=1.0)} - 1)) as bin, avg(score) as prob_pred,
                 avg(cast(y_true as double)) as prob_true, count(*) as n from B group by 1) g on g.bin = t.i""", "B"),
    ["center", "prob_pred", "prob_true"]))
def q_calibration_curve(spark, sf):
    return mt.calibration_curve(tb.scored_binary(spark, sf), n_bins=10)


def _thr_pred_sql():
    wide = ", ".join(f"max(case when cls = {c} then p end) as p{c}" for c in range(8))
    whens = " ".join(f"when p{c} >= {POL.threshold(c)} then {c}" for c in POL.priority_order())
    return f"""select row_id, y_true, cast(case {whens} else am end as bigint) as y_pred from (
              select row_id, any_value(y_true) as y_true, {wide}, arg_max(cls, (p, -cls)) as am from P group by row_id) w"""


def _cmu_sql(raw: bool = False):
    lv = ("high_risk", "moderate_risk", "low_risk")
    cols = []
    for L in lv:
        cols += [f"coalesce(sum(case when risk_level = '{L}' then fn end) / nullif(sum(case when risk_level = '{L}' then support end), 0), 0.0) as fn_rate_{L}",
                 f"coalesce(sum(case when risk_level = '{L}' then fn * fn_cost end), 0.0) as fn_cost_{L}",
                 f"coalesce(sum(case when risk_level = '{L}' then fp * fp_cost end), 0.0) as fp_cost_{L}"]
    ovr = OVR_SQL.replace("from PRED", "from M where model = mm.model").replace("PRED", "M")
    del ovr
    body = f"""select model, 1 - sum(fn * fn_cost + fp * fp_cost) / sum(n * greatest(fn_cost, fp_cost)) as utility_score,
        sum(fn * fn_cost + fp * fp_cost) as total_cost, {', '.join(cols)} from MC group by model"""
    movr = """select model, cls, cast(tp as bigint) as tp, cast(n_pred - tp as bigint) as fp, cast(n_true - tp as bigint) as fn,
       cast(n_true as bigint) as support, cast(n as bigint) as n from (
       select coalesce(t.model, p.model) as model, coalesce(t.cls, p.cls) as cls, coalesce(t.tp, 0) as tp,
              coalesce(t.n_true, 0) as n_true, coalesce(p.n_pred, 0) as n_pred,
              sum(coalesce(t.n_true, 0)) over (partition by coalesce(t.model, p.model)) as n
       from (select model, y_true as cls, count(*) as n_true, count(*) filter (where y_pred = y_true) as tp from M group by 1, 2) t
       full join (select model, y_pred as cls, count(*) as n_pred from M group by 1, 2) p
       on t.model = p.model and t.cls = p.cls) x"""
    mc = f"""select *, {_fn_cost('risk_level')} as fn_cost, {_fp_cost('risk_level')} as fp_cost
             from (select *, {_risk_case('cls')} as risk_level from MOVR) o"""
    m = "select 'argmax' as model, y_true, y_pred from PRED union all select 'thresholds', y_true, y_pred from TPRED"
    dbl = ["utility_score", "total_cost"] + [f"{k}_{L}" for L in lv for k in ("fn_rate", "fn_cost", "fp_cost")]
    if raw:
        return with_fixtures(body, "P", extra=list(CTES) + [("TPRED", _thr_pred_sql()), ("M", m), ("MOVR", movr), ("MC", mc)])
    return q(body, extra=[("TPRED", _thr_pred_sql()), ("M", m), ("MOVR", movr), ("MC", mc)], dbl=dbl)


def _models(spark, sf):
    w = tb.scored_multiclass_wide(spark, sf)
    a = w.select(F.lit("argmax").alias("model"), "y_true", lb.argmax_expr(F.col("proba")).alias("y_pred"))
    t = w.select(F.lit("thresholds").alias("model"), "y_true",
                 lb.apply_thresholds_expr(F.col("proba"), POL).alias("y_pred"))
    return a.unionByName(t)


@register("compare_model_utilities", _cmu_sql())
def q_cmu(spark, sf):
    return mt.compare_model_utilities(_models(spark, sf), POL)


@register("compare_thresholds", q("""select model, sum(fn * fn_cost + fp * fp_cost) as total_cost,
        sum(n * greatest(fn_cost, fp_cost)) as max_possible_cost, 1 - sum(fn * fn_cost + fp * fp_cost) / sum(n * greatest(fn_cost, fp_cost)) as utility_score
        from MC group by model""".replace("MC", "MC2"),
        extra=[("TPRED", _thr_pred_sql()),
               ("M", "select 'argmax' as model, y_true, y_pred from PRED union all select 'thresholds', y_true, y_pred from TPRED"),
               ("MOVR", """select model, cls, cast(tp as bigint) as tp, cast(n_pred - tp as bigint) as fp, cast(n_true - tp as bigint) as fn,
                  cast(n as bigint) as n from (
                  select coalesce(t.model, p.model) as model, coalesce(t.cls, p.cls) as cls, coalesce(t.tp, 0) as tp,
                         coalesce(t.n_true, 0) as n_true, coalesce(p.n_pred, 0) as n_pred,
                         sum(coalesce(t.n_true, 0)) over (partition by coalesce(t.model, p.model)) as n
                  from (select model, y_true as cls, count(*) as n_true, count(*) filter (where y_pred = y_true) as tp from M group by 1, 2) t
                  full join (select model, y_pred as cls, count(*) as n_pred from M group by 1, 2) p
                  on t.model = p.model and t.cls = p.cls) x"""),
               ("MC2", f"""select *, {_fn_cost('risk_level')} as fn_cost, {_fp_cost('risk_level')} as fp_cost
                  from (select *, {_risk_case('cls')} as risk_level from MOVR) o""")],
        dbl=["total_cost", "max_possible_cost", "utility_score"]))
def q_compare_thr(spark, sf):
    """Default argmax vs policy thresholds: utility and cost per variant (one job)."""
    return mt.clinical_utility(_models(spark, sf), POL, group_cols=["model"])


def _grid_sql(n=100, lo=0.01, hi=0.99):
    vals = th.grid(n, lo, hi)
    return "select * from (values " + ", ".join(f"({j}, {v!r}::double)" for j, v in enumerate(vals)) + ") g(j, threshold)"


def _sweep_sql(src, score, pos_expr, group=None, fn=10.0, fp=1.0, n=100, lo=0.01, hi=0.99):
    gsel = f"{group}, " if group else ""
    gjoin = f"and s.{group} = g2.{group}" if group else ""
    gfrom = f"(select distinct {group} from {src}) k, " if group else ""
    gk = f"k.{group}, " if group else ""
    body = f"""select {gsel}threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
           cast(NN - fp as bigint) as tn, cast(PP - tp as bigint) as fn from (
        select {('g2.' + group + ', ') if group else ''}g2.threshold,
               coalesce(sum(case when {pos_expr} and s.{score} >= g2.threshold then 1 else 0 end), 0) as tp,
               coalesce(sum(case when not ({pos_expr}) and s.{score} >= g2.threshold then 1 else 0 end), 0) as fp,
               sum(case when {pos_expr} then 1 else 0 end) as PP, sum(case when not ({pos_expr}) then 1 else 0 end) as NN
        from (select {gk}G.threshold from {gfrom}G) g2 join {src} s on true {gjoin}
        group by {('g2.' + group + ', ') if group else ''}g2.threshold) x"""
    return body


def _sweep_metrics_sql(inner, fn_cost, fp_cost):
    return f"""select *, fn * {fn_cost} + fp * {fp_cost} as total_cost,
        coalesce(tp / nullif(tp + fn, 0), 0.0) as sensitivity, coalesce(tn / nullif(tn + fp, 0), 0.0) as specificity,
        coalesce(tp / nullif(tp + fp, 0), 0.0) as precision, coalesce(tn / nullif(tn + fn, 0), 0.0) as npv,
        fn * {fn_cost} as false_neg_cost, fp * {fp_cost} as false_pos_cost from ({inner}) y"""


_SWEEP_DBL = ["threshold", "total_cost", "sensitivity", "specificity", "precision", "npv", "false_neg_cost", "false_pos_cost"]
SWEEP_B = _sweep_metrics_sql(_sweep_sql("B", "score", "s.y_true = 1"), "10.0", "1.0")


@register("threshold_sweep", rounded(with_fixtures(SWEEP_B, "B", extra=[("G", _grid_sql())]), _SWEEP_DBL))
def q_sweep(spark, sf):
    """Brute-force oracle (grid x rows) against the one-pass bucketed sweep."""
    return th.threshold_sweep(tb.scored_binary(spark, sf), fn_cost=10.0, fp_cost=1.0)


@register("optimal_threshold", rounded(with_fixtures(
    "select arg_min(threshold, (total_cost, threshold)) as optimal_threshold, min(total_cost) as min_total_cost from SW",
    "B", extra=[("G", _grid_sql()), ("SW", SWEEP_B)]), ["optimal_threshold", "min_total_cost"]))
def q_opt(spark, sf):
    return th.optimal_threshold(th.threshold_sweep(tb.scored_binary(spark, sf), fn_cost=10.0, fp_cost=1.0))


def _mc_sweep_sql(n=100, lo=0.01, hi=0.99):
    inner = _sweep_sql("P", "p", "s.y_true = s.cls", group="cls", n=n, lo=lo, hi=hi)
    return f"""select *, {_fn_cost('risk_level')} as fnc, {_fp_cost('risk_level')} as fpc from (
        select *, {_risk_case('cls')} as risk_level from ({inner}) a) b"""


MC_SWEEP = """select cls, threshold, tp, fp, tn, fn, risk_level, fn * fnc as false_neg_cost, fp * fpc as false_pos_cost,
    fn * fnc + fp * fpc as total_cost, coalesce(tp / nullif(tp + fn, 0), 0.0) as sensitivity,
    coalesce(tn / nullif(tn + fp, 0), 0.0) as specificity, coalesce(tp / nullif(tp + fp, 0), 0.0) as precision,
    coalesce(tn / nullif(tn + fn, 0), 0.0) as npv from MS"""


@register("threshold_sweep_multiclass", rounded(with_fixtures(
    MC_SWEEP, "P", extra=[("G", _grid_sql()), ("MS", _mc_sweep_sql())]), _SWEEP_DBL))
def q_sweep_mc(spark, sf):
    return th.threshold_sweep_multiclass(tb.scored_multiclass(spark, sf), POL)


@register("optimal_thresholds_multiclass", rounded(with_fixtures(
    """select cls, arg_min(threshold, (total_cost, threshold)) as optimal_threshold, min(total_cost) as min_total_cost
       from SW group by cls""", "P", extra=[("G", _grid_sql()), ("MS", _mc_sweep_sql()), ("SW", MC_SWEEP)]),
    ["optimal_threshold", "min_total_cost"]))
def q_opt_mc(spark, sf):
    return th.optimal_thresholds_multiclass(tb.scored_multiclass(spark, sf), POL)


def _defaults_sql():
    return "select * from (values " + ", ".join(
        f"({c}::bigint, {POL.threshold(c)}::double)" for c in POL.classes) + ") d(cls, default_threshold)"


@register("choose_thresholds", rounded(with_fixtures(
    """select d.cls, d.default_threshold, o.optimal_threshold,
              case when o.optimal_threshold is null or abs(o.optimal_threshold - d.default_threshold) <= 0.1
                   then d.default_threshold else o.optimal_threshold end as threshold
       from D d left join (select cls, arg_min(threshold, (total_cost, threshold)) as optimal_threshold
                           from SW group by cls) o on d.cls = o.cls""",
    "P", extra=[("G", _grid_sql(50, 0.1, 0.9)), ("MS", _mc_sweep_sql(50, 0.1, 0.9)), ("SW", MC_SWEEP),
                ("D", _defaults_sql())]), ["default_threshold", "optimal_threshold", "threshold"]))
def q_choose(spark, sf):
    return th.choose_thresholds(tb.scored_multiclass(spark, sf), POL)


@register("value_at_nearest_threshold", rounded(with_fixtures(
    """select arg_min(threshold, (abs(threshold - 0.42), threshold)) as threshold,
              arg_min(sensitivity, (abs(threshold - 0.42), threshold)) as sensitivity from SW""",
    "B", extra=[("G", _grid_sql()), ("SW", SWEEP_B)]), ["threshold", "sensitivity"]))
def q_nearest(spark, sf):
    sw = th.threshold_sweep(tb.scored_binary(spark, sf), fn_cost=10.0, fp_cost=1.0)
    return th.value_at_nearest_threshold(sw, 0.42, "sensitivity")


@register("bootstrap_metric_ci")
def q_boot(spark, sf):
    """Poisson bootstrap (200 replicates) summary of utility and accuracy - rows check."""
    return mt.bootstrap_metric_ci(_pred(spark, sf), POL, n_boot=200)[1]
