"""Registered label / risk / decision-rule queries (fixtures O, T, P, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels as lb
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rounded, with_fixtures
from tidemark.sources import tables as tb
from tidemark.sources.policy import policy

POL = policy("code")
POL_YAML = policy("yaml")

_LOOKUP_CASE = "case combo " + " ".join(
    f"when '{k}' then {v}" for k, v in lb.PATTERN_TO_CLASS.items()) + f" else {lb.PATTERN_DEFAULT_CLASS} end"


def _risk_case(col: str, pol=POL, default="moderate_risk") -> str:
    parts = " ".join(f"when {c} then '{pol.risk_of(c, None)}'" for c in pol.classes if pol.risk_of(c, None))
    return f"coalesce(case {col} {parts} end, '{default}')"


def _pri_case(col: str, pol=POL) -> str:
    return "case " + col + " " + " ".join(f"when {c} then {i}" for i, c in enumerate(pol.priority_order())) + " end"


@register("outcome_label_lookup", with_fixtures(
    f"""select patient_id, M6_Rem, Y1_Rem, Y1_Rem_6, cast({_LOOKUP_CASE} as bigint) as label from (
          select *, concat_ws('_', coalesce(M6_Rem, 'Missing'), coalesce(Y1_Rem, 'Missing'),
                              coalesce(Y1_Rem_6, 'Missing')) as combo from O) x""", "O"))
def q_label_lookup(spark, sf):
    return lb.outcome_label_lookup(tb.outcomes(spark, sf))


_TRUTH_CASE = "case " + " ".join(
    f"when y1 = {a} and m6 = {b} and y16 = {c} then {lab}" for (a, b, c), lab in lb.TRUTH_TABLE.items()) + " end"


def _yn(c):
    return (f"case when lower(trim({c})) in ('yes','y','1','true') then 1 "
            f"when lower(trim({c})) in ('no','n','0','false') then 0 end")


@register("outcome_label_truth", with_fixtures(
    f"""select patient_id, M6_Rem, Y1_Rem, Y1_Rem_6, cast({_TRUTH_CASE} as bigint) as label from (
          select *, {_yn('Y1_Rem')} as y1, {_yn('M6_Rem')} as m6, {_yn('Y1_Rem_6')} as y16 from O) x""", "O"))
def q_label_truth(spark, sf):
    return lb.outcome_label_truth(tb.outcomes(spark, sf))


@register("fill_missing_token", with_fixtures(
    """select patient_id, coalesce(M6_Rem, 'Missing') as M6_Rem, coalesce(Y1_Rem, 'Missing') as Y1_Rem,
              coalesce(Y1_Rem_6, 'Missing') as Y1_Rem_6 from O""", "O"))
def q_fill_missing(spark, sf):
    return lb.fill_missing_token(tb.outcomes(spark, sf))


@register("encode_binary", with_fixtures(
    f"""select patient_id, cast({_yn('M6_Rem')} as bigint) as M6_Rem, cast({_yn('Y1_Rem')} as bigint) as Y1_Rem,
              cast({_yn('Y1_Rem_6')} as bigint) as Y1_Rem_6 from O""", "O"))
def q_encode_binary(spark, sf):
    return lb.encode_binary(tb.outcomes(spark, sf), ["M6_Rem", "Y1_Rem", "Y1_Rem_6"])


@register("encode_ordinal", with_fixtures(
    """select T.row_id, d.code as segment from T left join
       (select segment, cast(dense_rank() over (order by segment) - 1 as bigint) as code
        from (select distinct segment from T where segment is not null) s) d on T.segment = d.segment""", "T"))
def q_encode_ordinal(spark, sf):
    return lb.encode_ordinal(tb.tabular(spark, sf).select("row_id", "segment"), "segment")


@register("class_to_risk", with_fixtures(
    f"select row_id, label, {_risk_case('label', POL_YAML)} as risk_level from T", "T"))
def q_class_to_risk(spark, sf):
    return lb.class_to_risk(tb.tabular(spark, sf).select("row_id", "label"), POL_YAML, "label")


@register("attach_sample_weight", rounded(with_fixtures(
    "select row_id, label, coalesce(case label " + " ".join(
        f"when {c} then {POL.weight(c)}" for c in POL.classes) + " end, 1.0) as sample_weight from T", "T"),
    ["sample_weight"]))
def q_sample_weight(spark, sf):
    return lb.attach_sample_weight(tb.tabular(spark, sf).select("row_id", "label"), POL, "label")


@register("balanced_weights", rounded(with_fixtures(
    """select cls, n_c, sum(n_c) over () / ((max(cls) over () + 1) * n_c) as weight from
       (select cast(label as bigint) as cls, count(*) as n_c from T group by 1) c""", "T"), ["weight"]))
def q_balanced(spark, sf):
    return lb.balanced_weights(tb.tabular(spark, sf), "label")


PRED_SQL = """select row_id, any_value(y_true) as y_true, any_value(t_days) as t_days,
                     cast(arg_max(cls, (p, -cls)) as bigint) as y_pred from P group by row_id"""


@register("argmax_class", with_fixtures(PRED_SQL, "P"))
def q_argmax_long(spark, sf):
    p = tb.scored_multiclass(spark, sf)
    return lb.argmax_long(p, ["row_id", "y_true", "t_days"])


@register("argmax_class_wide", with_fixtures(PRED_SQL, "P"))
def q_argmax_wide(spark, sf):
    w = tb.scored_multiclass_wide(spark, sf)
    return w.select("row_id", "y_true", "t_days", lb.argmax_expr(F.col("proba")).alias("y_pred"))


def _thr_sql(pol, variant="default"):
    wide = ", ".join(f"max(case when cls = {c} then p end) as p{c}" for c in range(8))
    whens = " ".join(f"when p{c} >= {pol.threshold(c)} then {c}" for c in pol.priority_order())
    return with_fixtures(
        f"""select row_id, cast(case {whens} else am end as bigint) as y_pred from (
              select row_id, {wide}, arg_max(cls, (p, -cls)) as am from P group by row_id) w""", "P")


@register("apply_thresholds", _thr_sql(POL))
def q_apply_thresholds(spark, sf):
    w = tb.scored_multiclass_wide(spark, sf)
    return w.select("row_id", lb.apply_thresholds_expr(F.col("proba"), POL).alias("y_pred"))


@register("apply_thresholds_long", _thr_sql(POL_YAML))
def q_apply_thresholds_long(spark, sf):
    return lb.apply_thresholds_long(tb.scored_multiclass(spark, sf), POL_YAML)


@register("risk_level_probability", rounded(with_fixtures(
    f"""select row_id, p_high_risk, p_moderate_risk, p_low_risk,
          case when p_high_risk > 0.4 then 'High' when p_moderate_risk > 0.4 then 'Moderate' else 'Low' end as overall_risk
        from (select row_id,
          sum(case when lvl = 'high_risk' then p else 0.0 end) as p_high_risk,
          sum(case when lvl = 'moderate_risk' then p else 0.0 end) as p_moderate_risk,
          sum(case when lvl = 'low_risk' then p else 0.0 end) as p_low_risk
          from (select *, {_risk_case('cls', POL, 'low_risk')} as lvl from P) x group by row_id) y""", "P"),
    ["p_high_risk", "p_moderate_risk", "p_low_risk"]))
def q_risk_level_prob(spark, sf):
    return lb.risk_level_probability(tb.scored_multiclass(spark, sf), POL)


@register("binary_flag", rounded(with_fixtures(
    "select row_id, y_true, score, case when score >= 0.5 then 'High Risk' else 'Low Risk' end as risk_flag from B",
    "B"), ["score"]))
def q_binary_flag(spark, sf):
    return lb.binary_flag(tb.scored_binary(spark, sf), 0.5)


def _recs_case(pol=POL):
    recs = pol.config["clinical_recommendations"]
    return "case risk_level " + " ".join(
        f"when '{lvl}' then '{' | '.join(v)}'" for lvl, v in recs.items()) + " end"


@register("recommendations_for", with_fixtures(
    f"""select row_id, risk_level, {_recs_case()} as recommendations from
        (select row_id, {_risk_case('label')} as risk_level from T) x""", "T"))
def q_recommendations(spark, sf):
    t = lb.class_to_risk(tb.tabular(spark, sf).select("row_id", "label"), POL, "label")
    r = lb.recommendations_for(t, POL)
    return r.select("row_id", "risk_level", F.array_join("recommendations", " | ").alias("recommendations"))


@register("risk_ordered_classes", with_fixtures(
    f"""select cast({_pri_case('cls')} as bigint) as priority, cls, {_risk_case('cls', POL, 'unassigned')} as risk_level
        from (select distinct cast(label as bigint) as cls from T) c""", "T"))
def q_risk_ordered(spark, sf):
    present = tb.tabular(spark, sf).select(F.col("label").cast("long").alias("cls")).distinct()
    pri = lb.risk_ordered_classes(spark, POL)
    return F.broadcast(pri).join(present, "cls", "inner").select("priority", "cls", "risk_level")


@register("rank_risk_factors", rounded(with_fixtures(
    """select feature, weight, side, rank from (
         select feature, weight, case when weight >= 0 then 'risk' else 'protective' end as side,
                cast(row_number() over (partition by case when weight >= 0 then 'risk' else 'protective' end
                                        order by abs(weight) desc, feature) as bigint) as rank
         from (select 'price' as feature, corr(price, label) as weight from T
               union all select 'acctbal', corr(acctbal, label) from T
               union all select 'qty', corr(qty, label) from T
               union all select 'n_lines', corr(n_lines, label) from T
               union all select 'disc', corr(disc, label) from T) f) r where rank <= 2""", "T"), ["weight"]))
def q_rank_factors(spark, sf):
    """Factors = feature/label correlations from T; top 2 per side by |weight|."""
    t = tb.tabular(spark, sf)
    feats = ["price", "acctbal", "qty", "n_lines", "disc"]
    row = t.agg(*[F.corr(f, F.col("label").cast("double")).alias(f) for f in feats])
    weights = row.unpivot([], feats, "feature", "weight")
    return lb.rank_risk_factors(weights, "feature", "weight", k=2).select("feature", "weight", "side", "rank")
