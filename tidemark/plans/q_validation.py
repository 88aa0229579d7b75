"""Registered validation-loop, group-fold, batch-scoring and policy-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import row_mean
from tidemark.operators import clean as cl
from tidemark.operators import splits as sp
from tidemark.operators import validation as va
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rounded, with_fixtures
from tidemark.plans.q_labels import POL, POL_YAML
from tidemark.session import checkpointed, stored
from tidemark.sources import tables as tb
from tidemark.sources.policy import validate_policy, YAML_OVERRIDES

FEATS = ["price", "acctbal", "qty", "n_lines", "disc"]


def _T_imputed(spark, sf):
    t = cl.impute_median(stored(tb.tabular(spark, sf).select("row_id", *FEATS, "label"), "table"), FEATS)
    return t.select("row_id", *FEATS, F.col("label").cast("long").alias("label"))


@register("balanced_group_kfold", """
    with cells as (select o_custkey as grp, o_orderkey % 8 as label, count(*) as n from orders group by 1, 2),
    groups as (select grp, sum(n) as size, first(label order by n desc, label) as main from cells group by 1),
    ranked as (select grp, size, main, length(bin(size::bigint)) as digits,
                      row_number() over (partition by main, length(bin(size::bigint))
                                         order by md5(grp::varchar || '-42')) - 1 as r from groups)
    select cast((r + main + digits) % 5 as bigint) as fold, cast(sum(size) as bigint) as n_rows, count(*) as n_groups
    from ranked group by 1""")
def q_group_kfold(spark, sf):
    """Customers as groups (never split) in 5 folds: rows and groups of each fold."""
    o = tb.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("grp"),
                                                  (F.col("o_orderkey") % 8).alias("label"))
    f = sp.balanced_group_kfold(o, "grp", "label", k=5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("grp").alias("n_groups"))


@register("cross_validate")
def q_cv(spark, sf):
    """Risk-stratified 3-fold CV of a weighted decision tree: per-fold utility / recall / accuracy."""
    return va.cross_validate(_T_imputed(spark, sf), FEATS, POL, "decision_tree", k=3, maxDepth=4).per


_FOLDS = (f"select label, (row_number() over (partition by level order by md5(row_id::varchar || '-42')) - 1) % 3 as fold from ("
          f"select row_id, label, case {' '.join(f'when label = {c} then ' + repr(POL.risk_of(c)) for c in POL.classes)} "
          "else 'moderate_risk' end as level from T) z")


@register("cross_validate_classes", with_fixtures(
    "select fold::bigint as fold, label as cls, count(*) as support, 0::bigint as n_outside from (" + _FOLDS + ") y group by all", "T"))
def q_cv_classes(spark, sf):
    """Class scores per fold: every class of a fold has its support, and precision, recall, F1 and AUC within 0 to 1."""
    c = va.cross_validate(_T_imputed(spark, sf), FEATS, POL, "decision_tree", k=3, maxDepth=4).classes
    outside = sum((F.when(F.coalesce(F.col(m), F.lit(-1.0)).between(0, 1), 0).otherwise(1) for m in ("precision", "recall", "f1", "auc")),
                  F.lit(0))
    return c.filter("support > 0").select("fold", "cls", "support", outside.cast("long").alias("n_outside"))


@register("temporal_cross_validate")
def q_temporal_cv(spark, sf):
    """Expanding-window evaluation over order years (train on earlier years, test the next)."""
    t = _T_imputed(spark, sf)
    yrs = tb.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"),
                                                    F.year("o_orderdate").cast("long").alias("year"))
    return va.temporal_cross_validate(t.join(yrs, "row_id"), FEATS, POL, "year", "decision_tree",
                                      min_train_periods=3, step=1, maxDepth=3).per


@register("bootstrap_evaluation")
def q_boot_eval(spark, sf):
    """Three Poisson-bootstrap refits scored on the hold-out: metric mean / std / CI."""
    t = _T_imputed(spark, sf)
    s = checkpointed(sp.train_test_split(t, "row_id", "label", 0.3))
    return va.bootstrap_evaluation(s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split"),
                                   FEATS, POL, n_boot=3, kind="decision_tree", maxDepth=3).summary


@register("batch_score_table", rounded(with_fixtures(
    """select patient_id, t, score from (
         select patient_id, t, (coalesce(s_click, 0) + coalesce(s_view, 0) + coalesce(s_error, 0) + coalesce(s_signup, 0)
                + coalesce(s_purchase, 0)) / nullif((s_click is not null)::int + (s_view is not null)::int
                + (s_error is not null)::int + (s_signup is not null)::int + (s_purchase is not null)::int, 0) as score,
                row_number() over (partition by patient_id order by t desc) as r from L) x where r <= 10""", "L"),
    ["score"]))
def q_batch_score(spark, sf):
    """Score every day of every entity (mean symptom level) and keep the latest 10 per entity."""
    lon = tb.longitudinal(spark, sf)
    out = va.batch_score_table(lon, row_mean(tb.SYMPTOMS_L), "patient_id", "t", 10)
    return out.select("patient_id", "t", "score")


def _policy_rows_sql(pol):
    rows = ", ".join(f"({r[0]}::bigint, '{r[2]}', {r[3]}::double, {r[4]}::double, {r[5]}::double, {r[6]}::double, "
                     f"{r[7]}::bigint)" for r in pol.rows())
    return (f"select * from (values {rows}) p(cls, risk_level, class_weight, threshold, fn_cost, fp_cost, priority)")


_POLICY_BODY = """select p.cls, p.risk_level, p.class_weight, p.threshold, p.fn_cost, p.fp_cost, p.priority,
                         coalesce(c.n, 0) as n_rows from POLT p left join
                  (select cast(label as bigint) as cls, count(*) as n from T group by 1) c on p.cls = c.cls"""


def _policy_table(spark, sf, pol):
    counts = tb.tabular(spark, sf).groupBy(F.col("label").cast("long").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    p = F.broadcast(pol.to_df(spark).drop("description"))           # K rows
    return p.join(counts, "cls", "left").select("cls", "risk_level", "class_weight", "threshold", "fn_cost",
                                                "fp_cost", "priority", F.coalesce("n", F.lit(0)).alias("n_rows"))


@register("policy_table", rounded(with_fixtures(_POLICY_BODY, "T", extra=[("POLT", _policy_rows_sql(POL))]),
                                  ["class_weight", "threshold", "fn_cost", "fp_cost"]))
def q_policy_table(spark, sf):
    """One row per class (level, weight, threshold, costs, priority) with its row count in T."""
    return _policy_table(spark, sf, POL)


@register("merge_policy", rounded(with_fixtures(_POLICY_BODY, "T", extra=[("POLT", _policy_rows_sql(POL_YAML))]),
                                  ["class_weight", "threshold", "fn_cost", "fp_cost"]))
def q_merge_policy(spark, sf):
    """Code policy deep-merged with the YAML overrides, as a class table with row counts."""
    return _policy_table(spark, sf, POL.merged(YAML_OVERRIDES))


@register("validate_policy", with_fixtures(
    """select 'prediction_thresholds' as section, cast(cls as varchar) as item, 'threshold outside (0,1)' as problem
       from (select distinct cast(label as bigint) as cls from T) c where cls in (3, 6)""", "T"))
def q_validate_policy(spark, sf):
    """Violations of a policy whose thresholds for two classes present in T were set to 1.0."""
    present = [r[0] for r in tb.tabular(spark, sf).select(F.col("label").cast("long")).distinct().collect()]   # K
    bad = POL.merged({"prediction_thresholds": {str(c): 1.0 for c in (3, 6) if c in present}})
    return validate_policy(bad, spark)
