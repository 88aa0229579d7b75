"""Queries registered under the remaining inventory keys.

Most are single operators that the composite queries already exercise (e.g. the five
trend statistics inside ``symptom_trends``); registering them on their own keeps the
inventory checkable key by key.  Column pruning removes the unused window and
aggregate expressions from each projected plan, so a projection costs only what it reads.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions.exprs import numeric_columns, string_columns
from tidemark.operators import clean as cl
from tidemark.operators import features as fe
from tidemark.operators import labels as lb
from tidemark.operators import longitudinal as lg
from tidemark.operators import metrics as mt
from tidemark.operators import models as md
from tidemark.operators import quality as qa
from tidemark.operators import reports as rp
from tidemark.operators import selection as sl
from tidemark.operators import splits as sp
from tidemark.operators import thresholds as th
from tidemark.operators.selector import FeatureSelector, FeatureSelectorModel
from tidemark.plans import oracle_longitudinal as ol
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rounded, with_fixtures
from tidemark.plans.q_labels import POL, _risk_case
from tidemark.plans.q_selection import _anova_sql
from tidemark.session import checkpointed, scratch_path, stored
from tidemark.sources import cohort as co
from tidemark.sources import tables as tb
from tidemark.sources.policy import read_policy, write_policy

SYM = tb.SYMPTOMS_L
SIGNS = tb.WARNING_SIGNS_L
NUM = ["price", "acctbal", "qty", "n_lines", "disc"]


def _scratch(spark, prefix):
    return scratch_path(spark, prefix)


def _proj(sql, cols):
    return f"select {', '.join(cols)} from ({sql}) _p"


def _L(spark, sf):
    return tb.longitudinal(spark, sf)


# ---- longitudinal statistics one by one --------------------------------------------

def _reg_trend(stat):
    cols = ["patient_id"] + [f"{s}_{stat}" for s in SYM]

    @register(f"trend_{stat}", _proj(ol.trends_sql(SYM), cols))
    def _q(spark, sf, _cols=cols):
        return lg.symptom_trends(_L(spark, sf), "patient_id", "t", SYM, hot_rows=None).select(*_cols)
    return _q


for _stat in ("slope", "volatility", "recent_change", "max_increase", "last_value"):
    _reg_trend(_stat)


def _reg_stability(stat):
    cols = ["patient_id"] + [f"{s}_{stat}" for s in SYM] + [f"overall_{stat}"]

    @register(f"stability_{stat}", _proj(ol.stability_sql(SYM), cols))
    def _q(spark, sf, _cols=cols):
        return lg.symptom_stability(_L(spark, sf), "patient_id", "t", SYM, 3, hot_rows=None).select(*_cols)
    return _q


for _stat in ("cv", "autocorr", "entropy"):
    _reg_stability(_stat)

_OVERALL = ["patient_id", "overall_cv", "overall_autocorr", "overall_entropy"]


@register("stability_overall", _proj(ol.stability_sql(SYM), _OVERALL))
def q_stab_overall(spark, sf):
    return lg.symptom_stability(_L(spark, sf), "patient_id", "t", SYM, 3, hot_rows=None).select(*_OVERALL)


def _reg_pattern(key, stat):
    cols = ["patient_id"] + [f"{s}_{stat}" for s in SYM]

    @register(key, _proj(ol.patterns_sql(SYM), cols))
    def _q(spark, sf, _cols=cols):
        return lg.temporal_patterns(_L(spark, sf), "patient_id", "t", SYM, hot_rows=None).select(*_cols)
    return _q


_reg_pattern("pattern_sudden", "sudden_increase")
_reg_pattern("pattern_sustained", "sustained_increase")
_reg_pattern("pattern_fluctuation", "fluctuation_ratio")

_SUMMARY = ["patient_id", "n_sudden_increases", "n_sustained_increases", "n_fluctuating_symptoms",
            "has_sudden_increases", "has_sustained_increases", "has_fluctuating_symptoms",
            "sudden_increase_symptoms", "sustained_increase_symptoms", "fluctuating_symptoms"]


@register("pattern_summary", _proj(ol.patterns_sql(SYM), _SUMMARY))
def q_pattern_summary(spark, sf):
    return lg.temporal_patterns(_L(spark, sf), "patient_id", "t", SYM, hot_rows=None).select(*_SUMMARY)


def _reg_warning(key, kinds):
    cols = ["patient_id"] + [f"{g}_{k}" for g in SIGNS for k in kinds]

    @register(key, _proj(ol.warnings_sql(SYM, SIGNS), cols))
    def _q(spark, sf, _cols=cols):
        return lg.early_warning_signs(_L(spark, sf), "patient_id", "t", SYM, SIGNS, hot_rows=None).select(*_cols)
    return _q


_reg_warning("warning_level", ["level"])
_reg_warning("warning_increase", ["increase", "alert"])
_reg_warning("warning_trend", ["trend", "trend_alert"])


@register("early_warning_score", _proj(ol.warnings_sql(SYM, SIGNS), ["patient_id", "early_warning_score"]))
def q_ews(spark, sf):
    return lg.early_warning_signs(_L(spark, sf), "patient_id", "t", SYM, SIGNS, hot_rows=None).select("patient_id",
                                                                                        "early_warning_score")


_RR = ["patient_id", "early_warning_score", "has_sudden_increases", "has_sustained_increases", "relapse_risk_score"]


@register("relapse_risk_score", _proj(ol.early_warning_sql(SYM, SIGNS, 1.5), _RR))
def q_relapse(spark, sf):
    return lg.early_warning_features(_L(spark, sf), "patient_id", "t", SYM, SIGNS, 1.5, hot_rows=None).select(*_RR)


# ---- sources / schema / cleaning ---------------------------------------------------

@register("read_cohort", with_fixtures("select patient_id, M6_Rem, Y1_Rem, Y1_Rem_6 from O", "O"))
def q_read_cohort(spark, sf):
    """CSV reader with an explicit schema; the text 'None' and blanks become null."""
    path = _scratch(spark, "cohort-")
    o = tb.outcomes(spark, sf)
    o.select("patient_id", F.coalesce("M6_Rem", F.lit("None")).alias("M6_Rem"),
             F.coalesce("Y1_Rem", F.lit("")).alias("Y1_Rem"),
             F.coalesce("Y1_Rem_6", F.lit("NA")).alias("Y1_Rem_6")).write.mode("overwrite").option("header", True).csv(path)
    return co.read_cohort(spark, path, "patient_id bigint, M6_Rem string, Y1_Rem string, Y1_Rem_6 string")


@register("upload_csv", rounded(with_fixtures("select row_id, price, status from T", "T"), ["price"]))
def q_upload(spark, sf):
    """A user-supplied CSV (any path, types inferred) becomes the working table."""
    path = _scratch(spark, "upload-")
    tb.tabular(spark, sf).select("row_id", "price", "status").write.mode("overwrite").option("header", True).csv(path)
    d = co.read_cohort(spark, path, infer=True)
    return d.select(F.col("row_id").cast("long"), F.col("price").cast("double"), "status")


@register("drop_columns", with_fixtures("select patient_id, M6_Rem, Y1_Rem from O", "O"))
def q_drop_columns(spark, sf):
    """Drop targets/cohort columns when present (absent names are ignored)."""
    return cl.drop_columns(tb.outcomes(spark, sf), ["Y1_Rem_6", "Cohort"])


def _coded(t):
    return t.select("row_id", F.col("price").alias("M0_PANSS_P1"), F.col("acctbal").alias("M0_PANSS_P2"),
                    F.col("qty").alias("M0_PANSS_N1"), F.col("n_lines").alias("M0_PANSS_N2"),
                    F.col("disc").alias("M0_PANSS_G1"), "status")


_CODED_SQL = ("select row_id, price as M0_PANSS_P1, acctbal as M0_PANSS_P2, qty as M0_PANSS_N1, "
              "n_lines as M0_PANSS_N2, disc as M0_PANSS_G1, status from T")
_ITEMS = ["M0_PANSS_P1", "M0_PANSS_P2", "M0_PANSS_N1", "M0_PANSS_N2", "M0_PANSS_G1"]


@register("select_by_prefix", rounded(with_fixtures(f"select {', '.join(_ITEMS)} from C", "T",
                                                    extra=[("C", _CODED_SQL)]), _ITEMS))
def q_select_prefix(spark, sf):
    d = _coded(tb.tabular(spark, sf))
    return d.select(*fe.select_by_prefix(d))


def _skew(c):
    return f"(select skewness({c}) from C)"


_ITEM_SQL = (
    "select row_id, " + ", ".join(f"case when {_skew(c)} > 0.5 then cbrt({c}) else {c} end as {c}" for c in _ITEMS)
    + " from C")
_ITEM_OUT = (
    "select row_id, " + ", ".join(_ITEMS) + ", "
    "coalesce(M0_PANSS_P1, 0) + coalesce(M0_PANSS_P2, 0) as PANSS_P_Total, "
    "coalesce(M0_PANSS_N1, 0) + coalesce(M0_PANSS_N2, 0) as PANSS_N_Total, coalesce(M0_PANSS_G1, 0) as PANSS_G_Total, "
    "M0_PANSS_P1 as PANSS_Factor_Positive, "
    "(coalesce(M0_PANSS_N1, 0) + coalesce(M0_PANSS_N2, 0)) / nullif((M0_PANSS_N1 is not null)::int "
    "+ (M0_PANSS_N2 is not null)::int, 0) as PANSS_Factor_Negative, "
    "M0_PANSS_P2 as PANSS_Factor_Disorganized, M0_PANSS_G1 as PANSS_Factor_Anxiety_Depression, "
    "(coalesce(M0_PANSS_P1, 0) + coalesce(M0_PANSS_P2, 0)) / ((coalesce(M0_PANSS_N1, 0) + coalesce(M0_PANSS_N2, 0)) "
    "+ 0.001) as PANSS_P_N_Ratio from I")
_ITEM_DBL = _ITEMS + ["PANSS_P_Total", "PANSS_N_Total", "PANSS_G_Total", "PANSS_Factor_Positive",
                      "PANSS_Factor_Negative", "PANSS_Factor_Disorganized", "PANSS_Factor_Anxiety_Depression",
                      "PANSS_P_N_Ratio"]


@register("item_transformer", rounded(with_fixtures(_ITEM_OUT, "T", extra=[("C", _CODED_SQL), ("I", _ITEM_SQL)]),
                                      _ITEM_DBL))
def q_item_transformer(spark, sf):
    """Fitted estimator: coded item columns, cube root of items with skew > 0.5, subscale
    totals, exact-match factor means and the positive/negative ratio."""
    d = _coded(tb.tabular(spark, sf)).drop("status")
    m = fe.SkewItemTransformer().fit(d)
    return m.transform(d)


@register("skew_select", rounded(with_fixtures(" union all ".join(
    f"select '{c}' as feature, skewness({c}) as skewness, cast(abs(skewness({c})) > 0.5 as bigint) as selected from T"
    for c in NUM), "T"), ["skewness"]))
def q_skew_select(spark, sf):
    t = tb.tabular(spark, sf)
    chosen = fe.skew_select(t, NUM, 0.5, absolute=True)
    return fe.skewness_table(t, NUM).withColumn("selected", F.col("feature").isin(*chosen).cast("long"))


@register("feature_roles", with_fixtures(
    """select * from (values ('row_id', 'continuous'), ('price', 'continuous'), ('acctbal', 'continuous'),
       ('qty', 'continuous'), ('n_lines', 'continuous'), ('disc', 'continuous'), ('status', 'categorical'),
       ('priority', 'categorical'), ('segment', 'categorical'), ('label', 'target')) r("column", role)"""))
def q_roles(spark, sf):
    roles = qa.feature_roles(tb.tabular(spark, sf), ["label"])
    return spark.createDataFrame([(c, r) for r, cs in roles.items() for c in cs], "column string, role string")


@register("preprocess_outcomes", with_fixtures(
    """select patient_id, label from (select patient_id,
         case when Y1_Rem = 'No' and M6_Rem = 'No' and Y1_Rem_6 = 'No' then 0
              when Y1_Rem = 'Yes' and M6_Rem = 'Yes' and Y1_Rem_6 = 'Yes' then 1
              when Y1_Rem = 'Yes' and M6_Rem = 'No' and Y1_Rem_6 = 'No' then 2
              when Y1_Rem = 'Yes' and M6_Rem = 'Yes' and Y1_Rem_6 = 'No' then 3
              when Y1_Rem = 'Yes' and M6_Rem = 'No' and Y1_Rem_6 = 'Yes' then 4
              when Y1_Rem = 'No' and M6_Rem = 'Yes' and Y1_Rem_6 = 'No' then 5
              when Y1_Rem = 'No' and M6_Rem = 'Yes' and Y1_Rem_6 = 'Yes' then 6
              when Y1_Rem = 'No' and M6_Rem = 'No' and Y1_Rem_6 = 'Yes' then 7 end as label
       from O where M6_Rem is not null and Y1_Rem is not null and Y1_Rem_6 is not null) x""", "O"))
def q_preprocess_outcomes(spark, sf):
    """clean (all outcomes present) -> encode -> truth-table label -> drop the targets."""
    o = cl.clean_outcomes(tb.outcomes(spark, sf))
    o = lb.outcome_label_truth(o)
    return cl.drop_columns(o, list(cl.OUTCOMES))


@register("threshold_policy_table", with_fixtures(
    "select cls, risk_level, 0.5::double as default_threshold, current_threshold, goal from (values "
    + ", ".join(f"({c}::bigint, '{POL.risk_of(c)}', {POL.threshold(c)}::double, '"
                + {"high_risk": "Maximise sensitivity (catch every case)",
                   "moderate_risk": "Balance sensitivity and specificity",
                   "low_risk": "Limit over-treatment (favour specificity)"}[POL.risk_of(c)] + "')"
                for c in POL.priority_order())
    + ") p(cls, risk_level, current_threshold, goal) where cls in (select distinct cast(label as bigint) from T)", "T"))
def q_thr_policy(spark, sf):
    present = tb.tabular(spark, sf).select(F.col("label").cast("long").alias("cls")).distinct()
    return th.threshold_policy_table(spark, POL).join(present, "cls", "left_semi")


@register("read_policy", with_fixtures(
    "select cast(label as bigint) as cls, " + _risk_case("cast(label as bigint)") .replace(
        "when 3 then 'moderate_risk'", "when 3 then 'high_risk'")
    + " as risk_level, count(*) as n from T group by 1, 2", "T"))
def q_read_policy(spark, sf):
    """Policy written as JSON to the shared folder (class 3 moved to high risk), read back and
    applied to T's labels."""
    path = _scratch(spark, "policy-") + "/policy.json"
    cfg = POL.merged({"risk_levels": {"high_risk": [0, 1, 2, 3], "moderate_risk": [4, 5]}})
    write_policy(cfg, path, spark)
    pol = read_policy(path, spark)
    t = lb.class_to_risk(tb.tabular(spark, sf).select(F.col("label").cast("long").alias("cls")), pol, "cls")
    return t.groupBy("cls", "risk_level").agg(F.count(F.lit(1)).alias("n"))


# ---- models / selection (rows checks) ------------------------------------------------

def _train_test(spark, sf):
    t = cl.impute_median(stored(tb.tabular(spark, sf).select("row_id", *NUM, "label"), "table"), NUM)
    t = t.select("row_id", *NUM, F.col("label").cast("long").alias("label"))
    s = checkpointed(sp.train_test_split(t, "row_id", "label", test_size=0.3))
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


@register("fit_cost_sensitive")
def q_fit_cs(spark, sf):
    """Weighted fit + cost-optimal thresholds (kept only when they move > 0.1) + class counts."""
    tr, _ = _train_test(spark, sf)
    b = md.fit_cost_sensitive(tr, NUM, POL, "decision_tree", maxDepth=4)
    rows = [(c, float(t), POL.threshold(c), int(b["history"]["class_counts"].get(c, 0)))
            for c, t in sorted(b["thresholds"].items())]
    return spark.createDataFrame(rows, "cls bigint, threshold double, default_threshold double, n_train bigint")


@register("score_proba")
def q_score_proba(spark, sf):
    tr, te = _train_test(spark, sf)
    b = md.fit_cost_sensitive(tr, NUM, POL, "multinomial", optimise_thresholds=False, maxIter=30)
    s = md.score_proba(b, te)
    return s.select("row_id", *[F.col("proba")[k].alias(f"p{k}") for k in range(8)])


@register("predict_labels")
def q_predict(spark, sf):
    """Scores + thresholds walked in clinical priority order (argmax fallback)."""
    tr, te = _train_test(spark, sf)
    b = md.fit_cost_sensitive(tr, NUM, POL, "multinomial", optimise_thresholds=False, maxIter=30)
    return md.predict_labels(b, te, POL).select("row_id", "label", "y_pred")


@register("high_risk_ensemble")
def q_hr_ensemble(spark, sf):
    """Main weighted model + one binary booster per high-risk class (positives weighted x5),
    combined sequentially in priority order; predictions on the hold-out."""
    tr, te = _train_test(spark, sf)
    main = md.fit_cost_sensitive(tr, NUM, POL, "decision_tree", optimise_thresholds=False, maxDepth=4)
    scored = md.score_proba(main, te)
    hr = [c for c in POL.priority_order() if c in POL.high_risk_classes]
    boosters = {}
    rows = md.assemble(tr, NUM).select("features", "label").persist()   # every booster passes over them several times
    try:
        for c in hr:
            d = rows.withColumn("_y", (F.col("label") == c).cast("long")) \
                    .withColumn("sample_weight", F.when(F.col("_y") == 1, F.lit(5.0)).otherwise(F.lit(1.0)))
            boosters[c] = md.make_classifier("decision_tree", "_y", maxDepth=3).fit(d)
    finally:
        rows.unpersist()
    x = md.assemble(scored, NUM)
    for c, m in boosters.items():
        x = m.setProbabilityCol(f"_pb{c}").setRawPredictionCol(f"_rb{c}").setPredictionCol(f"_yb{c}").transform(x)
    from pyspark.ml.functions import vector_to_array
    x = md.high_risk_boost(x, "proba", {c: vector_to_array(F.col(f"_pb{c}"))[1] for c in hr}, hr, 0.7, 0.99)
    return x.select("row_id", "label", lb.apply_thresholds_expr(F.col("proba"), POL).alias("y_pred"))


@register("select_importance")
def q_select_importance(spark, sf):
    """Forest (100 trees) impurity importances, top 3 selected."""
    tr, _ = _train_test(spark, sf)
    b = md.fit_cost_sensitive(tr, NUM, POL, "random_forest", optimise_thresholds=False, numTrees=100)
    imp = spark.createDataFrame(md.model_importance(b), "feature string, importance double")
    return sl.select_top(imp, "importance", k=3)


def _chosen_sql(variant: str, rule: str) -> str:
    return f"select '{variant}' as variant, f.feature, {rule} as keep from FS f join VS v on f.feature = v.feature"


@register("feature_selector", rounded(with_fixtures(
    "select c.variant, c.feature, u.n, u.top from (" + " union all ".join(
        (_chosen_sql("all", "true"), _chosen_sql("threshold", "f_score >= 1.0 and variance >= 1.0"),
         _chosen_sql("top", "row_number() over (order by case when vr <= 3 then f_score end desc nulls last) <= 3"))) + ") c join ("
    + " union all ".join(f"select '{c}' as feature, count({c}) as n, max({c})::double as top from T" for c in NUM)
    + ") u on u.feature = c.feature where c.keep", "T", extra=[
        ("FS", _anova_sql()),
        ("VS", "select *, row_number() over (order by variance desc) as vr from (" + " union all ".join(
            f"select '{c}' as feature, var_pop({c}) as variance from T" for c in NUM) + ") x")]), ["top"]))
def q_feature_selector(spark, sf):
    """Variance, then ANOVA F: a threshold of 1 (which beats the number given with it), the top 3, and all.
    Each chain is fitted, saved, read again and applied; one row per column that comes out."""
    t = tb.tabular(spark, sf)
    out = None
    for variant, given in (("threshold", {"threshold": 1.0, "nFeatures": 1}), ("top", {"nFeatures": 3}), ("all", {})):
        path = _scratch(spark, "selector-")
        FeatureSelector(methods=["variance", "statistical"], inputCols=NUM, labelCol="label", **given).fit(t).write().save(path)
        model = FeatureSelectorModel.load(path)
        kept = model.transform(t.select("row_id", *NUM)).drop("row_id")
        row = kept.agg(*[f(F.col(c)).alias(f"{f.__name__}_{c}") for c in kept.columns for f in (F.count, F.max)])
        cells = F.array(*[F.struct(F.lit(variant).alias("variant"), F.lit(c).alias("feature"), F.col(f"count_{c}").alias("n"),
                                   F.col(f"max_{c}").cast("double").alias("top")) for c in kept.columns])
        part = row.select(F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out


@register("select_best")
def q_select_best(spark, sf):
    """variance -> correlation (|r| > 0.8 drops the earlier) -> ANOVA importance, with counts."""
    t = tb.tabular(spark, sf)
    var_kept = [r["feature"] for r in sl.variance_table(t, NUM).where("variance > 0").collect()]
    corr = sl.correlation_matrix(t, var_kept, upper_only=True)
    corr_kept = sl.select_correlation(corr, var_kept, 0.8)
    top = sl.select_top(sl.anova_f(t, corr_kept, "label"), "f_score", k=3)
    return top.withColumn("n_after_variance", F.lit(len(var_kept))).withColumn("n_after_correlation",
                                                                                 F.lit(len(corr_kept)))


@register("pca_features")
def q_pca_features(spark, sf):
    """Rows projected on the first two centred principal components."""
    t = cl.impute_median(tb.tabular(spark, sf), NUM)
    fit = sl.pca_fit(t, NUM, k=2)
    pcs = fit["components"]
    exprs = [sum([(F.col(f) - F.lit(m)) * F.lit(float(pcs[i, j])) for i, (f, m) in enumerate(zip(NUM, fit["means"]))],
                 F.lit(0.0)).alias(f"pc{j + 1}") for j in range(2)]
    return t.select("row_id", *exprs)


@register("metric_interval")
def q_metric_interval(spark, sf):
    """Point estimate, lower and upper bound per metric from the Poisson bootstrap."""
    w = tb.scored_multiclass_wide(spark, sf)
    pred = w.select("row_id", "y_true", lb.argmax_expr(F.col("proba")).alias("y_pred"))
    point = mt.clinical_utility(pred, POL).select(F.lit("utility_score").alias("metric"),
                                                  F.col("utility_score").alias("point"))
    acc = mt.accuracy_macro(pred).select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("point"))
    _, summ = mt.bootstrap_metric_ci(pred, POL, n_boot=100)
    return point.unionByName(acc).join(summ.select("metric", F.col("ci_lower").alias("lower"),
                                                   F.col("ci_upper").alias("upper")), "metric")


@register("save_model")
def q_save_model(spark, sf):
    """Fit, persist (Spark ML format + JSON metadata, shared folder) and read the metadata back."""
    tr, _ = _train_test(spark, sf)
    b = md.fit_cost_sensitive(tr, NUM, POL, "decision_tree", optimise_thresholds=False, maxDepth=3)
    path = _scratch(spark, "saved-")
    md.save_model(b, path)
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return spark.createDataFrame([(meta["kind"], len(meta["features"]), len(meta["thresholds"]))],
                                 "kind string, n_features bigint, n_thresholds bigint")


@register("load_model_registry")
def q_registry(spark, sf):
    """Two fitted models saved under one folder, reloaded as a name -> model registry."""
    tr, _ = _train_test(spark, sf)
    folder = _scratch(spark, "registry-")
    for kind, params in (("decision_tree", {"maxDepth": 3}), ("gbt", {"maxIter": 2, "maxDepth": 2})):
        b = md.fit_cost_sensitive(tr, NUM, POL, kind, optimise_thresholds=False, **params)
        md.save_model(b, f"{folder}/{kind}_model")
    reg = md.load_model_registry(folder)
    return spark.createDataFrame([(n, b["kind"], len(b["features"])) for n, b in reg.items()],
                                 "name string, kind string, n_features bigint")


@register("experiment_summary")
def q_experiment(spark, sf):
    """One run record (name, time, runtime, metrics, params) for the runs table."""
    import time
    t0 = time.time()
    w = tb.scored_multiclass_wide(spark, sf)
    pred = w.select("row_id", "y_true", lb.argmax_expr(F.col("proba")).alias("y_pred"))
    u = mt.clinical_utility(pred, POL).first()
    return rp.experiment_summary(spark, "argmax_utility", time.time() - t0,
                                 {"utility_score": u["utility_score"], "total_cost": u["total_cost"]},
                                 {"policy": "code", "sf_dir": sf}).drop("ts", "runtime_s")


del numeric_columns, string_columns
