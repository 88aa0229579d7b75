"""Registered model queries: probability-combination rules (SQL-checked on P) and
Spark ML training / scoring / persistence (rows checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean as cl
from tidemark.operators import labels as lb
from tidemark.operators import metrics as mt
from tidemark.operators import models as md
from tidemark.operators import search as se
from tidemark.operators import splits as sp
from tidemark.operators import thresholds as th
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rounded, with_fixtures
from tidemark.plans.q_labels import POL
from tidemark.plans.q_metrics import AUC_SQL
from tidemark.plans.q_splits import MD5
from tidemark.session import checkpointed, scratch_path, stored
from tidemark.sources import tables as tb

K = 8
PCOLS = [f"p{c}" for c in range(K)]
HR = [c for c in POL.priority_order() if c in POL.high_risk_classes]


def _wide_sql():
    return ("select row_id, any_value(y_true) as y_true, any_value(t_days) as t_days, "
            + ", ".join(f"max(case when cls = {c} then p end) as p{c}" for c in range(K)) + " from P group by row_id")


def _renorm_sql(src, name, changes: dict, extra_cols=""):
    cols = {f"p{c}": changes.get(c, f"p{c}") for c in range(K)}
    tot = " + ".join(f"({v})" for v in cols.values())
    inner = f"select row_id, y_true, t_days{extra_cols}, " + ", ".join(f"{v} as p{c}" for c, v in
                                                                     zip(range(K), cols.values())) + f" from {src}"
    return name, (f"select row_id, y_true, t_days{extra_cols}, "
                  + ", ".join(f"p{c} / ({' + '.join(PCOLS)}) as p{c}" for c in range(K)) + f" from ({inner}) z"), tot


def _out(spark_proba):
    return [spark_proba[c].alias(f"p{c}") for c in range(K)]


def _wide(spark, sf):
    return tb.scored_multiclass_wide(spark, sf)


def _boost_sql():
    ctes = [("W", _wide_sql()), ("H", "select *, " + ", ".join(f"least(1.0, 2.5 * p{c}) as hr{c}" for c in HR)
                                     + " from W")]
    src = "H"
    extra = ", " + ", ".join(f"hr{c}" for c in HR)
    for i, c in enumerate(HR):
        cond = f"hr{c} >= 0.7"
        changed = {c: f"least(0.7 * hr{c} + 0.3 * p{c}, 0.99)"}
        cols = ", ".join(f"case when {cond} then {changed.get(k, f'p{k}')} else p{k} end as p{k}" for k in range(K))
        a = f"select row_id, y_true, t_days{extra}, {cols}, {cond} as hit from {src}"
        tot = " + ".join(PCOLS)
        b = (f"select row_id, y_true, t_days{extra}, "
             + ", ".join(f"case when hit then p{k} / ({tot}) else p{k} end as p{k}" for k in range(K)) + f" from A{i}")
        ctes += [(f"A{i}", a), (f"S{i}", b)]
        src = f"S{i}"
    return rounded(with_fixtures(f"select row_id, {', '.join(PCOLS)} from {src}", "P", extra=ctes), PCOLS)


@register("high_risk_ensemble_combine", _boost_sql())
def q_boost(spark, sf):
    """Main probabilities boosted by one binary booster per high-risk class (booster score
    derived from the data as min(1, 2.5 p_c)), sequential in priority order."""
    w = _wide(spark, sf)
    boosters = {c: F.least(F.lit(1.0), F.lit(2.5) * F.col("proba")[c]) for c in HR}
    b = md.high_risk_boost(w, "proba", boosters, HR, 0.7, 0.99)
    return b.select("row_id", *_out(F.col("proba")))


def _stacked_sql(exact=False):
    tot = " + ".join(PCOLS)
    a = ("select row_id, " + ", ".join(
        f"case when least(1.0, 2.5 * p0) > 0.7 then {'0.7 * least(1.0, 2.5 * p0) + 0.3 * p0' if k == 0 else f'p{k}'} "
        f"else p{k} end as p{k}" for k in range(K)) + ", least(1.0, 2.5 * p0) > 0.7 as hit from W")
    b = ("select row_id, " + ", ".join(f"case when hit then p{k} / ({tot}) else p{k} end as p{k}" for k in range(K))
         + " from A")
    sql = with_fixtures("select * from S", "P", extra=[("W", _wide_sql()), ("A", a), ("S", b)])
    return sql if exact else rounded(sql, PCOLS)


@register("stacked_boost", _stacked_sql())
def q_stacked(spark, sf):
    w = _wide(spark, sf)
    p = md.stacked_boost(F.col("proba"), F.least(F.lit(1.0), F.lit(2.5) * F.col("proba")[0]), 0.7, 0)
    return w.select("row_id", p.alias("pp")).select("row_id", *_out(F.col("pp")))


def _decay_sql(exact=False):
    ctes = [("W", _wide_sql()), ("X", "select *, pow(0.9, t_days / (select max(t_days) from W)) as w from W")]
    src = "X"
    tot = " + ".join(PCOLS)
    for i, c in enumerate(HR):
        a = ("select row_id, w, " + ", ".join(
            (f"p{k} + (1 - p{k}) * (1 - w) * 0.2" if k == c else f"p{k}") + f" as p{k}" for k in range(K))
            + f" from {src}")
        b = "select row_id, w, " + ", ".join(f"p{k} / ({tot}) as p{k}" for k in range(K)) + f" from A{i}"
        ctes += [(f"A{i}", a), (f"S{i}", b)]
        src = f"S{i}"
    sql = with_fixtures(f"select row_id, {', '.join(PCOLS)} from {src}", "P", extra=ctes)
    return sql if exact else rounded(sql, PCOLS)


def _decayed(spark, sf):
    w = _wide(spark, sf)
    max_t = float(w.agg(F.max("t_days")).first()[0])       # frozen scalar
    return md.time_decay_adjust(w.withColumn("pd", F.col("proba")), "pd", F.col("t_days"), max_t, HR, 0.9)


@register("time_decay_adjust", _decay_sql())
def q_decay(spark, sf):
    return _decayed(spark, sf).select("row_id", *_out(F.col("pd")))


@register("soft_vote", rounded(with_fixtures(
    "select W.row_id, " + ", ".join(f"W.p{k} * 0.7 + S.p{k} * 0.3 as p{k}" for k in range(K))
    + " from W join SB S on W.row_id = S.row_id", "P",
    extra=[("W", _wide_sql()), ("SB", f"select * from ({_stacked_sql(exact=True)})")]), PCOLS))
def q_soft_vote(spark, sf):
    """0.7 x main + 0.3 x stacked-boost probabilities."""
    w = _wide(spark, sf)
    st = md.stacked_boost(F.col("proba"), F.least(F.lit(1.0), F.lit(2.5) * F.col("proba")[0]), 0.7, 0)
    v = md.soft_vote([F.col("proba"), st], [0.7, 0.3])
    return w.select("row_id", v.alias("pp")).select("row_id", *_out(F.col("pp")))


def _argmax_sql(src):
    arr = ", ".join(f"({k}, p{k})" for k in range(K))
    del arr
    case = "case " + " ".join(
        f"when p{k} = greatest({', '.join(PCOLS)}) then {k}" for k in range(K)) + " end"
    return f"select row_id, {case} as lab from {src}"


@register("label_vote", with_fixtures(
    "select a.row_id, cast(round_even(a.lab * 0.7 + b.lab * 0.3, 0) as bigint) as y_vote from A a join D b on a.row_id = b.row_id",
    "P", extra=[("W", _wide_sql()), ("A", _argmax_sql("W")), ("DD", _decay_sql(exact=True)), ("D", _argmax_sql("DD"))]))
def q_label_vote(spark, sf):
    """Weighted (0.7/0.3) label vote of argmax(main) and argmax(time-decayed), half-to-even."""
    d = _decayed(spark, sf)
    a = lb.argmax_expr(F.col("proba"))
    b = lb.argmax_expr(F.col("pd"))
    return d.select("row_id", md.label_vote([a, b], [0.7, 0.3]).alias("y_vote"))


# ---------------------------------------------------------------------------
# Spark ML (rows checks)
# ---------------------------------------------------------------------------

FEATS = ["price", "acctbal", "qty", "n_lines", "disc"]


def _train_test(spark, sf):
    t = cl.impute_median(stored(tb.tabular(spark, sf).select("row_id", *FEATS, "label"), "table"), FEATS)
    t = t.select("row_id", *FEATS, F.col("label").cast("long").alias("label"))
    s = checkpointed(sp.train_test_split(t, "row_id", "label", test_size=0.3))  # many passes of a fit start here
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


def _fit_predict(spark, sf, kind, **params):
    tr, te = _train_test(spark, sf)
    b = md.fit_cost_sensitive(tr, FEATS, POL, kind, optimise_thresholds=True, **params)
    return md.predict_labels(b, te, POL).select("row_id", "label", "y_pred")


@register("fit_logistic")
def q_fit_logistic(spark, sf):
    """One-against-rest L1 path over 10 penalties, each class's chosen on 10 folds; cost-optimal thresholds."""
    return _fit_predict(spark, sf, "logistic", folds=10)


@register("fit_decision_tree")
def q_fit_tree(spark, sf):
    """Depth and leaf size from the whole grid (60 points, 5 folds, weighted AUC), then the one training path."""
    tr, te = _train_test(spark, sf)
    found = se.search_params(tr, FEATS, POL, "decision_tree", se.grid_candidates(md.TREE_GRID))
    b = md.fit_cost_sensitive(tr, FEATS, POL, "decision_tree", **found["best_params"])
    return md.predict_labels(b, te, POL).select("row_id", "label", "y_pred")


@register("fit_random_forest")
def q_fit_forest(spark, sf):
    return _fit_predict(spark, sf, "random_forest", numTrees=20)


@register("fit_gradient_boosting")
def q_fit_gbt(spark, sf):
    """Random search (20 draws of rate, depth, trees, row share and leaf size, 5 folds, weighted AUC), then boosting through
    the one training path, saved and read again; test rows scored by the reloaded model."""
    tr, te = _train_test(spark, sf)
    found = se.search_params(tr, FEATS, POL, "gbt", se.random_candidates(md.BOOSTING_CHOICES, 20))
    path = md.save_model(md.fit_cost_sensitive(tr, FEATS, POL, "gbt", **found["best_params"]), scratch_path(spark, "boosting-"))
    s = md.predict_labels(md.load_model(path), te, POL)
    total = F.aggregate("proba", F.lit(0.0), lambda x, y: x + y)
    return s.select("row_id", "label", "y_pred", total.alias("p_total"))


@register("fit_mlp")
def q_fit_mlp(spark, sf):
    """MLP through the one training path: scaled inputs, class weights by weighted resampling."""
    return _fit_predict(spark, sf, "mlp", layers=[len(FEATS), 6, 6, K], maxIter=50)


def _tts_sql(strat: str = "label") -> str:
    return (f"select row_id, label, case when rk < ceil(n * 0.3) then 'test' else 'train' end as split from (select row_id, label, "
            f"row_number() over (partition by {strat} order by {MD5}) - 1 as rk, count(*) over (partition by {strat}) as n from T) x")


CHECKED = {"logistic": {"Cs": [0.01, 1.0]}, "decision_tree": {"maxDepth": 3}, "gbt": {"maxIter": 2, "maxDepth": 2},
           "mlp": {"layers": [len(FEATS), 4, K], "maxIter": 10}}


@register("training_path_checks", with_fixtures(
    "select kind, n_test, n_test as n_sum_one, 0::bigint as n_negative, n_train, 0::bigint as n_off_grid from (select "
    "count(*) filter (where split = 'test') as n_test, count(*) filter (where split = 'train') as n_train from S) x, (values "
    + ", ".join(f"('{k}')" for k in CHECKED) + ") k(kind)", "T", extra=[("S", _tts_sql())]))
def q_training_checks(spark, sf):
    """What holds for every kind of the training path: the test rows are all scored, their probabilities are not
    negative and sum to 1, all training rows are counted, thresholds are the policy's or on the 50-point grid."""
    tr, te = _train_test(spark, sf)
    out = None
    grid = [round(x, 9) for x in th.grid(50, 0.1, 0.9)]
    for kind, params in CHECKED.items():
        b = md.fit_cost_sensitive(tr, FEATS, POL, kind, **params)
        off = sum(round(t, 9) not in grid and t != POL.threshold(c) for c, t in b["thresholds"].items())
        total = F.aggregate("proba", F.lit(0.0), lambda x, y: x + y)
        row = md.score_proba(b, te).agg(
            F.lit(kind).alias("kind"), F.count("*").alias("n_test"), F.count_if(F.abs(total - 1) < 1e-9).alias("n_sum_one"),
            F.count_if(F.array_min("proba") < 0).alias("n_negative"),
            F.lit(b["history"]["n_samples"]).cast("long").alias("n_train"), F.lit(off).cast("long").alias("n_off_grid"))
        out = row if out is None else out.unionByName(row)
    return out


@register("weighted_ovr_auc", rounded(with_fixtures(
    "select sum(auc * n_pos) / sum(n_pos) as weighted_ovr_auc from (" + AUC_SQL + ") x where n_pos > 0", "P"), ["weighted_ovr_auc"]))
def q_weighted_auc(spark, sf):
    """The searches' metric on fixed scores, through the evaluator's operator."""
    return mt.weighted_ovr_auc(tb.scored_multiclass(spark, sf))


@register("search_params")
def q_search(spark, sf):
    """Grid search of a tree: class weights, 3 risk-stratified folds, weighted AUC; one row per grid point."""
    tr, _ = _train_test(spark, sf)
    points = se.grid_candidates({"maxDepth": [2, 4], "minInstancesPerNode": [5, 50]})
    found = se.search_params(tr, FEATS, POL, "decision_tree", points, folds=3)
    rows = [(r["params"]["maxDepth"], r["params"]["minInstancesPerNode"], r["mean"], r["std"]) for r in found["results"]]
    return spark.createDataFrame(rows, "maxDepth int, minInstancesPerNode int, mean_auc double, std_auc double")


@register("best_params")
def q_best_params(spark, sf):
    """Random search: 20 seeded draws of a tree's parameters, 2 folds; the draw of the largest mean score."""
    tr, _ = _train_test(spark, sf)
    found = se.search_params(tr, FEATS, POL, "decision_tree", se.random_candidates(md.TREE_GRID, 20), folds=2)
    best = found["best_params"]
    top = max(r["mean"] for r in found["results"])
    return spark.createDataFrame([(len(found["results"]), best["maxDepth"], best["minInstancesPerNode"], top)],
                                 "n_draws int, maxDepth int, minInstancesPerNode int, mean_auc double")


@register("train_report")
def q_train_report(spark, sf):
    """Models of three kinds, the tree's (12 points) and the booster's (10 draws) parameters searched on 5 folds, saved to one
    folder and measured on the test rows."""
    tr, te = _train_test(spark, sf)
    tree = se.grid_candidates({"maxDepth": range(2, 6), "minInstancesPerNode": range(5, 35, 10)})
    kinds = {"multinomial": {}, "decision_tree": {"candidates": tree}, "gbt": {"candidates": se.random_candidates(md.BOOSTING_CHOICES, 10)}}
    return md.train_report(tr, te, FEATS, POL, kinds, folder=scratch_path(spark, "report-")).drop("path")


@register("save_load_model")
def q_save_load(spark, sf):
    """Persist a fitted bundle to the shared checkpoint folder, reload it and score."""
    tr, te = _train_test(spark, sf)
    b = md.fit_cost_sensitive(tr, FEATS, POL, "decision_tree", optimise_thresholds=False, maxDepth=3)
    path = scratch_path(spark, "model-")
    md.save_model(b, path)
    b2 = md.load_model(path)
    return md.predict_labels(b2, te, POL).select("row_id", "label", "y_pred")


@register("score_proba_long")
def q_score_long(spark, sf):
    tr, te = _train_test(spark, sf)
    b = md.fit_cost_sensitive(tr, FEATS, POL, "multinomial", optimise_thresholds=False, maxIter=30)
    scored = b["model"].transform(md.assemble(te, FEATS))
    return md.proba_long(scored, "label", "row_id")


@register("entity_contributions")
def q_contrib(spark, sf):
    """Linear-model contributions coef x value, top 3 per side per entity (class 0)."""
    tr, te = _train_test(spark, sf)
    b = md.fit_cost_sensitive(tr, FEATS, POL, "multinomial", optimise_thresholds=False, maxIter=30)
    return md.linear_contributions(b, te, 0, "row_id")


@register("model_importance")
def q_model_importance(spark, sf):
    tr, _ = _train_test(spark, sf)
    b = md.fit_cost_sensitive(tr, FEATS, POL, "random_forest", optimise_thresholds=False, numTrees=20)
    return spark.createDataFrame(md.model_importance(b), "feature string, importance double")
