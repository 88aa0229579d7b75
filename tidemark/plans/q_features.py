"""Registered cleaning / imputation / feature-engineering queries (fixtures O and T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import categories as ca
from tidemark.operators import clean as cl
from tidemark.operators import features as fe
from tidemark.operators import labels as lb
from tidemark.plans.catalog import register
from tidemark.session import scratch_path, stored
from tidemark.plans.oracle import rounded, with_fixtures
from tidemark.sources import tables as tb

NUM = ["price", "acctbal", "qty", "n_lines", "disc"]
CAT = ["status", "priority", "segment"]


def _T(spark, sf):
    return tb.tabular(spark, sf)


def T(body, dbl=(), extra=()):
    return rounded(with_fixtures(body, "T", extra=list(extra)), dbl)


@register("clean_outcomes", with_fixtures(
    "select * from O where M6_Rem is not null and Y1_Rem is not null and Y1_Rem_6 is not null", "O"))
def q_clean(spark, sf):
    return cl.clean_outcomes(tb.outcomes(spark, sf))


@register("drop_unlabelled", with_fixtures(
    """select patient_id, label from (select patient_id,
         case when lower(Y1_Rem) = 'no' and lower(M6_Rem) = 'no' and lower(Y1_Rem_6) = 'no' then 0
              when lower(Y1_Rem) = 'yes' and lower(M6_Rem) = 'yes' and lower(Y1_Rem_6) = 'yes' then 1
              when lower(Y1_Rem) = 'yes' and lower(M6_Rem) = 'no' and lower(Y1_Rem_6) = 'no' then 2
              when lower(Y1_Rem) = 'yes' and lower(M6_Rem) = 'yes' and lower(Y1_Rem_6) = 'no' then 3
              when lower(Y1_Rem) = 'yes' and lower(M6_Rem) = 'no' and lower(Y1_Rem_6) = 'yes' then 4
              when lower(Y1_Rem) = 'no' and lower(M6_Rem) = 'yes' and lower(Y1_Rem_6) = 'no' then 5
              when lower(Y1_Rem) = 'no' and lower(M6_Rem) = 'yes' and lower(Y1_Rem_6) = 'yes' then 6
              when lower(Y1_Rem) = 'no' and lower(M6_Rem) = 'no' and lower(Y1_Rem_6) = 'yes' then 7 end as label
       from O) x where label is not null""", "O"))
def q_drop_unlabelled(spark, sf):
    d = lb.outcome_label_truth(tb.outcomes(spark, sf))
    return cl.drop_unlabelled(d).select("patient_id", F.col("label").cast("long").alias("label"))


@register("load_and_prepare", with_fixtures(
    """select count(*) as n_rows, count(*) filter (where M6_Rem is null or Y1_Rem is null or Y1_Rem_6 is null)
              as n_missing_outcome from O""", "O"))
def q_load_prepare(spark, sf):
    """Prepared cohort profile: rows and rows with any missing outcome (one aggregation)."""
    o = cl.drop_columns(tb.outcomes(spark, sf), ["Cohort"])
    miss = F.col("M6_Rem").isNull() | F.col("Y1_Rem").isNull() | F.col("Y1_Rem_6").isNull()
    return o.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(miss).alias("n_missing_outcome"))


@register("impute_median", T(
    "select row_id, " + ", ".join(f"coalesce({c}, (select median({c}) from T)) as {c}" for c in NUM) + " from T", NUM))
def q_impute_median(spark, sf):
    return cl.impute_median(_T(spark, sf).select("row_id", *NUM), NUM)


@register("impute_median_refined", T(
    "select row_id, " + ", ".join(f"coalesce({c}, (select median({c}) from T)) as {c}" for c in NUM) + " from T", NUM))
def q_impute_median_refined(spark, sf):
    """Exact medians through the bounded-memory refinement path (tiny distinct limit forces rounds)."""
    from tidemark.functions.stats import exact_median
    t = _T(spark, sf).select("row_id", *NUM)
    return cl.impute_median(t, NUM, exact_median(t, NUM, limit=64))


def _mode_sql(c):
    return (f"coalesce({c}, (select {c} from T where {c} is not null group by {c} "
            f"order by count(*) desc, {c} asc limit 1), 'Unknown') as {c}")


@register("impute_mode", T("select row_id, " + ", ".join(_mode_sql(c) for c in CAT) + " from T"))
def q_impute_mode(spark, sf):
    return cl.impute_mode(_T(spark, sf).select("row_id", *CAT), CAT)


@register("standardize_for_impute", T(
    "select row_id, " + ", ".join(
        f"({c} - (select avg({c}) from T)) / (select stddev_samp({c}) from T) as {c}" for c in NUM) + " from T", NUM))
def q_standardize(spark, sf):
    return cl.standardize_for_impute(_T(spark, sf).select("row_id", *NUM), NUM)


@register("preprocess_for_ml", T(
    "select " + ", ".join(f"coalesce({c}, (select median({c}) from T)) as {c}" for c in ["row_id"] + NUM)
    + ", cast(label as bigint) as label from T", NUM))
def q_preprocess(spark, sf):
    return cl.preprocess_for_ml(_T(spark, sf), "label")


_OH = {"status": ["O", "P", None], "priority": ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
       "segment": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}
_OH_ALL = {"status": ["F", "O", "P", None], "priority": ["1-URGENT"] + _OH["priority"],
           "segment": ["AUTOMOBILE"] + _OH["segment"]}


def _oh_sql(cats):
    parts = []
    for c, vals in cats.items():
        for v in vals:
            cond = f"{c} is null" if v is None else f"{c} = '{v}'"
            parts.append(f'case when {cond} then 1.0 else 0.0 end as "{c}_{"nan" if v is None else v}"')
    return parts


@register("one_hot", T("select row_id, " + ", ".join(_oh_sql(_OH)) + " from T",
                       [f"{c}_{'nan' if v is None else v}" for c, vs in _OH.items() for v in vs]))
def q_one_hot(spark, sf):
    return fe.one_hot(_T(spark, sf).select("row_id", *CAT), CAT, drop_first=True)


@register("preprocess_for_ml_dummies", T(
    "select " + ", ".join(f"coalesce({c}, (select median({c}) from T)) as {c}" for c in ["row_id"] + NUM) + ", "
    + ", ".join(_oh_sql({k: [v for v in vs if v is not None] for k, vs in _OH_ALL.items()}))
    + ", cast(label as bigint) as label from (select row_id, price, acctbal, qty, n_lines, disc, label, priority, segment, "
    + "coalesce(status, (select status from T where status is not null group by status order by count(*) desc, status limit 1)) as status from T) T",
    NUM + [f"{c}_{v}" for c, vs in _OH_ALL.items() for v in vs if v is not None]))
def q_preprocess_dummies(spark, sf):
    return cl.preprocess_for_ml(_T(spark, sf), "label", dummies=True)


@register("skewness_table", T(
    " union all ".join(f"select '{c}' as feature, skewness({c}) as skewness from T" for c in NUM), ["skewness"]))
def q_skew(spark, sf):
    return fe.skewness_table(_T(spark, sf), NUM)


@register("transform_skewed", T(
    "select row_id, " + ", ".join(
        f"case when abs((select skewness({c}) from T)) > 0.5 then cbrt({c}) else {c} end as {c}" for c in NUM)
    + " from T", NUM))
def q_transform_skewed(spark, sf):
    return fe.transform_skewed(_T(spark, sf).select("row_id", *NUM), 0.5, "cbrt", NUM)


GROUPS = {"total_money": ["price", "acctbal"], "total_volume": ["qty", "n_lines", "disc"]}


def _rsum(cols):
    return " + ".join(f"coalesce({c}, 0)" for c in cols)


def _rmean(cols):
    return f"({_rsum(cols)}) / nullif({' + '.join(f'(case when {c} is not null then 1 else 0 end)' for c in cols)}, 0)"


@register("subscale_totals", T(
    "select row_id, " + ", ".join(f"{_rsum(v)} as {k}" for k, v in GROUPS.items()) + " from T", list(GROUPS)))
def q_subscale(spark, sf):
    return fe.subscale_totals(_T(spark, sf).select("row_id", *NUM), GROUPS).select("row_id", *GROUPS)


@register("factor_means", T(
    "select row_id, " + ", ".join(f"{_rmean(v)} as {k}" for k, v in GROUPS.items()) + " from T", list(GROUPS)))
def q_factor_means(spark, sf):
    return fe.factor_means(_T(spark, sf).select("row_id", *NUM), {k: k for k in GROUPS},
                           columns_by_factor=GROUPS).select("row_id", *GROUPS)


@register("ratio_feature", T("select row_id, price / (qty + 0.001) as price_per_qty from T", ["price_per_qty"]))
def q_ratio(spark, sf):
    return fe.ratio_feature(_T(spark, sf).select("row_id", "price", "qty"), "price", "qty", "price_per_qty") \
             .select("row_id", "price_per_qty")


@register("interactions", T(
    """select row_id, qty * n_lines as Interaction_qty_n_lines,
              coalesce(status, 'nan') || '_' || coalesce(segment, 'nan') as Interaction_status_segment from T""",
    ["Interaction_qty_n_lines"]))
def q_interactions(spark, sf):
    t = _T(spark, sf)
    out = fe.interactions(t, [("qty", "n_lines"), ("status", "segment")])
    return out.select("row_id", "Interaction_qty_n_lines", "Interaction_status_segment")


def _q(c, p):
    return f"(select quantile_cont({c}, {p}) from T)"


@register("iqr_outliers", T(" union all ".join(
    f"""select '{c}' as feature, {_q(c, 0.25)} as q1, {_q(c, 0.75)} as q3,
          {_q(c, 0.25)} - 1.5 * ({_q(c, 0.75)} - {_q(c, 0.25)}) as lower,
          {_q(c, 0.75)} + 1.5 * ({_q(c, 0.75)} - {_q(c, 0.25)}) as upper,
          (select count(*) from T where {c} > {_q(c, 0.75)} + 1.5 * ({_q(c, 0.75)} - {_q(c, 0.25)})
                                     or {c} < {_q(c, 0.25)} - 1.5 * ({_q(c, 0.75)} - {_q(c, 0.25)})) as n_outliers,
          cast(case when (select count(*) from T where {c} > {_q(c, 0.75)} + 1.5 * ({_q(c, 0.75)} - {_q(c, 0.25)})
                                     or {c} < {_q(c, 0.25)} - 1.5 * ({_q(c, 0.75)} - {_q(c, 0.25)})) > 0 then 1 else 0 end as bigint) as has_outliers"""
    for c in NUM), ["q1", "q3", "lower", "upper"]))
def q_iqr(spark, sf):
    return fe.iqr_outliers(_T(spark, sf), NUM)


def _std_sql(c):
    return f"({c} - (select avg({c}) from T)) / coalesce(nullif((select stddev_pop({c}) from T), 0), 1.0)"


def _minmax_sql(c):
    return (f"({c} - (select min({c}) from T)) / coalesce(nullif((select max({c}) - min({c}) from T), 0), 1.0)")


def _robust_sql(c):
    return f"({c} - {_q(c, 0.5)}) / coalesce(nullif({_q(c, 0.75)} - {_q(c, 0.25)}, 0), 1.0)"


@register("scale_standard", T("select row_id, " + ", ".join(f"{_std_sql(c)} as {c}" for c in NUM) + " from T", NUM))
def q_scale_std(spark, sf):
    t = _T(spark, sf).select("row_id", *NUM)
    return fe.apply_scaler(t, fe.fit_scaler(t, NUM, "standard"))


@register("scale_minmax", T("select row_id, " + ", ".join(f"{_minmax_sql(c)} as {c}" for c in NUM) + " from T", NUM))
def q_scale_minmax(spark, sf):
    t = _T(spark, sf).select("row_id", *NUM)
    return fe.apply_scaler(t, fe.fit_scaler(t, NUM, "minmax"))


@register("scale_robust", T("select row_id, " + ", ".join(f"{_robust_sql(c)} as {c}" for c in NUM) + " from T", NUM))
def q_scale_robust(spark, sf):
    t = _T(spark, sf).select("row_id", *NUM)
    return fe.apply_scaler(t, fe.fit_scaler(t, NUM, "robust"))


def _has_out(c):
    return (f"(select count(*) from T where {c} > {_q(c, 0.75)} + 1.5 * ({_q(c, 0.75)} - {_q(c, 0.25)}) "
            f"or {c} < {_q(c, 0.25)} - 1.5 * ({_q(c, 0.75)} - {_q(c, 0.25)})) > 0")


@register("scale_features", T("select row_id, " + ", ".join(
    f"case when {_has_out(c)} then {_robust_sql(c)} else {_std_sql(c)} end as {c}" for c in NUM) + " from T", NUM))
def q_scale_features(spark, sf):
    t = _T(spark, sf).select("row_id", *NUM)
    return fe.scale_features(t, "standard", True, NUM)


def _hot_sql(drop: int, src: str) -> str:
    """Places of the ones: the value's number in its column (null last), after the columns before."""
    dicts = [(f"K{i}", f"select {c} as v, row_number() over (order by {c} nulls last) - 1 as i, count(*) over () as k "
                       f"from (select distinct {c} from {src}) z") for i, c in enumerate(CAT)]
    ctes = ", ".join(f"{n} as ({sql})" for n, sql in dicts)
    base = ["0"]
    for i in range(len(CAT) - 1):
        base.append(base[-1] + f" + (select max(k) - {drop} from K{i})")
    places = ", ".join(f"case when K{i}.i >= {drop} then {base[i]} + K{i}.i - {drop} end" for i in range(len(CAT)))
    joins = " ".join(f"join K{i} on K{i}.v is not distinct from x.{c}" for i, c in enumerate(CAT))
    size = " + ".join(f"(select max(k) - {drop} from K{i})" for i in range(len(CAT)))
    return (f"with {ctes} select x.row_id, array_to_string(list_filter([{places}], lambda p: p is not null), ',') as ones, "
            f"({size})::bigint as width from {src} x {joins}")


def _ones(df):
    from pyspark.ml.functions import vector_to_array
    dense = vector_to_array(F.col("categories"))
    at = F.filter(F.transform(dense, lambda v, i: F.when(v == 1, i)), lambda i: i.isNotNull())
    return df.select("row_id", F.array_join(at.cast("array<string>"), ",").alias("ones"), F.size(dense).cast("long").alias("width"))


@register("one_hot_sparse", with_fixtures("select * from H", "T", extra=[("H", _hot_sql(1, "T"))]))
def q_one_hot_sparse(spark, sf):
    """Categories as one sparse vector over a distributed dictionary, first of each column left out."""
    return _ones(ca.one_hot_sparse(_T(spark, sf).select("row_id", *CAT), CAT))


@register("preprocess_for_ml_sparse", with_fixtures(
    "select h.row_id, h.ones, h.width from H h", "T", extra=[
        ("MF", "select row_id, " + ", ".join(f"coalesce({c}, (select {c} from T where {c} is not null group by {c} "
                                             f"order by count(*) desc, {c} limit 1)) as {c}" for c in CAT) + " from T"),
        ("H", _hot_sql(0, "MF"))]))
def q_preprocess_sparse(spark, sf):
    """Medians, modes and full one-hot vectors without a list of categories on the driver."""
    return _ones(cl.preprocess_for_ml(_T(spark, sf), "label", dummies="sparse").withColumn("row_id", F.col("row_id").cast("long")))


CODED = {"price": "M0_PANSS_P1", "acctbal": "M0_PANSS_P2", "qty": "M0_PANSS_N1", "n_lines": "M0_PANSS_N2", "disc": "M0_PANSS_G1"}
ITEMS = list(CODED.values())
DERIVED = {
    "PANSS_P_Total": "coalesce(M0_PANSS_P1, 0) + coalesce(M0_PANSS_P2, 0)",
    "PANSS_N_Total": "coalesce(M0_PANSS_N1, 0) + coalesce(M0_PANSS_N2, 0)",
    "PANSS_G_Total": "coalesce(M0_PANSS_G1, 0)",
    "PANSS_Factor_Positive": "M0_PANSS_P1",
    "PANSS_Factor_Negative": "(coalesce(M0_PANSS_N1, 0) + coalesce(M0_PANSS_N2, 0)) / nullif((M0_PANSS_N1 is not null)::int "
                             "+ (M0_PANSS_N2 is not null)::int, 0)",
    "PANSS_Factor_Disorganized": "M0_PANSS_P2",
    "PANSS_Factor_Anxiety_Depression": "M0_PANSS_G1",
    "PANSS_P_N_Ratio": "(coalesce(M0_PANSS_P1, 0) + coalesce(M0_PANSS_P2, 0)) / (coalesce(M0_PANSS_N1, 0) "
                       "+ coalesce(M0_PANSS_N2, 0) + 0.001)",
}


def _engineer_sql() -> str:
    """Every stage as a table of its own, each with a one-row table of what it fits."""
    keys = "row_id, label"
    num = [*ITEMS, *DERIVED]
    cross = [(f"Interaction_{a}_{b}", a, b) for a in ITEMS[:2] for b in ITEMS[2:4]]
    dummies = ["status_O", "status_P", "status_nan"]
    scaled = [*num, *[c for c, _, _ in cross], *dummies]
    one = lambda cols, f: "select " + ", ".join(f(c) for c in cols)
    extra = [
        ("C", f"select {keys}, status, " + ", ".join(f"{c}::double as {n}" for c, n in CODED.items()) + " from T"),
        ("KC", one(ITEMS, lambda c: f"skewness({c}) > 0.5 as {c}") + " from C"),
        ("I", f"select {keys}, status, " + ", ".join(f"case when KC.{c} then cbrt(C.{c}) else C.{c} end as {c}" for c in ITEMS)
         + " from C, KC"),
        ("D", f"select {keys}, status, {', '.join(ITEMS)}, " + ", ".join(f"{e} as {n}" for n, e in DERIVED.items()) + " from I"),
        ("KD", one(num, lambda c: f"abs(skewness({c})) > 0.5 as {c}") + " from D"),
        ("S", f"select {keys}, status, " + ", ".join(f"case when KD.{c} then cbrt(D.{c}) else D.{c} end as {c}" for c in num)
         + " from D, KD"),
        ("X", "select *, " + ", ".join(f"{a} * {b} as {n}" for n, a, b in cross)
         + ", coalesce(status = 'O', false)::int::double as status_O, coalesce(status = 'P', false)::int::double as status_P, "
         "(status is null)::int::double as status_nan from S"),
        ("QX", one(scaled, lambda c: f"quantile_cont({c}, 0.25) as q1_{c}, median({c}) as q2_{c}, quantile_cont({c}, 0.75) as q3_{c}, "
                                     f"avg({c}) as a_{c}, stddev_pop({c}) as s_{c}") + " from X"),
        ("OX", one(scaled, lambda c: f"count(*) filter (where {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}) "
                                     f"or {c} < q1_{c} - 1.5 * (q3_{c} - q1_{c})) > 0 as o_{c}") + " from X, QX"),
    ]
    body = f"select {keys}, " + ", ".join(
        f"case when o_{c} then ({c} - q2_{c}) / coalesce(nullif(q3_{c} - q1_{c}, 0), 1) else ({c} - a_{c}) / coalesce(nullif(s_{c}, 0), 1) "
        f"end as {c}" for c in scaled) + " from X, QX, OX"
    return rounded(with_fixtures(body, "T", extra=[(n, s) for n, s in extra]), scaled)


@register("engineer_features", _engineer_sql())
def q_engineer(spark, sf):
    """The whole chain over coded items, row key and label kept: fitted, saved, read again, then applied."""
    t = _T(spark, sf).select("row_id", "label", "status", *[F.col(c).cast("double").alias(n) for c, n in CODED.items()])
    t = stored(t, "table")
    path = scratch_path(spark, "engineer-")
    fe.FeatureEngineer(passThrough=["row_id", "label"]).fit(t).write().save(path)
    return fe.FeatureEngineerModel.load(path).transform(t)


def _knn_sql(k=5):
    p = len(NUM)
    z = "select row_id, " + ", ".join(
        f"({c} - (select avg({c}) from T)) / (select stddev_samp({c}) from T) as {c}" for c in NUM) + " from T"
    r = "select * from Z where " + " or ".join(f"{c} is null" for c in NUM)
    common = " + ".join(f"(r.{c} is not null and d.{c} is not null)::int" for c in NUM)
    ss = " + ".join(f"coalesce((r.{c} - d.{c}) * (r.{c} - d.{c}), 0)" for c in NUM)
    pairs = (f"select r.row_id as rid, d.row_id as did, {common} as nc, {ss} as ss, "
             + ", ".join(f"r.{c} is null as m_{c}, d.{c} as d_{c}" for c in NUM)
             + " from R r join Z d on r.row_id <> d.row_id")
    dist = f"select *, sqrt({float(p)} / nc * ss) as dist from PAIRS where nc > 0"
    fills = []
    for c in NUM:
        fills.append((f"F_{c}", f"""select rid, avg(d_{c}) as f from (
            select rid, d_{c}, row_number() over (partition by rid order by round(dist, 9), did) as rn
            from DIST where m_{c} and d_{c} is not null) x where rn <= {k} group by rid"""))
    body = ("select Z.row_id, " + ", ".join(
        f"coalesce(Z.{c}, F_{c}.f, (select avg({c}) from Z)) as {c}" for c in NUM)
        + " from Z " + " ".join(f"left join F_{c} on F_{c}.rid = Z.row_id" for c in NUM))
    return rounded(with_fixtures(body, "T", extra=[("Z", z), ("R", r), ("PAIRS", pairs), ("DIST", dist)] + fills), NUM)


@register("impute_knn", _knn_sql())
def q_impute_knn(spark, sf):
    """Exact 5-NN imputation on z-scored numerics (band-joined pivots, verified bounds);
    the oracle is the brute-force all-pairs definition."""
    return cl.impute_knn(_T(spark, sf).select("row_id", *NUM), "row_id", NUM, k=5)
