"""Registered feature-statistics / selection queries (fixture T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean as cl
from tidemark.operators import rank_correlation as rc
from tidemark.operators import selection as sl
from tidemark.functions.exprs import sig_round, sig_sql
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rounded, with_fixtures
from tidemark.session import stored
from tidemark.sources import tables as tb

NUM = ["price", "acctbal", "qty", "n_lines", "disc"]


def _T(spark, sf):
    return tb.tabular(spark, sf)


def _T_stored(spark, sf):
    """T's numbers, joined once for queries that pass over them many times."""
    return stored(_T(spark, sf).select("row_id", *NUM, "label"), "table")


def _Tsql(body, dbl=(), extra=()):
    return rounded(with_fixtures(body, "T", extra=list(extra)), dbl)


def _anova_sql():
    parts = []
    for f in NUM:
        parts.append(f"""select '{f}' as feature, label as y, count({f}) as n, avg({f}) as m, var_pop({f}) as v
                         from T group by label""")
    u = " union all ".join(parts)
    return f"""select feature, (ssb / (K - 1)) / (ssw / (N - K)) as f_score from (
        select feature, sum(n * (m - MM) * (m - MM)) as ssb, sum(n * v) as ssw, max(NN) as N, max(KK) as K from (
          select *, sum(n) over (partition by feature) as NN,
                 sum(n * m) over (partition by feature) / sum(n) over (partition by feature) as MM,
                 count(*) over (partition by feature) as KK from ({u}) u where n > 0) w group by feature) a"""


@register("select_anova_f", _Tsql(
    """select feature, f_score, cast(row_number() over (order by f_score desc nulls last, feature) as bigint) as rank,
              cast(case when row_number() over (order by f_score desc nulls last, feature) <= 3 then 1 else 0 end as bigint)
              as selected from A""", ["f_score"], [("A", _anova_sql())]))
def q_anova(spark, sf):
    return sl.select_top(sl.anova_f(_T(spark, sf), NUM, "label"), "f_score", k=3)


@register("select_variance", _Tsql(
    " union all ".join(f"select '{f}' as feature, {sig_sql(f'var_pop({f})')} as variance_sci, "
                       f"cast(case when var_pop({f}) >= 0.01 then 1 else 0 end as bigint) as selected from T" for f in NUM),
    []))
def q_variance(spark, sf):
    """Population variance per feature (10 significant digits: values reach 1e10)."""
    v = sl.variance_table(_T(spark, sf), NUM)
    v = v.withColumn("selected", F.when(F.col("variance") >= 0.01, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return v.withColumn("variance_sci", sig_round(F.col("variance"))).drop("variance")


def _corr_sql(upper=False):
    parts = []
    for i, a in enumerate(NUM):
        for j, b in enumerate(NUM):
            if upper and j <= i:
                continue
            cond = f"{a} is not null and {b} is not null"
            parts.append(f"""select '{a}' as feature_a, '{b}' as feature_b,
                case when stddev_pop({a}) filter (where {cond}) > 0 and stddev_pop({b}) filter (where {cond}) > 0
                     then covar_pop({a}, {b}) filter (where {cond}) /
                          (stddev_pop({a}) filter (where {cond}) * stddev_pop({b}) filter (where {cond})) end as r from T""")
    return " union all ".join(parts)


@register("correlation_matrix", _Tsql(_corr_sql(), ["r"]))
def q_corr(spark, sf):
    return sl.correlation_matrix(_T(spark, sf), NUM)


def _spearman_sql():
    parts = []
    for i, a in enumerate(NUM):
        for b in NUM[i + 1:]:
            r = f"""(select case when stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then corr(rx, ry) end from (
                select rank() over (order by {a}) + count(*) over (partition by {a}) / 2.0 as rx,
                       rank() over (order by {b}) + count(*) over (partition by {b}) / 2.0 as ry
                from T where {a} is not null and {b} is not null))"""
            parts.append(f"select '{a}' as feature_a, '{b}' as feature_b, {r} as r")
    return " union all ".join(parts)


def _kendall_sql():
    """Counts of smaller and larger pairs by a self join of whole rows; the sums are exact."""
    cols, outs = [], []
    for i, a in enumerate(NUM):
        for j in range(i + 1, len(NUM)):
            x, y = f"sign(u.{a} - v.{a})", f"sign(u.{NUM[j]} - v.{NUM[j]})"
            cols += [f"sum({x} * {y}) as s{i}_{j}", f"sum(abs({x})) filter (where {y} is not null) as x{i}_{j}",
                     f"sum(abs({y})) filter (where {x} is not null) as y{i}_{j}"]
            outs.append(f"select '{a}' as feature_a, '{NUM[j]}' as feature_b, "
                        f"s{i}_{j} / nullif(sqrt(x{i}_{j}::double) * sqrt(y{i}_{j}::double), 0) as r from S")
    return f"select {', '.join(cols)} from T u join T v on u.row_id < v.row_id", " union all ".join(outs)


def _mirrored(half):
    diagonal = " union all ".join(f"select '{f}', '{f}', case when min({f}) < max({f}) then 1.0 end from T" for f in NUM)
    return f"""select feature_a, feature_b, r from {half}
               union all select feature_b, feature_a, r from {half} union all {diagonal}"""


@register("correlation_spearman", _Tsql(_mirrored("H"), ["r"], [("H", _spearman_sql())]))
def q_spearman(spark, sf):
    return rc.rank_correlation_matrix(_T(spark, sf), NUM, "spearman")


@register("correlation_kendall", _Tsql(_mirrored("H"), ["r"], [("S", _kendall_sql()[0]), ("H", _kendall_sql()[1])]))
def q_kendall(spark, sf):
    return rc.rank_correlation_matrix(_T(spark, sf), NUM, "kendall")


_POS = {f: i for i, f in enumerate(NUM)}
_POS_CASE = "case {c} " + " ".join(f"when '{f}' then {i}" for f, i in _POS.items()) + " end"


@register("high_correlation_pairs", _Tsql(
    f"""select feature_a, feature_b, r, t as threshold from (
          select *, case when (select count(*) from LOW where abs(r) >= 0.2) > 0 then 0.2
                         else 0.8 * (select max(abs(r)) from LOW) end as t from LOW) x where abs(r) >= t""",
    ["r", "threshold"], [("C", _corr_sql()),
                         ("LOW", f"select * from C where {_POS_CASE.format(c='feature_a')} > {_POS_CASE.format(c='feature_b')}")]))
def q_high_corr(spark, sf):
    c = sl.correlation_matrix(_T(spark, sf), NUM)
    return sl.high_correlation_pairs(c, NUM, 0.2)


@register("select_correlation")
def q_select_corr(spark, sf):
    """Features kept by the sequential |r| > t rule (no target) - rows check."""
    c = sl.correlation_matrix(_T(spark, sf), NUM, upper_only=True)
    kept = sl.select_correlation(c, NUM, threshold=0.3)
    return spark.createDataFrame([(f, int(f in kept)) for f in NUM], "feature string, kept bigint")


def _gram_sql():
    cond = " and ".join(f"{f} is not null" for f in NUM)
    parts = []
    for i, a in enumerate(NUM):
        for b in NUM[i:]:
            parts.append(f"select '{a}' as feature_a, '{b}' as feature_b, {sig_sql(f'sum({a} * {b})')} as g_sci "
                         f"from T where {cond}")
    return " union all ".join(parts)


@register("gram_matrix", _Tsql(_gram_sql(), []))
def q_gram(spark, sf):
    """Sufficient statistic behind VIF and feature distances (upper triangle)."""
    out = sl.gram_table(_T(spark, sf), NUM)
    return out.withColumn("g_sci", sig_round(F.col("g"))).drop("g")    # sums reach 1e13: 10 significant digits


@register("select_vif")
def q_vif(spark, sf):
    """Iterative VIF elimination from one Gram pass - rows check (final table)."""
    kept, initial, final = sl.select_vif(_T(spark, sf), NUM, 10.0)
    return spark.createDataFrame([(f, float(v)) for f, v in final], "feature string, vif double")


@register("feature_distance_matrix", _Tsql(" union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, sqrt(sum(({a} - {b}) * ({a} - {b}))) as distance from T"
    for i, a in enumerate(NUM) for b in NUM[i + 1:]), ["distance"]))
def q_distance(spark, sf):
    return sl.feature_distance_matrix(_T(spark, sf), NUM)


def _mi_sql(n_bins=10):
    parts = []
    for f in NUM:
        edges = ", ".join(f"quantile_cont({f}, {i / n_bins})" for i in range(1, n_bins))
        parts.append(f"""select '{f}' as feature, b.bin, label as y, count(*) as n from (
            select label, len(list_filter(e.edges, lambda x: x < {f})) as bin from T, (select [{edges}] as edges from T) e
            where {f} is not null) b group by 1, 2, 3""")
    u = " union all ".join(parts)
    return f"""select feature, sum((cast(n as double) / NN) * ln((cast(n as double) * NN) / (cast(nb as double) * ny))) as mutual_info from (
        select *, sum(n) over (partition by feature) as NN, sum(n) over (partition by feature, bin) as nb,
               sum(n) over (partition by feature, y) as ny from ({u}) u) w group by feature"""


@register("select_mutual_info", _Tsql(_mi_sql(), ["mutual_info"]))
def q_mi(spark, sf):
    return sl.mutual_info_binned(_T(spark, sf), NUM, "label", 10)


@register("feature_groups", with_fixtures(
    """select feature, case when regexp_matches(feature, '[_.]') then split_part(regexp_replace(feature, '[.]', '_', 'g'), '_', 1)
              else 'Other' end as "group" from (select unnest(['row_id', 'price', 'acctbal', 'qty', 'n_lines', 'disc',
              'status', 'priority', 'segment', 'label']) as feature from (select 1 from T limit 1) t) x""", "T"))
def q_groups(spark, sf):
    names = spark.createDataFrame([(c,) for c in _T(spark, sf).columns], "feature string")
    return sl.feature_groups(names)


@register("group_importance", _Tsql(
    """select grp as "group", avg(f_score) as mean_importance, count(*) as n_features from (
         select feature, f_score, case when regexp_matches(feature, '[_.]') then split_part(feature, '_', 1)
                                       else 'Other' end as grp from A) x group by grp""",
    ["mean_importance"], [("A", _anova_sql())]))
def q_group_importance(spark, sf):
    a = sl.anova_f(_T(spark, sf), NUM, "label")
    return sl.group_importance(sl.feature_groups(a), "f_score")


_GROUP = """case when regexp_matches(feature, '[_.]') then split_part(feature, '_', 1) else 'Other' end"""


@register("group_importance_mutual_info", _Tsql(
    f"""select {_GROUP} as "group", avg(mutual_info) as mean_importance, count(*) as n_features from A group by 1""",
    ["mean_importance"], [("A", _mi_sql())]))
def q_group_mi(spark, sf):
    return sl.group_importance(sl.feature_groups(sl.mutual_info_binned(_T(spark, sf), NUM, "label", 10)), "mutual_info")


_VAR_SQL = " union all ".join(
    f"select '{f}' as feature, case when var_pop({f}) > 0 then var_samp({f}) / var_pop({f}) else 0.0 end as variance from T" for f in NUM)


@register("group_importance_variance", _Tsql(
    f"""select {_GROUP} as "group", avg(variance) as mean_importance, count(*) as n_features from A group by 1""",
    ["mean_importance"], [("A", _VAR_SQL)]))
def q_group_variance(spark, sf):
    return sl.group_importance(sl.feature_groups(sl.standardized_variance(_T(spark, sf), NUM)), "variance")


@register("top_features", _Tsql("select feature, f_score from A order by f_score desc, feature limit 2",
                                ["f_score"], [("A", _anova_sql())]))
def q_top(spark, sf):
    return sl.top_features(sl.anova_f(_T(spark, sf), NUM, "label"), "f_score", 2)


@register("pca_loadings")
def q_pca(spark, sf):
    t = cl.impute_median(_T_stored(spark, sf), NUM)
    fit = sl.pca_fit(t, NUM, k=2)
    return sl.pca_loadings(spark, fit)


@register("select_rfe")
def q_rfe(spark, sf):
    t = cl.impute_median(_T_stored(spark, sf), NUM).select(*NUM, F.col("label").cast("double").alias("label"))
    return sl.rfe(t, NUM, "label", n_select=3, num_trees=10)


@register("permutation_importance")
def q_perm(spark, sf):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    t = cl.impute_median(_T_stored(spark, sf), NUM).select("row_id", *NUM, F.col("label").cast("double").alias("label"))
    m = DecisionTreeClassifier(maxDepth=4, labelCol="label", seed=42).fit(
        VectorAssembler(inputCols=NUM, outputCol="features").transform(t))
    return sl.permutation_importance(m, t, NUM, "label", "row_id")


@register("row_clusters")
def q_clusters(spark, sf):
    t = cl.impute_median(_T_stored(spark, sf), NUM)
    return sl.row_clusters(t.select("row_id", *NUM), NUM, k=4).select("row_id", "cluster")
