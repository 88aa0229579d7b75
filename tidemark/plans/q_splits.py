"""Registered split / resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as mt
from tidemark.operators import splits as sp
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rounded, with_fixtures
from tidemark.plans.q_labels import POL, _risk_case
from tidemark.sources import tables as tb

MD5 = "md5(cast(row_id as varchar) || '-42')"


@register("train_test_split", with_fixtures(
    f"""select row_id, label, case when rk < ceil(n * 0.3) then 'test' else 'train' end as split from (
          select row_id, label, row_number() over (partition by label order by {MD5}) - 1 as rk,
                 count(*) over (partition by label) as n from T) x""", "T"))
def q_tts(spark, sf):
    t = tb.tabular(spark, sf).select("row_id", "label")
    return sp.train_test_split(t, "row_id", "label", 0.3)


@register("train_test_split_unstratified", with_fixtures(
    f"""select row_id, label, case when rk < ceil(n * 0.3) then 'test' else 'train' end as split from (
          select row_id, label, row_number() over (order by {MD5}) - 1 as rk, count(*) over () as n from T) x""", "T"))
def q_tts_plain(spark, sf):
    t = tb.tabular(spark, sf).select("row_id", "label")
    return sp.train_test_split(t, "row_id", None, 0.3)


@register("stratified_rank_small_buckets", with_fixtures(
    f"""select row_id, label, cast(row_number() over (partition by label order by {MD5}) - 1 as bigint) as _rank,
              count(*) over (partition by label) as _n from T""", "T"))
def q_rank_small(spark, sf):
    """Exact two-phase rank with ~50-row hash buckets (forces the multi-bucket path)."""
    t = tb.tabular(spark, sf).select("row_id", "label")
    return sp.stratified_rank(t, ["label"], "row_id", rows_per_bucket=50)


@register("risk_stratified_split", with_fixtures(
    f"""select row_id, label, risk_level, case when rk < ceil(n * 0.3) then 'test' else 'train' end as split from (
          select row_id, label, risk_level, row_number() over (partition by risk_level order by {MD5}) - 1 as rk,
                 count(*) over (partition by risk_level) as n from
            (select row_id, label, {_risk_case('label')} as risk_level from T) a) x""", "T"))
def q_risk_split(spark, sf):
    t = tb.tabular(spark, sf).select("row_id", "label")
    return sp.risk_stratified_split(t, "row_id", POL, "label", 0.3)


@register("risk_stratified_kfold", with_fixtures(
    f"""select row_id, label, risk_level, cast((row_number() over (partition by risk_level order by {MD5}) - 1) % 5 as bigint)
              as fold from (select row_id, label, {_risk_case('label')} as risk_level from T) a""", "T"))
def q_kfold(spark, sf):
    t = tb.tabular(spark, sf).select("row_id", "label")
    return sp.risk_stratified_kfold(t, "row_id", POL, "label", 5)


@register("temporal_split", with_fixtures(
    """select cast(s.split_id as bigint) as split_id, case when p.pi = s.split_id then 'test' else 'train' end as role,
              p.patient_id, p.t
       from (select patient_id, t, dense_rank() over (order by t) - 1 as pi from (select patient_id, t from L) l) p
       join (select unnest(range(20, (select count(distinct t) from L), 5)) as split_id) s
         on p.pi = s.split_id or (p.pi < s.split_id and p.pi >= s.split_id - 7)""", "L"))
def q_temporal(spark, sf):
    """Expanding window over days: test day i (every 5th from day 20), train on the 7 days before."""
    lon = tb.longitudinal(spark, sf).select("patient_id", "t")
    return sp.temporal_split(lon, "t", min_train_periods=20, step=5, max_train_periods=7)


def draw_sql(replicate: str, row: str = "row_id", seed: int = 42) -> str:
    """Poisson(1) multiplicity from the first 12 hexadecimal digits of an md5."""
    u = f"(('0x' || substr(md5({row}::varchar || '-{seed}-' || {replicate}::varchar), 1, 12))::bigint::double / {float(16 ** 12)!r}::double)"
    return " + ".join(f"({u} > {c!r}::double)::bigint" for c in sp.poisson_steps())


@register("bootstrap_weights", with_fixtures(
    "select replicate, sum(w)::bigint as n_drawn, count(*) as n_distinct from (select r as replicate, "
    + draw_sql("r") + " as w from B, range(20) x(r)) z where w > 0 group by replicate", "B"))
def q_boot_weights(spark, sf):
    """Poisson(1) bootstrap multiplicities (20 replicates) of B; total weight ~ n x B."""
    w = sp.poisson_weights(tb.scored_binary(spark, sf), "row_id", 20)
    return w.groupBy("replicate").agg(F.sum("weight").alias("n_drawn"), F.count(F.lit(1)).alias("n_distinct"))


@register("bootstrap_sample", rounded(with_fixtures(
    "select row_id, y_true, score, unnest(range(1, w + 1)) as copy from (select *, " + draw_sql("0") + " as w from B) z", "B"), ["score"]))
def q_bootstrap_sample(spark, sf):
    """One seeded with-replacement resample of B, for refits."""
    return sp.bootstrap_sample(tb.scored_binary(spark, sf), "row_id")


@register("class_distribution_by_split", with_fixtures(
    f"""select split, label as cls, count(*) as count, count(*) / sum(count(*)) over (partition by split) as share from (
          select row_id, label, case when rk < ceil(n * 0.3) then 'test' else 'train' end as split from (
            select row_id, label, row_number() over (partition by label order by {MD5}) - 1 as rk,
                   count(*) over (partition by label) as n from T) x) y group by 1, 2""".replace(
        "as share from (", "as share from (").replace("count(*) / sum", "round(round(count(*) / sum").replace(
        "over (partition by split) as share", "over (partition by split), 9), 6) + 0.0 as share"), "T"))
def q_dist_split(spark, sf):
    t = sp.train_test_split(tb.tabular(spark, sf).select("row_id", "label"), "row_id", "label", 0.3)
    return mt.class_distribution(t, "label", ["split"])


@register("thirty_row_window", with_fixtures(
    """select row_id, y_true, score, position from (
         select *, cast(row_number() over (order by score, row_id) - 1 as bigint) as position, count(*) over () as n from B) x
       where n <= 30 or position < 10 or (position >= (n - 10) // 2 and position < (n - 10) // 2 + 10)
          or position >= n - 10""".replace("select row_id, y_true, score, position", "select row_id, y_true, round(round(score, 9), 6) + 0.0 as score, position"), "B"))
def q_thirty(spark, sf):
    return sp.thirty_row_window(tb.scored_binary(spark, sf), "score", "row_id", 10)
