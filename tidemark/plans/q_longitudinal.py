"""Registered longitudinal queries over fixture L (events rolled up per user and day)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import longitudinal as lg
from tidemark.plans import oracle_longitudinal as ol
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rounded, with_fixtures
from tidemark.sources import tables as tb

SYM = tb.SYMPTOMS_L
SIGNS = tb.WARNING_SIGNS_L


def _L(spark, sf):
    """L has one row per (id, day), so every id's series is bounded by the number of days
    and the queries below pass ``hot_rows=None`` (no per-id count job).  The raw-event skew
    is absorbed by L's map-side partial aggregation; the ``*_hot_split`` queries force the
    chunked path to check it against the same oracle."""
    return tb.longitudinal(spark, sf)


@register("early_warning_features", ol.early_warning_sql(SYM, SIGNS, 1.5))
def q_early_warning(spark, sf):
    """Flagship: warnings + warning-sign patterns (tau=1.5) + relapse_risk_score."""
    return lg.early_warning_features(_L(spark, sf), "patient_id", "t", SYM, SIGNS, 1.5, hot_rows=None)


@register("symptom_trends", ol.trends_sql(SYM))
def q_trends(spark, sf):
    return lg.symptom_trends(_L(spark, sf), "patient_id", "t", SYM, hot_rows=None)


@register("symptom_trends_hot_split", ol.trends_sql(SYM))
def q_trends_hot(spark, sf):
    """Same result as symptom_trends with the hot-id chunked path forced on (ids > 8 rows)."""
    return lg.symptom_trends(_L(spark, sf), "patient_id", "t", SYM, hot_rows=8)


@register("symptom_stability", ol.stability_sql(SYM))
def q_stability(spark, sf):
    return lg.symptom_stability(_L(spark, sf), "patient_id", "t", SYM, min_observations=3, hot_rows=None)


@register("temporal_patterns", ol.patterns_sql(SYM))
def q_patterns(spark, sf):
    return lg.temporal_patterns(_L(spark, sf), "patient_id", "t", SYM, hot_rows=None)


@register("temporal_patterns_hot_split", ol.patterns_sql(SYM))
def q_patterns_hot(spark, sf):
    return lg.temporal_patterns(_L(spark, sf), "patient_id", "t", SYM, hot_rows=6)


@register("early_warning_signs", ol.warnings_sql(SYM, SIGNS))
def q_warnings(spark, sf):
    return lg.early_warning_signs(_L(spark, sf), "patient_id", "t", SYM, SIGNS, hot_rows=None)


_SNAP_COLS = ", ".join(f"arg_max({s}, t) filter (where {s} is not null) as {s}" for s in SYM)


@register("latest_snapshot",
          rounded(with_fixtures(f"select patient_id, {_SNAP_COLS} from L group by patient_id", "L"), SYM))
def q_latest(spark, sf):
    return lg.latest_snapshot(_L(spark, sf), "patient_id", "t", SYM)


@register("filter_time_window", rounded(with_fixtures(
    """select * from L where t between 5 and 20 and patient_id in
       (select patient_id from L where t between 5 and 20 group by patient_id having count(*) >= 12)""", "L"), SYM))
def q_filter_window(spark, sf):
    return lg.filter_time_window(_L(spark, sf), "patient_id", "t", (5, 20), min_observations=12)


_CENTERED = rounded(with_fixtures(
    """select patient_id, t, s_click,
         case when count(*) over w = 3 and count(s_click) over w = 3 then avg(s_click) over w end as rolling_mean
       from L window w as (partition by patient_id order by t rows between 1 preceding and 1 following)""", "L"),
    ["s_click", "rolling_mean"])
_TRAILING = rounded(with_fixtures(
    """select patient_id, t, s_view, rolling_mean from (
         select patient_id, t, s_view, count(*) over (partition by patient_id) as n,
                row_number() over (partition by patient_id order by t) as rn,
                case when count(*) over (partition by patient_id) < 5 then s_view
                     else avg(s_view) over (partition by patient_id order by t rows between 4 preceding and current row)
                end as rolling_mean
         from L) x where n < 5 or rn >= 5""", "L"), ["s_view", "rolling_mean"])


def _rolled(spark, sf, fn, col, window, hot_rows):
    return fn(_L(spark, sf).select("patient_id", "t", col), "patient_id", "t", col, window, hot_rows=hot_rows)


@register("rolling_mean_centered", _CENTERED)
def q_rolling_centered(spark, sf):
    return _rolled(spark, sf, lg.rolling_mean_centered, "s_click", 3, None)


@register("rolling_mean_centered_hot_split", _CENTERED)
def q_rolling_centered_split(spark, sf):
    """Series of more than 12 rows in blocks of 12 with halos: equal to the plain window."""
    return _rolled(spark, sf, lg.rolling_mean_centered, "s_click", 3, 12)


@register("rolling_mean_trailing", _TRAILING)
def q_rolling_trailing(spark, sf):
    return _rolled(spark, sf, lg.rolling_mean_trailing, "s_view", 5, None)


@register("rolling_mean_trailing_hot_split", _TRAILING)
def q_rolling_trailing_split(spark, sf):
    return _rolled(spark, sf, lg.rolling_mean_trailing, "s_view", 5, 12)


@register("longitudinal_summary", rounded(with_fixtures(
    """select patient_id, avg(s_purchase) as mean, min(s_purchase) as min, max(s_purchase) as max,
              stddev_samp(s_purchase) as std, count(s_purchase) as count from L group by patient_id""", "L"),
    ["mean", "min", "max", "std"]))
def q_long_summary(spark, sf):
    return lg.longitudinal_summary(_L(spark, sf), "patient_id", "s_purchase")


@register("timeline_with_events", rounded(with_fixtures(
    """select L.patient_id, L.t, L.s_error, e.event, e.n_events,
              cast(case when L.s_error > 30 then 1 else 0 end as bigint) as above_threshold
       from (select patient_id, t, s_error from L) L left join
            (select user_id as patient_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as t,
                    min(event_type) as event, count(*) as n_events
             from events where event_type in ('signup', 'purchase') group by 1, 2) e
       on L.patient_id = e.patient_id and L.t = e.t""", "L"), ["s_error"]))
def q_timeline(spark, sf):
    ev = (tb.read_table(spark, sf, "events").where(F.col("event_type").isin("signup", "purchase"))
          .select(F.col("user_id").alias("patient_id"),
                  F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("t"),
                  F.col("event_type").alias("label")))
    series = _L(spark, sf).select("patient_id", "t", "s_error")
    return lg.timeline_with_events(series, ev, "patient_id", "t", "s_error", 30.0)


@register("trend_feature_table")
def q_trend_table(spark, sf):
    """Trends, warnings, stability and patterns in one pass (rows check; parts are SQL-checked)."""
    return lg.trend_feature_table(_L(spark, sf), "patient_id", "t", SYM, SIGNS, hot_rows=None)
