"""Per-entity longitudinal features (trends, stability, patterns, early warning).

Design
------
All per-(entity, symptom) statistics are computed from ONE ordered pass and ONE
aggregation:

1. ``build_series`` adds, for every symptom column, the previous non-null value, the
   consecutive difference, the observation index, the length of the current run of
   positive differences and the sign of the previous non-zero difference.  These are
   window functions over ``partitionBy(id).orderBy(time, tie)``; p symptom columns share
   the same window (one exchange, one sort), nulls are skipped per symptom
   (``last(ignorenulls)``), so no wide->long explosion is needed.
2. ``series_stats`` runs one ``groupBy(id)`` with partial-aggregable built-ins
   (``regr_slope``, ``stddev_pop``, ``covar_pop``, ``max_by``, ``count_if``) on the same
   hash partitioning the window produced - no second shuffle.
3. The feature tables are projections of those sufficient statistics.

Hot entities: by default (``hot_rows=HOT_ROWS``; ``None`` disables the check) ids with
more than ``hot_rows`` rows have their series cut into time-ordered chunks of about
``hot_rows`` rows (approximate per-id quantiles of time); a per-id count finds them.  Windows then run per (id, chunk), and the state that
crosses chunk borders (last value, observation offset, last run reset, last non-zero
sign, id-level min/max/count) is carried by a small per-chunk summary table whose size
is bounded by ``n_hot_ids * chunks`` and checked before it is broadcast.  No group is
ever collected into one task.

Null policy: the series of a symptom is its non-null observations (``nulls='skip'``).
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import flag, last_by_time, row_max, row_mean, safe_div

MAX_BROADCAST_ROWS = 2_000_000     # rows of a carried-state table we agree to broadcast
HOT_ROWS = 2_000_000               # default: ids with more rows than this are split into time chunks
MAX_CHUNKS_PER_ID = 1024


def q(name: str) -> Column:
    """Column reference that tolerates spaces/colons/dots in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def _time_expr(df: DataFrame, time_col: str) -> Column:
    dt = df.schema[time_col].dataType
    if isinstance(dt, T.NumericType):
        return q(time_col).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(q(time_col)).cast("double")
    return (F.unix_micros(q(time_col).cast("timestamp")) / F.lit(1e6)).cast("double")


def _base(df: DataFrame, id_col: str, time_col: str, symptoms: Sequence[str],
          tie_col: str | None) -> DataFrame:
    tie = q(tie_col) if tie_col else F.xxhash64(*[q(c) for c in df.columns])
    return df.select(q(id_col).alias("_id"), _time_expr(df, time_col).alias("_t"), tie.alias("_tie"),
                     *[q(s).cast("double").alias(f"_v{i}") for i, s in enumerate(symptoms)])


def _assign_chunks(base: DataFrame, hot_rows: int):
    """Add ``_ch`` (time chunk) and ``_hot`` for ids with more than ``hot_rows`` rows."""
    counts = base.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > hot_rows)
    stat = hot.agg(F.count(F.lit(1)).alias("n_hot"), F.max("_n").alias("max_n")).first()
    n_hot, max_n = int(stat["n_hot"]), int(stat["max_n"] or 0)
    if n_hot == 0:
        return base.withColumn("_ch", F.lit(0)).withColumn("_hot", F.lit(False)), 0, 1
    k = max(2, min(MAX_CHUNKS_PER_ID, math.ceil(max_n / hot_rows)))
    probs = [j / k for j in range(1, k)]
    small = n_hot * k <= MAX_BROADCAST_ROWS
    hot_ids = hot.select("_id")
    bounds = (base.join(F.broadcast(hot_ids) if small else hot_ids, "_id", "left_semi")
              .groupBy("_id").agg(F.percentile_approx("_t", probs, 10000).alias("_b")))
    out = base.join(F.broadcast(bounds) if small else bounds, "_id", "left")
    out = out.select(*[c for c in base.columns],
                     F.coalesce(F.size(F.filter("_b", lambda b: b < F.col("_t"))), F.lit(0)).alias("_ch"),
                     F.col("_b").isNotNull().alias("_hot"))
    return out, n_hot, k


def _carry_join(frame: DataFrame, summary: DataFrame, n_rows_bound: int) -> DataFrame:
    small = n_rows_bound <= MAX_BROADCAST_ROWS
    return frame.join(F.broadcast(summary) if small else summary, ["_id", "_ch"], "left")


def build_series(df: DataFrame, id_col: str, time_col: str, symptoms: Sequence[str],
                 tie_col: str | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Row-level ordered series state for each symptom (internal column names)."""
    p = len(symptoms)
    base = _base(df, id_col, time_col, symptoms, tie_col)
    chunked = hot_rows is not None
    n_hot, k = 0, 1
    if chunked:
        base, n_hot, k = _assign_chunks(base, hot_rows)
        chunked = n_hot > 0
    keys = ["_id", "_ch"] if chunked else ["_id"]
    w = Window.partitionBy(*keys).orderBy("_t", "_tie")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = [F.col(f"_v{i}") for i in range(p)]

    # pass A: previous value, observation index, id-level range
    a_cols = [F.col(c) for c in base.columns]
    for i in range(p):
        a_cols += [F.last(v[i], ignorenulls=True).over(before).alias(f"_pin{i}"),
                   F.count(v[i]).over(run).alias(f"_kin{i}"),
                   F.min(v[i]).over(whole).alias(f"_low{i}"),
                   F.max(v[i]).over(whole).alias(f"_hiw{i}"),
                   F.count(v[i]).over(whole).alias(f"_nw{i}")]
    a = base.select(*a_cols)
    if chunked:
        ws = Window.partitionBy("_id").orderBy("_ch")
        prev = ws.rowsBetween(Window.unboundedPreceding, -1)
        allw = ws.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        sa = a.where("_hot").groupBy("_id", "_ch").agg(
            *[e for i in range(p) for e in (
                last_by_time(v[i], "_t", "_tie").alias(f"_lv{i}"), F.count(v[i]).alias(f"_cn{i}"),
                F.min(v[i]).alias(f"_mn{i}"), F.max(v[i]).alias(f"_mx{i}"))])
        sa = sa.select("_id", "_ch", *[e for i in range(p) for e in (
            F.last(f"_lv{i}", ignorenulls=True).over(prev).alias(f"_cv{i}"),
            F.coalesce(F.sum(f"_cn{i}").over(prev), F.lit(0)).alias(f"_off{i}"),
            F.min(f"_mn{i}").over(allw).alias(f"_idlo{i}"),
            F.max(f"_mx{i}").over(allw).alias(f"_idhi{i}"),
            F.sum(f"_cn{i}").over(allw).alias(f"_idn{i}"))])
        a = _carry_join(a, sa, n_hot * k)
    cols = [F.col(c) for c in base.columns]
    for i in range(p):
        if chunked:
            pv = F.coalesce(F.col(f"_pin{i}"), F.col(f"_cv{i}"))
            kk = F.col(f"_kin{i}") + F.coalesce(F.col(f"_off{i}"), F.lit(0))
            lo = F.when(F.col("_hot"), F.col(f"_idlo{i}")).otherwise(F.col(f"_low{i}"))
            hi = F.when(F.col("_hot"), F.col(f"_idhi{i}")).otherwise(F.col(f"_hiw{i}"))
            nn = F.when(F.col("_hot"), F.col(f"_idn{i}")).otherwise(F.col(f"_nw{i}"))
        else:
            pv, kk = F.col(f"_pin{i}"), F.col(f"_kin{i}")
            lo, hi, nn = F.col(f"_low{i}"), F.col(f"_hiw{i}"), F.col(f"_nw{i}")
        cols += [pv.alias(f"_pv{i}"), (v[i] - pv).alias(f"_d{i}"), kk.alias(f"_k{i}"),
                 lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}"), nn.alias(f"_n{i}")]
    b = a.select(*cols)

    # pass B: run resets and previous non-zero direction (same window -> no new exchange)
    d = [F.col(f"_d{i}") for i in range(p)]
    kcol = [F.col(f"_k{i}") for i in range(p)]
    reset_cond = [v[i].isNotNull() & (d[i].isNull() | (d[i] <= 0)) for i in range(p)]
    nz_sign = [F.when(d[i] != 0, F.signum(d[i])) for i in range(p)]
    b_cols = [F.col(c) for c in b.columns]
    for i in range(p):
        b_cols += [F.max(F.when(reset_cond[i], kcol[i])).over(run).alias(f"_rin{i}"),
                   F.last(nz_sign[i], ignorenulls=True).over(before).alias(f"_sin{i}")]
    c = b.select(*b_cols)
    if chunked:
        ws = Window.partitionBy("_id").orderBy("_ch")
        prev = ws.rowsBetween(Window.unboundedPreceding, -1)
        sb = b.where("_hot").groupBy("_id", "_ch").agg(
            *[e for i in range(p) for e in (
                F.max(F.when(reset_cond[i], kcol[i])).alias(f"_lr{i}"),
                last_by_time(nz_sign[i], "_t", "_tie").alias(f"_ls{i}"))])
        sb = sb.select("_id", "_ch", *[e for i in range(p) for e in (
            F.max(f"_lr{i}").over(prev).alias(f"_cr{i}"),
            F.last(f"_ls{i}", ignorenulls=True).over(prev).alias(f"_cs{i}"))])
        c = _carry_join(c, sb, n_hot * k)
    out = [F.col(x) for x in b.columns]
    for i in range(p):
        if chunked:
            reset = F.greatest(F.col(f"_rin{i}"), F.col(f"_cr{i}"))
            ps = F.coalesce(F.col(f"_sin{i}"), F.col(f"_cs{i}"))
        else:
            reset, ps = F.col(f"_rin{i}"), F.col(f"_sin{i}")
        out += [F.when(v[i].isNotNull(), kcol[i] - reset).alias(f"_run{i}"), ps.alias(f"_ps{i}")]
    return c.select(*out)


ENTROPY_MAX_BINS = 5


def series_stats(df: DataFrame, id_col: str, time_col: str, symptoms: Sequence[str],
                 tie_col: str | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One ``groupBy(id)`` of sufficient statistics per symptom (internal names)."""
    p = len(symptoms)
    s = build_series(df, id_col, time_col, symptoms, tie_col, hot_rows)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i in range(p):
        v, d, pv = F.col(f"_v{i}"), F.col(f"_d{i}"), F.col(f"_pv{i}")
        x = F.when(d.isNotNull(), pv)
        y = F.when(d.isNotNull(), v)
        bins = F.least(F.col(f"_n{i}"), F.lit(ENTROPY_MAX_BINS)).cast("double")
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        raw_bin = F.when(hi > lo, F.floor((v - lo) * (bins / (hi - lo)))).otherwise(F.floor(bins * 0.5))
        the_bin = F.least(raw_bin.cast("long"), bins.cast("long") - 1)
        ps = F.col(f"_ps{i}")
        change = (d != 0) & ps.isNotNull() & (F.signum(d) != ps)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.regr_slope(v, F.col("_t")).alias(f"slope{i}"),
            F.stddev_pop(d).alias(f"vol{i}"),
            last_by_time(d, "_t", "_tie").alias(f"rc{i}"),
            F.max(d).alias(f"mi{i}"),
            last_by_time(v, "_t", "_tie").alias(f"lv{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_pop(v).alias(f"sd{i}"),
            F.covar_pop(x, y).alias(f"cxy{i}"),
            F.stddev_pop(x).alias(f"sx{i}"),
            F.stddev_pop(y).alias(f"sy{i}"),
            F.count(d).alias(f"nd{i}"),
            F.max(F.col(f"_run{i}")).alias(f"mr{i}"),
            F.count_if(change).alias(f"ch{i}"),
            *[F.count_if(v.isNotNull() & (the_bin == b)).alias(f"bin{i}_{b}") for b in range(ENTROPY_MAX_BINS)],
        ]
    return s.groupBy(F.col("_id")).agg(*aggs)


# ---------------------------------------------------------------------------
# feature projections over series_stats
# ---------------------------------------------------------------------------

def _trend_cols(symptoms: Sequence[str], idx: Mapping[str, int]) -> list[Column]:
    out = []
    for s in symptoms:
        i = idx[s]
        many = F.col(f"n{i}") > 1
        out += [F.when(many, F.col(f"slope{i}")).otherwise(F.lit(0.0)).alias(f"{s}_slope"),
                F.when(many, F.col(f"vol{i}")).otherwise(F.lit(0.0)).alias(f"{s}_volatility"),
                F.when(many, F.col(f"rc{i}")).otherwise(F.lit(0.0)).alias(f"{s}_recent_change"),
                F.when(many, F.col(f"mi{i}")).otherwise(F.lit(0.0)).alias(f"{s}_max_increase"),
                F.col(f"lv{i}").alias(f"{s}_last_value")]
    return out


def _stability_cols(symptoms: Sequence[str], idx: Mapping[str, int], min_obs: int) -> list[Column]:
    enough = F.col("_rows") >= min_obs
    per, cvs, acs, ens = [], [], [], []
    for s in symptoms:
        i = idx[s]
        n = F.col(f"n{i}").cast("double")
        cv = F.when(enough & (F.col(f"mean{i}") > 0), safe_div(F.col(f"sd{i}"), F.col(f"mean{i}")))
        ac = F.when(enough & (F.col(f"nd{i}") >= 2) & (F.col(f"sx{i}") > 0) & (F.col(f"sy{i}") > 0),
                    safe_div(F.col(f"cxy{i}"), F.col(f"sx{i}") * F.col(f"sy{i}")))
        terms = []
        for b in range(ENTROPY_MAX_BINS):
            pb = F.col(f"bin{i}_{b}") / n
            terms.append(F.when(F.col(f"bin{i}_{b}") > 0, -pb * F.log2(pb + F.lit(1e-10))).otherwise(F.lit(0.0)))
        ent = F.when(enough & (F.col(f"n{i}") > 2), sum(terms[1:], terms[0]))
        per += [cv.alias(f"{s}_cv"), ac.alias(f"{s}_autocorr"), ent.alias(f"{s}_entropy")]
        cvs.append(cv), acs.append(ac), ens.append(ent)
    return per + [row_mean(cvs).alias("overall_cv"), row_mean(acs).alias("overall_autocorr"),
                  row_mean(ens).alias("overall_entropy")]


def _pattern_cols(symptoms: Sequence[str], idx: Mapping[str, int], sudden_threshold: float,
                  sustained_periods: int, per_symptom: bool = True) -> list[Column]:
    ok = F.col("_rows") >= 2
    sud, sus, flu, per = [], [], [], []
    for s in symptoms:
        i = idx[s]
        nd = F.col(f"nd{i}")
        is_sud = F.coalesce(F.col(f"mi{i}") >= F.lit(float(sudden_threshold)), F.lit(False))
        is_sus = F.coalesce(F.col(f"mr{i}") >= F.lit(sustained_periods), F.lit(False))
        ratio = F.when(nd > 1, F.col(f"ch{i}") / (nd - 1).cast("double")).otherwise(F.lit(0.0))
        is_flu = (ratio > 0.5) & (nd >= 3)
        sud.append((s, is_sud)), sus.append((s, is_sus)), flu.append((s, is_flu))
        if per_symptom:
            per += [F.when(ok, flag(is_sud)).alias(f"{s}_sudden_increase"),
                    F.when(ok, flag(is_sus)).alias(f"{s}_sustained_increase"),
                    F.when(ok, ratio).alias(f"{s}_fluctuation_ratio")]

    def count(lst):
        return sum([flag(c) for _, c in lst[1:]], flag(lst[0][1]))

    def names(lst):
        return F.nullif(F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in lst]), F.lit(""))

    agg = [F.when(ok, count(sud)).alias("n_sudden_increases"),
           F.when(ok, count(sus)).alias("n_sustained_increases"),
           F.when(ok, count(flu)).alias("n_fluctuating_symptoms"),
           F.when(ok, flag(count(sud) > 0)).alias("has_sudden_increases"),
           F.when(ok, flag(count(sus) > 0)).alias("has_sustained_increases"),
           F.when(ok, flag(count(flu) > 0)).alias("has_fluctuating_symptoms"),
           F.when(ok, names(sud)).alias("sudden_increase_symptoms"),
           F.when(ok, names(sus)).alias("sustained_increase_symptoms"),
           F.when(ok, names(flu)).alias("fluctuating_symptoms")]
    return per + agg


def _warning_cols(warning_signs: Mapping[str, Sequence[str]], idx: Mapping[str, int]) -> list[Column]:
    out, alerts = [], []
    for sign, syms in warning_signs.items():
        avail = [s for s in syms if s in idx]
        if not avail:
            continue
        level = row_mean([F.col(f"lv{idx[s]}") for s in avail])
        rcs = [F.when(F.col(f"n{idx[s]}") > 1, F.col(f"rc{idx[s]}")).otherwise(F.lit(0.0)) for s in avail]
        slopes = [F.when(F.col(f"n{idx[s]}") > 1, F.col(f"slope{idx[s]}")).otherwise(F.lit(0.0)) for s in avail]
        inc = row_max(rcs)
        trend = row_mean(slopes)
        alert = flag(inc >= 2)
        talert = flag(trend > 0.1)
        out += [level.alias(f"{sign}_level"), inc.alias(f"{sign}_increase"), alert.alias(f"{sign}_alert"),
                trend.alias(f"{sign}_trend"), talert.alias(f"{sign}_trend_alert")]
        alerts += [alert, talert]
    if alerts:
        out.append(sum(alerts[1:], alerts[0]).alias("early_warning_score"))
    return out


def _finish(stats: DataFrame, id_col: str, cols: list[Column]) -> DataFrame:
    return stats.select(F.col("_id").alias(id_col), *cols)


def _index(symptoms):
    return {s: i for i, s in enumerate(symptoms)}


def symptom_trends(df: DataFrame, id_col: str, time_col: str, symptoms: Sequence[str],
                   tie_col: str | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Per id and symptom: slope, volatility, recent change, max increase, last value."""
    st = series_stats(df, id_col, time_col, symptoms, tie_col, hot_rows)
    return _finish(st, id_col, _trend_cols(symptoms, _index(symptoms)))


def symptom_stability(df: DataFrame, id_col: str, time_col: str, symptoms: Sequence[str],
                      min_observations: int = 3, tie_col: str | None = None,
                      hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """cv, lag-1 autocorrelation, histogram entropy per symptom and their overall means."""
    st = series_stats(df, id_col, time_col, symptoms, tie_col, hot_rows)
    return _finish(st, id_col, _stability_cols(symptoms, _index(symptoms), min_observations))


def temporal_patterns(df: DataFrame, id_col: str, time_col: str, symptoms: Sequence[str],
                      sudden_increase_threshold: float = 2.0, sustained_increase_min_periods: int = 2,
                      tie_col: str | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Sudden / sustained increases and fluctuation per symptom plus per-id roll-ups."""
    st = series_stats(df, id_col, time_col, symptoms, tie_col, hot_rows)
    return _finish(st, id_col, _pattern_cols(symptoms, _index(symptoms), sudden_increase_threshold,
                                             sustained_increase_min_periods))


def latest_snapshot(df: DataFrame, id_col: str, time_col: str, columns: Sequence[str],
                    tie_col: str | None = None) -> DataFrame:
    """Last non-null value of every column per id (pandas ``groupby().last()``).

    Pure aggregation (``max_by`` over non-null rows): partial-aggregable, skew-safe.
    """
    t = _time_expr(df, time_col)
    tie = q(tie_col) if tie_col else F.xxhash64(*[q(c) for c in df.columns])
    base = df.select(q(id_col).alias("_id"), t.alias("_t"), tie.alias("_tie"),
                     *[q(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    return base.groupBy(F.col("_id").alias(id_col)).agg(
        *[last_by_time(f"_c{i}", "_t", "_tie").alias(c) for i, c in enumerate(columns)])


def early_warning_signs(df: DataFrame, id_col: str, time_col: str, symptoms: Sequence[str],
                        warning_signs: Mapping[str, Sequence[str]], tie_col: str | None = None,
                        hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Warning level / increase / alert / trend / trend alert per sign + early_warning_score."""
    st = series_stats(df, id_col, time_col, symptoms, tie_col, hot_rows)
    return _finish(st, id_col, _warning_cols(warning_signs, _index(symptoms)))


def trend_feature_table(df: DataFrame, id_col: str, time_col: str, symptoms: Sequence[str],
                        warning_signs: Mapping[str, Sequence[str]], min_observations: int = 3,
                        tie_col: str | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Trends + warnings + stability + patterns in one window pass and one aggregation."""
    idx = _index(symptoms)
    st = series_stats(df, id_col, time_col, symptoms, tie_col, hot_rows)
    return _finish(st, id_col, _trend_cols(symptoms, idx) + _warning_cols(warning_signs, idx)
                   + _stability_cols(symptoms, idx, min_observations)
                   + _pattern_cols(symptoms, idx, 2.0, 2))


RISK_WEIGHTS = {"early_warning_score": 2.0, "has_sudden_increases": 1.5, "has_sustained_increases": 1.0}


def early_warning_features(df: DataFrame, id_col: str, time_col: str, symptoms: Sequence[str],
                           warning_signs: Mapping[str, Sequence[str]], sudden_increase_threshold: float = 1.5,
                           tie_col: str | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Warnings + warning-sign patterns + relapse_risk_score on a 0-10 scale (not clipped).

    relapse = (2*early_warning_score + 1.5*has_sudden + 1*has_sustained) / 12.5 * 10.
    """
    sign_syms = [s for syms in warning_signs.values() for s in syms if s in symptoms]
    all_syms = list(symptoms) + [s for s in sign_syms if s not in symptoms]
    idx = _index(all_syms)
    st = series_stats(df, id_col, time_col, all_syms, tie_col, hot_rows)
    warn = _warning_cols(warning_signs, idx)
    pats = _pattern_cols(sign_syms, idx, sudden_increase_threshold, 2)
    frame = _finish(st, id_col, warn + pats)
    have = [c for c in RISK_WEIGHTS if c in frame.columns]
    if not have:
        return frame
    score = sum([F.col(c) * F.lit(RISK_WEIGHTS[c]) for c in have[1:]], F.col(have[0]) * F.lit(RISK_WEIGHTS[have[0]]))
    max_possible = sum(RISK_WEIGHTS[c] * (5 if c == "early_warning_score" else 1) for c in have)
    return frame.withColumn("relapse_risk_score", score / F.lit(max_possible) * F.lit(10.0))


# ---------------------------------------------------------------------------
# row-level longitudinal operators
# ---------------------------------------------------------------------------

def filter_time_window(df: DataFrame, id_col: str, time_col: str, time_window=None,
                       min_observations: int = 2) -> DataFrame:
    """Inclusive time window, then keep ids with at least ``min_observations`` rows.

    The id counts are a partial aggregation joined back with a semi join (AQE picks a
    broadcast only if the count table is small at run time).
    """
    out = df
    if time_window is not None:
        lo, hi = time_window
        out = out.where(q(time_col).between(lo, hi))
    keep = out.groupBy(q(id_col).alias(id_col)).count().where(F.col("count") >= min_observations).select(id_col)
    return out.join(keep, id_col, "left_semi")


def _halo_blocks(df: DataFrame, id_col: str, time_col: str, before: int, after: int, hot_rows: int | None):
    """Rows with their place ``_at`` (from 0) and number of rows ``_n`` of their id, dealt to blocks of a window.

    Ids with more than ``hot_rows`` rows are cut into blocks of as many; a row is also copied (``_own`` false) to the
    next block where a frame reaching ``before`` rows back and ``after`` forth needs it.  Returns the frame and
    the window over a block, so a long id spreads over tasks and each frame is whole.
    """
    tie = F.xxhash64(*[q(c) for c in df.columns])
    base = df.select("*", q(id_col).alias("_id"), _time_expr(df, time_col).alias("_t"), tie.alias("_tie"))
    n_hot, k = 0, 1
    if hot_rows is not None:
        base, n_hot, k = _assign_chunks(base, hot_rows)
    if not n_hot:
        base = base.withColumn("_ch", F.lit(0))
    w = Window.partitionBy("_id", "_ch")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = base.select("*", (F.row_number().over(w.orderBy("_t", "_tie")) - 1).alias("_at"), F.count(F.lit(1)).over(whole).alias("_n"))
    if not n_hot:
        return x.withColumn("_own", F.lit(True)), w.orderBy("_at")
    ws = Window.partitionBy("_id").orderBy("_ch")
    sizes = base.where("_hot").groupBy("_id", "_ch").agg(F.count(F.lit(1)).alias("_c"))
    offsets = sizes.select("_id", "_ch", F.coalesce(F.sum("_c").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
                           F.sum("_c").over(ws.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    x = _carry_join(x, offsets, n_hot * k)
    x = x.withColumns({"_at": F.col("_at") + F.coalesce("_off", F.lit(0)), "_n": F.coalesce("_all", "_n")})
    size = F.lit(max(hot_rows, before + after + 1))
    own = F.when(F.col("_hot"), F.floor(F.col("_at") / size)).otherwise(F.lit(0))
    reached = F.array_distinct(F.array(F.floor((F.col("_at") - after) / size), own, F.floor((F.col("_at") + before) / size)))
    x = x.withColumn("_home", own).withColumn("_block", F.explode(F.when(F.col("_hot"), reached).otherwise(F.array(own))))
    return x.withColumn("_own", F.col("_block") == F.col("_home")), Window.partitionBy("_id", "_block").orderBy("_at")


def rolling_mean_centered(df: DataFrame, id_col: str, time_col: str, value_col: str, window: int,
                          out_col: str = "rolling_mean", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Centred moving average (pandas ``rolling(w, center=True)``): null unless the frame is full.

    For even ``w`` the frame has one more row before than after, as pandas does.  Ids with more than
    ``hot_rows`` rows are computed in blocks with halos.
    """
    before, after = window // 2, (window - 1) // 2
    x, w = _halo_blocks(df, id_col, time_col, before, after, hot_rows)
    w = w.rowsBetween(-before, after)
    full = (F.count(F.lit(1)).over(w) == window) & (F.count(q(value_col)).over(w) == window)
    x = x.withColumn("_ma", F.when(full, F.avg(q(value_col)).over(w))).where("_own")
    return x.select(*[q(c) for c in df.columns], F.col("_ma").alias(out_col))


def rolling_mean_trailing(df: DataFrame, id_col: str, time_col: str, value_col: str, window: int,
                          out_col: str = "rolling_mean", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Valid-mode trailing moving average aligned to the last point of each window.

    Ids with fewer than ``window`` rows keep their raw series (the reference falls back to it).  Ids
    with more than ``hot_rows`` rows are computed in blocks with halos.
    """
    x, w = _halo_blocks(df, id_col, time_col, window - 1, 0, hot_rows)
    x = x.withColumn("_ma", F.avg(q(value_col)).over(w.rowsBetween(-(window - 1), 0))).where("_own")
    x = x.where((F.col("_n") < window) | (F.col("_at") >= window - 1))
    return x.select(*[q(c) for c in df.columns], F.when(F.col("_n") < window, q(value_col)).otherwise(F.col("_ma")).alias(out_col))


def longitudinal_summary(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Per id mean, min, max, sample std and count of a score (partial aggregation)."""
    v = q(value_col)
    return df.groupBy(q(id_col).alias(id_col)).agg(
        F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.stddev_samp(v).alias("std"), F.count(v).alias("count"))


def timeline_with_events(series: DataFrame, events: DataFrame, id_col: str, time_col: str,
                         score_col: str, threshold: float) -> DataFrame:
    """Series rows with an above-threshold mask and the event label at the same (id, time)."""
    ev = events.groupBy(id_col, time_col).agg(F.min("label").alias("event"),
                                              F.count(F.lit(1)).alias("n_events"))
    return (series.join(ev, [id_col, time_col], "left")
            .withColumn("above_threshold", flag(q(score_col) > threshold)))
