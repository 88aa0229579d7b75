"""DuckDB oracle SQL for the longitudinal features, written in long form.

Independent of the Spark implementation (which stays wide and uses ignore-nulls
windows): here every symptom becomes its own non-null series via UNION ALL and is
processed with plain ``lag`` / ``row_number`` windows per (id, symptom).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from tidemark.plans.oracle import L_SQL, rounded, with_fixtures


def _ctes(symptoms: Sequence[str]):
    ll = "\nunion all\n".join(
        f"select patient_id as id, t, '{s}' as sym, {s} as v from L where {s} is not null" for s in symptoms)
    s1 = """select id, t, sym, v, lag(v) over w as pv, v - lag(v) over w as d, row_number() over w as k,
        min(v) over (partition by id, sym) as lo, max(v) over (partition by id, sym) as hi,
        count(*) over (partition by id, sym) as n
        from LL window w as (partition by id, sym order by t)"""
    s2 = """select *,
        max(case when d is null or d <= 0 then k end) over (partition by id, sym order by t
            rows between unbounded preceding and current row) as reset,
        last_value(case when d <> 0 then sign(d) end ignore nulls) over (partition by id, sym order by t
            rows between unbounded preceding and 1 preceding) as ps,
        least(n, 5) as bins from S1"""
    s3 = """select *, k - reset as run,
        least(cast(case when hi > lo then floor((v - lo) * (cast(bins as double) / (hi - lo)))
                        else floor(bins * 0.5) end as bigint), bins - 1) as bin from S2"""
    bins = ", ".join(f"count(*) filter (where bin = {b}) as b{b}" for b in range(5))
    a = f"""select id, sym, count(*) as n, regr_slope(v, t) as slope, stddev_pop(d) as vol,
        arg_max(d, t) filter (where d is not null) as rc, max(d) as mi, arg_max(v, t) as lv,
        avg(v) as mean, stddev_pop(v) as sd,
        covar_pop(pv, v) filter (where d is not null) as cxy,
        stddev_pop(pv) filter (where d is not null) as sx,
        stddev_pop(v) filter (where d is not null) as sy,
        count(d) as nd, max(run) as mr,
        count(*) filter (where d <> 0 and ps is not null and sign(d) <> ps) as ch, {bins}
        from S3 group by id, sym"""
    r = "select patient_id as id, count(*) as _rows from L group by patient_id"
    j = "select R.id, R._rows, A.* exclude (id) from R left join A on A.id = R.id"
    return [("LL", ll), ("S1", s1), ("S2", s2), ("S3", s3), ("A", a), ("R", r), ("J", j)]


def _pick(s, expr, default="null"):
    inner = f"max(case when sym = '{s}' then {expr} end)"
    return inner if default == "null" else f"coalesce({inner}, {default})"


def per_symptom_sql(symptoms: Sequence[str], sudden: float = 2.0, sustained: int = 2, min_obs: int = 3) -> str:
    """One row per id with every per-symptom feature (trend, stability, pattern)."""
    cols = []
    for s in symptoms:
        ent_terms = " + ".join(
            f"case when b{b} > 0 then -(cast(b{b} as double) / n) * log2(cast(b{b} as double) / n + 1e-10) else 0.0 end"
            for b in range(5))
        cols += [
            _pick(s, "case when n > 1 then slope else 0.0 end", "0.0") + f" as {s}_slope",
            _pick(s, "case when n > 1 then vol else 0.0 end", "0.0") + f" as {s}_volatility",
            _pick(s, "case when n > 1 then rc else 0.0 end", "0.0") + f" as {s}_recent_change",
            _pick(s, "case when n > 1 then mi else 0.0 end", "0.0") + f" as {s}_max_increase",
            _pick(s, "lv") + f" as {s}_last_value",
            f"case when _rows >= {min_obs} then " + _pick(s, "case when mean > 0 then sd / mean end") + f" end as {s}_cv",
            f"case when _rows >= {min_obs} then " + _pick(
                s, "case when nd >= 2 and sx > 0 and sy > 0 then cxy / (sx * sy) end") + f" end as {s}_autocorr",
            f"case when _rows >= {min_obs} then " + _pick(s, f"case when n > 2 then {ent_terms} end") + f" end as {s}_entropy",
            f"cast(case when _rows >= 2 then " + _pick(s, f"case when mi >= {sudden} then 1 else 0 end", "0") + f" end as bigint) as {s}_sudden_increase",
            f"cast(case when _rows >= 2 then " + _pick(s, f"case when mr >= {sustained} then 1 else 0 end", "0") + f" end as bigint) as {s}_sustained_increase",
            f"case when _rows >= 2 then " + _pick(s, "case when nd > 1 then cast(ch as double) / (nd - 1) else 0.0 end", "0.0")
            + f" end as {s}_fluctuation_ratio",
        ]
    body = "select id, _rows, " + ",\n ".join(cols) + "\nfrom J group by id, _rows"
    return body


def _row_mean(exprs):
    num = " + ".join(f"coalesce({e}, 0)" for e in exprs)
    den = " + ".join(f"(case when {e} is not null then 1 else 0 end)" for e in exprs)
    return f"(({num}) / nullif({den}, 0))"


def _warning_exprs(warning_signs: Mapping[str, Sequence[str]]):
    out, alerts = [], []
    for sign, syms in warning_signs.items():
        lvl = _row_mean([f"{s}_last_value" for s in syms])
        inc = f"greatest({', '.join(f'{s}_recent_change' for s in syms)})" if len(syms) > 1 else f"{syms[0]}_recent_change"
        trend = _row_mean([f"{s}_slope" for s in syms])
        alert = f"(case when {inc} >= 2 then 1 else 0 end)"
        talert = f"(case when {trend} > 0.1 then 1 else 0 end)"
        out += [f"{lvl} as {sign}_level", f"{inc} as {sign}_increase", f"cast({alert} as bigint) as {sign}_alert",
                f"{trend} as {sign}_trend", f"cast({talert} as bigint) as {sign}_trend_alert"]
        alerts += [alert, talert]
    out.append(f"cast({' + '.join(alerts)} as bigint) as early_warning_score")
    return out


def _pattern_rollups(symptoms):
    def cnt(kind):
        return " + ".join(f"coalesce({s}_{kind}, 0)" for s in symptoms)
    flu = [f"(case when {s}_fluctuation_ratio > 0.5 and {s}_nd >= 3 then 1 else 0 end)" for s in symptoms]
    flu_cnt = " + ".join(flu)

    def names(conds):
        parts = ", ".join(f"case when {c} then '{s}' end" for s, c in zip(symptoms, conds))
        return f"nullif(concat_ws(',', {parts}), '')"
    return [
        f"case when _rows >= 2 then cast({cnt('sudden_increase')} as bigint) end as n_sudden_increases",
        f"case when _rows >= 2 then cast({cnt('sustained_increase')} as bigint) end as n_sustained_increases",
        f"case when _rows >= 2 then cast({flu_cnt} as bigint) end as n_fluctuating_symptoms",
        f"case when _rows >= 2 then cast(case when {cnt('sudden_increase')} > 0 then 1 else 0 end as bigint) end as has_sudden_increases",
        f"case when _rows >= 2 then cast(case when {cnt('sustained_increase')} > 0 then 1 else 0 end as bigint) end as has_sustained_increases",
        f"case when _rows >= 2 then cast(case when {flu_cnt} > 0 then 1 else 0 end as bigint) end as has_fluctuating_symptoms",
        f"case when _rows >= 2 then {names([f'{s}_sudden_increase = 1' for s in symptoms])} end as sudden_increase_symptoms",
        f"case when _rows >= 2 then {names([f'{s}_sustained_increase = 1' for s in symptoms])} end as sustained_increase_symptoms",
        f"case when _rows >= 2 then {names([f'{s}_fluctuation_ratio > 0.5 and {s}_nd >= 3' for s in symptoms])} end as fluctuating_symptoms",
    ]


def _nd_cols(symptoms):
    return [_pick(s, "nd", "0") + f" as {s}_nd" for s in symptoms]


def trends_sql(symptoms: Sequence[str]) -> str:
    cols = [f"{s}_{k}" for s in symptoms for k in ("slope", "volatility", "recent_change", "max_increase", "last_value")]
    body = f"select id as patient_id, {', '.join(cols)} from F"
    return rounded(with_fixtures(body, "L", extra=_ctes(symptoms) + [("F", per_symptom_sql(symptoms))]), cols)


def stability_sql(symptoms: Sequence[str], min_obs: int = 3) -> str:
    cols = [f"{s}_{k}" for s in symptoms for k in ("cv", "autocorr", "entropy")]
    overall = [f"{_row_mean([f'{s}_{k}' for s in symptoms])} as overall_{k}" for k in ("cv", "autocorr", "entropy")]
    body = f"select id as patient_id, {', '.join(cols)}, {', '.join(overall)} from F"
    return rounded(with_fixtures(body, "L", extra=_ctes(symptoms) + [("F", per_symptom_sql(symptoms, min_obs=min_obs))]),
                   cols + ["overall_cv", "overall_autocorr", "overall_entropy"])


def patterns_sql(symptoms: Sequence[str], sudden: float = 2.0, sustained: int = 2) -> str:
    per = [f"{s}_{k}" for s in symptoms for k in ("sudden_increase", "sustained_increase", "fluctuation_ratio")]
    f_sql = per_symptom_sql(symptoms, sudden, sustained).replace(
        "\nfrom J group by", ", " + ", ".join(_nd_cols(symptoms)) + "\nfrom J group by")
    body = (f"select id as patient_id, {', '.join(per)}, {', '.join(_pattern_rollups(symptoms))} from F")
    sql = with_fixtures(body, "L", extra=_ctes(symptoms) + [("F", f_sql)])
    return rounded(sql, [f"{s}_fluctuation_ratio" for s in symptoms])


def early_warning_sql(symptoms: Sequence[str], warning_signs: Mapping[str, Sequence[str]],
                      sudden: float = 1.5) -> str:
    sign_syms = [s for syms in warning_signs.values() for s in syms]
    all_syms = list(symptoms) + [s for s in sign_syms if s not in symptoms]
    f_sql = per_symptom_sql(all_syms, sudden, 2).replace(
        "\nfrom J group by", ", " + ", ".join(_nd_cols(all_syms)) + "\nfrom J group by")
    per = [f"{s}_{k}" for s in sign_syms for k in ("sudden_increase", "sustained_increase", "fluctuation_ratio")]
    warn = _warning_exprs(warning_signs)
    g = (f"select id as patient_id, {', '.join(warn)}, {', '.join(per)}, "
         f"{', '.join(_pattern_rollups(sign_syms))} from F")
    body = ("select *, (cast(early_warning_score as double) * 2.0 + has_sudden_increases * 1.5 "
            "+ has_sustained_increases * 1.0) / 12.5 * 10.0 as relapse_risk_score from G")
    sql = with_fixtures(body, "L", extra=_ctes(all_syms) + [("F", f_sql), ("G", g)])
    dbl = [f"{sg}_{k}" for sg in warning_signs for k in ("level", "increase", "trend")]
    dbl += [f"{s}_fluctuation_ratio" for s in sign_syms] + ["relapse_risk_score"]
    return rounded(sql, dbl)


def warnings_sql(symptoms: Sequence[str], warning_signs: Mapping[str, Sequence[str]]) -> str:
    warn = _warning_exprs(warning_signs)
    body = f"select id as patient_id, {', '.join(warn)} from F"
    sql = with_fixtures(body, "L", extra=_ctes(symptoms) + [("F", per_symptom_sql(symptoms))])
    return rounded(sql, [f"{sg}_{k}" for sg in warning_signs for k in ("level", "increase", "trend")])


__all__ = ["trends_sql", "stability_sql", "patterns_sql", "early_warning_sql", "warnings_sql", "L_SQL"]
