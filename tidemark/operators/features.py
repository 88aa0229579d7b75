"""Feature engineering: skew transforms, subscale/factor scores, interactions, one-hot,
outlier detection and scaling.

Fitted statistics (skewness, quantiles, means, categories) come from one aggregation per
kind; transforms are a single ``select`` with every new column (never a withColumn
loop), so wide frames stay one projection inside whole-stage codegen.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import bias_corrected_skewness, numeric_columns, row_mean, row_sum, string_columns
from tidemark.functions.stats import exact_quantiles
from tidemark.operators.stages import StatefulModel

# Five-factor item sets of the 30-item symptom scale.
FACTOR_ITEMS = {
    "PANSS_Factor_Positive": ["P1", "P3", "P5", "P6", "G9"],
    "PANSS_Factor_Negative": ["N1", "N2", "N3", "N4", "N6", "G7"],
    "PANSS_Factor_Disorganized": ["P2", "N5", "G5", "G10", "G11"],
    "PANSS_Factor_Excitement": ["P4", "P7", "G8", "G14"],
    "PANSS_Factor_Anxiety_Depression": ["G1", "G2", "G3", "G4", "G6"],
}
ITEM_PREFIXES = ("P", "N", "G")
CODED_PREFIX = "M0_PANSS_"


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def select_by_prefix(df: DataFrame, prefixes: Sequence[str] = ITEM_PREFIXES, coded: str = CODED_PREFIX) -> list[str]:
    """Item columns: names with a prefix and ':' ; only if none, coded names ``M0_PANSS_P..``."""
    named = [c for c in df.columns if c.startswith(tuple(prefixes)) and ":" in c]
    if named:
        return named
    return [c for c in df.columns if c.startswith(tuple(coded + p for p in prefixes))]


def skewness_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(feature, skewness) with bias-corrected sample skewness (pandas ``skew``)."""
    cols = numeric_columns(df) if cols is None else list(cols)
    row = df.agg(*[bias_corrected_skewness(q(c)).alias(c) for c in cols])
    return row.unpivot([], cols, "feature", "skewness")


def skew_select(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.5,
                absolute: bool = True) -> list[str]:
    """Columns whose corrected skewness exceeds the threshold (|.| if ``absolute``)."""
    cols = numeric_columns(df) if cols is None else list(cols)
    if not cols:
        return []
    row = df.agg(*[bias_corrected_skewness(q(c)).alias(c) for c in cols]).first()
    out = []
    for c in cols:
        s = row[c]
        if s is None:
            continue
        if (abs(s) if absolute else s) > threshold:
            out.append(c)
    return out


_TRANSFORMS = {"cbrt": F.cbrt, "log": F.log1p, "sqrt": F.sqrt}


def transform_columns(df: DataFrame, cols: Sequence[str], method: str = "cbrt") -> DataFrame:
    fn = _TRANSFORMS[method]
    return df.withColumns({c: fn(q(c).cast("double")) for c in cols})


def transform_skewed(df: DataFrame, threshold: float = 0.5, method: str = "cbrt",
                     cols: Sequence[str] | None = None) -> DataFrame:
    return transform_columns(df, skew_select(df, cols, threshold, absolute=True), method)


def _items_matching(columns: Sequence[str], codes: Sequence[str], match: str) -> list[str]:
    out = []
    for c in columns:
        for code in codes:
            if match == "exact":
                hit = c == CODED_PREFIX + code or c.startswith(code + ":") or c == code
            else:  # the reference's substring rule (G1 also matches G10..G16)
                hit = (code + ":") in c or (CODED_PREFIX + code) in c
            if hit:
                out.append(c)
                break
    return out


def subscale_totals(df: DataFrame, groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Row sums of item groups, null counted as 0 (pandas ``sum(axis=1)``)."""
    if groups is None:
        items = select_by_prefix(df)
        groups = {}
        for p in ITEM_PREFIXES:
            g = [c for c in items if c.startswith(p + "") and ":" in c or c.startswith(CODED_PREFIX + p)]
            if g:
                groups[f"PANSS_{p}_Total"] = g
    return df.withColumns({name: row_sum([q(c) for c in cols]) for name, cols in groups.items()})


def factor_means(df: DataFrame, factors: Mapping[str, Sequence[str]] = FACTOR_ITEMS, match: str = "exact",
                 columns_by_factor: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Null-skipping row mean of each factor's items (exact item match by default)."""
    out = {}
    for name, codes in factors.items():
        cols = columns_by_factor[name] if columns_by_factor else _items_matching(df.columns, codes, match)
        if cols:
            out[name] = row_mean([q(c) for c in cols])
    return df.withColumns(out)


def ratio_feature(df: DataFrame, num: str, den: str, out: str, eps: float = 0.001) -> DataFrame:
    return df.withColumn(out, q(num) / (q(den) + F.lit(eps)))


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]], numerical_only: bool = False) -> DataFrame:
    """``Interaction_a_b``: product for two numerics, else 'a_b' text (null -> 'nan')."""
    num = set(numeric_columns(df))
    new = {}
    for a, b in pairs:
        if a not in df.columns or b not in df.columns:
            continue
        both = a in num and b in num
        if numerical_only and not both:
            continue
        name = f"Interaction_{a}_{b}"
        if both:
            new[name] = q(a) * q(b)
        else:
            new[name] = F.concat(F.coalesce(q(a).cast("string"), F.lit("nan")), F.lit("_"),
                                 F.coalesce(q(b).cast("string"), F.lit("nan")))
    return df.withColumns(new)


def default_interaction_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """3 x 3 grid of the first positive and negative items."""
    items = select_by_prefix(df)
    p = [c for c in items if c.startswith("P") or c.startswith(CODED_PREFIX + "P")][:3]
    n = [c for c in items if c.startswith("N") or c.startswith(CODED_PREFIX + "N")][:3]
    return [(a, b) for a in p for b in n] if len(p) >= 2 and len(n) >= 2 else []


#: Categories that wide columns are made for at most; beyond, ``categories.one_hot_sparse`` has no such bound.
MOST_CATEGORIES = 10_000


def fit_categories(df: DataFrame, cols: Sequence[str], most: int = MOST_CATEGORIES) -> dict[str, list]:
    """Sorted distinct values per column with null last, for outputs with a column per category.

    They are counted apart first: more than ``most`` of them raise an error before any comes to the driver.
    """
    if not cols:
        return {}
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("col"), q(c).cast("string").alias("value")) for c in cols]))
    distinct = df.select(pairs).distinct().persist()
    try:
        n = distinct.count()
        if n > most:
            raise ValueError(f"{n} categories would become as many columns (at most {most}); use one_hot_sparse")
        out: dict[str, list] = {c: [] for c in cols}
        for r in distinct.collect():
            out[r["col"]].append(r["value"])
    finally:
        distinct.unpersist()
    return {c: sorted([v for v in vals if v is not None]) + ([None] if None in vals else []) for c, vals in out.items()}


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True,
            categories: Mapping[str, list] | None = None) -> DataFrame:
    """Wide 0/1 double columns ``col_value`` (null -> ``col_nan``), sources replaced.

    Categories are fitted once (sorted, null last); ``drop_first`` drops the first.
    """
    cats = fit_categories(df, cols) if categories is None else categories
    keep = [q(c) for c in df.columns if c not in cols]
    new = []
    for c in cols:
        vals = cats[c][1:] if drop_first else cats[c]
        for v in vals:
            cond = q(c).isNull() if v is None else (q(c).cast("string") == F.lit(v))
            new.append(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{'nan' if v is None else v}"))
    return df.select(*keep, *new)


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Per column: exact q1/q3, fences, number of values outside, has_outliers flag."""
    cols = numeric_columns(df) if cols is None else list(cols)
    qs = exact_quantiles(df, cols, [0.25, 0.75])
    aggs = []
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            aggs.append(F.lit(0).cast("long").alias(c))
            continue
        iqr = q3 - q1
        lo, hi = q1 - k * iqr, q3 + k * iqr
        aggs.append(F.count_if((q(c) > F.lit(hi)) | (q(c) < F.lit(lo))).cast("long").alias(c))
    row = df.agg(*aggs).first()
    spark = df.sparkSession
    rows = []
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            rows.append((c, None, None, None, None, 0, 0))
            continue
        iqr = q3 - q1
        rows.append((c, float(q1), float(q3), float(q1 - k * iqr), float(q3 + k * iqr), int(row[c]), int(row[c] > 0)))
    return spark.createDataFrame(rows, "feature string, q1 double, q3 double, lower double, upper double, "
                                       "n_outliers bigint, has_outliers bigint")


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    """(center, scale) per column; scale 0 -> 1 (sklearn)."""
    out = {}
    if not cols:
        return out
    if method == "standard":
        row = df.agg(*[e for c in cols for e in (F.avg(q(c)).alias(f"a{c}"), F.stddev_pop(q(c)).alias(f"s{c}"))]).first()
        for c in cols:
            s = row[f"s{c}"]
            out[c] = (row[f"a{c}"], s if s else 1.0)
    elif method == "minmax":
        row = df.agg(*[e for c in cols for e in (F.min(q(c)).alias(f"a{c}"), F.max(q(c)).alias(f"s{c}"))]).first()
        for c in cols:
            lo, hi = row[f"a{c}"], row[f"s{c}"]
            rng = (hi - lo) if (hi is not None and lo is not None) else None
            out[c] = (lo, rng if rng else 1.0)
    elif method == "robust":
        qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        for c in cols:
            q1, med, q3 = qs[c]
            iqr = (q3 - q1) if q1 is not None else None
            out[c] = (med, iqr if iqr else 1.0)
    else:
        raise ValueError(method)
    return out


def apply_scaler(df: DataFrame, params: Mapping[str, tuple]) -> DataFrame:
    return df.withColumns({c: (q(c) - F.lit(center)) / F.lit(float(scale))
                           for c, (center, scale) in params.items() if center is not None})


def fit_outlier_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard",
                       robust_for_outliers: bool = True) -> dict[str, tuple]:
    """(center, scale) per column: robust for columns with IQR outliers, ``method`` for the rest.

    Reads the data twice in total: one exact-quantile computation (q1, median, q3 of every
    column) and one aggregation with every column's outlier count, mean, population std, min
    and max.
    """
    cols = list(cols)
    if not cols:
        return {}
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for c in cols:
        q1, _, q3 = qs[c]
        if q1 is None:
            aggs.append(F.lit(0).cast("long").alias(f"o{c}"))
        else:
            iqr = q3 - q1
            aggs.append(F.count_if((q(c) > F.lit(q3 + 1.5 * iqr)) | (q(c) < F.lit(q1 - 1.5 * iqr))).alias(f"o{c}"))
        aggs += [F.avg(q(c)).alias(f"a{c}"), F.stddev_pop(q(c)).alias(f"s{c}"),
                 F.min(q(c)).alias(f"l{c}"), F.max(q(c)).alias(f"h{c}")]
    row = df.agg(*aggs).first()
    params = {}
    for c in cols:
        q1, med, q3 = qs[c]
        robust = robust_for_outliers and row[f"o{c}"] > 0
        m = "robust" if robust else method
        if m == "robust":
            iqr = (q3 - q1) if q1 is not None else None
            params[c] = (med, iqr if iqr else 1.0)
        elif m == "standard":
            params[c] = (row[f"a{c}"], row[f"s{c}"] if row[f"s{c}"] else 1.0)
        elif m == "minmax":
            lo, hi = row[f"l{c}"], row[f"h{c}"]
            rng = (hi - lo) if (hi is not None and lo is not None) else None
            params[c] = (lo, rng if rng else 1.0)
        else:
            raise ValueError(method)
    return params


def scale_features(df: DataFrame, method: str = "standard", robust_for_outliers: bool = True,
                   cols: Sequence[str] | None = None) -> DataFrame:
    """Robust scaling for columns with IQR outliers, ``method`` for the rest, in one projection."""
    cols = numeric_columns(df) if cols is None else list(cols)
    return apply_scaler(df, fit_outlier_scaler(df, cols, method, robust_for_outliers)) if cols else df


class SkewItemTransformer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fit: find item columns and those with skewness > 0.5; transform: cube-root them and
    add subscale totals, factor means and the positive/negative ratio."""

    method = Param(Params._dummy(), "method", "cbrt, log, sqrt, or empty for none", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "skewness above which an item is transformed", TypeConverters.toFloat)
    derived = Param(Params._dummy(), "derived", "add totals, factor means and the ratio", TypeConverters.toBoolean)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(method="cbrt", threshold=0.5, derived=True)
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> "SkewItemModel":
        items = select_by_prefix(dataset)
        skewed = skew_select(dataset, items, self.getOrDefault("threshold"), absolute=False) if items else []
        return SkewItemModel({"items": items, "skewed": skewed, "method": self.getOrDefault("method"),
                              "derived": self.getOrDefault("derived")})


class SkewItemModel(StatefulModel):
    """Fitted items; saved and read with its state."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        skewed = [c for c in self.state["skewed"] if c in dataset.columns]
        out = transform_columns(dataset, skewed, self.state["method"]) if self.state["method"] and skewed else dataset
        if self.state["derived"]:
            out = subscale_totals(out)
            out = factor_means(out)
            if "PANSS_P_Total" in out.columns and "PANSS_N_Total" in out.columns:
                out = ratio_feature(out, "PANSS_P_Total", "PANSS_N_Total", "PANSS_P_N_Ratio")
        return out


class FeatureEngineer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """item transform -> skew transform -> interactions -> one-hot -> scaling (each switchable), fitted once.

    Columns of ``passThrough`` (row keys, the label) are kept as they are and enter no statistic.  The skew
    transform is applied twice (item stage, then all numerics), as observed.
    """

    items = Param(Params._dummy(), "items", "transform items and add totals", TypeConverters.toBoolean)
    skew = Param(Params._dummy(), "skew", "cube roots of skewed numerics", TypeConverters.toBoolean)
    interact = Param(Params._dummy(), "interact", "add interactions", TypeConverters.toBoolean)
    encode = Param(Params._dummy(), "encode", "one-hot text columns, first category dropped", TypeConverters.toBoolean)
    scale = Param(Params._dummy(), "scale", "scale numerics, robustly where there are outliers", TypeConverters.toBoolean)
    pairs = Param(Params._dummy(), "pairs", "interacting pairs; unset: the first items", TypeConverters.identity)
    passThrough = Param(Params._dummy(), "passThrough", "columns left alone", TypeConverters.toListString)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(items=True, skew=True, interact=True, encode=True, scale=True, passThrough=[])
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> "FeatureEngineerModel":
        kept = self.getOrDefault("passThrough")
        free = lambda names: [c for c in names if c not in kept]
        state: dict = {"kept": kept, "items": None, "skewed": [], "pairs": [], "categories": None, "scaler": None}
        model = FeatureEngineerModel(state)
        if self.getOrDefault("items"):
            state["items"] = SkewItemTransformer().fit(dataset).state
        out = model._items(dataset)
        if self.getOrDefault("skew"):
            state["skewed"] = skew_select(out, free(numeric_columns(out)), 0.5, absolute=True)
        out = model._skew(out)
        if self.getOrDefault("interact"):
            pairs = self.getOrDefault("pairs") if self.isDefined("pairs") else default_interaction_pairs(out)
            state["pairs"] = [list(p) for p in pairs]
        out = model._interact(out)
        if self.getOrDefault("encode"):
            cats = fit_categories(out, free(string_columns(out)))
            state["categories"] = [[c, values] for c, values in cats.items()]
        out = model._encode(out)
        if self.getOrDefault("scale"):
            out = out.persist()  # quantiles read it several times
            state["scaler"] = {c: list(p) for c, p in fit_outlier_scaler(out, free(numeric_columns(out))).items()}
            out.unpersist()
        return model


class FeatureEngineerModel(StatefulModel):
    """Fitted chain; saved and read with its state (items, skewed columns, pairs, categories, centres and scales)."""

    def _items(self, df: DataFrame) -> DataFrame:
        return SkewItemModel(self.state["items"]).transform(df) if self.state["items"] else df

    def _skew(self, df: DataFrame) -> DataFrame:
        return transform_columns(df, self.state["skewed"], "cbrt") if self.state["skewed"] else df

    def _interact(self, df: DataFrame) -> DataFrame:
        return interactions(df, [tuple(p) for p in self.state["pairs"]]) if self.state["pairs"] else df

    def _encode(self, df: DataFrame) -> DataFrame:
        cats = dict(self.state["categories"] or [])
        return one_hot(df, list(cats), drop_first=True, categories=cats) if cats else df

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self._encode(self._interact(self._skew(self._items(dataset))))
        return apply_scaler(out, self.state["scaler"]) if self.state["scaler"] else out


def engineer_features(df: DataFrame, label_col: str | None = None, keep: Sequence[str] = (), transform: bool = True,
                      skew: bool = True, interact: bool = True, encode: bool = True, scale: bool = True,
                      pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``FeatureEngineer`` fitted on and applied to the same rows."""
    given = {} if pairs is None else {"pairs": [list(p) for p in pairs]}
    kept = [*keep, *([label_col] if label_col else [])]
    return FeatureEngineer(items=transform, skew=skew, interact=interact, encode=encode, scale=scale, passThrough=kept,
                           **given).fit(df).transform(df)
