"""Outcome labels, risk mapping and decision rules as column expressions.

Everything here is a projection (no shuffle).  Probabilities are handled in two forms:
wide (``proba`` array<double> ordered by class index) and long (``row_id, cls, p``).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import safe_div
from tidemark.sources.policy import Policy

OUTCOME_COLS = ("M6_Rem", "Y1_Rem", "Y1_Rem_6")

# Outcome pattern (M6_Y1_Y1-6, null -> Missing) -> class, default class 2.
PATTERN_TO_CLASS = {
    "No_No_No": 0, "No_No_Missing": 0, "No_Missing_Missing": 1, "No_Yes_Yes": 3, "No_Yes_No": 4,
    "Missing_Missing_Missing": 2, "Yes_No_No": 2, "Yes_No_Missing": 2, "Yes_Missing_Missing": 6,
    "Yes_Yes_No": 4, "Yes_Yes_Yes": 7, "Missing_Yes_Yes": 5, "Missing_No_No": 0, "Missing_Yes_No": 4,
}
PATTERN_DEFAULT_CLASS = 2

# Truth table (Y1_Rem, M6_Rem, Y1_Rem_6) -> class.
TRUTH_TABLE = {(0, 0, 0): 0, (1, 1, 1): 1, (1, 0, 0): 2, (1, 1, 0): 3,
               (1, 0, 1): 4, (0, 1, 0): 5, (0, 1, 1): 6, (0, 0, 1): 7}

YES = ("yes", "y", "1", "true")
NO = ("no", "n", "0", "false")


def fill_missing_token(df: DataFrame, cols: Sequence[str] = OUTCOME_COLS, token: str = "Missing") -> DataFrame:
    return df.fillna(token, subset=[c for c in cols if c in df.columns])


def outcome_label_lookup(df: DataFrame, cols: Sequence[str] = OUTCOME_COLS, out: str = "label") -> DataFrame:
    """Pattern lookup scheme: concat with '_' (null -> 'Missing'), 14-entry map, default 2."""
    combo = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("Missing")) for c in cols])
    items = []
    for k, v in PATTERN_TO_CLASS.items():
        items += [F.lit(k), F.lit(v).cast("long")]
    return df.withColumn(out, F.coalesce(F.try_element_at(F.create_map(*items), combo),
                                         F.lit(PATTERN_DEFAULT_CLASS).cast("long")))


def yes_no_to_int(c) -> Column:
    """Yes/No/Y/N/1/0/true/false (case-insensitive) -> 1/0; anything else -> null."""
    s = F.lower(F.trim(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")))
    return F.when(s.isin(*YES), F.lit(1)).when(s.isin(*NO), F.lit(0)).cast("long")


def outcome_label_truth(df: DataFrame, out: str = "label") -> DataFrame:
    """Truth-table scheme over (Y1_Rem, M6_Rem, Y1_Rem_6); unmatched/null -> null label."""
    y1, m6, y16 = yes_no_to_int("Y1_Rem"), yes_no_to_int("M6_Rem"), yes_no_to_int("Y1_Rem_6")
    e = None
    for (a, b, c), lab in TRUTH_TABLE.items():
        cond = (y1 == a) & (m6 == b) & (y16 == c)
        e = F.when(cond, F.lit(lab)) if e is None else e.when(cond, F.lit(lab))
    return df.withColumn(out, e.cast("long"))


def encode_binary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Yes/No text -> 1/0 in place."""
    return df.withColumns({c: yes_no_to_int(c) for c in cols})


def encode_ordinal(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Ordinal code by sorted distinct value (0-based); null stays null.

    Distinct values are few; the dense rank is computed on the distinct set and joined
    back (AQE broadcasts it only when small at run time).
    """
    out = out or col
    codes = (df.select(col).where(F.col(col).isNotNull()).distinct()
             .withColumn("_code", (F.dense_rank().over(Window.orderBy(col)) - 1).cast("long")))
    return df.join(codes, col, "left").withColumn(out, F.col("_code")).drop("_code") if out != col else \
        df.join(codes, col, "left").drop(col).withColumnRenamed("_code", col)


def class_to_risk(df: DataFrame, policy: Policy, cls_col: str = "cls", out: str = "risk_level",
                  default: str = "moderate_risk") -> DataFrame:
    return df.withColumn(out, policy.risk_expr(cls_col, default))


def risk_ordered_classes(spark, policy: Policy, classes: Sequence[int] | None = None) -> DataFrame:
    order = policy.priority_order(classes)
    rows = [(i, c, policy.risk_of(c, None) or "unassigned") for i, c in enumerate(order)]
    return spark.createDataFrame(rows, "priority bigint, cls bigint, risk_level string")


def attach_sample_weight(df: DataFrame, policy: Policy | None, label_col: str = "label",
                         custom: Mapping[int, float] | None = None, out: str = "sample_weight") -> DataFrame:
    """Per-row weight: custom map, else policy class weight, else 1.0 (others 1.0)."""
    lab = F.col(label_col).cast("long")
    if custom:
        items = []
        for k, v in custom.items():
            items += [F.lit(int(k)).cast("long"), F.lit(float(v))]
        w = F.try_element_at(F.create_map(*items), lab)
    elif policy is not None:
        w = policy.weight_expr(lab)
    else:
        w = F.lit(1.0)
    return df.withColumn(out, F.coalesce(w, F.lit(1.0)))


def balanced_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """N / (K * count_c) with K = max label + 1 (bincount length), one row per present class."""
    counts = df.groupBy(F.col(label_col).cast("long").alias("cls")).agg(F.count(F.lit(1)).alias("n_c"))
    allc = Window.partitionBy()   # the counts table has one row per class (K rows)
    n, k = F.sum("n_c").over(allc), F.max("cls").over(allc) + 1
    return counts.select("cls", "n_c", (n / (k * F.col("n_c"))).alias("weight"))


def argmax_expr(proba: Column) -> Column:
    """Index of the maximum probability, first index on ties."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("long")


def argmax_long(p_long: DataFrame, id_cols: Sequence[str] = ("row_id",)) -> DataFrame:
    """Long form: class with max p per row, smallest class on ties (partial aggregation)."""
    return p_long.groupBy(*id_cols).agg(
        (-F.max(F.struct(F.col("p"), (-F.col("cls")).alias("neg")))["neg"]).cast("long").alias("y_pred"))


def apply_thresholds_expr(proba: Column, policy: Policy, thresholds: Mapping[int, float] | None = None,
                          classes: Sequence[int] | None = None, missing: str = "default",
                          default_threshold: float = 0.5) -> Column:
    """Walk classes in priority order; the first with p >= tau wins, else argmax.

    ``missing='default'``: classes without tau use ``default_threshold`` (model scoring
    variant); ``missing='skip'``: they are skipped (optimisation / comparison variants).
    """
    classes = list(range(len(policy.classes))) if classes is None else list(classes)
    thr = {c: policy.threshold(c) for c in classes} if thresholds is None else dict(thresholds)
    e = None
    for c in policy.priority_order(classes):
        t = thr.get(c)
        if t is None:
            if missing == "skip":
                continue
            t = default_threshold
        cond = F.element_at(proba, classes.index(c) + 1) >= F.lit(float(t))
        e = F.when(cond, F.lit(c)) if e is None else e.when(cond, F.lit(c))
    am = F.element_at(F.array(*[F.lit(c) for c in classes]), argmax_expr(proba).cast("int") + 1)
    return (am if e is None else e.otherwise(am)).cast("long")


def apply_thresholds_long(p_long: DataFrame, policy: Policy, thresholds: Mapping[int, float] | None = None,
                          id_cols: Sequence[str] = ("row_id",)) -> DataFrame:
    """Long-form variant: min priority among classes with p >= tau, else argmax (skip missing tau)."""
    tau = policy.threshold_expr(F.col("cls")) if thresholds is None else F.try_element_at(
        F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(int(k)).cast("long"), F.lit(float(v)))]),
        F.col("cls").cast("long"))
    pri = policy.priority_expr(F.col("cls"))
    hit = F.when(F.col("p") >= tau, F.struct(pri.alias("pr"), F.col("cls").alias("c")))
    best = F.struct(F.col("p"), (-F.col("cls")).alias("neg"))
    g = p_long.groupBy(*id_cols).agg(F.min(hit)["c"].alias("_hit"), F.max(best)["neg"].alias("_neg"))
    return g.select(*id_cols, F.coalesce(F.col("_hit"), -F.col("_neg")).cast("long").alias("y_pred"))


def risk_level_probability(p_long: DataFrame, policy: Policy, id_cols: Sequence[str] = ("row_id",),
                           cut: float = 0.4) -> DataFrame:
    """Sum probabilities per risk level; High if high > cut, else Moderate if moderate > cut, else Low."""
    lvl = policy.risk_expr("cls", "low_risk")
    g = p_long.groupBy(*id_cols).agg(
        *[F.sum(F.when(lvl == L, F.col("p")).otherwise(F.lit(0.0))).alias(f"p_{L}")
          for L in ("high_risk", "moderate_risk", "low_risk")])
    return g.withColumn("overall_risk", F.when(F.col("p_high_risk") > cut, "High")
                        .when(F.col("p_moderate_risk") > cut, "Moderate").otherwise("Low"))


SCORE_CANDIDATES = ("score", "probability", "risk_score")


def binary_flag(df: DataFrame, threshold: float = 0.5, out: str = "risk_flag") -> DataFrame:
    """Pick the score column (score, probability, risk_score, else first numeric) and flag >= tau."""
    from tidemark.functions.exprs import numeric_columns
    col = next((c for c in SCORE_CANDIDATES if c in df.columns), None) or numeric_columns(df)[0]
    return df.withColumn(out, F.when(F.col(col) >= threshold, F.lit("High Risk")).otherwise(F.lit("Low Risk")))


def recommendations_for(df: DataFrame, policy: Policy, level_col: str = "risk_level",
                        out: str = "recommendations") -> DataFrame:
    recs = policy.config["clinical_recommendations"]
    items = []
    for lvl, lst in recs.items():
        items += [F.lit(lvl), F.array(*[F.lit(x) for x in lst])]
    return df.withColumn(out, F.try_element_at(F.create_map(*items), F.col(level_col)))


def feature_advice(df: DataFrame, advice: Mapping[str, str], feature_col: str = "feature",
                   out: str = "advice") -> DataFrame:
    """Feature -> advice text, templated fallback naming the feature."""
    items = []
    for k, v in advice.items():
        items += [F.lit(k), F.lit(v)]
    lookup = F.try_element_at(F.create_map(*items), F.col(feature_col)) if items else F.lit(None).cast("string")
    fallback = F.format_string("Monitor and address %s as clinically appropriate",
                               F.regexp_replace(F.col(feature_col), "_", " "))
    return df.withColumn(out, F.coalesce(lookup, fallback))


def rank_risk_factors(df: DataFrame, feature_col: str = "feature", weight_col: str = "weight",
                      k: int | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """Order by |weight| desc; split risk (>= 0) and protective (< 0); optional top k per side."""
    side = F.when(F.col(weight_col) >= 0, F.lit("risk")).otherwise(F.lit("protective"))
    w = Window.partitionBy(*group_cols, side).orderBy(F.abs(F.col(weight_col)).desc(), F.col(feature_col))
    out = df.withColumn("side", side).withColumn("rank", F.row_number().over(w).cast("long"))
    return out.where(F.col("rank") <= k) if k else out


def normalise_proba(proba: Column) -> Column:
    tot = F.aggregate(proba, F.lit(0.0), lambda a, x: a + x)
    return F.transform(proba, lambda x: safe_div(x, tot))
