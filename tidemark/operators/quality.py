"""Validation and selection helpers: schema checks, null/bound checks, probability checks,
column-role selection and row filters.  Checks return *violation tables* (one row per
problem) computed with one aggregation, never a driver-side row loop.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import numeric_columns, string_columns

VIOLATION_SCHEMA = "check string, item string, detail string, count bigint"

TYPE_CLASSES = {"numeric": T.NumericType, "string": T.StringType, "timestamp": (T.TimestampType, T.TimestampNTZType),
                "date": T.DateType, "boolean": T.BooleanType}


def _violations(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, VIOLATION_SCHEMA)


def check_table(df: DataFrame, required: Sequence[str] = (), types: dict | None = None,
                no_nulls: Sequence[str] = (), raise_on_error: bool = False) -> DataFrame:
    """Non-empty, required columns, type classes, no-null columns (with null counts)."""
    spark = df.sparkSession
    rows = []
    present = set(df.columns)
    for c in required:
        if c not in present:
            rows.append(("required", c, "missing column", None))
    for c, cls in (types or {}).items():
        if c in present and not isinstance(df.schema[c].dataType, TYPE_CLASSES[cls]):
            rows.append(("type", c, f"expected {cls}, got {df.schema[c].dataType.simpleString()}", None))
    nn = [c for c in no_nulls if c in present]
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in nn]).first()
    if agg["_rows"] == 0:
        rows.append(("non_empty", "*", "table is empty", 0))
    for c in nn:
        if agg[c] > 0:
            rows.append(("no_nulls", c, "null values", int(agg[c])))
    out = _violations(spark, rows)
    if raise_on_error and rows:
        raise ValueError(f"table check failed: {rows}")
    return out


def check_feature_names(df: DataFrame, pattern: str | None = r"^[A-Za-z_][A-Za-z0-9_:. -]*$",
                        forbidden: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """Duplicates, regex mismatches, forbidden and missing required names."""
    spark = df.sparkSession
    names = spark.createDataFrame([(n,) for n in df.columns], "name string")
    dup = names.groupBy("name").count().where("count > 1").select(
        F.lit("duplicate").alias("check"), F.col("name").alias("item"), F.lit("duplicate name").alias("detail"),
        F.col("count").cast("long").alias("count"))
    bad = names.where(~F.col("name").rlike(pattern)) if pattern else names.limit(0)
    bad = bad.select(F.lit("pattern"), "name", F.lit(f"does not match {pattern}"), F.lit(None).cast("long"))
    forb = names.where(F.col("name").isin(*forbidden)) if forbidden else names.limit(0)
    forb = forb.select(F.lit("forbidden"), "name", F.lit("forbidden name"), F.lit(None).cast("long"))
    req = spark.createDataFrame([(r,) for r in required], "name string").join(names, "name", "left_anti")
    req = req.select(F.lit("required"), "name", F.lit("missing required name"), F.lit(None).cast("long"))
    return dup.unionAll(bad).unionAll(forb).unionAll(req)


def check_numeric_column(df: DataFrame, col: str, min_len: int | None = None, max_len: int | None = None,
                         min_value: float | None = None, max_value: float | None = None,
                         allow_null: bool = False) -> DataFrame:
    """Length bounds, value bounds and null/NaN counts in one aggregation."""
    c = F.col(col)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull() | F.isnan(c)).alias("nulls"),
               F.count_if(c < F.lit(min_value)).alias("low") if min_value is not None else F.lit(0).alias("low"),
               F.count_if(c > F.lit(max_value)).alias("high") if max_value is not None else F.lit(0).alias("high")).first()
    rows = []
    if min_len is not None and r["n"] < min_len:
        rows.append(("length", col, f"fewer than {min_len} values", int(r["n"])))
    if max_len is not None and r["n"] > max_len:
        rows.append(("length", col, f"more than {max_len} values", int(r["n"])))
    if not allow_null and r["nulls"] > 0:
        rows.append(("nulls", col, "null or NaN values", int(r["nulls"])))
    if r["low"] > 0:
        rows.append(("min_value", col, f"values below {min_value}", int(r["low"])))
    if r["high"] > 0:
        rows.append(("max_value", col, f"values above {max_value}", int(r["high"])))
    return _violations(df.sparkSession, rows)


def check_probabilities(p_long: DataFrame, id_col: str = "row_id", tol: float = 1e-5,
                        binary_only: bool = False) -> DataFrame:
    """Values in [0,1], no null/NaN, optional 0/1 only, per-row sums within tol of 1."""
    p = F.col("p")
    rows_agg = p_long.groupBy(id_col).agg(F.sum("p").alias("_s"))
    bad_sum = rows_agg.agg(F.count_if(F.abs(F.col("_s") - 1.0) > tol).alias("bad_sum")).first()["bad_sum"]
    r = p_long.agg(F.count_if(p.isNull() | F.isnan(p)).alias("nulls"),
                   F.count_if((p < 0) | (p > 1)).alias("range"),
                   F.count_if(~p.isin(0.0, 1.0)).alias("non_binary")).first()
    rows = []
    if r["nulls"]:
        rows.append(("nulls", "p", "null or NaN probabilities", int(r["nulls"])))
    if r["range"]:
        rows.append(("range", "p", "outside [0, 1]", int(r["range"])))
    if binary_only and r["non_binary"]:
        rows.append(("binary", "p", "not 0/1", int(r["non_binary"])))
    if bad_sum:
        rows.append(("row_sum", id_col, f"row sums differ from 1 by more than {tol}", int(bad_sum)))
    return _violations(p_long.sparkSession, rows)


def check_scoring_input(df: DataFrame, expected: Sequence[str], n_rows: int | None = None) -> DataFrame:
    """Non-empty, missing / extra columns, expected row count."""
    rows = []
    cols = set(df.columns)
    for c in expected:
        if c not in cols:
            rows.append(("missing", c, "expected column absent", None))
    for c in df.columns:
        if c not in set(expected):
            rows.append(("extra", c, "unexpected column", None))
    n = df.count()
    if n == 0:
        rows.append(("non_empty", "*", "no rows", 0))
    if n_rows is not None and n != n_rows:
        rows.append(("shape", "*", f"expected {n_rows} rows", int(n)))
    return _violations(df.sparkSession, rows)


def check_weights(policy_df: DataFrame, min_weight: float = 0.0, max_weight: float = 100.0) -> DataFrame:
    """Policy table: weights present, numeric and within bounds."""
    w = F.col("class_weight")
    bad = policy_df.where(w.isNull() | (w < min_weight) | (w > max_weight))
    return bad.select(F.lit("class_weight").alias("check"), F.col("cls").cast("string").alias("item"),
                      F.when(w.isNull(), F.lit("missing weight")).otherwise(F.lit("weight out of bounds")).alias("detail"),
                      F.lit(None).cast("long").alias("count"))


def select_numeric(df: DataFrame, label_col: str | None = None) -> DataFrame:
    cols = numeric_columns(df, [label_col] if label_col else [])
    return df.select(*cols, *([label_col] if label_col else []))


def select_categorical(df: DataFrame) -> DataFrame:
    return df.select(*string_columns(df))


def align_features(df: DataFrame, feature_names: Sequence[str]) -> DataFrame:
    """Reorder to training features; extra columns dropped; missing ones raise."""
    missing = [c for c in feature_names if c not in df.columns]
    if missing:
        raise ValueError(f"scoring frame lacks features {missing}")
    return df.select(*feature_names)


def filter_date_range(df: DataFrame, ts_col: str, start, end) -> DataFrame:
    """start 00:00:00 .. end 23:59:59.999999 inclusive; start = end - 1 day when start > end."""
    import datetime as dt
    s = dt.date.fromisoformat(str(start)[:10])
    e = dt.date.fromisoformat(str(end)[:10])
    if s > e:
        s = e - dt.timedelta(days=1)
    lo = dt.datetime.combine(s, dt.time.min)
    hi = dt.datetime.combine(e, dt.time.max)
    c = F.col(ts_col).cast("timestamp_ntz")
    return df.where((c >= F.lit(lo).cast("timestamp_ntz")) & (c <= F.lit(hi).cast("timestamp_ntz")))


def filter_entity(df: DataFrame, id_col: str, ids=None, first_n: int | None = None) -> DataFrame:
    """One id, a list of ids, or the first n ids in id order (semi join to the top-n ids)."""
    if ids is not None:
        ids = ids if isinstance(ids, (list, tuple, set)) else [ids]
        return df.where(F.col(id_col).isin(*list(ids)))
    if first_n is not None:
        top = df.select(id_col).distinct().orderBy(id_col).limit(first_n)
        return df.join(F.broadcast(top), id_col, "left_semi")
    return df


def filter_above_threshold(df: DataFrame, score_col: str, threshold: float, inclusive: bool = True) -> DataFrame:
    c = F.col(score_col)
    return df.where(c >= threshold if inclusive else c > threshold)


def filter_events(df: DataFrame, flag_col: str) -> DataFrame:
    return df.where(F.col(flag_col) == 1)


def dataset_profile(df: DataFrame, targets: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(summary row, target value counts incl. nulls) - one aggregation + one grouped count."""
    num = numeric_columns(df)
    txt = string_columns(df)
    n_cols = len(df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"_n_{i}")
                                                    for i, c in enumerate(df.columns)])
    null_sum = sum([F.col(f"_n_{i}") for i in range(n_cols)], F.lit(0))
    summary = agg.select("rows", F.lit(n_cols).cast("long").alias("columns"),
                         F.lit(len(num)).cast("long").alias("numeric_columns"),
                         F.lit(len(txt)).cast("long").alias("text_columns"),
                         null_sum.cast("long").alias("null_cells"),
                         (null_sum * 100.0 / F.nullif(F.col("rows") * n_cols, F.lit(0))).alias("null_percent"))
    if targets:
        long = df.select(*[F.col(t).cast("string").alias(t) for t in targets]).unpivot([], list(targets), "target", "value")
        counts = long.groupBy("target", "value").agg(F.count(F.lit(1)).alias("count"))
    else:
        counts = df.sparkSession.createDataFrame([], "target string, value string, count bigint")
    return summary, counts


def feature_roles(df: DataFrame, targets: Sequence[str] = ()) -> dict[str, list[str]]:
    t = set(targets)
    return {"categorical": [c for c in string_columns(df) if c not in t],
            "continuous": [c for c in numeric_columns(df) if c not in t],
            "target": [c for c in df.columns if c in t]}


def top_n_by(df: DataFrame, value_col: str, n: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Top n rows by value per group (row_number over the group, ties by all columns)."""
    if not group_cols:
        return df.orderBy(F.col(value_col).desc()).limit(n)
    w = Window.partitionBy(*group_cols).orderBy(F.col(value_col).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def names_matching(df: DataFrame, regex: str) -> list[str]:
    r = re.compile(regex)
    return [c for c in df.columns if r.search(c)]
