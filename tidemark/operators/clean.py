"""Cohort cleaning and missing-data handling.

Imputation statistics (medians, modes, means, stds) are *fitted* once with a few
aggregations and then applied as literals in a single projection, so scoring any
partition gives the same result as scoring the whole table.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import numeric_columns, string_columns
from tidemark.functions.stats import exact_median
from tidemark.operators.neighbours import nearest_means
from tidemark.operators.stages import StatefulModel
from tidemark.session import stored

OUTCOMES = ("M6_Rem", "Y1_Rem", "Y1_Rem_6")


def clean_outcomes(df: DataFrame, cols: Sequence[str] = OUTCOMES) -> DataFrame:
    """Keep rows where every outcome column is present."""
    return df.dropna(subset=[c for c in cols if c in df.columns])


def drop_unlabelled(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.dropna(subset=[label_col])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns if present (no-op otherwise)."""
    return df.drop(*[c for c in cols if c in df.columns])


def fit_medians(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float | None]:
    cols = numeric_columns(df) if cols is None else list(cols)
    return exact_median(df, cols)


def fit_modes(df: DataFrame, cols: Sequence[str] | None = None, all_null: str = "Unknown") -> dict[str, str]:
    """Most frequent value per column, ties -> smallest value; all-null column -> ``all_null``.

    One unpivot + one partial aggregation of (column, value) counts, then a min over
    struct(-count, value) per column - no single task sees a whole column.
    """
    cols = string_columns(df) if cols is None else list(cols)
    if not cols:
        return {}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "col", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("col").agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col("value"))).alias("b"))
    got = {r["col"]: r["b"]["value"] for r in best.collect()}      # one row per column
    return {c: got.get(c, all_null) for c in cols}


def impute_median(df: DataFrame, cols: Sequence[str] | None = None, medians: Mapping | None = None) -> DataFrame:
    cols = numeric_columns(df) if cols is None else list(cols)
    med = fit_medians(df, cols) if medians is None else medians
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c]).cast(df.schema[c].dataType))
                           for c in cols if med.get(c) is not None})


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None, modes: Mapping | None = None) -> DataFrame:
    cols = string_columns(df) if cols is None else list(cols)
    mo = fit_modes(df, cols) if modes is None else modes
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(mo[c])) for c in cols})


def fit_mean_std(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> dict[str, tuple]:
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    row = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), sd(c).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standardize_for_impute(df: DataFrame, cols: Sequence[str], stats: Mapping | None = None) -> DataFrame:
    """(x - mean) / sample std where std > 0; other columns untouched."""
    st = fit_mean_std(df, cols, 1) if stats is None else stats
    out = {}
    for c in cols:
        m, s = st[c]
        if s is not None and s > 0:
            out[c] = (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(out)


def preprocess_for_ml(df: DataFrame, label_col: str = "label", drop: Sequence[str] = OUTCOMES,
                      dummies: bool | str = False) -> DataFrame:
    """Median-fill numerics, mode-fill text, keep numeric features + integer label.

    ``dummies=True`` keeps the categoricals as full one-hot columns (no level dropped); "sparse" as one
    sparse vector ``categories``, for any number of levels.
    """
    from tidemark.operators.features import one_hot
    d = drop_columns(df, [c for c in drop if c != label_col])
    num = [c for c in numeric_columns(d) if c != label_col]
    cat = [c for c in string_columns(d) if c != label_col]
    d = impute_median(d, num)
    if dummies == "sparse" and cat:
        from tidemark.operators.categories import one_hot_sparse
        d = one_hot_sparse(impute_mode(d, cat), cat, drop_first=False)
        keep = [*num, "categories"]
    elif dummies and cat:
        d = impute_mode(d, cat)
        d = one_hot(d, cat, drop_first=False)
        keep = [c for c in d.columns if c != label_col and c not in cat]
    else:
        keep = num
    return d.select(*keep, F.col(label_col).cast("long").alias(label_col))


class MedianModeImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fit exact medians (numeric) and modes (text) once; transform fills nulls."""

    def _fit(self, dataset: DataFrame) -> "MedianModeImputerModel":
        cols = self.getInputCols() if self.isDefined("inputCols") else dataset.columns
        num = [c for c in cols if c in numeric_columns(dataset)]
        txt = [c for c in cols if c in string_columns(dataset)]
        return MedianModeImputerModel({"medians": fit_medians(dataset, num), "modes": fit_modes(dataset, txt)})


class MedianModeImputerModel(StatefulModel):
    """Fitted medians and modes; saved and read with its state."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        medians, modes = self.state["medians"], self.state["modes"]
        return impute_mode(impute_median(dataset, list(medians), medians), list(modes), modes)


# ---------------------------------------------------------------------------
# exact k-nearest-neighbour imputation without all pairs
# ---------------------------------------------------------------------------

def impute_knn(df: DataFrame, id_col: str, cols: Sequence[str], k: int = 5, bucket_size: int = 1024,
               standardize: bool = True) -> DataFrame:
    """k-NN imputation (uniform mean of the k nearest donors under nan-euclidean distance),
    exact, without emitting all pairs.

    Output columns are the (z-scored when ``standardize``) features with missing cells
    filled - the reference returns z-scores and never scales back.

    Each missing cell looks for donors in the cells of about ``bucket_size`` rows that lie
    within its k-th distance (see ``neighbours``).  Ties: (distance rounded to 1e-9, donor id).
    No common coordinate -> no distance (excluded); no valid donor -> column mean.
    """
    cols = list(cols)
    z = df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols])
    z = stored(z, "knn-rows")
    if standardize:
        st = fit_mean_std(z, cols, 1)
        z = z.select("_id", *[((F.col(c) - F.lit(st[c][0])) / F.lit(st[c][1])).alias(c)
                              if st[c][1] else F.col(c).alias(c) for c in cols])
    agg = z.agg(*[F.count(c).alias(f"n_{c}") for c in cols], *[F.avg(c).alias(f"m_{c}") for c in cols],
                F.count(F.lit(1)).alias("_n")).first()
    if all(agg[f"n_{c}"] in (0, agg["_n"]) for c in cols):
        return z.withColumnRenamed("_id", id_col)
    v = nearest_means(z, cols, k, bucket_size)
    # (a null id gets no fill, and a value without donors the column's mean)
    fills = v.groupBy("_id").agg(*[F.max(F.when(F.col("_col") == i, F.col("_v"))).alias(f"_f_{i}") for i in range(len(cols))])
    mean = lambda c: F.when(F.col("_id").isNotNull(), F.lit(agg[f"m_{c}"]).cast("double"))
    out = z.join(fills, "_id", "left").select(
        "_id", *[F.coalesce(F.col(c), F.col(f"_f_{i}"), mean(c)).alias(c) for i, c in enumerate(cols)])
    return out.withColumnRenamed("_id", id_col)
