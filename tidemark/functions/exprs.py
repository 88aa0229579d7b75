"""Column-expression helpers shared by every operator (all JVM-side built-ins)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, null when b is 0 or null (ANSI mode would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def row_sum(cols: Iterable, null_as_zero: bool = True) -> Column:
    cs = [F.coalesce(col(c), F.lit(0.0)) if null_as_zero else col(c) for c in cols]
    return reduce(lambda x, y: x + y, cs) if cs else F.lit(0.0)


def row_count_present(cols: Iterable) -> Column:
    cs = [F.when(col(c).isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in cols]
    return reduce(lambda x, y: x + y, cs) if cs else F.lit(0)


def row_mean(cols: Iterable) -> Column:
    """Null-skipping mean across columns of one row (pandas ``mean(axis=1)``)."""
    cols = list(cols)
    if not cols:
        return F.lit(None).cast("double")
    return safe_div(row_sum(cols), F.nullif(row_count_present(cols), F.lit(0)))


def row_max(cols: Iterable) -> Column:
    cols = [col(c) for c in cols]
    if not cols:
        return F.lit(None).cast("double")
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def flag(cond: Column) -> Column:
    """Boolean condition as 0/1 integer, null/false -> 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")


def bias_corrected_skewness(c) -> Column:
    """Sample skewness G1 as pandas/scipy(bias=False) report it; Spark's is population g1."""
    n = F.count(col(c)).cast("double")
    g1 = F.skewness(col(c))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def last_by_time(value, *order) -> Column:
    """Value at the latest ordering among rows where value is not null."""
    v = col(value)
    return F.max_by(v, F.when(v.isNotNull(), F.struct(*[col(o) for o in order])))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def round_cmp(c, digits: int = 6) -> Column:
    """Comparison rounding: two stages (collapse last-bit summation noise first), each
    as round(x * 10^d) / 10^d - the arithmetic DuckDB's round(double, d) uses - and -0.0
    normalised to 0.0."""
    x = col(c).cast("double")
    s1 = F.round(x * F.lit(10.0 ** (digits + 3)), 0) / F.lit(10.0 ** (digits + 3))
    return F.round(s1 * F.lit(10.0 ** digits), 0) / F.lit(10.0 ** digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (and normalise -0.0) for cross-engine comparison."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_cmp(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sig_round(c, digits: int = 10) -> Column:
    """Scientific text with ``digits`` significant digits (for comparing statistics of
    large magnitude across engines; engines parse such text differently, so keep it text)."""
    return F.format_string(f"%.{digits - 1}e", col(c))


def sig_sql(expr: str, digits: int = 10) -> str:
    """DuckDB twin of ``sig_round``."""
    return f"printf('%.{digits - 1}e', {expr})"
