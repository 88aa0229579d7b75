"""Cohort file reader / writers.

``read_cohort`` always takes an explicit path (file, directory or glob) and an explicit
schema when one is known; the configured ``na_strings`` become nulls (pandas also turns
the text ``None`` into a missing value, so it is in the default list).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NA_STRINGS = ("", "NA", "NaN", "None", "null")

# Coded item -> descriptive item name for the 30-item symptom scale.
ITEM_NAMES = {
    "P1": "Delusions", "P2": "Conceptual disorganization", "P3": "Hallucinatory behaviour", "P4": "Excitement",
    "P5": "Grandiosity", "P6": "Suspiciousness", "P7": "Hostility",
    "N1": "Blunted affect", "N2": "Emotional withdrawal", "N3": "Poor rapport",
    "N4": "Passive/apathetic social withdrawal", "N5": "Difficulty in abstract thinking",
    "N6": "Lack of spontaneity and flow of conversation", "N7": "Stereotyped thinking",
    "G1": "Somatic concern", "G2": "Anxiety", "G3": "Guilt feelings", "G4": "Tension",
    "G5": "Mannerisms & posturing", "G6": "Depression", "G7": "Motor retardation",
    "G8": "Uncooperativeness", "G9": "Unusual thought content", "G10": "Disorientation",
    "G11": "Poor attention", "G12": "Lack of judgment and insight", "G13": "Disturbance of volition",
    "G14": "Poor impulse control", "G15": "Preoccupation", "G16": "Active social avoidance",
}


def read_cohort(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                na_strings: Sequence[str] = NA_STRINGS, infer: bool = False) -> DataFrame:
    """CSV with header; listed NA strings -> null on every string column; NaN -> null on doubles."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(F.trim(c).isin(*na_strings) | c.isNull(), F.lit(None).cast("string"))
                       .otherwise(c).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            out.append(c.alias(f.name))
    return df.select(*out)


def rename_items(df: DataFrame, prefix: str = "M0_PANSS_", names: Mapping[str, str] = ITEM_NAMES) -> DataFrame:
    """``M0_PANSS_P1`` -> ``P1: Delusions`` for every coded item column present."""
    m = {f"{prefix}{k}": f"{k}: {v}" for k, v in names.items() if f"{prefix}{k}" in df.columns}
    return df.withColumnsRenamed(m)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path
