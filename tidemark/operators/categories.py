"""Categories as a distributed dictionary, and one-hot coding as sparse vectors.

Category values never come to the driver: they are counted with partial aggregates, sorted by range, numbered
by place within range plus the rows of the ranges before, and joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoderModel, OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: Dictionary rows of a column that are broadcast; larger ones are joined in salted shares.
MOST_BROADCAST = 200_000


def category_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col, value, n, index): distinct values as text, numbered from 0 in their order within the column, null last.

    Written to the shared folder, so that later readers don't count again.
    """
    spark = df.sparkSession
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]))
    counts = df.select(pairs).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    order = ["col", F.col("value").asc_nulls_last()]
    path = scratch_path(spark, "categories-")
    (counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
     .write.parquet(path))
    cut = spark.read.parquet(path).withColumn("_part", F.shiftright("_mid", 33))
    # a row a partition and column: where the column starts in the partition, and how much of it came before
    runs = cut.groupBy("col", "_part").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("col").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("col", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return (cut.join(F.broadcast(runs), ["col", "_part"])  # columns x partitions rows
            .select("col", "value", "n", (F.col("_mid") - F.col("_first") + F.col("_before")).alias("index")))


def index_categories(df: DataFrame, cols: Sequence[str], dictionary: DataFrame, suffix: str = "_index") -> DataFrame:
    """``df`` with a column ``<col>_index`` for each column: the value's number, or null if the dictionary lacks it."""
    sizes = {r["col"]: r["k"] for r in dictionary.groupBy("col").agg(F.count(F.lit(1)).alias("k")).collect()}  # a row a column
    out = df
    for c in cols:
        # text can't be null in a join key, so a null is a key of its own
        key = lambda v: F.coalesce(F.concat(F.lit("="), v), F.lit(""))
        own = dictionary.filter(F.col("col") == c).select(key(F.col("value")).alias("_key"), F.col("index").cast("double").alias(f"{c}{suffix}"))
        out = out.withColumn("_key", key(F.col(f"`{c}`").cast("string")))
        if sizes.get(c, 0) <= MOST_BROADCAST:
            out = out.join(F.broadcast(own), "_key", "left").drop("_key")
            continue
        salts = 16  # a value that a third of the rows have is joined in shares
        own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = out.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in df.columns]), F.lit(salts)).cast("int"))
        out = out.join(own, ["_key", "_salt"], "left").drop("_key", "_salt")
    return out


def one_hot_sparse(df: DataFrame, cols: Sequence[str], dictionary: DataFrame | None = None, drop_first: bool = True,
                   out_col: str = "categories") -> DataFrame:
    """``df`` with one sparse vector of all columns' categories, in the order of ``cols`` and of the dictionary.

    ``drop_first`` leaves out each column's first category.  Values that a given dictionary lacks have no entry.
    """
    cols = list(cols)
    words = category_dictionary(df, cols) if dictionary is None else dictionary
    sizes = {r["col"]: r["k"] for r in words.groupBy("col").agg(F.count(F.lit(1)).alias("k")).collect()}  # a row a column
    places, vectors = [f"{c}_index" for c in cols], [f"_vec{i}" for i in range(len(cols))]
    out = index_categories(df, cols, words)
    for c in cols:
        # the encoder leaves out the largest number, and what it doesn't know is one above: the first category, or
        # (where all are kept) an unknown value, goes there
        k = sizes.get(c, 0)
        at = F.col(f"`{c}_index`")
        place = F.when(at > 0, at - 1).otherwise(F.lit(float(max(k - 1, 0)))) if drop_first else F.coalesce(at, F.lit(float(k)))
        out = out.withColumn(f"{c}_index", place)
    width = [max(sizes.get(c, 0), 1) if drop_first else sizes.get(c, 0) + 1 for c in cols]
    encoder = OneHotEncoder(inputCols=places, outputCols=vectors, dropLast=True)
    rows = [tuple(float(w - 1) for w in width)]
    fitted: OneHotEncoderModel = encoder.fit(df.sparkSession.createDataFrame(rows, ", ".join(f"`{p}` double" for p in places)))
    out = fitted.transform(out)
    return VectorAssembler(inputCols=vectors, outputCol=out_col).transform(out).drop(*places, *vectors)
