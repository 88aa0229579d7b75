"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each step is a partial aggregation over a few bytes a row, so a group of copies that holds a third
of all rows reaches the shuffle as one row per map task.  The full text is hashed only in groups
of equal length and equal prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_CHARS = 256


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_chars: int = PREFIX_CHARS, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept; ``extra`` adds columns of docs.

    A null text counts as empty.  Of equal texts the largest id stays (null is below every id).
    Rows that repeat an id with the same text are the same document: they count in group_size, and
    stay or go together.  Other columns of ``docs`` are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).alias("_size")
    head = F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_head")

    sizes = docs.select(size).groupBy("_size").agg(F.count("*").alias("_n")).filter("_n > 1").select("_size")
    heads = (docs.select(size, head).join(sizes, "_size", "left_semi")
             .groupBy("_size", "_head").agg(F.count("*").alias("_n")).filter("_n > 1")
             .select("_size", "_head", F.lit(True).alias("_open")))
    more = [c.alias(f"_x_{name}") for name, c in (extra or {}).items()]
    rows = (docs.select(F.col(id_col).alias("_id"), text.alias("_text"), size, head, *more)
            .join(heads, ["_size", "_head"], "left")
            # a settled row gets a key of its own, so that such rows don't meet in one task
            .select("_id", *[f"_x_{name}" for name in extra or {}],
                    F.when(F.col("_open"), F.unhex(F.sha2("_text", 256)))
                    .otherwise(F.concat(F.lit("#"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
                               .cast("binary")).alias("_key"), "_open"))
    groups = (rows.filter("_open").groupBy("_key")
              .agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")))
    return (rows.join(groups, "_key", "left")
            .select(F.col("_id").alias(id_col),
                    F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
                    F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("_n").isNull() | F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
                    *[F.col(f"_x_{name}").alias(name) for name in extra or {}]))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; an id goes when none of its rows stays."""
    dropped = (exact_duplicates(docs, id_col, text_col).groupBy(F.col(id_col).alias("_gone"))
               .agg(F.max("kept").alias("_kept")).filter(~F.col("_kept")).select("_gone"))
    return docs.join(dropped, docs[id_col].eqNullSafe(dropped["_gone"]), "left_anti")
