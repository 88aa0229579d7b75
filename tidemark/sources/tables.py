"""Readers for the shared parquet tables and the five derived fixture views.

The fixture views (outcomes O, tabular T, longitudinal L, 8-class scored P, binary
scored B) give the operators inputs of the reference's shapes, derived by Spark from the
given tables so that their size grows with the tables.  Only the columns each view needs
are selected, so the parquet scans prune everything else (``ReadSchema``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The warning-sign map used with the longitudinal view L.
WARNING_SIGNS_L = {
    "withdrawal": ["s_view", "s_signup"],
    "agitation": ["s_error"],
    "adherence": ["s_purchase"],
    "engagement": ["s_click"],
}
SYMPTOMS_L = ["s_click", "s_view", "s_error", "s_signup", "s_purchase"]
EVENT_TYPES_L = ["click", "view", "error", "signup", "purchase"]
N_CLASSES_P = 8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _yes_no(cond) -> F.Column:
    return F.when(cond, F.lit("No")).otherwise(F.lit("Yes"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O: patient_id + the three remission outcomes (Yes/No/null)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("patient_id"),
        F.when(F.col("o_orderstatus") == "F", "No").when(F.col("o_orderstatus") == "O", "Yes").alias("M6_Rem"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(_yes_no(k % 5 < 2)).alias("Y1_Rem"),
        F.when((k % 7 == 0) | (k % 11 == 0), F.lit(None).cast("string"))
         .otherwise(_yes_no((k % 5 < 2) | (k % 3 == 0))).alias("Y1_Rem_6"),
    )


def tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: one row per order with numeric and categorical features and an 8-way label.

    Join order keeps the lineitem roll-up co-partitioned with orders on the order key
    (both sides hash-partitioned on it); the customer side is joined last on custkey.
    AQE turns either join into a broadcast only when the runtime size is under
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    li = (read_table(spark, sf_dir, "lineitem")
          .select("l_orderkey", "l_quantity", "l_discount")
          .groupBy("l_orderkey")
          .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n_lines"),
               F.avg("l_discount").alias("disc")))
    k = F.col("o_orderkey")
    j = (o.join(li, o.o_orderkey == li.l_orderkey, "left")
          .join(c, o.o_custkey == c.c_custkey, "inner"))
    return j.select(
        k.alias("row_id"),
        F.when(k % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("acctbal"),
        F.col("qty").cast("double").alias("qty"),
        F.col("n_lines").cast("double").alias("n_lines"),
        F.round("disc", 6).alias("disc"),
        F.when(k % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        (k % 8).alias("label"),
    )


def longitudinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: one row per (patient_id, day) with five sparse symptom columns.

    ``groupBy(user_id, day)`` is partial-aggregated map side, so even a user holding a
    third of all events reaches the shuffle as at most one row per (day, map task).
    """
    e = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    aggs = [F.avg(F.when(F.col("event_type") == et, F.col("value"))).alias(s)
            for et, s in zip(EVENT_TYPES_L, SYMPTOMS_L)]
    return (e.groupBy(F.col("user_id").alias("patient_id"), day.cast("long").alias("t"))
             .agg(*aggs))


def scored_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: long-form 8-class scores (row_id, y_true, t_days, cls, p).

    The 8 scores of a row are built as one array and normalised in place, then
    exploded: no cross join and no shuffle (the per-row sum is an array fold).
    """
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    y = k % N_CLASSES_P
    scores = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(N_CLASSES_P - 1).cast("long")),
        lambda c: (F.lit(1) + (k * (c * 2 + 3) + ck * (c + 1)) % 50
                   + F.when(c == y, F.lit(25)).otherwise(F.lit(0))).cast("double"))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    base = o.select(k.alias("row_id"), y.alias("y_true"), (k % 365 + 1).alias("t_days"),
                    scores.alias("_s"), total.alias("_tot"))
    return base.select("row_id", "y_true", "t_days",
                       F.posexplode("_s").alias("cls", "_v"), "_tot") \
               .select("row_id", "y_true", "t_days", F.col("cls").cast("long").alias("cls"),
                       (F.col("_v") / F.col("_tot")).alias("p"))


def scored_multiclass_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P in wide form (row_id, y_true, t_days, proba array<double> by class), no shuffle."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    y = k % N_CLASSES_P
    scores = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(N_CLASSES_P - 1).cast("long")),
        lambda c: (F.lit(1) + (k * (c * 2 + 3) + ck * (c + 1)) % 50
                   + F.when(c == y, F.lit(25)).otherwise(F.lit(0))).cast("double"))
    base = o.select(k.alias("row_id"), y.alias("y_true"), (k % 365 + 1).alias("t_days"),
                    scores.alias("_s"))
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)
    return base.select("row_id", "y_true", "t_days",
                       F.transform("_s", lambda x: x / total).alias("proba"))


def scored_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B: (row_id, y_true 0/1, score) from labels joined to document lengths.

    Only ``doc_id, n_chars`` are read from documents, never the text column.
    """
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id", "inner")
    return j.select(F.col("doc_id").alias("row_id"), F.col("toxic").cast("long").alias("y_true"),
                    F.least(F.lit(1.0), F.col("n_chars").cast("double") / F.lit(8000.0)).alias("score"))


def wide_scores(p_long: DataFrame, n_classes: int = N_CLASSES_P) -> DataFrame:
    """P long form -> one row per case with ``proba`` array ordered by class.

    Grouping by row_id is a partial aggregation; the array is assembled by class index
    (never by arrival order).
    """
    return (p_long.groupBy("row_id", "y_true", "t_days")
            .agg(F.array(*[F.max(F.when(F.col("cls") == c, F.col("p"))) for c in range(n_classes)])
                 .alias("proba")))
