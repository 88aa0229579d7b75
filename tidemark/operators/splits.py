"""Deterministic, exact and skew-safe splits (train/test, stratified K-fold, temporal,
bootstrap).

Exact stratified allocation needs each row's rank inside its stratum under a seeded
hash order.  A window ``partitionBy(stratum)`` would put a whole stratum (maybe a third
of the data) in one task, so ``stratified_rank`` ranks in two phases: the hash order is
cut into equal-width hash buckets (bucket count per stratum sized from its row count),
bucket counts form a tiny prefix table, and only rows inside one bucket are sorted
together.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
ROWS_PER_BUCKET = 100_000   # one task sorts a bucket, so that few large ones would leave later stages to few tasks
HEX_PREFIX = 12            # 48 bits of the md5 order key
SLOT_DIGITS = 3            # rows are counted in 4096 slots of the order key, of which buckets are made


def order_key(id_col: str, seed: int = SEED) -> Column:
    """Portable seeded order key: md5(id || '-seed') (same order in DuckDB)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null: the keys, then left's and right's other columns."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, same, how).select(*keys, *[c for c in [*left.columns, *right.columns] if c not in keys])


def stratified_rank(df: DataFrame, strata: Sequence[str], id_col: str, seed: int = SEED,
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``_rank`` (0-based, by md5 order within stratum) and ``_n`` (stratum size).  Null is a
    stratum like any other, and a null id has an order key of its own."""
    strata = list(strata)
    key = F.coalesce(order_key(id_col, seed), F.md5(F.lit(f"-{seed}-")))
    slot = F.conv(F.substring(key, 1, SLOT_DIGITS), 16, 10).cast("long")
    slots = df.groupBy(*strata, slot.alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    # a row per stratum (label / risk levels / folds): its rows, its buckets' first slots and the rows before each
    own = slots.groupBy(*strata).agg(F.sum("_c").alias("_n"), F.array_sort(F.collect_list(F.struct("_s", "_c"))).alias("_slots"))
    own = own.withColumn("_nb", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(rows_per_bucket))).cast("long"))
    bucket = lambda s, nb: F.floor(s * nb / F.lit(float(16 ** SLOT_DIGITS))).cast("long")
    x = df.withColumn("_key", key)
    per = own.select(*strata, "_n", "_nb", F.inline("_slots")).groupBy(*strata, "_n", "_nb", bucket(F.col("_s"), F.col("_nb")).alias("_b")).agg(
        F.sum("_c").alias("_bc"))
    wb = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn("_off", F.coalesce(F.sum("_bc").over(wb), F.lit(0))).groupBy(*strata, "_n", "_nb").agg(
        F.map_from_entries(F.collect_list(F.struct("_b", "_off"))).alias("_offs"))
    x = null_safe_join(x, F.broadcast(offs), strata).withColumn(
        "_b", bucket(F.conv(F.substring("_key", 1, SLOT_DIGITS), 16, 10).cast("long"), F.col("_nb")))
    x = x.withColumn("_off", F.element_at("_offs", F.col("_b"))).drop("_offs")
    w = Window.partitionBy(*strata, "_b").orderBy("_key")
    return x.withColumn("_rank", F.col("_off") + F.row_number().over(w) - 1).drop("_b", "_off", "_nb", "_key")


def train_test_split(df: DataFrame, id_col: str, strat_col: str | None = None, test_size: float = 0.3,
                     seed: int = SEED) -> DataFrame:
    """Adds ``split`` = test for the first ceil(test_size * n) rows of each stratum in
    seeded md5 order, train otherwise (not stratified: one stratum)."""
    if strat_col is None:
        d = df.withColumn("_all", F.lit(0))
        strata = ["_all"]
    else:
        d, strata = df, [strat_col]
    r = stratified_rank(d, strata, id_col, seed)
    n_test = F.ceil(F.col("_n") * F.lit(float(test_size)))
    out = r.withColumn("split", F.when(F.col("_rank") < n_test, F.lit("test")).otherwise(F.lit("train")))
    return out.drop("_rank", "_n", *(["_all"] if strat_col is None else []))


def risk_stratified_split(df: DataFrame, id_col: str, policy, label_col: str = "label", test_size: float = 0.3,
                          seed: int = SEED) -> DataFrame:
    d = df.withColumn("risk_level", policy.risk_expr(label_col, "moderate_risk"))
    return train_test_split(d, id_col, "risk_level", test_size, seed)


def stratified_kfold(df: DataFrame, id_col: str, strat_col: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """fold = rank % k inside each stratum (sizes differ by at most 1 per stratum)."""
    r = stratified_rank(df, [strat_col], id_col, seed)
    return r.withColumn("fold", (F.col("_rank") % k).cast("long")).drop("_rank", "_n")


def risk_stratified_kfold(df: DataFrame, id_col: str, policy, label_col: str = "label", k: int = 5,
                          seed: int = SEED) -> DataFrame:
    d = df.withColumn("risk_level", policy.risk_expr(label_col, "moderate_risk"))
    return stratified_kfold(d, id_col, "risk_level", k, seed)


def temporal_split(df: DataFrame, time_col: str, min_train_periods: int = 1, step: int = 1,
                   max_train_periods: int | None = None) -> DataFrame:
    """Expanding-window splits over distinct periods: split i tests period i and trains on
    the periods before it (the last ``max_train_periods`` if set).  One tagged frame
    ``(split_id, role, ...)``; the distinct-period table is small and ranked once."""
    periods = df.select(time_col).distinct()
    periods = periods.withColumn("_pi", F.dense_rank().over(Window.orderBy(time_col)) - 1)
    x = df.join(F.broadcast(periods), time_col, "inner")
    n = periods.count()
    tests = list(range(min_train_periods, n, step))
    if not tests:
        return x.limit(0).withColumn("split_id", F.lit(0)).withColumn("role", F.lit(""))
    arr = F.array(*[F.lit(t) for t in tests])
    # each row belongs to the test set of split (_pi) and to the train set of later splits
    lo_ok = (lambda t: F.col("_pi") >= t - max_train_periods) if max_train_periods else (lambda t: F.lit(True))
    tags = F.filter(F.transform(arr, lambda t: F.struct(t.alias("split_id"),
                                                        F.when(F.col("_pi") == t, F.lit("test"))
                                                        .when((F.col("_pi") < t) & lo_ok(t), F.lit("train"))
                                                        .alias("role"))),
                    lambda s: s["role"].isNotNull())
    return x.withColumn("_tag", F.explode(tags)).select(
        F.col("_tag.split_id").cast("long").alias("split_id"), F.col("_tag.role").alias("role"),
        *[c for c in df.columns]).drop("_pi")


def poisson_draw(id_col: str, replicate: Column, seed: int) -> Column:
    """Poisson(1) multiplicity of a row in a replicate, from md5 of id, seed and replicate (the same in any engine)."""
    key = F.md5(F.concat_ws("-", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed)), replicate.cast("string")))
    u = F.conv(F.substring(key, 1, HEX_PREFIX), 16, 10).cast("double") / float(16 ** HEX_PREFIX)
    return sum((F.when(u > F.lit(c), 1).otherwise(0) for c in poisson_steps()), F.lit(0)).cast("long")


def poisson_steps(n: int = 16) -> list[float]:
    """Distribution function of Poisson(1) at 0 .. n - 1."""
    out, acc = [], 0.0
    for k in range(n):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


def poisson_weights(df: DataFrame, id_col: str, n_boot: int, seed: int = SEED) -> DataFrame:
    """(replicate, row) Poisson(1) multiplicities keyed by the row's id - the bootstrap sample
    without materialising n x B rows (rows with weight 0 are dropped)."""
    reps = F.sequence(F.lit(0), F.lit(n_boot - 1))
    x = df.withColumn("replicate", F.explode(reps))
    return x.withColumn("weight", poisson_draw(id_col, F.col("replicate"), seed)).where("weight > 0")


def bootstrap_sample(df: DataFrame, id_col: str, replicate: int = 0, seed: int = SEED) -> DataFrame:
    """One with-replacement resample, for refits: each row as often as its md5-keyed draw says, numbered ``copy``.

    The same rows come out after any repartition, and on a rerun; a null id has one draw.
    """
    weight = poisson_draw(id_col, F.lit(replicate), seed)
    x = df.withColumn("_weight", weight).where("_weight > 0")
    return x.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_weight")))).drop("_weight")


def thirty_row_window(df: DataFrame, order_col: str, id_col: str, head: int = 10) -> DataFrame:
    """After sorting: first, middle and last ``head`` rows when there are more than 3*head rows.

    Ranks come from ``stratified_rank``-style two-phase counting over ``order_col``
    buckets, not a single global window.
    """
    from tidemark.operators.metrics import prefix_sums
    x = df.withColumn("_one", F.lit(1)).withColumn("_g", F.lit(0))
    keyed = x.withColumn("_ord", F.struct(F.col(order_col), F.col(id_col)))
    # unique order: (order_col, id); rank = rows strictly before
    agg = keyed.groupBy("_g", F.col(order_col).alias("_o")).agg(F.count(F.lit(1)).alias("_c"))
    ranked_vals = prefix_sums(agg, ["_g"], "_o", ["_c"], n_buckets=64)
    n = df.count()
    y = keyed.join(ranked_vals.select("_g", F.col("_o").alias(order_col), "_c_before"), ["_g", order_col])
    w = Window.partitionBy("_g", order_col).orderBy(id_col)
    y = y.withColumn("_rank", F.col("_c_before") + F.row_number().over(w) - 1)
    if n <= 3 * head:
        sel = F.lit(True)
    else:
        mid = (n - head) // 2
        sel = (F.col("_rank") < head) | ((F.col("_rank") >= mid) & (F.col("_rank") < mid + head)) | \
              (F.col("_rank") >= n - head)
    return y.where(sel).select(*df.columns, F.col("_rank").cast("long").alias("position"))


def balanced_group_kfold(df: DataFrame, group_col: str, label_col: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Groups never split across folds, dealt evenly by main class and size.

    A group's stratum is its most frequent label (the smallest on ties) and the number of binary
    digits of its row count, so groups of a stratum are alike and within a factor of two in size;
    ranks in seeded md5 order inside the stratum deal them to the folds in turn, each stratum
    starting one fold further.  One rule for any number of groups; only counts are shuffled.  Rows
    without a group are one group, and null is a class like any other.
    """
    cells = df.groupBy(group_col, label_col).agg(F.count(F.lit(1)).alias("_n"))
    groups = cells.groupBy(group_col).agg(
        F.sum("_n").alias("_size"), F.max(F.struct("_n", (-F.col(label_col).cast("long")).alias("_l"))).alias("_top"))
    groups = groups.select(group_col, (-F.col("_top._l")).alias("_main"), F.length(F.bin("_size")).alias("_digits"))
    ranked = stratified_rank(groups, ["_main", "_digits"], group_col, seed)
    first = F.coalesce(F.col("_main"), F.lit(-1)) + F.col("_digits")
    folds = ranked.select(group_col, F.pmod(F.col("_rank") + first, F.lit(k)).cast("long").alias("fold"))
    return null_safe_join(df, folds, [group_col], "left")
