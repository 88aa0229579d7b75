"""Rank correlations of all feature pairs: Spearman's rho and Kendall's tau-b, over the rows that have both values.

Rows shrink to counts of distinct (x, y) per pair at once.  Ranks and ties come from the counts of each side's
values and their prefix sums.  Kendall's discordant pairs are counted by merging: blocks of neighbouring values
along either side hold a bounded number of points and count their own inversions in a task; what lies in
different blocks on both sides is the same question on the grid of blocks, which is at most a quarter as large.
"""

from __future__ import annotations

import math
from decimal import Decimal
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import prefix_sums
from tidemark.session import stored

#: Points of a block, about: a block holds less than twice as many.
BLOCK = 200_000


def _value(c: str):
    """The column as double, NaN as null."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, x, y, n): how many rows have x and y, where both are there; ``pair`` numbers the given pairs."""
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), _value(a).alias("x"), _value(b).alias("y"))
                      for i, (a, b) in enumerate(pairs)])
    return (df.select(F.inline(cells)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
            .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n")))


def _sides(points: DataFrame, n_buckets: int) -> DataFrame:
    """(pair, side, v, n, m, n_before, m_before): rows n and points m of each value, and those of smaller values."""
    both = F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("v")),
                   F.struct(F.lit("y").alias("side"), F.col("y").alias("v")))
    v = points.select("pair", "n", F.inline(both)).groupBy("pair", "side", "v").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))
    return prefix_sums(stored(v, "rank-values"), ["pair", "side"], "v", ["n", "m"], n_buckets)


def _joined(points: DataFrame, sides: DataFrame, col: str) -> DataFrame:
    """Points with their values' ``col`` as ``col_x`` and ``col_y``."""
    for s in ("x", "y"):
        points = points.join(sides.where(F.col("side") == s).select("pair", F.col("v").alias(s), F.col(col).alias(f"{col}_{s}")),
                             ["pair", s])
    return points


def _largest(points: DataFrame) -> int:
    return points.groupBy("pair").count().agg(F.max("count")).first()[0] or 0


def _buckets(largest: int) -> int:
    return min(2048, max(16, largest // 500_000))


def spearman(points: DataFrame) -> DataFrame:
    """(pair, r): Pearson's r of average ranks; null where a side is constant."""
    totals = points.groupBy("pair").agg(F.sum("n").alias("n_all"))
    ranks = stored(_sides(points, _buckets(_largest(points))).join(F.broadcast(totals), "pair").withColumn(
        "rank", F.col("n_before") + (F.col("n") - F.col("n_all")) / 2), "ranks")  # average rank less the mean rank
    spread = ranks.groupBy("pair").agg(*[F.sum(F.when(F.col("side") == s, F.col("n") * F.col("rank") * F.col("rank"))).alias(f"v_{s}")
                                         for s in ("x", "y")])
    cov = _joined(points, ranks, "rank").groupBy("pair").agg(F.sum(F.col("n") * F.col("rank_x") * F.col("rank_y")).alias("c"))
    return cov.join(F.broadcast(spread), "pair").select(
        "pair", F.try_divide(F.col("c"), F.sqrt("v_x") * F.sqrt("v_y")).alias("r"))


def inversions(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Weight of the point pairs with x_i < x_j and y_i > y_j, bit by bit over the ranks of y."""
    order = np.lexsort((y, x))
    r = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    w = n[order].astype(np.int64)
    if float(w.sum()) ** 2 >= 2.0 ** 62:
        w = w.astype(object)
    total = 0
    for b in range(int(r.max(initial=0)).bit_length() - 1, -1, -1):
        node, one = r >> (b + 1), (r >> b) & 1
        first = np.searchsorted(node, node, side="left")
        high = w * one
        through = np.cumsum(high)
        before = through - through[first] + high[first]  # weight with the bit, in this node up to here
        total += int((w * before)[one == 0].sum())
        order = np.argsort(r >> b, kind="stable")
        r, w = r[order], w[order]
    return total


def _count_block(key, table):
    """One block's discordant pairs."""
    d = inversions(*(table.column(c).to_numpy() for c in ("x", "y", "n")))
    return pa.table({"pair": pa.array([key[0].as_py()], pa.int32()), "d": pa.array([Decimal(d)], pa.decimal128(38, 0))})


def discordant(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pair, d): exact number of discordant row pairs.

    A block takes the values whose points start within its range, a value with more points than a block stands
    alone (odd numbers) and has no pair of its own to count.  Block numbers rise with the values, so a discordant
    pair lies in one block along x, or in one along y only, or in two on both sides: these three are added up.
    """
    parts = []
    while True:
        largest = _largest(points)
        if largest <= block:
            parts.append(points.select("pair", F.lit(0.0).alias("b"), "x", "y", "n"))
            break
        size = max(block, math.ceil(4 * math.sqrt(largest)))  # so that the grid has at most a quarter as many points
        at = (2 * F.floor(F.col("m_before") / size) + (F.col("m") > size).cast("long")).cast("double")
        cut = stored(_joined(points, _sides(points, _buckets(largest)).withColumn("b", at), "b"), "rank-blocks")
        parts.append(cut.where("b_x % 2 = 0").select("pair", F.col("b_x").alias("b"), "x", "y", "n"))
        parts.append(cut.where("b_y % 2 = 0").groupBy("pair", F.col("b_y").alias("b"), F.col("b_x").alias("x"), "y")
                     .agg(F.sum("n").alias("n")))
        points = stored(cut.groupBy("pair", F.col("b_x").alias("x"), F.col("b_y").alias("y")).agg(F.sum("n").alias("n")), "rank-grid")
    counted = [p.groupBy("pair", "b").applyInArrow(_count_block, "pair int, d decimal(38,0)") for p in parts]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out.groupBy("pair").agg(F.sum("d").alias("d"))


def kendall(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pair, r): tau-b, (concordant - discordant) over the root of the pairs untied in x and those untied in y."""
    two = lambda n: (n.cast("decimal(19,0)") * (n - 1).cast("decimal(19,0)") / 2).cast("decimal(38,0)")
    ties = _sides(points, _buckets(_largest(points))).groupBy("pair").agg(
        *[F.sum(F.when(F.col("side") == s, two(F.col("n")))).alias(f"t_{s}") for s in ("x", "y")])
    whole = points.groupBy("pair").agg(F.sum("n").alias("n_all"), F.sum(two(F.col("n"))).alias("t_xy"))
    t = whole.join(F.broadcast(ties), "pair").join(F.broadcast(discordant(points, block)), "pair")
    free_x, free_y = two(F.col("n_all")) - F.col("t_x"), two(F.col("n_all")) - F.col("t_y")
    excess = free_x - F.col("t_y") + F.col("t_xy") - 2 * F.col("d")
    return t.select("pair", F.try_divide(excess.cast("double"), F.sqrt(free_x.cast("double")) * F.sqrt(free_y.cast("double"))).alias("r"))


def rank_correlation_matrix(df: DataFrame, features: Sequence[str], method: str = "spearman",
                            upper_only: bool = False, block: int = BLOCK) -> DataFrame:
    """(feature_a, feature_b, r) for all feature pairs by ``method`` ("spearman" or "kendall"); 1 on the diagonal.

    Null and NaN are missing, pair by pair.  r is null where a side is constant among the pair's rows, or no row has both.
    Values are compared as doubles.  ``upper_only`` leaves out the diagonal and the mirrored half.
    """
    if method not in ("spearman", "kendall"):
        raise ValueError(f"unknown method {method!r}")
    feats = list(features)
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    spark = df.sparkSession
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, feature_a string, feature_b string")
    if pairs:
        df = stored(df.select(*feats), "rank-rows")
        points = stored(pair_counts(df, pairs), "rank-points")
        r = spearman(points) if method == "spearman" else kendall(points, block)
        half = names.join(F.broadcast(r), "pair", "left").select("feature_a", "feature_b", "r")
    else:
        half = names.select("feature_a", "feature_b", F.lit(None).cast("double").alias("r"))
    if upper_only:
        return half
    own = df.agg(*[F.when(F.min(_value(f)) < F.max(_value(f)), F.lit(1.0)).alias(f"r{i}") for i, f in enumerate(feats)])
    diagonal = own.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature_a"), F.lit(f).alias("feature_b"), F.col(f"r{i}").alias("r"))
                                             for i, f in enumerate(feats)])))
    return half.unionByName(half.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "r")).unionByName(diagonal)
