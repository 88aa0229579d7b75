"""Exact distributed quantiles with bounded memory.

Spark's exact ``percentile`` aggregate keeps every distinct value of a group in one
task, and ``percentile_approx`` is approximate.  ``exact_quantiles`` gets exact
linear-interpolation quantiles (pandas / DuckDB ``quantile_cont``) by range refinement:

1. count non-null values per column and find their ends;
2. while a wanted rank's range holds more than ``limit`` rows of several values, cut it into ``BINS``
   equal widths, count all ranges' bins in one aggregation and go on with the bin of the rank
   (the ends of a range lie in different bins, so that every round narrows it);
3. rank the (value, count) pairs left in each range with a cumulative window - at most
   ``limit`` rows per range - and read off the needed order statistics.

Results are a handful of scalars per column (fitted parameters), never data-sized.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins that a range is cut into at a time.
BINS = 1024
_LARGEST = 1.7976931348623157e308


def _needed_ranks(n: int, probs: Sequence[float]) -> list[int]:
    out = set()
    for q in probs:
        pos = q * (n - 1)
        out.add(int(math.floor(pos)))
        out.add(int(math.ceil(pos)))
    return sorted(out)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], limit: int = 200_000,
                    ) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles; each wanted rank has a value range of its own, which is narrowed until it
    holds at most ``limit`` rows or one value, whatever the other ranks are.  NaN counts as the largest value."""
    cols = list(cols)
    if not cols:
        return {}
    x = df.select(*[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(cols)])
    own = df.storageLevel == StorageLevel.NONE  # several passes: what they read isn't joined or parsed again
    if own:
        x = x.persist()
    try:
        return _quantiles(x, cols, probs, limit)
    finally:
        if own:
            x.unpersist()


def _quantiles(x: DataFrame, cols: Sequence[str], probs: Sequence[float], limit: int) -> dict[str, list[float | None]]:
    names = [f"_q{i}" for i in range(len(cols))]
    row = x.agg(*[e for n in names for e in (F.count(n).alias(f"n{n}"), F.min(n).alias(f"l{n}"), F.max(n).alias(f"h{n}"))]).first()
    n_of = {n: int(row[f"n{n}"]) for n in names}
    # per rank: closed range of values, rows below it and in it
    state = {(n, r): (row[f"l{n}"], row[f"h{n}"], 0, n_of[n]) for n in names if n_of[n] for r in _needed_ranks(n_of[n], probs)}
    value: dict[tuple[str, int], float] = {}

    def ranges(wanted) -> list:
        """Different ranges of the wanted ranks, as (column, lowest, highest)."""
        return sorted({(k[0], state[k][0], state[k][1]) for k in wanted}, key=repr)

    def listed(spans, what) -> DataFrame:
        """(k, v): ``what`` of every value in range number k."""
        cells = F.array(*[F.when(F.col(n).between(F.lit(lo), F.lit(hi)), F.struct(F.lit(i).alias("k"), what(F.col(n), lo, hi).alias("b"),
                                                                                 F.col(n).alias("v"))) for i, (n, lo, hi) in enumerate(spans)])
        return x.select(F.explode(cells).alias("e")).where("e is not null").select("e.k", "e.b", "e.v")

    def bin_of(v, lo, hi):
        """Equal widths between the finite ends of a range; infinities and NaN have bins of their own."""
        a, b = max(lo, -_LARGEST), min(hi, _LARGEST) if not math.isnan(hi) else _LARGEST
        at = F.floor((v / 2 - F.lit(a / 2)) / F.lit((b / 2 - a / 2) or 1.0) * F.lit(float(BINS))) if b > a else F.lit(0)
        return (F.when(F.isnan(v), BINS + 1).when(v == F.lit(float("inf")), BINS).when(v == F.lit(float("-inf")), -1)
                .otherwise(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), at))).cast("int"))

    while True:
        todo = []
        for k, (lo, hi, _, n_in) in state.items():
            if k not in value:
                if lo == hi or (math.isnan(lo) and math.isnan(hi)):
                    value[k] = lo
                elif n_in > limit:
                    todo.append(k)
        if not todo:
            break
        spans = ranges(todo)
        got = (listed(spans, bin_of).groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
               .collect())                                            # at most BINS + 3 rows a range
        bins: dict[int, list] = {}
        for r in sorted(got, key=lambda r: (r["k"], r["b"])):
            bins.setdefault(r["k"], []).append(r)
        number = {s: i for i, s in enumerate(spans)}
        for k in todo:
            lo, hi, below, _ = state[k]
            for r in bins[number[k[0], lo, hi]]:
                if k[1] < below + r["n"]:
                    state[k] = (r["lo"], r["hi"], below, int(r["n"]))
                    break
                below += r["n"]

    # final: values in range, counted, then a running count over at most ``limit`` rows a range
    left = [k for k in state if k not in value]
    if left:
        spans = ranges(left)
        u = listed(spans, lambda v, lo, hi: F.lit(0)).groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
        w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        number = {s: i for i, s in enumerate(spans)}
        of: dict[int, list] = {}
        for k in left:
            of.setdefault(number[k[0], state[k][0], state[k][1]], []).append(k)
        wanted = F.array(*[F.array(*[F.lit(k[1] - state[k][2]) for k in of[i]]) for i in range(len(spans))])
        hit = F.filter(F.element_at(wanted, F.col("k") + 1), lambda r: (F.col("cum") > r) & (F.col("cum") - F.col("c") <= r))
        picked = u.withColumn("cum", F.sum("c").over(w)).select("k", "v", F.explode(hit).alias("r")).collect()   # one row per rank
        place = {(i, k[1] - state[k][2]): k for i, ks in of.items() for k in ks}
        value |= {place[r["k"], r["r"]]: r["v"] for r in picked}

    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for n, c in zip(names, cols):
        for j, q in enumerate(probs):
            if n_of[n]:
                pos = q * (n_of[n] - 1)
                k0, k1 = int(math.floor(pos)), int(math.ceil(pos))
                result[c][j] = value[n, k0] + (pos - k0) * (value[n, k1] - value[n, k0])
    return result


def exact_median(df: DataFrame, cols: Sequence[str], **kw) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5], **kw).items()}
