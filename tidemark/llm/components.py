"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends there, and lost executors don't matter."""
    path = scratch_path(df.sparkSession, f"{name}-")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node of its component.

    Each round points every node's neighbours to the smallest of them: first the larger ones, then
    the smaller ones.  Groupings are minima (partial aggregates), so a star of any size is no hot
    group; rounds are about logarithmic in the length of chains, and end when nothing changes.
    """
    edges = stored(links.select("a", "b").filter("a != b").distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct())
        new = stored(small, "links")
        now = _state(new)
        if now == state:
            break
        edges, state = new, now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def numbered(df: DataFrame, order: list, as_col: str) -> DataFrame:
    """Rows with their place (from 0) in ``order``, written to the shared folder.

    Ranges are sorted apart; a table of one row a partition, which is broadcast, says how many rows
    come before each.
    """
    cut = stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_mid", 33).alias("_part")
    sizes = cut.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return (cut.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(as_col, F.col("_before") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_mid"))


def with_small(df: DataFrame, small: DataFrame, key: str, spread: str, most_rows: int = 100_000) -> DataFrame:
    """df joined with ``small`` (one row a key): broadcast up to ``most_rows`` rows.

    Above that the rows of a key are dealt over salts by a hash of ``spread``, so that a key that
    holds a third of all rows isn't one task; ``small`` is copied for each salt.
    """
    n = small.count()
    if n <= most_rows:
        return df.join(F.broadcast(small), key)
    salts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(copies, [key, "_salt"]).drop("_salt")
