"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target divided by its size says how many copies of each of its documents the mix takes.  The
whole part is taken outright; the rest is a probability, and its words are a mass between none and all of
the document.  Two documents of a source meet, and one hands mass to the other, in a direction drawn so
that expectations are kept, until one of them is out or in as a whole.  What is left of the other meets the
next.  A bucket of documents ends with one residual at most; residuals are bucketed and combined again, a
tree whose depth is logarithmic in the documents.  Masses are only moved within a source, so its taken
words differ from its target by less than its last document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import numbered, stored, with_small

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 12
#: Documents, or residuals, of a bucket of the tree on average.
FAN = 256


def words(text: Column) -> Column:
    """Number of runs of characters other than space, tab, line ends, vertical tab and form feed; null: 0."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_key, source, source_size, target) of ``units`` (_key, source, size, n): one row a source.

    Sources in the order of their code points, null last, take the weights in turn and ``share`` times
    all sizes by weight.  A target above ``most`` times its source's size stops there and its excess is
    shared again, until none is above: all others then stand at one level times their weight.
    """
    sizes = units.groupBy("_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    placed = numbered(sizes, [F.col("source").asc_nulls_last()], "_at")
    turn = F.array(*[F.lit(w) for w in weights])
    sources = stored(placed.withColumn("_weight", F.element_at(turn, (F.col("_at") % len(weights) + 1).cast("int"))).drop("_at"),
                     "sources")
    goal = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped_before = None, -1
    while True:
        stop = F.lit(False) if level is None else most * F.col("source_size") <= F.lit(level) * F.col("_weight")
        capped, held, weight = sources.agg(
            F.sum(F.when(stop, 1).otherwise(0)), F.sum(F.when(stop, most * F.col("source_size")).otherwise(0)),
            F.sum(F.when(stop, 0).otherwise(F.col("_weight")))).first()
        if not weight or capped == capped_before:
            break
        level, capped_before = (goal - held) / weight, capped
    target = F.least(F.lit(level or 0.0) * F.col("_weight"), (most * F.col("source_size")).cast("double"))
    return sources.select("_key", "source", "source_size", target.alias("target"))


def _meet(held: Column, unit: Column) -> Column:
    """Both after one transfer: at least one of them has a mass of none or all of its size."""
    def moved(step: Column) -> Column:
        up, down = step["up"], step["down"]
        rise = unit["u"] * (up + down) < down
        whole = held["size"].cast("double")
        first = F.when(rise, F.when(up == whole - held["mass"], whole).otherwise(held["mass"] + up)).otherwise(
            F.when(down == held["mass"], 0.0).otherwise(held["mass"] - down))
        full = unit["size"].cast("double")
        second = F.when(rise, F.when(up == unit["mass"], 0.0).otherwise(unit["mass"] - up)).otherwise(
            F.when(down == full - unit["mass"], full).otherwise(unit["mass"] + down))
        return F.array(held.withField("mass", first), unit.withField("mass", second))
    steps = F.struct(F.least(held["size"] - held["mass"], unit["mass"]).alias("up"),
                     F.least(held["mass"], unit["size"] - unit["mass"]).alias("down"))
    return F.transform(F.array(steps), moved)[0]


def _settled(unit: Column) -> Column:
    return (unit["mass"] <= 0) | (unit["mass"] >= unit["size"])


def _fold(units: Column, unit_type: str) -> Column:
    """(done, held) of a bucket's units, met one after the other."""
    start = F.struct(F.array().cast(f"array<{unit_type}>").alias("done"), F.lit(None).cast(unit_type).alias("held"))

    def step(state: Column, unit: Column) -> Column:
        both = lambda pair: F.struct(
            F.concat(state["done"], F.filter(pair, _settled)).alias("done"),
            F.get(F.filter(pair, lambda x: ~_settled(x)), 0).alias("held"))
        met = F.transform(F.array(_meet(state["held"], unit)), both)[0]
        return F.when(state["held"].isNull(), F.struct(state["done"].alias("done"), unit.alias("held"))).otherwise(met)

    return F.aggregate(units, start, step)


def _level(nodes: DataFrame, unit_type: str, fan: int, seed: int, depth: int) -> DataFrame:
    """(_key, _state) of every bucket: nodes of a source are dealt by a hash of the document."""
    per_key = nodes.groupBy("_key").agg(F.ceil(F.count("*") / fan).alias("_buckets"))
    drawn = F.xxhash64(F.col("_unit.id"), F.col("_unit.size"), F.lit(seed), F.lit(depth))
    uniform = F.shiftrightunsigned(F.xxhash64(drawn, F.lit("u")), 11) / F.lit(float(1 << 53))
    dealt = (with_small(nodes.withColumn("_h", drawn), per_key, "_key", "_h")
             .withColumn("_bucket", F.pmod("_h", "_buckets"))
             .withColumn("_unit", F.col("_unit").withField("h", F.col("_h")).withField("u", uniform)))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("_unit.h").alias("h"), F.col("_unit").alias("unit"))))
    return (dealt.groupBy("_key", "_bucket").agg(ordered.alias("_units"))
            .select("_key", _fold(F.col("_units.unit"), unit_type).alias("_state")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, fan: int = FAN) -> DataFrame:
    """A row per document: id, source, size, source_size, target, copies and taken words.

    Sizes are words (null text: 0).  A source's documents are taken ``target / source_size`` times, all
    the whole number of times below or above that, so never beyond ``most``; in expectation each has
    its share, and a source's taken words differ from its target by less than one document of it.
    The draws are hashes of id and size, so they don't depend on partitions, order or reruns.

    Null is a source of its own (the last) and a valid id.  Rows of one source, id and size are alike, and
    so many of them get the further copy as their joint probability says.  Documents without words
    take nothing; an empty table has no rows; other columns aren't read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    units = stored(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("size"))
                   .groupBy("source", "id", "size").agg(F.count("*").alias("n")).withColumn("_key", key), "units")
    sources = stored(source_targets(units, weights, share, most), "targets")

    id_type = units.schema["id"].dataType.simpleString()
    unit_type = "struct<" + ", ".join(f"{name}:{kind}" for name, kind in (x.split(" ", 1) for x in (
        f"id {id_type}", "size bigint", "n bigint", "whole bigint", "mass double", "h bigint", "u double"))) + ">"
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # like rows settle among themselves but for one, which stands for them in the tree
    joint = F.col("n") * (rate - F.floor(rate))
    whole = F.floor(joint)
    unit = F.struct("id", "size", "n", whole.alias("whole"), ((joint - whole) * F.col("size")).alias("mass"),
                    F.lit(0).cast("long").alias("h"), F.lit(0.0).alias("u"))
    nodes = with_small(units, sources.drop("source"), "_key", "id").select("_key", unit.alias("_unit"))
    done = [nodes.filter(_settled(F.col("_unit")))]
    nodes = nodes.filter(~_settled(F.col("_unit")))
    depth = 0
    while (nodes.groupBy("_key").count().agg(F.max("count")).first()[0] or 0) > 1:
        state = stored(_level(nodes, unit_type, fan, seed, depth), "mixed")
        done.append(state.select("_key", F.explode("_state.done").alias("_unit")))
        nodes = state.filter(F.col("_state.held").isNotNull()).select("_key", F.col("_state.held").alias("_unit"))
        depth += 1
    last = F.shiftrightunsigned(F.xxhash64(F.col("_unit.id"), F.col("_unit.size"), F.lit(seed), F.lit("last")), 11) / F.lit(float(1 << 53))
    done.append(nodes.withColumn("_unit", F.col("_unit").withField("mass", F.when(
        last * F.col("_unit.size") < F.col("_unit.mass"), F.col("_unit.size").cast("double")).otherwise(0.0))))

    settled = reduce(DataFrame.unionByName, done).select("_key", "_unit.*")
    up = F.col("whole") + F.when((F.col("mass") > 0) & (F.col("mass") >= F.col("size")), 1).otherwise(0)
    million = 1_000_000  # like rows are numbered in two steps, so that no array of theirs is long
    rows = (with_small(settled.withColumn("_up", up), sources, "_key", "id")
            .withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(million).cast("long"))))
            .withColumn("_row", F.explode(F.sequence(F.col("_from"), F.least(F.col("n"), F.col("_from") + (million - 1))))))
    copies = F.floor(rate) + F.when(F.col("_row") <= F.col("_up"), 1).otherwise(0)
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.cast("long").alias("copies"),
                       (copies * F.col("size")).cast("long").alias("taken"))
