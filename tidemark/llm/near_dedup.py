"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A text is a bag of five-word shingles.  Every unit of a shingle's weight is a region into which
hashed darts fall, a Poisson number in each layer of rank, the same ones in every text that has the
unit.  A text keeps the earliest dart of each of its coordinates, so two texts agree in a
coordinate with the probability of their weighted Jaccard similarity.  Layers are thrown only
until no coordinate is empty: O(shingles + t log t) darts for t coordinates.

Texts of equal bags are one node.  Nodes that share a band of coordinates form a bucket; each is
compared with its bucket's leader on its whole bag.  The nodes of buckets that then still hold
several components are compared through a prefix filter: units are ordered by how rare they are
among these nodes, and two bags of enough similarity share one of their first few units.  Pairs that
do, and whose components differ, are candidates; rounds verify the most promising ones of each
two components first, and the last round all that are left.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_of, pieces_of, utf8_of
from tidemark.llm.components import components, stored

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of rows: at similarity 0.8 two texts share none of them once in half a million.
BANDS, ROWS = 25, 4
COORDINATES = BANDS * ROWS
#: Borders of the layers of rank.
LAYERS = (0.0, *(2.0 ** k for k in range(-3, 13)))
#: Bytes looked at together; members of a block of a group that shares a prefix unit.
RUN, BLOCK = 1 << 20, 2048
#: What names a group of members that are compared in one place.
GROUP = ["_unit", "_i", "_j"]
#: Most units whose counts are broadcast: those that make up more than this part of all units.
HOT = 4096
#: Pairs verified for two components that a round joins in a group; the last round takes all pairs.
ROUNDS = (1, 8, None)
#: Bytes that words consist of.
WORDLIKE = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
BASE = np.uint64(0xD1342543DE82EF95)
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64((1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) of hashes."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


@functools.cache
def poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... events."""
    most = int(mean + 12 * math.sqrt(mean) + 30)
    return np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(most)])


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, and the value of each byte."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x)]), dtype=np.uint64) for x in (BASE, inverse))
    return up, down, mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLY)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of lower-case bytes: runs of ASCII letters and digits and of
    bytes beyond ASCII.  Hashes come from prefix sums of a polynomial modulo 2^64."""
    up, down, value = powers(RUN)
    inside = WORDLIKE[data].view(np.int8)
    edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
    first, last = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * up[:len(data)], dtype=np.uint64)])
    return first, mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def words_by_row(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Word hashes of each row; rows are taken together up to half of ``RUN``, and a longer row is
    cut where a word ends (a longer word: where the run ends)."""
    for i, j in blocks_of(offsets, RUN // 2):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a + j - i <= RUN:
            spaced = np.full(b - a + j - i, 32, np.uint8)  # a space after each row keeps words apart
            spaced[np.arange(b - a) + np.repeat(np.arange(j - i), np.diff(offsets[i:j + 1]))] = data[a:b]
            first, h = word_hashes(spaced)
            cut = np.searchsorted(first, offsets[i:j + 1] - a + np.arange(j - i + 1))
            yield from (h[x:y] for x, y in zip(cut, cut[1:]))
            continue
        for k in range(i, j):
            a, b, parts = int(offsets[k]), int(offsets[k + 1]), [np.zeros(0, np.uint64)]
            while a < b:
                end = min(a + RUN, b)
                stops = np.flatnonzero(~WORDLIKE[data[a:end]]) if end < b else ()
                end = a + int(stops[-1]) + 1 if len(stops) else end
                parts.append(word_hashes(data[a:end])[1])
                a = end
            yield np.concatenate(parts)


def units_of(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of (shingle, occurrence number), one for each unit of weight; a text of fewer
    words than a shingle is one shingle, and one without words none."""
    if not len(h):
        return np.zeros(0, np.uint64)
    n = max(len(h) - size + 1, 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        total = total * MULTIPLY + h[i:i + n]
    total = np.sort(mix(total))
    same = total[1:] == total[:-1]
    if not same.any():
        return total
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    occurrence = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    return np.sort(np.where(occurrence > 0, mix(total + occurrence.astype(np.uint64) * MULTIPLY), total))


def units_by_row(column: pa.Array) -> Iterator[np.ndarray]:
    """Units of each text of a column, null as empty, case aside."""
    return map(units_of, words_by_row(*utf8_of(pc.utf8_lower(pc.fill_null(column, "")))))


def throw(units: np.ndarray, layer: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit number, dart) of the darts that fall into the units' regions in a layer of rank; a dart's
    value is its rank within the layer, and its name."""
    low, high = LAYERS[layer:layer + 2]
    seed = mix(units ^ mix(np.full(1, layer + 1, np.uint64) * MULTIPLY))
    count = np.searchsorted(poisson(high - low), unit(seed), side="right")
    owner = np.repeat(np.arange(len(units)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + 1
    return owner, mix(seed[owner] + number.astype(np.uint64) * MULTIPLY)


def signatures(rows: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate of each row (zeros for rows without units), layer by layer,
    all rows together; a row is done when none of its coordinates is empty."""
    size = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), t), np.uint64)
    empty = np.repeat(size > 0, t).reshape(len(rows), t)
    units = np.concatenate([np.zeros(0, np.uint64), *rows])
    of = np.repeat(np.arange(len(rows)), size)
    for layer in range(len(LAYERS) - 1):
        left = empty.any(axis=1)
        if not left.any():
            break
        if not left.all():
            live = left[of]
            units, of = units[live], of[live]
        owner, dart = throw(units, layer)
        least = np.full(len(rows) * t, NONE)
        np.minimum.at(least, of[owner] * t + (mix(dart) % np.uint64(t)).astype(np.int64), dart)
        least = least.reshape(len(rows), t)
        new = empty & (least != NONE)
        out[new] = least[new]
        empty &= ~new
    return out


def bag_of(units: np.ndarray) -> bytes:
    """128-bit name of a bag of shingles."""
    return hashlib.blake2b(units.tobytes(), digest_size=16).digest()


def band_keys(signs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = signs.reshape(-1, BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * MULTIPLY) + np.zeros((len(rows), 1), np.uint64)
    for i in range(ROWS):
        key = mix(key * MULTIPLY + rows[:, :, i])
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces_of(batches):
        bags, bands, signs, sizes, held = [], [], [], [], []

        def flush():
            s = signatures(held)
            bands.extend(k if len(u) else [] for k, u in zip(band_keys(s), held))
            signs.extend(x.tobytes() for x in s.astype(np.uint8))
            sizes.extend(map(len, held))
            held.clear()

        for units in units_by_row(b.column(1)):
            bags.append(bag_of(units))
            held.append(units)
            if len(units) > 50_000 or len(held) >= 256:
                flush()
        flush()
        yield pa.record_batch([b.column(0), pa.array(bags, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                               pa.array(signs, pa.binary()), pa.array(sizes, pa.int32())],
                              ["_id", "_bag", "_bands", "_sign", "_size"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces_of(batches):
        bags, held = [], []
        for units in units_by_row(b.column(0)):
            bags.append(bag_of(units))
            held.append(units.view(np.int64))
        yield pa.record_batch([pa.array(bags, pa.binary()), pa.array(held, pa.list_(pa.int64()))], ["_bag", "_units"])


def verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, ...) of nodes whose bags have at least the similarity."""
    left = bags.select(F.col("_bag").alias("a"), F.col("_units").alias("ua"))
    right = bags.select(F.col("_bag").alias("b"), F.col("_units").alias("ub"))
    shared = F.size(F.array_intersect("ua", "ub"))
    joined = pairs.join(left, "a").join(right, "b")
    # a pair whose sizes alone keep it below the similarity isn't compared
    small, big = F.least(F.size("ua"), F.size("ub")), F.greatest(F.size("ua"), F.size("ub"))
    return (joined.filter(small >= similarity * big)
            .select(*pairs.columns, (shared / (F.size("ua") + F.size("ub") - shared)).alias("_j"))
            .filter(F.col("_j") >= similarity).select(*pairs.columns))


def counted(units: DataFrame) -> DataFrame:
    """(_bag, _n, _unit): each row (_bag, _unit) with the number of rows that have its unit.

    Both joins keep the rows one by one, whichever units are frequent.  Counts of the most frequent ones
    are broadcast, and their rows are dealt by bag to the join with the others, so that no key of it
    holds more than a small part of the rows.
    """
    counts = stored(units.groupBy("_unit").agg(F.count("*").alias("_n")).filter("_n > 1"), "units")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    is_hot = F.col("_n") * HOT > total
    hot = counts.filter(is_hot).select("_unit", F.col("_n").alias("_most"))  # fewer than HOT rows
    other = counts.filter(~is_hot).select(F.col("_unit").alias("_key"), F.lit(True).alias("_rare"), "_n")
    rare = F.col("_most").isNull()
    keyed = (units.join(F.broadcast(hot), "_unit", "left")
             .withColumns({"_rare": rare, "_key": F.when(rare, F.col("_unit")).otherwise(F.xxhash64("_bag"))}))
    return (keyed.join(other, ["_key", "_rare"], "left")
            .select("_bag", F.coalesce("_most", "_n", F.lit(1)).alias("_n"), "_unit"))


def prefixes(bags: DataFrame, similarity: float) -> DataFrame:
    """(_unit, _bag, _size, _at): the units, rarest first, that two bags of the similarity can't both lack.

    Two bags of n and m units that share k of them have one of these among the first n - k + 1 and
    m - k + 1 in any common order; k is at least similarity * n.  Units of one bag only are left out.
    """
    ranked = counted(bags.select("_bag", F.explode("_units").alias("_unit")))
    size = F.size("_order")
    needed = F.ceil(size * F.lit(similarity) - F.lit(1e-9)).cast("int")
    return (ranked.groupBy("_bag").agg(F.sort_array(F.collect_list(F.struct("_n", "_unit"))).alias("_order"))
            .select("_bag", size.alias("_size"), F.posexplode(F.slice("_order", F.lit(1), size - needed + 1)).alias("_at", "_u"))
            .filter("_u._n > 1").select(F.col("_u._unit").alias("_unit"), "_bag", "_size", "_at"))


def possible_pairs(t: pa.Table, roots: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) row numbers of the pairs of a group of ``split_groups`` whose roots differ and whose sizes and
    places of the shared unit leave room for the similarity."""
    size, at, side = (t[c].to_numpy() for c in ("_size", "_at", "_side"))
    rows = np.arange(len(t))
    left, right = (rows, rows) if t["_i"][0] == t["_j"][0] else (rows[~side], rows[side])
    found = [(left[:0], right[:0])]
    for i in range(0, len(left), 512):
        p = left[i:i + 512]
        needed = np.ceil((size[p][:, None] + size[right]) * (similarity / (1 + similarity)) - 1e-9)
        fit = (np.minimum((size - at)[p][:, None], (size - at)[right]) >= needed) & (roots[p][:, None] != roots[right])
        if left is right:
            fit &= p[:, None] < right
        x, y = np.nonzero(fit)
        found.append((p[x], right[y]))
    return tuple(np.concatenate(c) for c in zip(*found))


def promising(x: np.ndarray, y: np.ndarray, agree: np.ndarray, bags: np.ndarray, roots: np.ndarray, best: int) -> np.ndarray:
    """Numbers of the pairs to verify first: of each two roots that a forest of the most agreeing pairs
    joins, the ``best`` pairs.  There are at most ``best`` times the roots."""
    n = int(roots.max()) + 1
    low, high = np.minimum(roots[x], roots[y]), np.maximum(roots[x], roots[y])
    key = low * n + high
    order = np.lexsort((np.maximum(bags[x], bags[y]), np.minimum(bags[x], bags[y]), -agree, key))
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    to, kept = list(range(n)), []

    def find(i: int) -> int:
        while to[i] != i:
            to[i] = i = to[to[i]]
        return i

    ends = np.append(first[1:], len(order))
    for k in np.argsort(-agree[order[first]], kind="stable").tolist():
        pair = order[first[k]]
        a, b = find(int(low[pair])), find(int(high[pair]))
        if a != b:
            to[a] = b
            kept.append(order[first[k]:min(first[k] + best, ends[k])])
    return np.concatenate(kept)


def pairs_of(t: pa.Table, similarity: float, best: int | None) -> pa.RecordBatch:
    """Pairs (a, b) of nodes of a group to be verified, with their roots (ra, rb)."""
    bag_names, root_names = (np.array([v.hex() for v in t[c].to_pylist()]) for c in ("_bag", "_root"))
    (_, bags), (_, roots) = (np.unique(v, return_inverse=True) for v in (bag_names, root_names))
    x, y = possible_pairs(t, roots, similarity)
    if best is not None and len(x):
        signs = np.frombuffer(b"".join(t["_sign"].to_pylist()), np.uint8).reshape(len(t), COORDINATES)
        agree = np.concatenate([(signs[x[i:i + 8192]] == signs[y[i:i + 8192]]).sum(axis=1) for i in range(0, len(x), 8192)])
        kept = promising(x, y, agree, bags, roots, best)
        x, y = x[kept], y[kept]
    swap = bags[x] > bags[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    return pa.record_batch([t[c].take(pa.array(i)).combine_chunks().cast(pa.binary()) for c, i in
                            (("_bag", x), ("_bag", y), ("_root", x), ("_root", y))], ["a", "b", "ra", "rb"])


def _pairs(similarity: float, best: int | None):
    """``pairs_of`` each group; rows of a group follow each other, maybe over batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.table(b) if rest is None else pa.concat_tables([rest, pa.table(b)])
            group = np.stack([t[c].to_numpy() for c in GROUP])
            edges = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist()]
            for i, j in zip(edges, edges[1:]):
                if j - i > 1:
                    yield pairs_of(t.slice(i, j - i), similarity, best)
            rest = t.slice(edges[-1])
        if rest is not None and len(rest) > 1:
            yield pairs_of(rest, similarity, best)

    return run


def split_groups(members: DataFrame) -> DataFrame:
    """Groups of members (_unit, _bag, _root, ...) that share a prefix unit and have several roots.

    A group is split into blocks by hash, and each two blocks meet in one place, so that no task holds
    more of a group than two blocks.
    """
    groups = (members.groupBy("_unit")
              .agg(F.ceil(F.count("*") / BLOCK).alias("_g"), F.min("_root").alias("_low"), F.max("_root").alias("_high"))
              .filter("_low != _high").select("_unit", "_g"))
    return (members.join(groups, "_unit").withColumn("_block", F.pmod(F.xxhash64("_bag"), F.col("_g")))
            .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g") - 1)))
            .withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other"),
                          "_side": F.col("_block") > F.col("_other")})
            .repartition(*GROUP).sortWithinPartitions(*GROUP).drop("_g", "_block", "_other"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, class_id (smallest id of its class), class_size, kept.

    Two texts are linked when the weighted Jaccard similarity of their bags of five-word shingles
    (case and punctuation aside) is at least ``similarity``; a class is a component of links, and
    its document with the smallest id is kept.  Null counts as empty; texts without words are one
    class; a text of fewer than five words is one shingle.  Rows that repeat an id are one document
    and stay or go together; a null id is above every id.  Other columns aren't read.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = stored(source.mapInArrow(_sketch, f"_id {kind}, _bag binary, _bands array<long>, _sign binary, _size int"), "sketches")
    nodes = rows.groupBy("_bag").agg(F.first("_bands").alias("_bands"))
    keys = nodes.select("_bag", F.explode("_bands").alias("_key"))
    shared = keys.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    buckets = stored(keys.join(shared, "_key"), "buckets")

    wanted = buckets.select("_bag").distinct()
    bags = stored(source.select("_text").mapInArrow(_units, "_bag binary, _units array<long>")
                  .groupBy("_bag").agg(F.first("_units").alias("_units")).join(wanted, "_bag"), "bags")

    leader = buckets.groupBy("_key").agg(F.min("_bag").alias("b"))
    pairs = buckets.join(leader, "_key").select(F.col("_bag").alias("a"), "b").filter("a != b").distinct()
    roots = components(verified(pairs, bags, similarity))

    # buckets that still hold several components: members of different ones that share a prefix unit
    named = (buckets.join(roots, buckets["_bag"] == roots["node"], "left")
             .select("_key", "_bag", F.coalesce("root", "_bag").alias("_root")))
    several = (named.groupBy("_key").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high"))
               .filter("_low != _high").select("_key"))
    unsettled = named.join(several, "_key", "left_semi").select("_bag").distinct()
    signs = rows.groupBy("_bag").agg(F.first("_sign").alias("_sign"))
    held = stored(bags.join(unsettled, "_bag"), "open")
    members = stored(prefixes(held, similarity).join(signs, "_bag"), "prefixes")
    for best in ROUNDS:
        rooted = (members.join(roots, members["_bag"] == roots["node"], "left")
                  .select(*members.columns, F.coalesce("root", "_bag").alias("_root")))
        pairs = stored(split_groups(rooted).mapInArrow(_pairs(similarity, best), "a binary, b binary, ra binary, rb binary")
                       .distinct(), "pairs")
        if pairs.isEmpty():
            break
        joined = components(verified(pairs, held, similarity).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        moved = joined.select(F.col("node").alias("_root"), F.col("root").alias("_new"))
        # every node of the links gets its new root; a node that had no link until now was its own root
        roots = stored(roots.withColumnRenamed("root", "_root").join(moved, "_root", "left")
                       .select("node", F.coalesce("_new", "_root").alias("root"))
                       .unionByName(moved.select(F.col("_root").alias("node"), F.col("_new").alias("root")))
                       .distinct(), "roots")

    classes = rows.select("_id", "_bag").join(roots, rows["_bag"] == roots["node"], "left").select(
        "_id", F.coalesce("root", "_bag").alias("_root"))
    sizes = classes.groupBy("_root").agg(F.min("_id").alias("_class"), F.count("*").alias("_n"))
    return (classes.join(sizes, "_root")
            .select(F.col("_id").alias(id_col), F.col("_class").alias("class_id"),
                    F.col("_n").alias("class_size"), F.col("_id").eqNullSafe(F.col("_class")).alias("kept")))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns; an id goes when none of its rows is kept."""
    gone = (near_duplicates(docs, similarity, id_col, text_col).groupBy(F.col(id_col).alias("_gone"))
            .agg(F.max("kept").alias("_kept")).filter(~F.col("_kept")).select("_gone"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
