"""How far the sources of a language differ in their words: pair tasks that merge sparse counts.

Words are counted in tasks before anything is shuffled.  Each (language, source) group becomes arrays
of (term id, count), sorted by id and cut into blocks of ids.  For every unordered pair of sources and
every block, the two arrays meet in one co-grouped call: a galloping intersection finds the terms that
both have, and these, the terms of one side only and the terms of neither are priced for both sources.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import utf8_of
from tidemark.llm.components import numbered, stored

LEAST_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50
#: A block holds 2**BLOCK_BITS term ids, so an array of a pair task has at most as many entries.
BLOCK_BITS = 16
#: Entries that a counting task holds before it hands them on.
ENTRIES = 250_000
#: Texts are cut between words into pieces of about this many bytes.
PIECE = 1 << 20

TERM = re.compile(rb"[a-z\x80-\xff]+")
GAP = re.compile(rb"[^a-z\x80-\xff]")
COUNTS = "lang string, source string, term string, occ long, docs long"


def _pieces(text: bytes) -> Iterator[bytes]:
    a = 0
    while len(text) - a > PIECE:
        gap = GAP.search(text, a + PIECE)
        b = gap.start() if gap else len(text)
        yield text[a:b]
        a = b
    yield text[a:]


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    """The counts held, in batches, with one row of a null term for every group."""
    langs, sources, terms, occ, docs = [], [], [], [], []
    for (lang, source), (times, inside) in held.items():
        langs += [lang] * (len(times) + 1)
        sources += [source] * (len(times) + 1)
        terms += [None, *(t.decode() for t in times)]
        occ += [0, *times.values()]
        docs += [0, *(inside[t] for t in times)]
    for a in range(0, len(terms), 50_000):
        part = slice(a, a + 50_000)
        yield pa.record_batch({"lang": pa.array(langs[part], pa.string()), "source": pa.array(sources[part], pa.string()),
                               "term": pa.array(terms[part], pa.string()), "occ": pa.array(occ[part], pa.int64()),
                               "docs": pa.array(docs[part], pa.int64())})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    entries = 0
    for batch in batches:
        data, offsets = utf8_of(batch.column("_text"))
        for i, group in enumerate(zip(batch.column("_lang").to_pylist(), batch.column("_source").to_pylist())):
            times, inside = held.setdefault(group, (Counter(), Counter()))
            before, seen = len(times), set()
            for piece in _pieces(data[offsets[i]:offsets[i + 1]].tobytes().lower()):  # bytes: A-Z only
                terms = TERM.findall(piece)
                times.update(terms)
                seen.update(terms)
            inside.update(seen)
            entries += len(times) - before
            if entries >= ENTRIES:
                yield from _rows(held)
                held, entries = {}, 0
    yield from _rows(held)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, occ, docs): occurrences and documents of each term in each group.

    A term is a run of ASCII letters and characters beyond ASCII; only A-Z are lower-cased.  Null text,
    lang and source count as empty.  Every group has one more row, whose term is null.
    """
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col), empty).alias("_lang"), F.coalesce(F.col(source_col), empty).alias("_source"),
                       F.coalesce(F.col(text_col), empty).alias("_text"))
    return (rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("occ").alias("occ"), F.sum("docs").alias("docs")))


def shares(counts: np.ndarray, total: int, n_terms: int, prior: int, scale_digits: int = 9) -> np.ndarray:
    """1 + floor(10**digits * (count + prior) / (total + prior * n_terms)), exactly, by long division.

    Three digits are divided at a time, so that no product overflows below 9e15 words.
    """
    whole = total + prior * n_terms
    rest = counts.astype(np.int64) + prior
    p = rest // whole
    rest = rest % whole
    for _ in range(scale_digits // 3):
        rest = rest * 1000
        p = p * 1000 + rest // whole
        rest = rest % whole
    return p + 1


def _reach(ids: np.ndarray, at: int, value: int) -> int:
    """First place from ``at`` on whose id is at least ``value``, by steps that double."""
    step = 1
    while at + step < len(ids) and ids[at + step] < value:
        step *= 2
    return at + int(np.searchsorted(ids[at:at + step + 1], value))


def gallop(short: np.ndarray, long: np.ndarray, run: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``short`` and in ``long`` of the ids that both have; ids ascend and don't repeat.

    Runs of the shorter array jump forward in the longer one, which is never read between them.
    """
    at, here, there = 0, [], []
    for a in range(0, len(short), run):
        part = short[a:a + run]
        at = _reach(long, at, part[0])
        end = _reach(long, at, part[-1])
        window = long[at:end + 1]
        if not len(window):
            break
        place = np.minimum(np.searchsorted(window, part), len(window) - 1)
        same = np.flatnonzero(window[place] == part)
        here.append(same + a)
        there.append(place[same] + at)
        at = end
    none = np.zeros(0, np.int64)
    return (np.concatenate(here), np.concatenate(there)) if here else (none, none)


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = [table.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "occ")]
    return row[0], row[1]


def _pair_task(prior: int, digits: int):
    def price(left: pa.Table, right: pa.Table) -> pa.Table:
        (ia, ca), (ib, cb) = _side(left), _side(right)
        one = (left if left.num_rows else right).select(["lang", "a", "b", "na", "nb", "v"]).slice(0, 1).to_pylist()[0]
        pa_, pb = shares(ca, one["na"], one["v"], prior, digits), shares(cb, one["nb"], one["v"], prior, digits)
        a0, b0 = (int(shares(np.zeros(1), one[n], one["v"], prior, digits)[0]) for n in ("na", "nb"))
        if len(ia) <= len(ib):
            at_a, at_b = gallop(ia, ib)
        else:
            at_b, at_a = gallop(ib, ia)
        both = int(np.abs(pa_[at_a] - pb[at_b]).sum())
        only_a = int(np.abs(pa_ - b0).sum() - np.abs(pa_[at_a] - b0).sum())
        only_b = int(np.abs(pb - a0).sum() - np.abs(pb[at_b] - a0).sum())
        return pa.table({"lang": [one["lang"]], "a": [one["a"]], "b": [one["b"]],
                         "priced": pa.array([both + only_a + only_b], pa.int64()),
                         "n": pa.array([len(ia) + len(ib) - len(at_a)], pa.int64())})
    return price


def _share(count: Column, total: str, prior: int, digits: int) -> Column:
    """The same share as a column: integer division of decimals, which is exact."""
    whole = (F.col(total) + F.lit(prior) * F.col("v")).cast("decimal(20,0)")
    part = (count + F.lit(prior)).cast("decimal(20,0)") * F.lit(10 ** digits).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", part, whole)


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  least_docs: int = LEAST_DOCS, prior: int = PRIOR, digits: int = 9, top: int = TOP,
                  block_bits: int = BLOCK_BITS) -> DataFrame:
    """lang, source, part, item, value, rank: distances between sources, and what marks each of them.

    A language keeps the terms of at least ``least_docs`` of its documents (rows).  ``part`` pair: for
    each other source of the language, the difference of shares summed over all kept terms, every rank.
    ``part`` term: kept terms whose share is above the language's, the ``top`` of them by difference.
    Values descend with rank, ties go by the item's bytes.  Null texts, languages and sources count as
    empty; a group without terms has pairs, a language without kept terms has pairs of value 0, an
    empty table has no rows; repeated rows count each; other columns aren't read.
    """
    counts = stored(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = (counts.filter(F.col("term").isNotNull()).groupBy("lang", "term")
            .agg(F.sum("docs").alias("_docs"), F.sum("occ").alias("everywhere")).filter(F.col("_docs") >= least_docs).drop("_docs"))
    terms = numbered(kept, ["lang", "term"], "id")
    cells = stored(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "id", "occ", "everywhere"), "cells")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("everywhere").alias("nl"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("occ").alias("n"))
    groups = stored(counts.filter(F.col("term").isNull()).select("lang", "source")
                    .join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "nl"]), "groups")

    # every pair of a language is a row of the result; salts deal a language with many sources over tasks
    salts = 1 + groups.count() // 256
    salted = groups.withColumn("_salt", F.pmod(F.xxhash64("source"), F.lit(salts)).cast("int"))
    others = groups.select("lang", F.col("source").alias("b"), F.col("n").alias("nb"),
                           F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    pairs = (salted.join(others, ["lang", "_salt"]).filter(F.col("source") < F.col("b"))
             .select("lang", F.col("source").alias("a"), "b", F.col("n").alias("na"), "nb", "v"))

    entries = F.sort_array(F.collect_list(F.struct("id", "occ"))).alias("_entries")
    arrays = (cells.withColumn("block", F.shiftright("id", block_bits)).groupBy("lang", "source", "block").agg(entries)
              .select("lang", "source", "block", F.col("_entries.id").alias("ids"), F.col("_entries.occ").alias("occ")))
    keys = ["lang", "a", "b", "block"]
    left = pairs.join(arrays.withColumnRenamed("source", "a"), ["lang", "a"])
    right = pairs.join(arrays.withColumnRenamed("source", "b"), ["lang", "b"])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own for the co-group
    priced = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
              .applyInArrow(_pair_task(prior, digits), "lang string, a string, b string, priced long, n long")
              .groupBy("lang", "a", "b").agg(F.sum("priced").alias("priced"), F.sum("n").alias("n")))
    nowhere = F.abs(_share(F.lit(0), "na", prior, digits) - _share(F.lit(0), "nb", prior, digits))
    value = F.coalesce("priced", F.lit(0)) + (F.col("v") - F.coalesce("n", F.lit(0))) * nowhere
    distances = (pairs.join(priced, ["lang", "a", "b"], "left")
                 .withColumn("value", F.when(F.col("v") > 0, value).otherwise(F.lit(0)).cast("long")))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    by_pair = distances.select("lang", "value", ways.alias("_way")).select("lang", "_way.source", "_way.item", "value")

    own, whole = _share(F.col("occ"), "n", prior, digits), _share(F.col("everywhere"), "nl", prior, digits)
    by_term = (cells.join(groups, ["lang", "source"]).withColumn("value", (own - whole).cast("long")).filter("value > 0")
               .select("lang", "source", F.col("term").alias("item"), "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return (by_pair.withColumn("rank", place).withColumn("part", F.lit("pair")).select(out)
            .unionByName(by_term.withColumn("rank", place).filter(F.col("rank") <= top)
                         .withColumn("part", F.lit("term")).select(out)))
