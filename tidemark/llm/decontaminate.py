"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An occurrence of an item of m bytes with at most e edits shares at least m - q + 1 - q e q-grams
with the text, and these lie on at most e + 1 neighbouring diagonals (text position less item
position).  Shared q-grams are counted in diagonal bands that overlap, so that one band holds any
such stretch; bands that meet the bound are regions, and an alignment restricted to the band
verifies each.  The index of the items is broadcast in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import utf8_of

#: Gram lengths, longest first, edits allowed per byte of an item, and bytes from which an item is searched.
GRAMS, EDIT_RATE, LEAST_ITEM = (8, 4, 2, 1), 0.10, 8
#: Bytes of items in one broadcast, and of text looked at together.
BLOCK_BYTES, RUN = 4 << 20, 1 << 20
FILTER_BITS = 21

#: Case and punctuation don't count: A-Z are folded, other ASCII but letters and digits is a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)]


def folded(data: np.ndarray) -> np.ndarray:
    return FOLD[data]


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each position as one number; q is a power of two up to 8."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    codes, width = data.astype(np.uint64 if q > 4 else np.uint32), 1
    while width < q:
        codes = codes[:-width] << codes.dtype.type(8 * width) | codes[width:]
        width *= 2
    return codes.astype(np.uint64)


def edits_allowed(size: int, rate: float) -> int:
    return int(size * rate)


def gram_of(size: int, rate: float) -> int:
    """The longest gram length of which an occurrence with all allowed edits still keeps one whole gram."""
    return next(q for q in GRAMS if size >= q * (edits_allowed(size, rate) + 1))


def slots(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


@dataclass
class ItemIndex:
    """Grams of a block of items: sorted distinct codes, and for each its (item, position) places.
    All items of an index have the same gram length."""

    gram: int
    ids: list
    items: list[np.ndarray]
    codes: np.ndarray
    first: np.ndarray
    item_of: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    edits: np.ndarray
    bound: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[object, bytes]], rate: float = EDIT_RATE) -> list[ItemIndex]:
        """An index for each gram length that the items need."""
        lengths = [gram_of(len(t), rate) for _, t in rows]
        return [cls.of_gram([x for x, n in zip(rows, lengths) if n == q], q, rate) for q in sorted(set(lengths))]

    @classmethod
    def of_gram(cls, rows: list[tuple[object, bytes]], q: int, rate: float) -> ItemIndex:
        items = [(i, folded(np.frombuffer(t, np.uint8))) for i, t in rows]
        all_codes = [grams(t, q) for _, t in items]
        codes = np.concatenate(all_codes)
        item_of = np.repeat(np.arange(len(items)), [len(c) for c in all_codes])
        place = np.concatenate([np.arange(len(c)) for c in all_codes])
        order = np.argsort(codes, kind="stable")
        distinct, first = np.unique(codes[order], return_index=True)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[slots(distinct)] = True
        size = np.array([len(t) for _, t in items], np.int64)
        edits = np.array([edits_allowed(len(t), rate) for _, t in items], np.int64)
        return cls(q, [i for i, _ in items], [t for _, t in items], distinct, np.append(first, len(codes)),
                   item_of[order], place[order], seen, edits, size - q + 1 - q * edits)

    def regions(self, codes: np.ndarray, valid: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of the bands that meet their item's bound."""
        at = np.flatnonzero(self.seen[slots(codes)] & valid)
        if not len(at):
            return
        found = np.searchsorted(self.codes, codes[at])
        found[found == len(self.codes)] = 0
        hit = self.codes[found] == codes[at]
        at, found = at[hit], found[hit]
        n = self.first[found + 1] - self.first[found]
        if not n.sum():
            return
        index = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, width = self.item_of[index], self.edits[self.item_of[index]] + 1
        # a band is 2 (e + 1) diagonals wide and starts every e + 1: each diagonal is in two of them
        band = (np.repeat(at, n) - self.place[index]) // width
        most = np.int64(len(codes) + RUN)
        key = item * (2 * most) + band + most
        key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        item = key // (2 * most)
        good = count >= self.bound[item]
        for i, b in zip(item[good].tolist(), (key[good] % (2 * most) - most).tolist()):
            w = int(self.edits[i]) + 1
            yield i, b * w, (b + 2) * w - 1


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int | None = None) -> tuple[int, int]:
    """(edits, end) of the best occurrence of the whole item in the text on diagonals low..high; with
    ``most``, an occurrence of more edits may be given up early, with more than ``most`` edits."""
    m, n = len(item), len(text)
    k = np.arange(high - low + 1)
    far = m + n + 2
    at = low + k  # text position before the first item byte
    cost = np.where((at >= 0) & (at <= n), 0, far)
    # the text byte that would match item byte i on diagonal k is near[i + k], and too far outside the text
    first, last = max(low, 0), max(min(high + m, n), max(low, 0))
    near, beyond = np.full(m + len(k), -1, np.int16), np.full(m + len(k), far)
    near[first - low:last - low], beyond[first - low:last - low] = text[first:last], 0
    outside = low < 0 or high + m > n
    for i, c in enumerate(item.tolist()):
        step = cost + (near[i:i + len(k)] != c)
        if outside:
            step += beyond[i:i + len(k)]
        np.minimum(step[:-1], cost[1:] + 1, out=step[:-1])  # item byte without a text byte
        if outside:
            end = at + i + 1
            step[(end < 0) | (end > n)] = far
        cost = np.minimum.accumulate(step - k) + k  # text bytes without an item byte
        if most is not None and i % 8 == 7 and cost.min() > most:
            return most + 1, 0  # costs never fall
    best = int(cost.argmin())
    return int(cost[best]), min(max(low + best + m, 0), n)


def find_items(data: np.ndarray, offsets: np.ndarray, index: ItemIndex) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, edits, end byte) of the best verified occurrence of each item in each row."""
    overlap = max(len(t) for t in index.items) + 4 * int(index.edits.max()) + index.gram
    best: dict[tuple[int, int], tuple[int, int]] = {}
    row, rows = 0, len(offsets) - 1
    while row < rows:
        start = int(offsets[row])
        last = max(row, int(np.searchsorted(offsets, start + RUN, side="right")) - 2)
        stop = int(offsets[last + 1])
        for a in range(start, max(stop, start + 1), RUN):  # a row longer than a run: runs that overlap
            b = min(stop, a + RUN + overlap)
            run = folded(data[a:b])
            codes = grams(run, index.gram)
            ends = offsets[row + 1:last + 1] - a
            valid = np.ones(len(codes), bool)
            for back in range(1, index.gram):
                cut = ends - back
                valid[cut[(cut >= 0) & (cut < len(codes))]] = False
            for item, low, high in index.regions(codes, valid):
                pattern = index.items[item]
                # a band may lie over several rows: each is aligned by itself
                lo, hi = max(low, 0), min(high + len(pattern) + int(index.edits[item]), len(run))
                of = int(np.searchsorted(offsets, a + lo, side="right")) - 1
                while of < rows and offsets[of] < a + max(hi, lo + 1):
                    x, y = max(int(offsets[of]) - a, lo), min(int(offsets[of + 1]) - a, hi)
                    if y - x >= len(pattern) - index.edits[item]:
                        edits, end = align(pattern, run[x:y], low - x, high - x, int(index.edits[item]))
                        if edits <= index.edits[item]:
                            found = (edits, a + x + end - int(offsets[of]))
                            best[of, item] = min(best.get((of, item), found), found)
                    of += 1
            if stop - start <= RUN:
                break
        row = last + 1
    for (of, item), (edits, end) in sorted(best.items()):
        yield of, item, edits, end


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES, least_item: int = LEAST_ITEM) -> DataFrame:
    """One row per document and benchmark item that occurs in it: id, item id, n_edits, end_byte.

    The whole item must occur with at most ``rate`` (under 1) edits per byte, rounded down, case and
    punctuation aside.  Items for which grams of 8 bytes couldn't hold that budget are searched by
    shorter ones.  Items under ``least_item`` bytes are left out: "whole item" says little of a word
    that is in any text; 1 searches all but null and empty ones.
    Null texts hold nothing; repeated rows and items give repeated rows; other columns aren't read.
    Items are broadcast in blocks of about ``block_bytes``; each further block is one more pass.
    """
    items = (benchmark.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text"))
             .filter(F.octet_length("_text") >= max(least_item, 1)))
    size = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes) or 1
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"_id {kind}, _item {item_kind}, n_edits int, end_byte long"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for b in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("_text"), F.lit(n_blocks)) == b).collect() if size else []
        indexes = ItemIndex.build(sorted(((r["_item"], r["_text"].encode()) for r in block), key=repr), rate)
        shared = docs.sparkSession.sparkContext.broadcast(indexes)
        item_type = items.limit(0).toArrow().schema.field("_item").type

        def search(batches: Iterator[pa.RecordBatch], shared=shared, item_type=item_type) -> Iterator[pa.RecordBatch]:
            for batch, index in ((b, x) for b in batches for x in shared.value):
                found = list(find_items(*utf8_of(batch.column(1)), index))
                yield pa.record_batch(
                    [batch.column(0).take(pa.array([x[0] for x in found], pa.int64())),
                     pa.array([index.ids[x[1]] for x in found], item_type),
                     pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.int64())],
                    ["_id", "_item", "n_edits", "end_byte"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"_id": id_col, "_item": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs, all columns; rows that share an id go
    together."""
    found = (contaminated(docs, benchmark, rate, id_col, text_col).groupBy(F.col(id_col).alias("_leaky"))
             .agg(F.lit(1)).select("_leaky"))
    return docs.join(found, docs[id_col].eqNullSafe(found["_leaky"]), "left_anti")
