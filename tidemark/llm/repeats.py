"""Removal of byte strings of a given length that occur more than once in a corpus.

Every window of ``length`` bytes has an anchor, the gram of the smallest hash in it, and equal
windows have equal anchors at equal offsets.  So a text falls into runs of windows with one anchor
each, and only runs whose anchor occurs again can hold repeated windows; the others are settled
from one count per anchor.  Runs with an equal context (all bytes of their windows) are repeated
as a whole.  What is left are the edges of repeated passages: their contexts are dealt by anchor to
shards; a shard builds the suffix array of its contexts by Larsson-Sadakane refinement as far as a
window reaches, which brings the repeated windows together.  An anchor with more contexts than
a shard holds is spread over several, whose sorted windows are cut into ranges by binary search and
merged, again by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_of, utf8_of
from tidemark.llm.components import stored
from tidemark.llm.near_dedup import MULTIPLY, mix

LENGTH, GRAM = 200, 32
#: Bytes of text looked at together, and contexts of a shard.
RUN, SHARD = 1 << 20, 4096
#: Bits of the position in a block below the gram's hash.
PLACE = 24


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each position."""
    h, n = mix(data.astype(np.uint64) + np.uint64(1)), 1
    factor = MULTIPLY
    while n < size and len(h) > n:
        h = h[:-n] * factor + h[n:]
        factor = factor * MULTIPLY | np.uint64(1)
        n *= 2
    return mix(h) if n >= size and len(data) >= size else np.zeros(0, np.uint64)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[:len(x) - (width - n)], x[width - n:]) if n < width else x


def context_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hash of data[a:b] and a seed, from prefix sums of a polynomial modulo 2^64 (contexts are short)."""
    base = np.uint64(0xD1342543DE82EF95)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), base)]), dtype=np.uint64)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), inverse)]), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data.astype(np.uint64) + np.uint64(77)) * power[:-1], dtype=np.uint64)])
    return mix((total[b] - total[a]) * back[a] + mix(seed.astype(np.uint64) * MULTIPLY + (b - a).astype(np.uint64)))


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor hash, context hash) of each run of windows with one anchor.

    ``ends`` are the ends of the rows that the bytes consist of; no window crosses one.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    h = gram_hashes(data)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << PLACE) - 1)
    anchor = (sliding_least((h & ~low) | place, length - GRAM + 1) & low).astype(np.int64)
    start = np.arange(len(anchor))
    row_end = ends[np.searchsorted(ends, start, side="right")]
    start = start[row_end - start >= length]
    if not len(start):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    anchor = anchor[start]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    at = anchor[new]
    return first, last, h[at], context_hashes(data, first, last + length, at - first)


def _runs(length: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, first window << 8 | windows - 1, anchor, context) of every run of every text."""
        for b in batches:
            keys, (data, offsets) = b.column(0), utf8_of(b.column(1))
            for i, j in blocks_of(offsets, RUN):
                base, stop = int(offsets[i]), int(offsets[j])
                for a in range(base, max(stop, base + 1), RUN):  # a longer row: its windows in stretches
                    part = data[a:min(stop, a + RUN + length - 1)]
                    ends = np.minimum(offsets[i + 1:j + 1] - a, len(part)) if j > i + 1 else np.array([len(part)])
                    first, last, anchor, context = anchors(part, ends, length)
                    row = i + np.searchsorted(offsets[i + 1:j + 1], first + a, side="right")
                    begin = first + a - offsets[row]
                    if len(begin):  # a run has at most length - GRAM + 1 windows: its anchor is in all of them
                        yield pa.record_batch(
                            [keys.take(pa.array(row)), pa.array(begin << 8 | (last - first)), pa.array(anchor.view(np.int64)),
                             pa.array(context.view(np.int64))], ["_key", "_span", "_anchor", "_context"])
                    if stop - base <= RUN:
                        break
    return runs


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array."""
    return suffix_groups(text, len(text))[0]


def suffix_groups(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of their first ``depth`` symbols, and which of the places begin a group of equal ones.

    Larsson-Sadakane: ranks by the first h symbols and those of the suffix up to h further give ranks by up
    to 2h, so that the last step ends at ``depth``; only suffixes whose rank isn't unique are sorted again.
    """
    n = len(text)
    h = max(1, min(7, depth))
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(h, np.uint64)])
    code = np.zeros(n, np.uint64)
    for i in range(h):
        code = code * np.uint64(512) + padded[i:i + n]
    order = np.argsort(code)
    key = code[order]
    border = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(border)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    while h < depth:
        # places of the order that belong to groups of several suffixes
        group = np.flatnonzero(border)
        size = np.diff(np.append(group, n))
        place = np.flatnonzero(np.repeat(size > 1, size))
        if not len(place):
            break
        step = min(h, depth - h)
        suffix = order[place]
        beyond = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + beyond  # below 2^63 for any text that fits into memory
        again = np.argsort(key)
        order[place], key = suffix[again], key[again]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        border[place] |= new
        start = np.flatnonzero(new)
        rank[order[place]] = np.repeat(place[start], np.diff(np.append(start, len(place))))
        h += step
    return order, border


def common_prefixes(text: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix (``most`` at most) of each suffix and the one before it in the order.

    Kasai: from one position to the next the length falls by one at most, so it is carried on.  All
    contexts (begin, size) take their steps side by side.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    carry = np.zeros(len(begin), np.int64)
    longest = np.argsort(-size, kind="stable")
    begin, size = begin[longest], size[longest]
    for step in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -step, side="left"))  # contexts longer than step
        at = begin[:live] + step
        other = before[at]
        length = np.where(other >= 0, np.maximum(carry[:live] - 1, 0), 0)
        grow = np.flatnonzero(other >= 0)
        while len(grow):
            i, j = at[grow] + length[grow], other[grow] + length[grow]
            good = (length[grow] < most) & (i < n) & (j < n)
            good[good] = text[i[good]] == text[j[good]]
            grow = grow[good]
            length[grow] += 1
        out[at] = length
        carry[:live] = length
    return out


def _shard(length: int):
    def shard(table: pa.Table) -> pa.Table:
        """Repeated windows of a shard's contexts, as (key, first byte, end) with no windows; and for
        shards that share an anchor with others, the windows that are still unmatched."""
        table = table.combine_chunks()
        keys, lo = table["_key"].to_pylist(), table["_lo"].to_numpy()
        parts = [np.frombuffer(x, np.uint8) for x in table["_bytes"].to_pylist()]
        size = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        text = np.full(int(size.sum() + len(size)), 256, np.uint16)
        for p, b in zip(parts, begin):
            text[b:b + len(p)] = p
        # windows that are equal follow each other in the order of suffixes by ``length`` symbols
        order, border = suffix_groups(text, length)
        repeated = np.zeros(len(text), bool)
        repeated[order] = ~(border & np.append(border[1:], True))
        out, open_windows = [], []
        salts, single = table["_salts"].to_numpy(), table["_n"].to_numpy() == 1
        for c in range(len(parts)):
            windows = int(size[c]) - length + 1
            mark = repeated[begin[c]:begin[c] + windows]
            if single[c]:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
                out += [(keys[c], int(lo[c] + a), int(lo[c] + b - 1 + length)) for a, b in zip(edge[::2], edge[1::2])]
            if salts[c] > 1:
                open_windows.append(c)
        rows = {"_key": [x[0] for x in out], "_a": [x[1] for x in out], "_b": [x[2] for x in out],
                "_group": [None] * len(out), "_windows": [None] * len(out)}
        if open_windows:
            _cut(rows, table, parts, keys, lo, length, open_windows)
        return pa.table({"_key": pa.array(rows["_key"], pa.binary()), "_a": pa.array(rows["_a"], pa.int64()),
                         "_b": pa.array(rows["_b"], pa.int64()), "_group": pa.array(rows["_group"], pa.string()),
                         "_windows": pa.array(rows["_windows"], pa.binary())})
    return shard


WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("c", "<i8"), ("at", "<i8"), ("key", "V16")])


def _cut(rows: dict, table: pa.Table, parts, keys, lo, length: int, chosen: list[int]) -> None:
    """Adds the distinct windows of contexts that meet others elsewhere, sorted by fingerprint and cut
    by binary search into as many ranges as the anchor has shards."""
    anchor, salts, n = table["_anchor"].to_numpy(), table["_salts"].to_numpy(), table["_n"].to_numpy()
    for a in sorted({int(anchor[c]) for c in chosen}):
        own = [c for c in chosen if anchor[c] == a]
        runs = []
        for c in own:
            first = np.arange(len(parts[c]) - length + 1)
            w = np.zeros(len(first), WINDOW)
            w["h"] = context_hashes(parts[c], first, first + length, first * 0)
            w["g"] = context_hashes(parts[c] ^ np.uint8(0x5A), first, first + length, first * 0 + 1)
            w["c"], w["at"] = int(n[c] > 1), lo[c] + first
            w["key"] = np.frombuffer(keys[c], "V16")[0]
            runs.append(w)
        w = np.concatenate(runs)
        w = w[np.argsort(w["h"], kind="stable")]
        ranges = int(salts[own[0]])
        border = [np.uint64((1 << 64) * r // ranges) for r in range(1, ranges)]
        for r, piece in enumerate(np.split(w, np.searchsorted(w["h"], border))):
            if len(piece):
                for name, value in (("_key", None), ("_a", None), ("_b", None), ("_group", f"{a}:{r}"),
                                    ("_windows", piece.tobytes())):
                    rows[name].append(value)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two pieces sorted by fingerprint as one; where b's windows go is found by binary search."""
    return np.insert(a, np.searchsorted(a["h"], b["h"], side="right"), b)


def _merge(length: int):
    def merge(table: pa.Table) -> pa.Table:
        """Repeated windows of a range, from the sorted pieces of several shards."""
        pieces = [np.frombuffer(x, WINDOW) for x in table["_windows"].to_pylist()]
        while len(pieces) > 1:
            pieces = [merged(*pieces[i:i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        w = pieces[0]
        # equal fingerprints stand together but for collisions of h alone, which g tells apart
        order = np.lexsort((w["g"], w["h"]))
        w = w[order]
        same = (w["h"][1:] == w["h"][:-1]) & (w["g"][1:] == w["g"][:-1])
        repeated = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        w = w[repeated & (w["c"] == 0)]
        return pa.table({"_key": pa.array([x.tobytes() for x in w["key"]], pa.binary()), "_a": pa.array(w["at"]),
                         "_b": pa.array(w["at"] + length)})
    return merge


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the spans from each text."""
    for b in batches:
        data, offsets = utf8_of(b.column(1))
        out = []
        for i, spans in enumerate(b.column(2)):
            text = data[offsets[i]:offsets[i + 1]]
            depth = np.zeros(len(text) + 1, np.int32)
            if spans.is_valid and len(spans):
                spans = spans.values
                np.add.at(depth, np.asarray(spans.field(0)), 1)
                np.add.at(depth, np.asarray(spans.field(1)), -1)
            gone = np.cumsum(depth[:-1]) > 0
            kept = text[~gone].tobytes()
            begins = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
            out.append((len(text), int(gone.sum()), begins, hashlib.sha256(kept).hexdigest(), kept))
        yield pa.record_batch([b.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(
            (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))],
            ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   shard: int = SHARD, kept: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for.

    Each byte covered by a string of ``length`` bytes (64 to 256) that also starts anywhere else,
    in the same text or another row's, is removed; strings are judged on the input.  Null counts as
    empty, and texts shorter than ``length`` are kept whole.  Repeated rows repeat each other's
    strings; other columns aren't read.
    """
    if not 2 * GRAM <= length <= 255 + GRAM:
        raise ValueError("length must be from 64 to 287 bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(text)).alias("_key"), text.alias("_text"))
    # stored before they are counted: finding anchors costs more than writing them
    runs = stored(rows.select("_key", "_text").mapInArrow(_runs(length), "_key binary, _span long, _anchor long, _context long"), "all-runs")
    again = runs.groupBy("_anchor").agg(F.count("*").alias("_n")).filter("_n > 1").select("_anchor")
    runs = stored(runs.join(again, "_anchor", "left_semi"), "runs")
    contexts = runs.groupBy("_anchor", "_context").agg(
        F.count("*").alias("_n"), F.first(F.struct("_key", "_span")).alias("_of"))
    whole = (runs.join(contexts.filter("_n > 1").select("_anchor", "_context"), ["_anchor", "_context"], "left_semi")
             .select("_key", F.shiftright("_span", 8).alias("_a"),
                     (F.shiftright("_span", 8) + F.col("_span").bitwiseAND(255) + length).alias("_b")))

    # anchors with several contexts, some of them seen once
    mixed = (contexts.groupBy("_anchor").agg(F.count("*").alias("_k"), F.min("_n").alias("_least"))
             .filter("_k > 1 and _least = 1")
             .select("_anchor", F.ceil(F.col("_k") / shard).cast("int").alias("_salts")))
    edges = stored(contexts.join(mixed, "_anchor").select("_anchor", "_context", "_n", "_of._key", "_of._span", "_salts"), "edges")
    shards = max(1, -(-edges.count() // shard))
    texts = rows.groupBy("_key").agg(F.first("_text").alias("_text"))
    lo = F.shiftright("_span", 8)
    dealt = (texts.join(edges, "_key")
             .select("_key", "_anchor", "_n", "_salts", lo.alias("_lo"),
                     F.substring(F.col("_text").cast("binary"), (lo + 1).cast("int"),
                                 (F.col("_span").bitwiseAND(255) + length).cast("int")).alias("_bytes"),
                     # an anchor's contexts meet in one shard, or are spread over several of its own
                     F.when(F.col("_salts") == 1, F.pmod(F.xxhash64("_anchor"), F.lit(shards)).cast("string"))
                     .otherwise(F.concat_ws(":", "_anchor", F.pmod(F.xxhash64("_context"), F.col("_salts")))).alias("_shard")))
    found = stored(dealt.groupBy("_shard").applyInArrow(
        _shard(length), "_key binary, _a long, _b long, _group string, _windows binary"), "windows")
    across = found.filter("_group is not null").select("_group", "_windows").groupBy("_group").applyInArrow(
        _merge(length), "_key binary, _a long, _b long")
    spans = (whole.unionByName(found.filter("_group is null").select("_key", "_a", "_b")).unionByName(across)
             .groupBy("_key").agg(F.collect_set(F.struct("_a", "_b")).alias("_spans")))
    result = texts.join(spans, "_key", "left").select("_key", "_text", "_spans").mapInArrow(
        _keep, "_key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept else [])]
    return (rows.select("_id", "_key").join(result.select("_key", *columns), "_key")
            .select(F.col("_id").alias(id_col), *columns))
