"""BPE encoding and decoding, and token counts, of whole texts on Spark (see bpe.py)."""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import CACHED_CHARS, Cache, tokenizer
from tidemark.llm.common import pieces_of, texts_of

#: Entries of the broadcast table, and of a partition's summary it is made from.
FREQUENT, SUMMARY = 1 << 15, 1 << 13
TOKEN_LIMIT = 1024


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for.

    ``path`` names a word-end BPE tokenizer file that executors can open.  Texts are encoded run by
    run, digests are updated with each run, and memory doesn't grow with the text (but for ``ids``).
    The file has no decoder, so the ids of a run decode to their token strings joined by spaces
    (`Tokenizer.spell`); `Tokenizer.decode` gives running text.  Null counts as empty: no token, digests of the empty string.  Repeated rows
    are encoded one by one; other columns aren't read.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        cache = Cache(t.entry)
        for b in pieces_of(batches):
            out = []
            for text in texts_of(b.column(1)):
                n, kept = 0, array("i")
                digests = hashlib.sha256(), hashlib.sha256()
                for number, run in enumerate(t.encode_words(text, cache)):
                    for d, part in zip(digests, run):
                        d.update((" " + part if number else part).encode("utf-8", "replace"))
                    n += run[0].count(" ") + 1
                    if ids:
                        kept.extend(map(int, run[0].split(" ")))
                out.append((n, *(d.hexdigest() for d in digests), kept))
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()),
                       pa.array([x[2] for x in out], pa.string())]
            names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                ends = pa.array(accumulate((len(x[3]) for x in out), initial=0), pa.int32())
                flat = pa.Array.from_buffers(pa.int32(), sum(len(x[3]) for x in out), [None, pa.py_buffer(b"".join(x[3] for x in out))])
                columns.append(pa.ListArray.from_arrays(ends, flat))
                names.append("ids")
            yield pa.record_batch([b.column(0), *columns], names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(encode, schema)
    return rows.withColumnRenamed("_id", id_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of token ids, through the byte-to-text state machine; null ids give an empty text."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            texts = ["".join(t.decode(x.as_py() or [])) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return rows.mapInArrow(decode, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def frequent_pieces(docs: DataFrame, text_col: str = "text", entries: int = FREQUENT,
                    summary: int = SUMMARY) -> list[str]:
    """The most frequent pieces between spaces, from bounded summaries of all texts.

    Each partition keeps a counter of at most 8 x ``summary`` pieces (the smallest are dropped and
    their bound subtracted when it is full) and hands on the top ``summary``; only these meet.
    """
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in texts_of(b.column(0)):
                seen.update(text.split(" "))
                if len(seen) > 8 * summary:
                    top = seen.most_common(4 * summary + 1)
                    seen = Counter({w: n - top[-1][1] for w, n in top if n > top[-1][1]})
        top = [(w, n) for w, n in seen.most_common(summary) if 0 < len(w) <= CACHED_CHARS]
        yield pa.record_batch([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                              ["w", "n"])

    top = (docs.select(F.col(text_col).alias("_text")).mapInArrow(summarise, "w string, n long")
           .groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(entries).select("w").collect())
    return [r["w"] for r in top]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = TOKEN_LIMIT, pieces: list[str] | None = None) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A piece between spaces is one or more whole pre-tokens.  Lengths of the frequent pieces (at most
    ``FREQUENT``, the same size for any corpus) are broadcast; others are encoded once and kept in
    the worker's bounded cache.  The table is only a short cut: any table gives the same counts.
    Null counts as empty.  Repeated rows are counted one by one; other columns aren't read.
    """
    if pieces is None:
        pieces = frequent_pieces(docs, text_col)
    t = tokenizer(path)
    shared = docs.sparkSession.sparkContext.broadcast({w: t.length(w) for w in pieces})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        cache = Cache(t.length, shared.value)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            n = [t.count(x, cache) for x in texts_of(texts)]
            yield pa.record_batch([b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64())],
                                  ["_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long"))
    return rows.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
