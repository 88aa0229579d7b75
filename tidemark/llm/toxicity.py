"""Toxicity by maximum-scoring segments of token log-odds.

Tokens get log-odds between toxic and clean labelled texts with an informative Dirichlet prior;
the significant ones are the lexicon.  A toxic passage is modelled as background text into which
the lexicon's words are mixed, so a token's score is the log-likelihood ratio of the two, and other
tokens score a little below zero.  A linear scan finds all maximal scoring segments, that is, all
toxic passages of a text.  Segment scores of clean texts follow an extreme-value law; the
significance of a text's segments under it, summed, goes through a logistic curve.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import Cache
from tidemark.llm.common import crc_mod, texts_of
from tidemark.llm.components import stored
from tidemark.llm.labelled import fit_logistic, sigmoid, training_sample

#: Rows that the fit takes at most, and the held-out remainder of crc32(id).
MAX_ROWS, HELD_OUT = 20_000, (4, 2)
#: Least z value of a lexicon word's log-odds.
LEAST_Z = 5.0
#: Weight of the prior as a share of the smaller class, share of lexicon words in a toxic passage,
#: largest token score.
PRIOR, MIXED, LARGEST = 0.1, 0.05, 8.0
#: Lengths of a word's leading letters that are tokens too.
STEMS = (4, 5, 6, 7)
#: Times that a fitted text counts a token at most.
MOST_A_TEXT = 5
THRESHOLD = 0.3


def word(piece: str) -> str:
    """A piece between white space without case and outer punctuation."""
    piece = piece.lower()
    if piece.isalnum():
        return piece
    a, b = 0, len(piece)
    while a < b and not piece[a].isalnum():
        a += 1
    while b > a and not piece[b - 1].isalnum():
        b -= 1
    return piece[a:b]


def tokens(piece: str) -> list[str]:
    """The word, and its stems marked by '~': languages that compound and inflect hide a term there."""
    w = word(piece)
    return [w, *[w[:n] + "~" for n in STEMS if n < len(w)]]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their scores, in linear time.

    Runs between positive scores are taken as one step.  A segment joins with the nearest earlier
    one whose left sum is lower, as long as that one's right sum isn't higher.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, left, right, nearest with a lower left sum
    for i in up.tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= left:
                k = found[k][4]
            if k < 0 or found[k][3] >= right:
                found.append((start, end, left, right, k))
                break
            start, left, k_next = found[k][0], found[k][2], found[k][4]
            del found[k:]
            k = k_next
    return [(s, e, r - lo) for s, e, lo, r, _ in found]


@dataclass
class ToxicityModel:
    """Word scores, score of other words, extreme-value law (rate, log of K) and calibration."""

    lexicon: dict[str, float] = field(default_factory=dict)
    other: float = float(np.log(1 - MIXED))
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    intercept: float = 0.0

    def cache(self) -> Cache:
        return Cache(lambda piece: max(self.lexicon.get(t, self.other) for t in tokens(piece)))

    def passages(self, text: str, cache: Cache) -> tuple[list[tuple[int, int, float]], int]:
        """(segments by word number, words of the text)."""
        words = text.split()
        return segments(np.fromiter(map(cache.__getitem__, words), np.float64, len(words))), len(words)

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """Sum over the segments of how far each lies beyond what a clean text of n words gives."""
        level = self.log_k + np.log(max(n, 1))
        return float(sum(max(0.0, self.rate * s - level) for _, _, s in found))

    def score(self, found: list[tuple[int, int, float]], n: int) -> float:
        return float(sigmoid(self.slope * self.evidence(found, n) + self.intercept))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic count, clean count), summed within runs of a partition.  A text counts a token
    a few times at most, so that one text that repeats it can't make it significant."""
    sums: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        words = list(sums[0].keys() | sums[1].keys())
        out = pa.record_batch([pa.array(words, pa.string()), pa.array([sums[1][w] for w in words], pa.int64()),
                               pa.array([sums[0][w] for w in words], pa.int64())], ["w", "n1", "n0"])
        sums[0].clear(), sums[1].clear()
        return out

    for b in batches:
        for text, y in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
            own: Counter = Counter()
            for piece, n in Counter(text.split()).items():
                for t in tokens(piece):
                    own[t] += n
            sums[y].update({t: min(n, MOST_A_TEXT) for t, n in own.items()})
            if len(sums[0]) + len(sums[1]) > 200_000:
                yield flush()
    yield flush()


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS,
                 held_out: tuple[int, int] = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Model from at most about ``max_rows`` labelled rows; the driver gets the lexicon (the words of these
    rows beyond ``LEAST_Z``, all of them) and its segments' scores.  Without labelled rows every score is 0.5.

    The sampled rows and their counts are written once to the shared folder, as totals, lexicon and
    calibration each read them.
    """
    sample = stored(training_sample(docs, labels, label_col, held_out, max_rows, id_col, text_col)
                    .select("_text", "_y"), "toxic-rows")
    sums = stored(sample.mapInArrow(count_words, "w string, n1 long, n0 long").filter("w != ''")
                  .groupBy("w").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "toxic-words")
    all1, all0 = sums.agg(F.sum("n1"), F.sum("n0")).first()
    if not all1 or not all0:
        n = sample.agg(F.count("*"), F.sum("_y")).first()
        return ToxicityModel(intercept=float(np.log(((n[1] or 0) + 1) / (n[0] - (n[1] or 0) + 1))))
    weight = PRIOR * min(all1, all0)
    alpha = weight * (F.col("n1") + F.col("n0")) / (all1 + all0)
    a1, a0 = F.col("n1") + alpha, F.col("n0") + alpha
    odds = F.log(a1 / (all1 + weight - a1)) - F.log(a0 / (all0 + weight - a0))
    top = (sums.select("w", odds.alias("odds"), (odds / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
           .filter(F.col("z") >= LEAST_Z).collect())
    # a toxic passage has lexicon words MIXED of the time, in the proportions of the log-odds
    model = ToxicityModel({r["w"]: float(min(LARGEST, np.log(1 - MIXED + MIXED * np.exp(min(r["odds"], 30.0)))))
                           for r in top})
    model.lexicon = {w: s for w, s in model.lexicon.items() if s > 0}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = m.cache()
        for b in batches:
            found = [m.passages(t, cache) for t in texts_of(b.column(0))]
            yield pa.record_batch([pa.array([[s for _, _, s in f] for f, _ in found], pa.list_(pa.float64())),
                                   pa.array([n for _, n in found], pa.int64()), b.column(1)], ["s", "n", "y"])

    rows = sample.mapInArrow(best, "s array<double>, n long, y int").collect()
    clean = np.array([[max(r["s"], default=0.0), max(r["n"], 1)] for r in rows if r["y"] == 0]).reshape(-1, 2)
    # the largest of n words' segments is about Gumbel: location log(K n) / rate, deviation pi / (rate sqrt 6)
    if len(clean):
        model.rate = float(min(1.0, np.pi / np.sqrt(6) / max(clean[:, 0].std(), 1e-3)))
        model.log_k = float((model.rate * clean[:, 0] - np.log(clean[:, 1])).mean() - 0.5772156649015329)
    x = np.array([model.evidence([(0, 0, s) for s in r["s"]], r["n"]) for r in rows])
    model.slope, model.intercept = fit_logistic(x, np.array([r["y"] for r in rows]))
    return model


def judge_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted, n_passages, best_start, best_end, best_score.

    The score reads the whole text and nothing else.  Null counts as empty; a text without any
    lexicon word has no passage (best_* are null) and the score of no evidence.  best_start and
    best_end are word numbers of the strongest passage.  Repeated rows are scored one by one, and
    other columns aren't read.
    """
    model = fit_toxicity(docs, labels, max_rows=max_rows, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = m.cache()
        for b in batches:
            rows = [m.passages(t, cache) for t in texts_of(b.column(1))]
            best = [max(f, key=lambda s: (s[2], -s[0]), default=(None, None, None)) for f, _ in rows]
            yield pa.record_batch(
                [b.column(0), pa.array([m.score(f, n) for f, n in rows], pa.float64()),
                 pa.array([len(f) for f, _ in rows], pa.int32()), pa.array([x[0] for x in best], pa.int64()),
                 pa.array([x[1] for x in best], pa.int64()), pa.array([x[2] for x in best], pa.float64())],
                ["_id", "score", "n_passages", "best_start", "best_end", "best_score"])

    k, out = HELD_OUT
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        score, f"_id {kind}, score double, n_passages int, best_start long, best_end long, best_score double")
    return rows.select(F.col("_id").alias(id_col), (crc_mod("_id", k) == out).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"),
                       "n_passages", "best_start", "best_end", "best_score")
