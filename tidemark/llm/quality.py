"""Quality classifier: naive Bayes support vectors over byte n-gram indicators.

A text's features are the distinct byte 2-grams (by value) and 4-grams (hashed), scaled by the
class log-count ratios of naive Bayes and by 1/sqrt(number of features), so that texts of one
word and of 20,000 are comparable.  A linear hinge-loss model is fitted to them by dual coordinate
descent, its weights are interpolated with their mean magnitude, and a logistic curve through
out-of-fold margins turns margins into scores.  Fitting takes a bounded sample of labelled rows
(``max_rows``) in one task; scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, utf8_of
from tidemark.llm.labelled import fit_logistic, sigmoid, training_sample

PAIRS, HASHED = 1 << 16, 1 << 18
DIMS = PAIRS + HASHED
#: Rows that the fit takes at most, and the held-out remainder of crc32(id).
MAX_ROWS, HELD_OUT = 8000, (5, 0)
SMOOTHING, COST, EPOCHS, MIX = 1.0, 1.0, 12, 0.25
THRESHOLD = 0.3
#: Bytes of a text that are looked at together; longer texts are taken in overlapping runs.
RUN = 1 << 20
#: Bytes of a batch that are scored together.
BLOCK = 1 << 20


def features(data: np.ndarray) -> np.ndarray:
    """Distinct feature numbers (sorted) of a text's bytes."""
    parts = []
    for a in range(0, max(len(data) - 1, 0), RUN):
        run = data[a:a + RUN + 3].astype(np.uint32)
        two = run[:-1] << 8 | run[1:]
        parts.append(two)
        if len(run) > 3:
            four = two[:-2] << 16 | two[2:]
            parts.append(((four * np.uint32(2654435761)) >> np.uint32(14)) + np.uint32(PAIRS))
        if len(parts) > 2:
            parts = [distinct(np.concatenate(parts))]
    return distinct(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


@dataclass
class QualityModel:
    """Weights by feature (with the log-count ratios in them), bias and calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum(dtype=np.float64) / np.sqrt(max(len(found), 1)) + self.bias)

    def score(self, found: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(found) + self.intercept))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of the smoothed share of each feature in class 1 over that in class 0."""
    def share(k):
        n = np.full(DIMS, SMOOTHING)
        for r, v in zip(rows, y):
            if v == k:
                n[r] += 1  # a row's features are distinct
        return n / n.sum()
    return np.log(share(1) / share(0))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; one dual variable a row, visited in random order."""
    w, bias = np.zeros(DIMS), 0.0

    def values(i: int) -> np.ndarray:  # made for each visit: those of all rows would take twice their features' memory
        return ratio[rows[i]] / np.sqrt(max(len(rows[i]), 1))

    norm = np.array([v @ v + 1.0 for v in map(values, range(len(rows)))])
    sign = np.where(y == 1, 1.0, -1.0)
    # both classes weigh the same in all
    most = COST * len(y) / 2 / np.where(y == 1, max(y.sum(), 1), max(len(y) - y.sum(), 1))
    dual, random = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in random.permutation(len(y)):
            own = values(i)
            slack = sign[i] * (w[rows[i]] @ own + bias) - 1
            new = min(max(dual[i] - slack / norm[i], 0.0), most[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                w[rows[i]] += step * own
                bias += step
                dual[i] = new
    return w, bias


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> QualityModel:
    def fit(rows, y):
        ratio = log_count_ratio(rows, y)
        w, bias = dual_descent(rows, y, ratio)
        w = MIX * w + (1 - MIX) * np.abs(w).mean()
        return QualityModel((w * ratio).astype(np.float32), bias, 1.0, 0.0)

    margins, half = np.zeros(len(y)), np.arange(len(y)) % 2 == 0
    for part in (half, ~half):
        m = fit([r for r, p in zip(rows, part) if p], y[part])
        margins[~part] = [m.margin(r) for r, p in zip(rows, part) if not p]
    model = fit(rows, y)
    model.slope, model.intercept = fit_logistic(margins, y) if len(y) else (0.0, 0.0)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS,
                held_out: tuple[int, int] = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Model from at most about ``max_rows`` labelled rows.  Texts become feature numbers where they
    are read; one task gathers these and fits; the driver gets the weights (1.3 MB).  Without any
    labelled row every score is 0.5."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8_of(b.column(1))
            found = [features(data[at[i]:at[i + 1]]).astype(np.int32) for i in range(b.num_rows)]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.int32())), b.column(2)], ["_id", "_f", "_y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y, ids = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            rows += [np.asarray(x.values, dtype=np.int32) for x in b.column(1)]
            y += b.column(2).to_pylist()
        order = np.argsort(np.array([str(i) for i in ids])) if ids else []
        m = fit_rows([rows[i] for i in order], np.array([y[i] for i in order], dtype=np.int64))
        yield pa.record_batch([pa.array([m.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([m.bias]),
                               pa.array([m.slope]), pa.array([m.intercept])], ["w", "b", "s", "i"])

    sample = training_sample(docs, labels, label_col, held_out, max_rows, id_col, text_col)
    kind = dict(sample.dtypes)["_id"]
    row = (sample.select("_id", "_text", "_y").mapInArrow(extract, f"_id {kind}, _f array<int>, _y int")
           .repartition(1).mapInArrow(fit, "w binary, b double, s double, i double").first())
    if row is None:
        return QualityModel(np.zeros(DIMS, np.float32), 0.0, 0.0, 0.0)
    return QualityModel(np.frombuffer(row["w"], dtype=np.float32), row["b"], row["s"], row["i"])


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns of ``docs`` and score (0 to 1, higher: better), for every row.

    The score reads the whole text and nothing else; null counts as empty, and an empty text gets
    the score of a margin of bias alone.
    """
    return docs.select(*[F.col(c) for c in keep], scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))


def scorer(spark: SparkSession, model: QualityModel):
    """Column function of a text's score.  Only texts go to Python and only scores come back; a batch is
    taken in blocks of ``BLOCK`` bytes, so that no copies of a whole one are made."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m, scores = shared.value, []
        for part in blocks(texts):
            data, off = utf8_of(part)
            scores += [m.score(features(data[off[i]:off[i + 1]])) for i in range(len(part))]
        return pa.array(scores, pa.float64())

    return score


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a string column of about ``BLOCK`` bytes each."""
    rows = max(1, len(texts) * BLOCK // max(texts.nbytes, 1))
    for i in range(0, len(texts), rows):
        yield texts.slice(i, rows)


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted.  Repeated rows are scored one by one."""
    model = fit_quality(docs, labels, max_rows=max_rows, id_col=id_col, text_col=text_col)
    k, out = HELD_OUT
    scored = score_quality(docs, model, id_col, text_col, (id_col,))
    return scored.select(id_col, (crc_mod(id_col, k) == out).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    return docs.filter(scorer(docs.sparkSession, model)(F.col(text_col)) >= threshold)
