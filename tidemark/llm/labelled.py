"""Labelled rows for fitting, and the logistic calibration that both classifiers end with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod

#: Hash cells that a sampled fraction is rounded to.
CELLS = 1 << 20


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, held_out_mod: tuple[int, int],
                    max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _y) of labelled rows that aren't held out, about ``max_rows`` of them at most.

    Rows are chosen by a hash of the id, so the choice doesn't depend on partitions or order.  Labels
    other than 0 and 1 are left out, and an id with several labels has the largest.
    """
    k, out = held_out_mod
    marks = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (crc_mod(id_col, k) != out))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y")))
    n = marks.count()
    if n > max_rows:
        marks = marks.filter(F.pmod(F.xxhash64("_id"), F.lit(CELLS)) < int(CELLS * max_rows / n))
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(marks, "_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) of P(y = 1 | x), with Platt's smoothed targets, by damped Newton steps."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    if not n1 or not n0:  # one class only: its smoothed rate, whatever x is
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    design = np.stack([(x - mean) / scale, np.ones_like(x)], 1)
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (p - t) + 1e-3 * w * [1, 0])
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
