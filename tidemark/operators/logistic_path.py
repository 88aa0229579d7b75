"""One-against-rest L1 logistic regression over a path of penalties, chosen by cross-validation.

All models of a fit - every fold, class and penalty - advance together: a step is one pass over the rows that
sums every model's loss, gradient and curvature, and the driver then takes a proximal Newton step of each
(coordinate descent on its quadratic, halved while the penalised loss rises).  A penalty starts from the
coefficients of the next stronger one, a step after it.  What a step moves is folds x classes x penalties
x features^2 / 2 numbers, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stages import StatefulModel

#: Rows that are multiplied out at a time.
CHUNK = 1024


def _pass(flat: np.ndarray, fold_of: np.ndarray, class_of: np.ndarray, mean: np.ndarray, scale: np.ndarray, groups: int):
    """Sums of one pass, a row of bytes a partition: loss, held-out hits, gradient and curvature of some models.

    ``flat`` has a column of coefficients on standardised features (the intercept first) for each model, which
    is fitted on the rows outside ``fold_of`` it and tells ``class_of`` it from the rest.
    """
    width = len(flat)
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, hits = np.zeros(flat.shape[1]), np.zeros(flat.shape[1])
        grad, curve = np.zeros((width, flat.shape[1])), np.zeros((len(upper[0]), flat.shape[1]))
        for batch in batches:
            y, w, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w", "_fold"))
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            x = np.nan_to_num((x - mean) / scale)  # a missing value counts as the mean
            x = np.concatenate([np.ones((len(y), 1)), x], 1)
            for a in range(0, len(y), CHUNK):
                xs, ws = x[a:a + CHUNK], w[a:a + CHUNK]
                margin = xs @ flat
                target = (y[a:a + CHUNK, None] == class_of[None]).astype(float)
                inside = (fold[a:a + CHUNK, None] != fold_of[None]).astype(float)
                weight = inside * ws[:, None]
                small = np.exp(-np.abs(margin))
                p = np.where(margin >= 0, 1, small) / (1 + small)
                loss += (weight * (np.maximum(margin, 0) + np.log1p(small) - target * margin)).sum(0)
                grad += xs.T @ (weight * (p - target))
                curve += (xs[:, upper[0]] * xs[:, upper[1]]).T @ (weight * p * (1 - p))
                hits += ((1 - inside) * ((margin > 0) == (target > 0.5))).sum(0)
        from pyspark import TaskContext
        sums = np.concatenate([loss, hits, grad.ravel(), curve.ravel()])
        yield pa.record_batch({"g": pa.array([TaskContext.get().partitionId() % groups], pa.int32()),
                               "sums": pa.array([sums.tobytes()], pa.binary())})
    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table.column("sums"))
    return pa.table({"g": table.column("g").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _summed(rows: DataFrame, run, groups: int) -> np.ndarray:
    """Partitions are summed in about the square root of their number of groups, and these on the driver."""
    parts = rows.mapInArrow(run, "g int, sums binary")
    if groups > 8:
        parts = parts.groupBy("g").applyInArrow(_added, "g int, sums binary")
    return sum(np.frombuffer(r["sums"], np.float64) for r in parts.collect())


def newton_direction(coef: np.ndarray, grad: np.ndarray, hess: np.ndarray, lam: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """Minimum over d of grad d + d H d / 2 + sum(lam |coef + d|), for each model, by coordinate descent."""
    d = np.zeros_like(coef)
    slope = grad.copy()  # gradient of the smooth part at d
    for _ in range(sweeps):
        largest = 0.0
        for j in range(coef.shape[1]):
            h = np.maximum(hess[:, j, j], 1e-12)
            u = coef[:, j] + d[:, j] - slope[:, j] / h
            new = np.sign(u) * np.maximum(np.abs(u) - lam[:, j] / h, 0)
            step = new - coef[:, j] - d[:, j]
            d[:, j] += step
            slope += step[:, None] * hess[:, j, :]
            largest = max(largest, float(np.abs(step).max(initial=0)))
        if largest < 1e-10:
            break
    return d


def violation(coef: np.ndarray, grad: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """How far each model is from its optimality conditions: the largest over its coefficients."""
    at_zero = np.maximum(np.abs(grad) - lam, 0)
    return np.where(coef == 0, at_zero, np.abs(grad + lam * np.sign(coef))).max(1)


class _PathParams(HasFeaturesCol, HasLabelCol, HasWeightCol):
    Cs = Param(Params._dummy(), "Cs", "inverse penalties, ascending", TypeConverters.toListFloat)
    foldCol = Param(Params._dummy(), "foldCol", "column of folds 0.. that penalties are judged on", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "passes at most", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "violation of the optimality conditions, per weight of a row", TypeConverters.toFloat)


class L1LogisticPath(Estimator, _PathParams, DefaultParamsReadable, DefaultParamsWritable):
    """For each class against the rest, minimises C sum(w loss) + sum |b_j| (intercept free) for each C of ``Cs``.

    With ``foldCol``, each class takes the C of the largest mean accuracy on held-out folds (the smallest C on
    ties), else the middle one.  Labels are whole numbers from 0; null features and NaN count as the mean.
    """

    def __init__(self, **params):
        super().__init__()
        self._setDefault(Cs=[10.0 ** (-4 + 8 * i / 9) for i in range(10)], maxIter=60, tol=1e-6)
        self._set(**params)

    def setWeightCol(self, value: str) -> "L1LogisticPath":
        return self._set(weightCol=value)

    def _fit(self, dataset: DataFrame) -> "L1LogisticPathModel":
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined("weightCol") else F.lit(1.0)
        fold = F.col(self.getOrDefault("foldCol")).cast("long") if self.isDefined("foldCol") else F.lit(-1).cast("long")
        rows = dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("_x"), weight.alias("_w"),
                              F.col(self.getLabelCol()).cast("long").alias("_y"), F.coalesce(fold, F.lit(-1)).alias("_fold"))
        rows = rows.filter(F.col("_y").isNotNull()).persist()
        try:
            return self._path(rows)
        finally:
            rows.unpersist()

    def _path(self, rows: DataFrame) -> "L1LogisticPathModel":
        cells = rows.groupBy("_y", "_fold").agg(F.sum("_w").alias("w"), F.count("*").alias("n")).collect()  # K x folds rows
        classes = sorted({r["_y"] for r in cells})
        n_folds = max((r["_fold"] for r in cells), default=-1) + 1
        width = rows.select(F.max(F.size("_x"))).first()[0] or 0
        valid = [F.when(~F.isnan(F.col("_x")[j]), F.col("_x")[j]) for j in range(width)]
        stats = rows.agg(*[F.avg(v) for v in valid], *[F.stddev_pop(v) for v in valid]).first()
        mean, scale = np.array([v or 0.0 for v in stats[:width]]), np.array([v or 0.0 for v in stats[width:]])
        flat_ = scale == 0
        safe = np.where(flat_, 1.0, scale)
        cs = sorted(self.getOrDefault("Cs"))
        m, shape = len(cs), (n_folds + 1, len(classes), len(cs), width + 1)
        # the objective is divided by C: loss + sum |b_j| / C, and b_j = coefficient / scale
        lam = np.zeros(shape)
        lam[..., 1:] = (1 / np.array(cs))[None, None, :, None] / safe
        lam[..., 1:][..., flat_] = 1e30  # a constant column has no coefficient
        coef = np.zeros(shape)
        for f in range(n_folds + 1):
            w_all = sum(r["w"] for r in cells if r["_fold"] != f)
            for i, c in enumerate(classes):
                w_own = sum(r["w"] for r in cells if r["_fold"] != f and r["_y"] == c)
                coef[f, i, :, 0] = math.log((w_own + 1e-9) / (w_all - w_own + 1e-9)) if w_all else 0.0
        total_weight = sum(r["w"] for r in cells) or 1.0
        n_models = coef.size // (width + 1)
        lam2 = lam.reshape(n_models, -1)
        started = np.zeros(shape[:3], bool)
        groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))
        upper = np.triu_indices(width + 1)
        good = coef.reshape(n_models, -1).copy()   # where each model stands
        best, direction, step = np.full(n_models, np.inf), np.zeros_like(good), np.ones(n_models)
        grad, worst, hits = np.zeros_like(good), np.full(n_models, np.inf), np.zeros(n_models)
        trial = good.copy()
        penalty = lambda b: (lam2 * np.abs(b)).sum(1)
        fold_of, class_of = (np.broadcast_to(v, shape[:3]).ravel() for v in (
            np.arange(n_folds + 1)[:, None, None], np.array(classes)[None, :, None]))
        limit = self.getOrDefault("tol") * total_weight
        for turn in range(self.getOrDefault("maxIter")):
            if turn < m:  # the next weaker penalty starts where the one before it stands
                now = good.reshape(shape)
                if turn:
                    now[:, :, turn] = now[:, :, turn - 1]
                    trial.reshape(shape)[:, :, turn] = now[:, :, turn]
                started[:, :, turn] = True
            at = np.flatnonzero(started.ravel() & (worst > limit))  # those that have converged rest
            if not len(at):
                if started.all():
                    break
                continue
            sums = _summed(rows, _pass(trial[at].T.copy(), fold_of[at], class_of[at], mean, safe, groups), groups)
            value, seen, sums = sums[:len(at)] + penalty(trial)[at], sums[len(at):2 * len(at)], sums[2 * len(at):]
            g = sums[:(width + 1) * len(at)].reshape(width + 1, len(at)).T
            hess = np.zeros((len(at), width + 1, width + 1))
            hess[:, upper[0], upper[1]] = sums[(width + 1) * len(at):].reshape(-1, len(at)).T
            hess[:, upper[1], upper[0]] = hess[:, upper[0], upper[1]]
            held_best = best[at]
            better = value <= held_best + 1e-12 * np.abs(np.where(np.isinf(held_best), 0, held_best))
            ok = at[better]
            good[ok], best[ok], grad[ok], hits[ok] = trial[ok], value[better], g[better], seen[better]
            worst[ok] = violation(good[ok], grad[ok], lam2[ok])
            if len(ok):
                direction[ok] = newton_direction(good[ok], grad[ok], hess[better], lam2[ok])
                step[ok] = 1.0
            step[at[~better]] /= 2  # the penalised loss rose: half as far
            trial = good + step[:, None] * direction
            trial = np.where(np.abs(trial) < 1e-13 * (1 + np.abs(good)), 0.0, trial)
        full = good.reshape(shape)[-1]
        right = hits.reshape(shape[:3])
        held = np.array([sum(r["n"] for r in cells if r["_fold"] == f) for f in range(n_folds)])
        accuracy = (right[:n_folds][held > 0] / held[held > 0][:, None, None]).mean(0) if (held > 0).any() else None
        pick = accuracy.argmax(1) if accuracy is not None else np.full(len(classes), m // 2)
        chosen = full[np.arange(len(classes)), pick]
        raw = np.where(flat_, 0.0, chosen[:, 1:] / safe)
        model = L1LogisticPathModel({
            "classes": classes, "n_classes": max(classes, default=-1) + 1, "coefficients": raw.tolist(),
            "intercepts": (chosen[:, 0] - raw @ mean).tolist(), "mean": mean.tolist(), "C": [cs[i] for i in pick],
            "Cs": cs, "accuracy": accuracy.tolist() if accuracy is not None else None,
            "violation": float(worst.max(initial=0.0) / total_weight), "passes": turn + 1,
            "path": (full[..., 1:] / safe).tolist()})
        return self._copyValues(model)


class L1LogisticPathModel(StatefulModel, _PathParams):
    """``probability``: every class's sigmoid, divided by their sum; ``prediction``: the largest."""

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        """Coefficients by class number (rows of zeros for numbers that no row had)."""
        own = dict(zip(self.state["classes"], self.state["coefficients"]))
        width = len(self.state["mean"])
        flat = [v for c in range(self.state["n_classes"]) for v in own.get(c, [0.0] * width)]
        return DenseMatrix(self.state["n_classes"], width, flat, isTransposed=True)

    @property
    def interceptVector(self):
        own = dict(zip(self.state["classes"], self.state["intercepts"]))
        return Vectors.dense([own.get(c, 0.0) for c in range(self.state["n_classes"])])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = dict(zip(self.state["classes"], zip(self.state["coefficients"], self.state["intercepts"])))
        mean = F.array(*[F.lit(float(v)) for v in self.state["mean"]])
        x = F.zip_with(vector_to_array(F.col(self.getFeaturesCol())), mean, lambda v, one: F.when(F.isnan(v) | v.isNull(), one).otherwise(v))
        out = dataset.withColumn("_x", x)

        def share(c: int):
            if c not in own:
                return F.lit(0.0)
            coefs, intercept = own[c]
            products = F.zip_with(F.col("_x"), F.array(*[F.lit(float(b)) for b in coefs]), lambda v, b: v * b)
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.aggregate(products, F.lit(float(intercept)), lambda a, v: a + v)))

        out = out.withColumn("_shares", F.array(*[share(c) for c in range(self.state["n_classes"])])).drop("_x")
        total = F.aggregate("_shares", F.lit(0.0), lambda a, v: a + v)
        even = F.lit(1.0 / max(1, len(own)))
        out = out.withColumn("_shares", F.when(total > 0, F.transform("_shares", lambda v: v / total)).otherwise(
            F.array(*[even if c in own else F.lit(0.0) for c in range(self.state["n_classes"])])))
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return out.withColumn("probability", array_to_vector(F.col("_shares"))).withColumn("prediction", best).drop("_shares")
