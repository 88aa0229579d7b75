"""Multilayer perceptron with row weights.

Spark's perceptron knows no weights, so that a row of weight 10 has to be there 10 times in every pass.  Here a
row is packed once, beside how often it counts: a pass sums the weighted loss and gradient of the packed rows in
each partition, and the driver takes a step of L-BFGS (a few numbers a weight of the network, whatever the number
of rows).  Start and result are those of Spark's own classifier, which the fitted weights are given to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasTol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Rows that are packed, and multiplied out, together.
BLOCK = 2048
#: Steps that L-BFGS remembers, and trials of a line search.
MEMORY, TRIALS = 10, 10


def packed(layers: Sequence[int]):
    """Blocks of rows as bytes, column by column: features, label and how often a row counts, all doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("_y", "_w"))
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), layers[0])
            rows = np.column_stack([x, y, w])
            if not np.isfinite(rows).all() or not np.isin(y, np.arange(layers[-1])).all():
                raise ValueError(f"features have to be finite numbers, labels whole numbers from 0 to {layers[-1] - 1}")
            blocks = [rows[a:a + BLOCK].T.tobytes() for a in range(0, len(rows), BLOCK)]
            yield pa.record_batch([pa.array(blocks, pa.binary())], ["block"])
    return run


def parts_of(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, bias) views of each layer, in the order in which Spark keeps them."""
    out, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        end = at + n_in * n_out
        out.append((weights[at:end].reshape(n_in, n_out), weights[end:end + n_out]))
        at = end + n_out
    return out


def loss_and_gradient(weights: np.ndarray, layers: Sequence[int], rows: np.ndarray) -> np.ndarray:
    """Sum of weights, of weighted cross-entropies, and of their gradients over packed rows (a column a row)."""
    y, w = rows[-2].astype(np.int64), rows[-1]
    net, seen = parts_of(weights, layers), [rows[:layers[0]]]
    for i, (matrix, bias) in enumerate(net):
        z = matrix.T @ seen[-1]
        z += bias[:, None]
        if i < len(net) - 1:   # sigmoid
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
        seen.append(z)
    z = seen.pop()
    z -= z.max(0)
    label = y * len(y) + np.arange(len(y))
    own_z = z.take(label)
    delta = np.exp(z, out=z)   # becomes the derivative by the last layer's inputs
    total = delta.sum(0)
    out = np.zeros(2 + len(weights))
    out[0], out[1] = w.sum(), w @ (np.log(total) - own_z)
    delta *= w / total
    delta.reshape(-1)[label] -= w
    own = parts_of(out[2:], layers)
    for i in range(len(net) - 1, -1, -1):
        own[i][0][...] = seen[i] @ delta.T
        own[i][1][...] = delta.sum(1)
        if i:
            delta = net[i][0] @ delta
            delta *= seen[i]
            delta *= 1 - seen[i]
    return out


def _pass(weights: np.ndarray, layers: Sequence[int]):
    """Sums of one pass, a row of bytes a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + len(weights))
        with np.errstate(over="ignore"):
            for batch in batches:
                for block in batch.column(0):
                    sums += loss_and_gradient(weights, layers, np.frombuffer(block.as_buffer(), np.float64).reshape(layers[0] + 2, -1))
        yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], ["sums"])
    return run


def wolfe_step(along: Callable[[float], tuple[float, float]], value: float, slope: float, t: float) -> float | None:
    """Step that meets the strong Wolfe conditions (bracketing, then cubic interpolation), None if none is found.

    ``along`` gives the value and slope after a step.
    """
    def enough(v, t):
        return v <= value + 1e-4 * t * slope

    def zoom(left, right):
        for _ in range(TRIALS):
            a, b = sorted((left, right))
            with np.errstate(all="ignore"):
                d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
                d2 = np.sqrt(d1 * d1 - a[2] * b[2])
                t = b[0] - (b[0] - a[0]) * (b[2] + d2 - d1) / (b[2] - a[2] + 2 * d2)
            width = b[0] - a[0]
            t = float(np.clip(t, a[0] + 0.1 * width, a[0] + 0.9 * width)) if np.isfinite(t) else a[0] + width / 2
            v, s = along(t)
            if not enough(v, t) or v >= left[1]:
                right = t, v, s
            else:
                if abs(s) <= 0.9 * abs(slope):
                    return t
                if s * (right[0] - left[0]) >= 0:
                    right = left
                left = t, v, s
        return None

    low = 0.0, value, slope
    for i in range(TRIALS):
        v, s = along(t)
        if not np.isfinite(v):
            t /= 2
            continue
        if not enough(v, t) or (i and v >= low[1]):
            return zoom(low, (t, v, s))
        if abs(s) <= 0.9 * abs(slope):
            return t
        if s >= 0:
            return zoom((t, v, s), low)
        low, t = (t, v, s), 1.5 * t
    return None


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS: ends after ``max_iter`` steps, when values or gradients hardly change, or when no step helps."""
    value, grad = f(x)
    first, values, past, failed = abs(value), [value], [], False
    for step in range(max_iter):
        if np.linalg.norm(grad) <= max(tol * abs(value), 1e-8):
            break
        d, alphas = grad.copy(), []
        for s, y in reversed(past):
            alphas.append(s @ d / (s @ y))
            d -= alphas[-1] * y
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas)):
            d += (a - y @ d / (s @ y)) * s
        d = -d
        tried: dict[float, tuple[float, np.ndarray]] = {}

        def along(t: float) -> tuple[float, float]:
            tried[t] = f(x + t * d)
            return tried[t][0], float(tried[t][1] @ d)

        t = wolfe_step(along, value, float(grad @ d), 1.0 if step else 1 / np.linalg.norm(d))
        if t is None or t * np.linalg.norm(grad) < 1e-10:
            if failed or not past:
                break
            failed, past = True, []
            continue
        failed = False
        new, slope = tried[t]
        past = [*past, (t * d, slope - grad)][-MEMORY:]
        x, value, grad = x + t * d, new, slope
        if abs(value - max(values)) <= tol * first:
            break
        values = [*values, value][-20:]
    return x


class WeightedNetwork(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter, HasTol, HasSeed,
                      DefaultParamsReadable, DefaultParamsWritable):
    """Scaled inputs and a perceptron (sigmoid layers, softmax), fitted as if each row were there ``weightCol`` times.

    Weights are whole numbers.  The model is a pipeline of Spark's scaler and perceptron.
    """

    layers = Param(Params._dummy(), "layers", "sizes of the layers, inputs first", TypeConverters.toListInt)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(maxIter=200, tol=1e-6, seed=SEED)
        self._set(**params)

    def setWeightCol(self, value: str) -> "WeightedNetwork":
        return self._set(weightCol=value)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        spark, layers = dataset.sparkSession, self.getOrDefault("layers")
        features, label = self.getFeaturesCol(), self.getLabelCol()
        weight = F.col(self.getWeightCol()) if self.isDefined("weightCol") else F.lit(1)
        copies = dataset.select(features, F.explode(F.sequence(F.lit(1), weight.cast("int"))))
        scaler = StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True).fit(copies.select(features))
        net = MultilayerPerceptronClassifier(featuresCol="_scaled", labelCol=label, layers=layers, seed=self.getSeed(), maxIter=0)
        one = spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], ["_scaled", label])   # no step is taken on it
        start = net.fit(one).weights.toArray()
        rows = scaler.transform(dataset).select(vector_to_array(F.col("_scaled")).alias("_x"), F.col(label).cast("double").alias("_y"),
                                                weight.cast("double").alias("_w"))
        blocks = rows.mapInArrow(packed(layers), "block binary").persist()

        def summed(weights: np.ndarray) -> tuple[float, np.ndarray]:
            got = blocks.mapInArrow(_pass(weights, layers), "sums binary").collect()   # the network's size, a partition
            sums = sum(np.frombuffer(r["sums"], np.float64) for r in got)
            return float(sums[1] / sums[0]), sums[2:] / sums[0]

        try:
            found = minimise(summed, start, self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        return PipelineModel(stages=[scaler, net.setInitialWeights(Vectors.dense(found)).fit(one)])
