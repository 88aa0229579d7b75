"""Gradient boosting for many classes: one weighted binary booster per class, as one estimator and one model."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import packed_boosting as pb
from tidemark.operators.stages import StatefulModel

SEED = 42


class _BoostParams(HasFeaturesCol, HasLabelCol, HasWeightCol):
    maxIter = Param(Params._dummy(), "maxIter", "trees of a class's booster", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows a tree sees", TypeConverters.toFloat)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a leaf", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the row samples", TypeConverters.toInt)
    parallelism = Param(Params._dummy(), "parallelism", "classes fitted at a time", TypeConverters.toInt)


class MultiClassBoosting(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """A ``GBTClassifier`` (which knows two classes) for each class against the rest, with row weights.

    Labels are whole numbers from 0.  A number below the largest that no row has gets probability 0; with
    one class only, that class has probability 1.  Of up to ``packed_boosting.VALUES`` values the same trees are grown
    without Spark's jobs.
    """

    def __init__(self, **params):
        super().__init__()
        self._setDefault(maxIter=100, maxDepth=3, stepSize=0.1, subsamplingRate=1.0, minInstancesPerNode=1, seed=SEED,
                         parallelism=4)
        self._set(**params)

    def setWeightCol(self, value: str) -> "MultiClassBoosting":
        return self._set(weightCol=value)

    def values(self) -> dict:
        """What a search may choose, with this estimator's values."""
        return {k: self.getOrDefault(k) for k in sorted(pb.PARAMS)}

    def _fit(self, dataset: DataFrame) -> "MultiClassBoostingModel":
        label = F.col(self.getLabelCol()).cast("long")
        classes = sorted(r[0] for r in dataset.select(label.alias("c")).distinct().collect() if r[0] is not None)   # K rows

        def one(c: int) -> GBTClassificationModel:
            gbt = GBTClassifier(featuresCol=self.getFeaturesCol(), labelCol="_is", **{
                k: self.getOrDefault(k) for k in ("maxIter", "maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode", "seed")})
            if self.isDefined("weightCol"):
                gbt.setWeightCol(self.getWeightCol())
            return gbt.fit(dataset.withColumn("_is", (label == c).cast("double")))

        boosters, trees = {}, None
        if len(classes) > 1:
            weight = self.getWeightCol() if self.isDefined("weightCol") else None
            table = pb.collected(dataset, self.getFeaturesCol(), self.getLabelCol(), weight)
            if table is not None:
                trees = pb.fitted(dataset.sparkSession, table, classes, self.values(), self.getOrDefault("seed"))
        if len(classes) > 1 and trees is None:
            with ThreadPoolExecutor(self.getOrDefault("parallelism")) as pool:
                boosters = dict(zip(classes, pool.map(one, classes)))
        model = MultiClassBoostingModel({"classes": classes, "n_classes": max(classes, default=-1) + 1, "trees": trees,
                                         "features": len(dataset.select(self.getFeaturesCol()).first()[0]) if trees else None})
        model.boosters = boosters
        return self._copyValues(model)


class MultiClassBoostingModel(StatefulModel, _BoostParams):
    """``probability`` (a vector over all class numbers, summing to 1) and ``prediction`` of the fitted boosters."""

    def __init__(self, state: dict | None = None):
        super().__init__(state)
        self.boosters: dict[int, GBTClassificationModel] = {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.state.get("trees"):
            run = pb.probabilities(self.state["trees"], self.state["n_classes"])

            @F.pandas_udf("array<double>")
            def shares(x: pd.Series) -> pd.Series:
                return pd.Series([*run(np.array(x.tolist(), float).reshape(len(x), -1))])

            return self._scored(dataset.withColumn("_shares", shares(vector_to_array(F.col(self.getFeaturesCol())))))
        out, own = dataset, {}
        for c, booster in self.boosters.items():
            one = booster.copy().setFeaturesCol(self.getFeaturesCol()).setProbabilityCol(f"_p{c}")
            out = one.setRawPredictionCol("").setPredictionCol("").transform(out)
            own[c] = vector_to_array(F.col(f"_p{c}"))[1]
        if not own:
            own = {c: F.lit(1.0) for c in self.state["classes"]}
        shares = F.array(*[own.get(c, F.lit(0.0)) for c in range(self.state["n_classes"])])
        out = out.withColumn("_shares", shares).drop(*[f"_p{c}" for c in self.boosters])
        total = F.aggregate("_shares", F.lit(0.0), lambda a, x: a + x)
        return self._scored(out.withColumn("_shares", F.transform("_shares", lambda x: x / total)))

    @staticmethod
    def _scored(out: DataFrame) -> DataFrame:
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return out.withColumn("probability", array_to_vector(F.col("_shares"))).withColumn("prediction", best).drop("_shares")

    @property
    def featureImportances(self):
        """Mean of the boosters' importances, as a dense vector."""
        from pyspark.ml.linalg import Vectors
        if self.state.get("trees"):
            parts = []
            for own in self.state["trees"].values():
                gains = sum(np.bincount(t["feature"], t["gain"], self.state["features"]) for t in own)
                parts.append(gains / (gains.sum() or 1.0))
            return Vectors.dense(sum(parts) / len(parts))
        parts = [b.featureImportances.toArray() for b in self.boosters.values()]
        return Vectors.dense(sum(parts) / len(parts)) if parts else Vectors.dense([])

    def _save_parts(self, path: str) -> None:
        for c, booster in self.boosters.items():
            booster.write().save(f"{path}/boosters/{c}")

    def _load_parts(self, path: str) -> None:
        if len(self.state["classes"]) > 1 and not self.state.get("trees"):
            self.boosters = {c: GBTClassificationModel.load(f"{path}/boosters/{c}") for c in self.state["classes"]}
