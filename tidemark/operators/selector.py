"""Feature selection as a stage: an ordered list of methods, each fitted on what the one before it left."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import models as md
from tidemark.operators import selection as sl
from tidemark.operators.stages import StatefulModel

METHODS = ("importance", "statistical", "mutual_info", "variance", "rfe", "pca")


def choose(scores: dict[str, float], threshold: float | None, n: int | None) -> list[str]:
    """Names whose score reaches the threshold; without one the ``n`` largest (ties: earlier); else all.  Order is kept."""
    if threshold is not None:
        return [c for c, s in scores.items() if s is not None and s >= threshold]
    if n is not None:
        names = list(scores)
        ranked = sorted(names, key=lambda c: (-(scores[c] if scores[c] is not None else -np.inf), names.index(c)))
        return [c for c in names if c in ranked[:n]]
    return list(scores)


def elimination_order(df: DataFrame, features: Sequence[str], label_col: str, kind: str, params: dict, least: int = 1,
                      scored: DataFrame | None = None) -> tuple[list[str], dict[int, float]]:
    """Features as they are dropped, the least important of a fit first, until ``least`` remain.

    With ``scored``, also the accuracy on those rows of the model of each size.
    """
    left, dropped, accuracy = list(features), [], {}
    while True:
        model = md.make_classifier(kind, label_col, weight_col=None, **params).fit(md.assemble(df, left))
        if scored is not None:
            hit = (F.col("prediction") == F.col(label_col)).cast("double")
            accuracy[len(left)] = model.transform(md.assemble(scored, left)).agg(F.avg(hit)).first()[0] or 0.0
        if len(left) <= least:
            return dropped, accuracy
        weights = dict(md.model_importance({"model": model, "features": left}))
        worst = min(left, key=lambda c: (weights[c], left.index(c)))
        left.remove(worst)
        dropped.append(worst)


def eliminated(df: DataFrame, features: Sequence[str], label_col: str, kind: str, params: dict, n: int | None, folds: int,
               id_col: str) -> dict[str, float]:
    """Score of each feature by recursive elimination: 1 for those that stay, less the earlier one goes.

    Without ``n``, the number that stays has the largest accuracy summed over label-stratified folds
    (the fewest features on ties).
    """
    from tidemark.operators.splits import stratified_kfold
    if n is None:
        dealt = stratified_kfold(df, id_col, label_col, folds).persist()
        total = {size: 0.0 for size in range(1, len(features) + 1)}
        for f in range(folds):
            _, accuracy = elimination_order(dealt.filter(F.col("fold") != f), features, label_col, kind, params,
                                            scored=dealt.filter(F.col("fold") == f))
            for size, value in accuracy.items():
                total[size] += value
        dealt.unpersist()
        n = min(total, key=lambda size: (-total[size], size))
    dropped, _ = elimination_order(df, features, label_col, kind, params, least=n)
    rank = {c: len(dropped) - i + 1 for i, c in enumerate(dropped)}
    most = max(rank.values(), default=1)
    return {c: (most - rank.get(c, 1) + 1) / most for c in features}


class FeatureSelector(Estimator, HasInputCols, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """``methods`` in order: importance, statistical (ANOVA F), mutual_info, variance, rfe or pca.

    After each method but pca (whose components replace the columns), ``threshold`` keeps the columns whose score
    reaches it; without one ``nFeatures`` keeps the largest; without either all stay.  ``model`` and
    ``modelParams`` name the classifier of importance and rfe.  Columns that aren't inputs pass through.
    """

    methods = Param(Params._dummy(), "methods", "methods, applied in order", TypeConverters.toListString)
    threshold = Param(Params._dummy(), "threshold", "least score that stays", TypeConverters.toFloat)
    nFeatures = Param(Params._dummy(), "nFeatures", "columns that stay", TypeConverters.toInt)
    model = Param(Params._dummy(), "model", "kind of classifier", TypeConverters.toString)
    modelParams = Param(Params._dummy(), "modelParams", "its parameters", TypeConverters.identity)
    folds = Param(Params._dummy(), "folds", "folds of rfe without nFeatures", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "row key that folds are dealt by", TypeConverters.toString)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(methods=["importance"], model="random_forest", modelParams={}, folds=5, idCol="row_id")
        self._set(**params)

    def _scores(self, method: str, df: DataFrame, cols: list[str]) -> dict[str, float]:
        label, kind, params = self.getLabelCol(), self.getOrDefault("model"), self.getOrDefault("modelParams")
        n = self.getOrDefault("nFeatures") if self.isDefined("nFeatures") else None
        if method == "importance":
            fitted = md.make_classifier(kind, label, weight_col=None, **params).fit(md.assemble(df, cols))
            found = dict(md.model_importance({"model": fitted, "features": cols}))
        elif method == "rfe":
            found = eliminated(df, cols, label, kind, params, min(n, len(cols)) if n else None, self.getOrDefault("folds"),
                               self.getOrDefault("idCol"))
        else:
            table = {"statistical": lambda: sl.anova_f(df, cols, label), "mutual_info": lambda: sl.mutual_info_binned(df, cols, label),
                     "variance": lambda: sl.variance_table(df, cols)}[method]()
            name = [c for c in table.columns if c != "feature"][0]
            found = {r["feature"]: r[name] for r in table.collect()}  # one row a feature
        return {c: found.get(c) for c in cols}

    def _fit(self, dataset: DataFrame) -> "FeatureSelectorModel":
        threshold = self.getOrDefault("threshold") if self.isDefined("threshold") else None
        n = self.getOrDefault("nFeatures") if self.isDefined("nFeatures") else None
        unknown = [m for m in self.getOrDefault("methods") if m not in METHODS]
        if unknown:
            raise ValueError(f"unknown feature selection method: {unknown[0]}")
        cols, steps, df = list(self.getInputCols()), [], dataset
        for method in self.getOrDefault("methods"):
            if method == "pca":
                fit = sl.pca_fit(df, cols, n)
                step = {"method": method, "columns": cols, "means": [float(v) for v in fit["means"]],
                        "components": fit["components"].tolist(), "selected": [f"PC{i + 1}" for i in range(fit["k"])],
                        "explained": [float(v) for v in fit["explained_variance"]],
                        "scores": dict(zip(cols, np.abs(fit["components"]).mean(1).tolist()))}
            else:
                scores = self._scores(method, df, cols)
                step = {"method": method, "columns": cols, "scores": scores, "selected": choose(scores, threshold, n)}
            steps.append(step)
            df, cols = FeatureSelectorModel({"steps": [step]}).transform(df), step["selected"]
        return FeatureSelectorModel({"steps": steps, "selected": cols})


class FeatureSelectorModel(StatefulModel):
    """Fitted steps with their scores; saved and read with its state."""

    @property
    def selected(self) -> list[str]:
        return self.state["selected"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for step in self.state["steps"]:
            gone = [c for c in step["columns"] if step["method"] == "pca" or c not in step["selected"]]
            if step["method"] == "pca":
                centred = [F.col(c) - F.lit(m) for c, m in zip(step["columns"], step["means"])]
                out = out.withColumns({name: sum((x * F.lit(row[j]) for x, row in zip(centred, step["components"])), F.lit(0.0))
                                       for j, name in enumerate(step["selected"])})
            out = out.drop(*gone)
        return out
