"""Clinical cost policy: per-class risk level, weight, threshold and error costs.

A policy is a tiny, fixed-size table (one row per class).  It is passed explicitly to
every operator (never global state) and used either as literal map expressions inside
projections (no join at all) or as a broadcast dimension DataFrame.
"""

from __future__ import annotations

import copy
import json
import os
from dataclasses import dataclass, field
from typing import Any, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RISK_LEVELS = ("high_risk", "moderate_risk", "low_risk")

# The code-default policy (class descriptions, risk groups, weights,
# thresholds, error costs, stratification cut points, recommendations, time discount).
CODE_POLICY: dict[str, Any] = {
    "class_definitions": {
        "0": "No remission at 6 months, No remission at 12 months, Poor treatment adherence (Highest risk)",
        "1": "No remission at 6 months, No remission at 12 months, Moderate treatment adherence (Very high risk)",
        "2": "Remission at 6 months, No remission at 12 months - Early Relapse with significant functional decline (High risk)",
        "3": "No remission at 6 months, Remission at 12 months, Poor treatment adherence (Moderate-high risk)",
        "4": "Remission at 6 months, No remission at 12 months, Maintained social functioning (Moderate risk)",
        "5": "No remission at 6 months, Remission at 12 months, Good treatment adherence (Moderate-low risk)",
        "6": "Remission at 6 months, Remission at 12 months with some residual symptoms (Low risk)",
        "7": "Remission at 6 months, Remission at 12 months, Full symptomatic and functional recovery (Lowest risk)",
    },
    "risk_levels": {"high_risk": [0, 1, 2], "moderate_risk": [3, 4, 5], "low_risk": [6, 7]},
    "class_weights": {"0": 10.0, "1": 8.0, "2": 7.0, "3": 5.0, "4": 4.0, "5": 3.0, "6": 2.0, "7": 1.0},
    "prediction_thresholds": {"0": 0.2, "1": 0.25, "2": 0.3, "3": 0.35, "4": 0.4, "5": 0.45, "6": 0.5, "7": 0.55},
    "error_costs": {
        "false_negative": {"high_risk": 10.0, "moderate_risk": 5.0, "low_risk": 1.0},
        "false_positive": {"high_risk": 1.0, "moderate_risk": 2.0, "low_risk": 3.0},
    },
    "stratification_thresholds": {"high_risk": 0.3, "moderate_risk": 0.2},
    "clinical_recommendations": {
        "high_risk": [
            "Consider more frequent monitoring (weekly)",
            "Implement strategies to improve medication adherence",
            "Intensive psychosocial interventions",
            "Family/caregiver education and involvement",
            "Regular monitoring for early warning signs of relapse",
            "Consider case management or assertive community treatment",
        ],
        "moderate_risk": [
            "Increase monitoring frequency (bi-weekly)",
            "Address specific modifiable risk factors",
            "Targeted psychosocial support",
            "Education about early warning signs",
            "Regular medication review",
            "Employment/educational support as appropriate",
        ],
        "low_risk": [
            "Maintain standard monitoring schedule",
            "Continue current management plan",
            "Routine monitoring for changes in status",
            "Focus on functional recovery and social integration",
            "Gradual transition to less intensive services",
        ],
    },
    "time_discount_factor": 0.9,
}

# The YAML preset overrides (risk groups, weights, thresholds).
YAML_OVERRIDES: dict[str, Any] = {
    "risk_levels": {"high_risk": [0, 3], "moderate_risk": [2, 5, 6], "low_risk": [1, 4, 7]},
    "class_weights": {"0": 10.0, "1": 1.0, "2": 3.0, "3": 8.0, "4": 1.0, "5": 4.0, "6": 3.0, "7": 1.5},
    "prediction_thresholds": {"0": 0.3, "1": 0.5, "2": 0.4, "3": 0.3, "4": 0.5, "5": 0.4, "6": 0.4, "7": 0.5},
}


def deep_merge(base: Mapping, new: Mapping) -> dict:
    """Recursive dict merge: mappings merge key by key, everything else is replaced."""
    out = copy.deepcopy(dict(base))
    for k, v in new.items():
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
            out[k] = deep_merge(out[k], v)
        else:
            out[k] = copy.deepcopy(v)
    return out


@dataclass
class Policy:
    config: dict = field(default_factory=lambda: copy.deepcopy(CODE_POLICY))

    # -- derived driver-side views (K entries, K = number of classes) -----------------
    @property
    def classes(self) -> list[int]:
        return sorted(int(c) for c in self.config["class_definitions"])

    def risk_of(self, cls: int, default: str | None = "low_risk") -> str | None:
        for lvl in RISK_LEVELS:
            if int(cls) in [int(x) for x in self.config["risk_levels"].get(lvl, [])]:
                return lvl
        return default

    def priority_order(self, classes=None) -> list[int]:
        classes = self.classes if classes is None else list(classes)
        out = []
        for lvl in RISK_LEVELS:
            out += [c for c in classes if self.risk_of(c, None) == lvl]
        out += [c for c in classes if self.risk_of(c, None) is None]
        return out

    def fn_cost(self, level: str) -> float:
        return float(self.config["error_costs"]["false_negative"][level])

    def fp_cost(self, level: str) -> float:
        return float(self.config["error_costs"]["false_positive"][level])

    def weight(self, cls: int) -> float | None:
        w = self.config["class_weights"].get(str(cls))
        return None if w is None else float(w)

    def threshold(self, cls: int) -> float | None:
        t = self.config["prediction_thresholds"].get(str(cls))
        return None if t is None else float(t)

    @property
    def high_risk_classes(self) -> list[int]:
        return [int(c) for c in self.config["risk_levels"].get("high_risk", [])]

    @property
    def time_discount(self) -> float:
        return float(self.config.get("time_discount_factor", 0.9))

    def rows(self) -> list[tuple]:
        order = self.priority_order()
        out = []
        for c in self.classes:
            lvl = self.risk_of(c)
            out.append((c, self.config["class_definitions"][str(c)], lvl, self.weight(c), self.threshold(c),
                        self.fn_cost(lvl), self.fp_cost(lvl), order.index(c)))
        return out

    # -- Spark views -------------------------------------------------------------------
    SCHEMA = T.StructType([
        T.StructField("cls", T.LongType()), T.StructField("description", T.StringType()),
        T.StructField("risk_level", T.StringType()), T.StructField("class_weight", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()), T.StructField("fn_cost", T.DoubleType()),
        T.StructField("fp_cost", T.DoubleType()), T.StructField("priority", T.LongType())])

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per class; K rows, safe to broadcast."""
        return spark.createDataFrame(self.rows(), self.SCHEMA)

    def _map(self, values: Mapping[int, Any], dtype: str) -> Column:
        items = []
        for k, v in values.items():
            if v is None:
                continue
            items += [F.lit(int(k)).cast("long"), F.lit(v).cast(dtype)]
        return F.create_map(*items) if items else F.create_map().cast(f"map<bigint,{dtype}>")

    def risk_expr(self, cls_col, default: str = "moderate_risk") -> Column:
        """class -> risk level; unknown classes default to ``default`` (callers use moderate)."""
        m = self._map({c: self.risk_of(c, None) for c in self.classes}, "string")
        return F.coalesce(F.try_element_at(m, F.col(cls_col).cast("long") if isinstance(cls_col, str) else cls_col.cast("long")),
                          F.lit(default))

    def level_cost_expr(self, level_col: Column, kind: str) -> Column:
        costs = self.config["error_costs"]["false_negative" if kind == "fn" else "false_positive"]
        items = []
        for lvl, v in costs.items():
            items += [F.lit(lvl), F.lit(float(v))]
        return F.try_element_at(F.create_map(*items), level_col)

    def weight_expr(self, cls_col: Column) -> Column:
        return F.try_element_at(self._map({c: self.weight(c) for c in self.classes}, "double"), cls_col.cast("long"))

    def threshold_expr(self, cls_col: Column) -> Column:
        return F.try_element_at(self._map({c: self.threshold(c) for c in self.classes}, "double"), cls_col.cast("long"))

    def priority_expr(self, cls_col: Column) -> Column:
        order = self.priority_order()
        return F.try_element_at(self._map({c: i for i, c in enumerate(order)}, "bigint"), cls_col.cast("long"))

    def merged(self, overrides: Mapping) -> "Policy":
        return Policy(deep_merge(self.config, overrides))


def policy(preset: str = "code") -> Policy:
    if preset == "code":
        return Policy()
    if preset == "yaml":
        return Policy(deep_merge(CODE_POLICY, YAML_OVERRIDES))
    raise ValueError(f"unknown policy preset {preset!r}")


def read_policy(path: str | None, spark: SparkSession | None = None) -> Policy:
    """Read a policy file (.json / .yaml / .yml) merged over the code default; missing -> default.

    With ``spark`` the file is read through Spark (any shared filesystem URI)."""
    if spark is not None and path:
        try:
            text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())   # one file
        except Exception:  # noqa: BLE001 - missing file falls back to the default
            return Policy()
        data = _parse(text, path)
        return Policy(deep_merge(CODE_POLICY, data))
    if not path or not os.path.exists(path):
        return Policy()
    with open(path) as fh:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml  # optional dependency
            except ImportError as e:  # pragma: no cover
                raise RuntimeError("YAML policy files need PyYAML") from e
            data = yaml.safe_load(fh) or {}
        else:
            data = json.load(fh)
    return Policy(deep_merge(CODE_POLICY, data))


def _parse(text: str, path: str) -> dict:
    if path.endswith((".yaml", ".yml")):
        import yaml
        return yaml.safe_load(text) or {}
    return json.loads(text)


def write_policy(p: Policy, path: str, spark: SparkSession | None = None) -> str:
    """Write JSON / YAML by extension; with ``spark`` through Spark (one text file under ``path``)."""
    if spark is not None:
        if path.endswith((".yaml", ".yml")):
            import yaml
            text = yaml.safe_dump(p.config, sort_keys=True)
        else:
            text = json.dumps(p.config, sort_keys=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return path
    with open(path, "w") as fh:
        if path.endswith((".yaml", ".yml")):
            import yaml
            yaml.safe_dump(p.config, fh, sort_keys=True)
        else:
            json.dump(p.config, fh, indent=2, sort_keys=True)
    return path


def validate_policy(p: Policy, spark: SparkSession) -> DataFrame:
    """Violations table (section, item, problem); empty when the policy is valid.

    Checks required sections, equal class sets across definitions / risk levels / weights,
    and thresholds strictly inside (0, 1) - as set operations on small DataFrames.
    """
    cfg = p.config
    required = ["class_definitions", "risk_levels", "class_weights", "prediction_thresholds", "error_costs"]
    rows = [("config", s, "missing section") for s in required if s not in cfg]
    defs = spark.createDataFrame([(int(c),) for c in cfg.get("class_definitions", {})], "cls bigint")
    lv = spark.createDataFrame([(int(c),) for l in cfg.get("risk_levels", {}).values() for c in l] or [], "cls bigint")
    wt = spark.createDataFrame([(int(c),) for c in cfg.get("class_weights", {})], "cls bigint")
    th = spark.createDataFrame([(int(c), float(v)) for c, v in cfg.get("prediction_thresholds", {}).items()],
                               "cls bigint, threshold double")
    base = spark.createDataFrame(rows, "section string, item string, problem string")
    miss_lv = defs.join(lv, "cls", "left_anti").select(F.lit("risk_levels").alias("section"),
                                                       F.col("cls").cast("string").alias("item"),
                                                       F.lit("class without risk level").alias("problem"))
    extra_lv = lv.distinct().join(defs, "cls", "left_anti").select(F.lit("risk_levels"), F.col("cls").cast("string"),
                                                                   F.lit("undefined class in risk levels"))
    miss_w = defs.join(wt, "cls", "left_anti").select(F.lit("class_weights"), F.col("cls").cast("string"),
                                                      F.lit("class without weight"))
    bad_t = th.where((F.col("threshold") <= 0) | (F.col("threshold") >= 1)).select(
        F.lit("prediction_thresholds"), F.col("cls").cast("string"), F.lit("threshold outside (0,1)"))
    return base.unionAll(miss_lv).unionAll(extra_lv).unionAll(miss_w).unionAll(bad_t)
