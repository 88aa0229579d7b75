"""Feature statistics and selection from one-pass sufficient statistics.

ANOVA F, variance, correlation, Gram matrix (-> VIF, feature distances) and binned
mutual information are all single aggregations whose outputs have O(p^2) or O(p*K)
rows; the sequential selection rules then run on those tiny tables.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import exact_quantiles
from tidemark.session import stored


def anova_f(df: DataFrame, features: Sequence[str], label_col: str = "label") -> DataFrame:
    """F statistic per feature vs class: group count / mean / population variance in one pass.

    F = [sum_g n_g (m_g - m)^2 / (k - 1)] / [sum_g n_g var_g / (n - k)]; null values skipped
    per feature.
    """
    g = df.groupBy(F.col(label_col).alias("_y")).agg(
        *[e for f in features for e in (F.count(f).alias(f"n_{f}"), F.avg(f).alias(f"m_{f}"),
                                        F.var_pop(f).alias(f"v_{f}"))])
    # a row per class and feature of the one aggregation
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n"), F.col(f"m_{f}").alias("m"),
                               F.col(f"v_{f}").alias("v")) for f in features])
    u = g.select("_y", F.inline(cells))
    u = u.where(F.col("n") > 0)
    w = Window.partitionBy("feature")
    u = u.withColumn("_N", F.sum("n").over(w)) \
         .withColumn("_M", F.sum(F.col("n") * F.col("m")).over(w) / F.col("_N")) \
         .withColumn("_k", F.count(F.lit(1)).over(w))
    a = u.groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("_M")) ** 2).alias("ssb"),
                                 F.sum(F.col("n") * F.col("v")).alias("ssw"), F.max("_N").alias("N"),
                                 F.max("_k").alias("K"))
    f = F.try_divide(F.col("ssb") / (F.col("K") - 1), F.col("ssw") / (F.col("N") - F.col("K")))
    return a.select("feature", f.alias("f_score"))


def select_top(scores: DataFrame, score_col: str, k: int | None = None, threshold: float | None = None) -> DataFrame:
    """threshold (>=) beats top-k beats keep-all; adds ``selected`` and ``rank``."""
    w = Window.orderBy(F.col(score_col).desc_nulls_last(), F.col("feature"))   # one row per feature
    s = scores.withColumn("rank", F.row_number().over(w).cast("long"))
    if threshold is not None:
        sel = F.col(score_col) >= threshold
    elif k is not None:
        sel = F.col("rank") <= k
    else:
        sel = F.lit(True)
    return s.withColumn("selected", F.when(sel, F.lit(1)).otherwise(F.lit(0)).cast("long"))


def variance_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.var_pop(f).alias(f) for f in features])
    return row.unpivot([], list(features), "feature", "variance")


def correlation_matrix(df: DataFrame, features: Sequence[str], upper_only: bool = False) -> DataFrame:
    """Pairwise-complete Pearson r for every pair in one aggregation -> (a, b, r).

    Only the upper triangle (and diagonal) is aggregated - r is symmetric - and mirrored in
    the output.  Zero-variance pairs give null (Spark ANSI would raise; DuckDB gives NaN).
    """
    feats = list(features)
    pairs = [(a, b) for i, a in enumerate(feats) for j, b in enumerate(feats) if j >= i]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        aggs += [F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(x).alias(f"sx{i}"), F.stddev_pop(y).alias(f"sy{i}")]
    row = df.agg(*aggs)
    cols = []
    for i, (a, b) in enumerate(pairs):
        r = F.when((F.col(f"sx{i}") > 0) & (F.col(f"sy{i}") > 0), F.col(f"c{i}") / (F.col(f"sx{i}") * F.col(f"sy{i}")))
        if a != b or not upper_only:
            if not (upper_only and a == b):
                cols.append(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), r.alias("r")))
        if a != b and not upper_only:
            # mirrored cell: same statistic with the roles of x and y swapped
            rm = F.when((F.col(f"sx{i}") > 0) & (F.col(f"sy{i}") > 0),
                        F.col(f"c{i}") / (F.col(f"sy{i}") * F.col(f"sx{i}")))
            cols.append(F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"), rm.alias("r")))
    return row.select(F.explode(F.array(*cols)).alias("s")).select("s.*")


def high_correlation_pairs(corr: DataFrame, order: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Lower-triangle pairs (b before a in ``order``) with |r| >= t; none -> t = 0.8 * max|r|."""
    pos = F.create_map(*[x for i, f in enumerate(order) for x in (F.lit(f), F.lit(i))])
    low = corr.where(F.element_at(pos, F.col("feature_a")) > F.element_at(pos, F.col("feature_b")))
    mx = low.agg(F.max(F.abs("r")).alias("m"), F.count_if(F.abs(F.col("r")) >= threshold).alias("n")).first()
    t = threshold if (mx["n"] or 0) > 0 else 0.8 * (mx["m"] or 0.0)
    return low.where(F.abs(F.col("r")) >= t).withColumn("threshold", F.lit(float(t)))


def select_correlation(corr: DataFrame, order: Sequence[str], threshold: float = 0.8,
                       target_corr: Mapping[str, float] | None = None) -> list[str]:
    """Sequential rule on the p x p table (driver, p^2 numbers): no target -> drop the
    earlier feature of each |r| > t pair; with target -> drop the one weaker to the target."""
    r = {(x["feature_a"], x["feature_b"]): x["r"] for x in corr.collect()}   # p^2 rows
    keep = list(order)
    dropped = set()
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if a in dropped or b in dropped:
                continue
            v = r.get((a, b))
            if v is None or abs(v) <= threshold:
                continue
            if target_corr is None:
                dropped.add(a)
            else:
                dropped.add(a if abs(target_corr.get(a, 0.0)) < abs(target_corr.get(b, 0.0)) else b)
    return [f for f in keep if f not in dropped]


def gram_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, g): sum(a * b) over complete rows, upper triangle, one aggregation."""
    feats = list(features)
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.sum(F.col(a) * F.col(b)).alias("g"))
             for i, a in enumerate(feats) for b in feats[i:]]
    return df.dropna(subset=feats).agg(F.array(*cells).alias("s")).select(F.inline("s"))


def gram_matrix(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Uncentred Gram matrix sum(x_i x_j) over complete rows - one aggregation, p^2 numbers."""
    feats = list(features)
    got = {(r["feature_a"], r["feature_b"]): r["g"] for r in gram_table(df, feats).collect()}  # p^2 / 2 rows
    p = len(feats)
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = got[feats[i], feats[j]] or 0.0
    return g


def vif_from_gram(g: np.ndarray) -> np.ndarray:
    """Uncentred VIF_i = G_ii * (G^-1)_ii (no intercept)."""
    inv = np.linalg.pinv(g)
    return np.diag(g) * np.diag(inv)


def select_vif(df: DataFrame, features: Sequence[str], threshold: float = 10.0) -> tuple[list, list, list]:
    """Iteratively drop the max-VIF feature while it exceeds the threshold; the data is read
    once (Gram matrix), the iterations work on the p x p matrix."""
    feats = list(features)
    g = gram_matrix(df, feats)
    initial = list(zip(feats, vif_from_gram(g).tolist()))
    idx = list(range(len(feats)))
    while len(idx) > 1:
        v = vif_from_gram(g[np.ix_(idx, idx)])
        m = int(np.argmax(v))
        if v[m] <= threshold:
            break
        idx.pop(m)
    final = list(zip([feats[i] for i in idx], vif_from_gram(g[np.ix_(idx, idx)]).tolist()))
    return [feats[i] for i in idx], initial, final


def feature_distance_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Euclidean distance between feature columns over rows where both are present."""
    feats = list(features)
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    row = df.agg(*[F.sum((F.col(a) - F.col(b)) ** 2).alias(f"d{i}") for i, (a, b) in enumerate(pairs)])
    cols = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.sqrt(F.col(f"d{i}")).alias("distance"))
            for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cols)).alias("s")).select("s.*")


def mutual_info_binned(df: DataFrame, features: Sequence[str], label_col: str = "label", n_bins: int = 10) -> DataFrame:
    """MI(feature; class) in nats from an equal-frequency binned contingency table.

    Bin edges are exact quantiles (fitted once); nulls are dropped per feature.
    (The reference uses a k-NN estimator with random jitter - estimates differ.)
    """
    probs = [i / n_bins for i in range(1, n_bins)]
    edges = exact_quantiles(df, features, probs)
    cells = []
    for f in features:
        arr = F.array(*[F.lit(float(e)) for e in edges[f] if e is not None])
        b = F.size(F.filter(arr, lambda e: e < F.col(f)))
        cells.append(F.struct(F.lit(f).alias("feature"), F.when(F.col(f).isNotNull(), b).alias("bin")))
    u = (df.select(F.col(label_col).alias("y"), F.inline(F.array(*cells))).where("bin is not null")
         .groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n")))  # one scan for all features
    wf = Window.partitionBy("feature")
    # (column names are case-insensitive: keep totals distinct from "n")
    u = u.withColumn("_tot", F.sum("n").over(wf)) \
         .withColumn("_nb", F.sum("n").over(Window.partitionBy("feature", "bin"))) \
         .withColumn("_ny", F.sum("n").over(Window.partitionBy("feature", "y")))
    term = (F.col("n") / F.col("_tot")) * F.log((F.col("n") * F.col("_tot")) / (F.col("_nb") * F.col("_ny")))
    return u.groupBy("feature").agg(F.sum(term).alias("mutual_info"))


def feature_groups(names: DataFrame, name_col: str = "feature", mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Group = text before the first '_' or '.', else 'Other' (or an explicit mapping)."""
    if mapping:
        m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        return names.withColumn("group", F.coalesce(F.try_element_at(m, F.col(name_col)), F.lit("Other")))
    has = F.col(name_col).rlike(r"[_.]")
    return names.withColumn("group", F.when(has, F.split(F.col(name_col), r"[_.]", 2)[0]).otherwise(F.lit("Other")))


def group_importance(scores: DataFrame, score_col: str | None) -> DataFrame:
    """Mean score of a group's features (ANOVA F, mutual information, variance...); without a score, their number."""
    n = F.count(F.lit(1))
    mean = n.cast("double") if score_col is None else F.avg(score_col)
    return scores.groupBy("group").agg(mean.alias("mean_importance"), n.alias("n_features")) \
                 .orderBy(F.col("mean_importance").desc())


def standardized_variance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, variance): sample variance after scaling by mean and population deviation; 0 if constant."""
    row = df.agg(*[F.when(F.var_pop(f) > 0, F.var_samp(f) / F.var_pop(f)).otherwise(F.lit(0.0)).alias(f) for f in features])
    return row.unpivot([], list(features), "feature", "variance")


def top_features(scores: DataFrame, score_col: str, n: int) -> DataFrame:
    """The top-n report (limit is the feature)."""
    return scores.orderBy(F.col(score_col).desc(), F.col("feature")).limit(n)


def pca_fit(df: DataFrame, features: Sequence[str], k: int | None = None, variance: float = 0.95):
    """PCA on mean-centred features (Spark's PCA does not centre); k from cumulative variance."""
    from pyspark.ml.feature import PCA, VectorAssembler
    feats = list(features)
    d = df.dropna(subset=feats)
    means = d.agg(*[F.avg(f).alias(f) for f in feats]).first()
    c = d.select(*[(F.col(f) - F.lit(means[f])).alias(f) for f in feats])
    v = VectorAssembler(inputCols=feats, outputCol="features").transform(c)
    full = PCA(k=len(feats), inputCol="features", outputCol="pcs").fit(v)
    ev = full.explainedVariance.toArray()
    if k is None:
        k = int(np.searchsorted(np.cumsum(ev), variance) + 1)
    pc = np.array(full.pc.toArray())[:, :k].copy()
    # sign convention: largest-|loading| entry of each component positive
    for j in range(k):
        if pc[np.argmax(np.abs(pc[:, j])), j] < 0:
            pc[:, j] *= -1
    return {"features": feats, "means": [means[f] for f in feats], "components": pc, "explained_variance": ev[:k],
            "k": k}


def pca_loadings(spark, fit: dict, absolute: bool = False) -> DataFrame:
    rows = []
    for i, f in enumerate(fit["features"]):
        for j in range(fit["k"]):
            v = float(fit["components"][i, j])
            rows.append((f, f"PC{j + 1}", abs(v) if absolute else v))
    return spark.createDataFrame(rows, "feature string, component string, loading double")


def rfe(df: DataFrame, features: Sequence[str], label_col: str = "label", n_select: int = 3,
        num_trees: int = 30) -> DataFrame:
    """Recursive elimination with forest importances (driver loop over fits, cached vectors);
    importance column = (max_rank - rank + 1) / max_rank."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    feats = list(features)
    d = VectorAssembler(inputCols=feats, outputCol="_all", handleInvalid="skip").transform(df).select("_all", label_col)
    d = d.persist()
    from pyspark.ml.functions import vector_to_array
    arr = d.select(vector_to_array("_all").alias("_a"), label_col).persist()
    active = list(range(len(feats)))
    ranking = {}
    step = len(feats)
    while len(active) > n_select:
        sub = arr.select(F.array(*[F.col("_a")[i] for i in active]).alias("_s"), label_col)
        from pyspark.ml.functions import array_to_vector
        sub = sub.select(array_to_vector("_s").alias("features"), label_col)
        m = RandomForestClassifier(labelCol=label_col, numTrees=num_trees, seed=42).fit(sub)
        imp = m.featureImportances.toArray()
        worst = int(np.argmin(imp))
        ranking[feats[active[worst]]] = step
        step -= 1
        active.pop(worst)
    for i in active:
        ranking[feats[i]] = 1
    d.unpersist()
    arr.unpersist()
    mx = max(ranking.values())
    rows = [(f, int(r), (mx - r + 1) / mx, int(r == 1)) for f, r in ranking.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, rank bigint, importance double, selected bigint")


def permutation_importance(model, df: DataFrame, features: Sequence[str], label_col: str = "label",
                           id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """Accuracy drop when one column is permuted: the column's values are re-assigned by a
    seeded hash order (rank join), so the permutation is distributed and reproducible."""
    from pyspark.ml.feature import VectorAssembler
    from tidemark.operators.splits import stratified_rank
    base = df.withColumn("_g", F.lit(0))
    ranked = stratified_rank(base, ["_g"], id_col, seed)               # rank by md5(id)
    natural = stratified_rank(base, ["_g"], id_col, seed + 1)          # a second independent order
    donors = natural.select("_rank", *[F.col(f).alias(f"_v_{f}") for f in features])
    paired = stored(ranked.join(donors, "_rank"), "permuted")          # one join: each row beside its donor

    def acc(frame):
        v = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(frame)
        return model.transform(v).agg(F.avg((F.col("prediction") == F.col(label_col)).cast("double"))).first()[0]

    a0 = acc(df)
    rows = []
    for f in features:
        rows.append((f, float(a0 - acc(paired.withColumn(f, F.col(f"_v_{f}"))))))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def row_clusters(df: DataFrame, features: Sequence[str], k: int = 4, seed: int = 42) -> DataFrame:
    """Min-max scale then bisecting k-means (a top-down hierarchy) -> cluster per row."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import VectorAssembler
    from tidemark.operators.features import apply_scaler, fit_scaler
    d = df.dropna(subset=list(features))
    d = apply_scaler(d, fit_scaler(d, list(features), "minmax"))
    v = VectorAssembler(inputCols=list(features), outputCol="features").transform(d)
    m = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v)
    return m.transform(v).drop("features")


def _log(x):
    return math.log(x)
