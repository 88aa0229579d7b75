"""Exact quantiles, splits and label schemes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import exact_quantiles
from tidemark.operators import labels as lb
from tidemark.operators import splits as sp
from tidemark.sources.policy import policy


@pytest.mark.parametrize("limit", [200_000, 16])
def test_exact_quantiles_match_numpy(spark, limit):
    rnd = random.Random(7)
    a = [rnd.gauss(0, 1) for _ in range(3000)]
    b = [float(rnd.randint(0, 20)) for _ in range(3000)]          # heavy duplicates
    c = [None if i % 4 == 0 else rnd.random() * 100 for i in range(3000)]
    df = spark.createDataFrame(list(zip(a, b, c)), "a double, b double, c double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.99]
    got = exact_quantiles(df, ["a", "b", "c"], probs, limit=limit)
    for name, vals in (("a", a), ("b", b), ("c", [v for v in c if v is not None])):
        exp = np.percentile(np.array(vals), [p * 100 for p in probs])
        assert np.allclose(got[name], exp, rtol=0, atol=1e-12), name


def test_exact_quantiles_all_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_stratified_split_exact_counts(spark):
    rows = [(i, i % 3 if i % 10 else 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id long, label long")
    out = sp.train_test_split(df, "row_id", "label", 0.3)
    got = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    for lab in {l for _, l in rows}:
        n = sum(1 for _, l in rows if l == lab)
        assert got[(lab, "test")] == int(np.ceil(0.3 * n))
        assert got[(lab, "train")] == n - int(np.ceil(0.3 * n))


def test_kfold_sizes_differ_by_at_most_one(spark):
    rows = [(i, i % 4) for i in range(1003)]
    df = spark.createDataFrame(rows, "row_id long, label long")
    f = sp.stratified_kfold(df, "row_id", "label", k=5)
    counts = {}
    for r in f.groupBy("label", "fold").count().collect():
        counts.setdefault(r["label"], []).append(r["count"])
    for v in counts.values():
        assert max(v) - min(v) <= 1


def test_rank_multi_bucket_equals_sort(spark):
    rows = [(i, i % 2) for i in range(700)]
    df = spark.createDataFrame(rows, "row_id long, label long")
    a = {r["row_id"]: r["_rank"] for r in sp.stratified_rank(df, ["label"], "row_id", rows_per_bucket=20).collect()}
    b = {r["row_id"]: r["_rank"] for r in sp.stratified_rank(df, ["label"], "row_id").collect()}
    assert a == b


def test_large_stratum_is_ranked_in_many_tasks(spark):
    df = spark.range(400_000).select(F.col("id").alias("row_id"), F.lit(1).alias("label"))
    r = sp.stratified_rank(df, ["label"], "row_id").persist()
    per = [x["count"] for x in r.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(per) > 1 and max(per) < 0.8 * 400_000
    assert r.agg(F.countDistinct("_rank"), F.max("_rank")).first() == (400_000, 399_999)
    r.unpersist()


# Fixed golden table of outcome triples (M6_Rem, Y1_Rem, Y1_Rem_6) -> lookup class, truth-table class
GOLDEN = [
    (("Yes", "Yes", "Yes"), 7, 1), (("No", "No", "No"), 0, 0), (("Yes", "No", "No"), 2, 5),
    (("No", "Yes", "No"), 4, 2), (("Yes", None, None), 6, None), ((None, None, None), 2, None),
    (("No", None, None), 1, None), ((None, "Yes", None), 2, None), ((None, "No", None), 2, None),
]


def test_label_schemes_golden(spark):
    rows = [(i, *t) for i, (t, _, _) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "patient_id long, M6_Rem string, Y1_Rem string, Y1_Rem_6 string")
    look = {r["patient_id"]: r["label"] for r in lb.outcome_label_lookup(df).collect()}
    truth = {r["patient_id"]: r["label"] for r in lb.outcome_label_truth(df).collect()}
    for i, (_, lk, tt) in enumerate(GOLDEN):
        assert look[i] == lk and truth[i] == tt


def test_policy_presets_and_validation(spark):
    code, yaml_p = policy("code"), policy("yaml")
    assert code.priority_order() == [0, 1, 2, 3, 4, 5, 6, 7]
    assert yaml_p.priority_order() == [0, 3, 2, 5, 6, 1, 4, 7]
    assert policy("code").to_df(spark).count() == 8
    from tidemark.sources.policy import validate_policy
    assert validate_policy(code, spark).count() == 0
    bad = code.merged({"prediction_thresholds": {"3": 1.5}})
    v = validate_policy(bad, spark).collect()
    assert [(r["section"], r["item"]) for r in v] == [("prediction_thresholds", "3")]


def test_group_kfold_never_splits_groups(spark):
    rows = [(i, i % 37, (i * 7) % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, grp long, label long")
    f = sp.balanced_group_kfold(df, "grp", "label", k=5)
    per_group = f.groupBy("grp").agg(F.countDistinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in per_group) and len(per_group) == 37
    assert f.count() == 600
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 20


def test_group_kfold_keeps_null_groups_and_labels(spark):
    rows = [(i, None if i % 3 == 0 else i % 23, None if i % 23 < 6 or i % 7 == 0 else (i * 7) % 4) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, grp long, label long")
    cells = {}
    for _, g, label in rows:
        of = cells.setdefault(g, {})
        of[label] = of.get(label, 0) + 1
    strata = {}
    for g, of in cells.items():
        # most rows; on ties the smallest label, null last
        main = min(of, key=lambda c: (-of[c], c is None, c or 0))
        strata.setdefault((main, sum(of.values()).bit_length()), []).append(g)
    want = {}
    for (main, digits), groups in strata.items():
        groups.sort(key=lambda g: hashlib.md5(("-42-" if g is None else f"{g}-42").encode()).hexdigest())
        want.update({g: (r + (-1 if main is None else main) + digits) % 5 for r, g in enumerate(groups)})
    f = sp.balanced_group_kfold(df, "grp", "label", k=5)
    got = {r["row_id"]: (r["grp"], r["label"], r["fold"]) for r in f.collect()}
    assert f.count() == 900 and got == {i: (g, label, want[g]) for i, g, label in rows}
    s = sp.train_test_split(df, "row_id", "label", 0.3)
    assert s.count() == 900
    n = sum(label is None for _, _, label in rows)
    assert s.filter("label is null and split = 'test'").count() == int(np.ceil(0.3 * n))



def test_exact_quantiles_by_counted_bins(spark, monkeypatch):
    """Ranges are narrowed by counts of bins, which any number of tasks add up; no sketch is merged in one task."""
    import numpy as np
    from tidemark.functions import stats

    def refused(*a, **k):
        raise AssertionError("one task merges every partition's sketch")

    monkeypatch.setattr(stats.F, "percentile_approx", refused)
    rnd = np.random.default_rng(3)
    a = np.concatenate([10.0 ** rnd.uniform(-12, 12, 900), np.full(400, 7.0), -np.ones(50)])
    df = spark.createDataFrame([(float(v), None if i % 9 == 0 else float(i % 4)) for i, v in enumerate(a)], "a double, b double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = stats.exact_quantiles(df, ["a", "b"], probs, limit=20)
    assert np.allclose(got["a"], np.quantile(a, probs), rtol=1e-12)
    assert np.allclose(got["b"], np.quantile([i % 4 for i in range(len(a)) if i % 9], probs))


def test_exact_quantiles_infinite_ends(spark):
    from tidemark.functions import stats
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in [-inf] * 5 + [float(i) for i in range(41)] + [inf] * 5], "a double")
    assert np.allclose(stats.exact_quantiles(df, ["a"], [0.2, 0.5, 0.8], limit=3)["a"], [5.0, 20.0, 35.0])


def test_stratified_rank_counts_once(spark):
    """The rows are read to be counted and to be ranked: twice, in place of three times."""
    from tidemark.operators import splits as sp
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    r = sp.stratified_rank(df, ["g"], "id", rows_per_bucket=50)
    assert r._jdf.queryExecution().sparkPlan().toString().count("Range (") == 2
    rows = r.select("g", "_rank", "_n", F.md5(F.concat(F.col("id").cast("string"), F.lit("-42"))).alias("k")).collect()
    for g in range(3):
        own = sorted((x for x in rows if x["g"] == g), key=lambda x: x["k"])
        assert [x["_rank"] for x in own] == list(range(len(own))) and {x["_n"] for x in own} == {len(own)}


def test_training_rows_are_joined_once(spark):
    """The passes of a fit read the stored split, not the joins, medians and ranks behind it."""
    from tidemark.plans import q_inventory, q_models
    for module in (q_models, q_inventory):
        for part in module._train_test(spark, "/root/testdata/sf0.001"):
            plan = part._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Window" not in plan
