"""Distributed category dictionary and sparse one-hot vectors against a plain encoding."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import categories as ca
from tidemark.operators import features as fe


def plain(rows, cols, dictionary, drop):
    out = []
    for r in rows:
        one, base = [], 0
        for i, _ in enumerate(cols):
            names = dictionary[i]
            if r[i] in names and names.index(r[i]) >= drop:
                one.append(base + names.index(r[i]) - drop)
            base += len(names) - drop
        out.append((one, base))
    return out


@pytest.mark.parametrize("most", [200_000, 3])
def test_sparse_vectors(spark, monkeypatch, most):
    monkeypatch.setattr(ca, "MOST_BROADCAST", most)
    values = [("b", "x"), ("a", None), (None, "y"), ("é", "x"), ("", "x"), ("B", "z z")] * 5 + [("hot", "x")] * 60
    cols = ["k 1", "k2"]
    df = spark.createDataFrame([(i, *v, 0) for i, v in enumerate(values)], "id long, `k 1` string, k2 string, col int").repartition(6)
    words = ca.category_dictionary(df, cols)
    got = {(r["col"], r["value"]): (r["index"], r["n"]) for r in words.collect()}
    names = [sorted({v[i] for v in values if v[i] is not None}, key=lambda s: s.encode()) + ([None] if any(v[i] is None for v in values) else [])
             for i in range(2)]
    assert got == {(c, v): (j, sum(x[i] == v for x in values)) for i, c in enumerate(cols) for j, v in enumerate(names[i])}
    for drop in (0, 1):
        out = ca.one_hot_sparse(df, cols, words, drop_first=bool(drop)).orderBy("id")
        assert out.columns == [*df.columns, "categories"]
        for r, (ones, width) in zip(out.collect(), plain(values, cols, names, drop), strict=True):
            assert r["categories"].size == width and r["categories"].indices.tolist() == ones
    new = spark.createDataFrame([(0, "unseen", "x", 0), (1, "a", "unseen", 0)], df.schema)
    rows = ca.one_hot_sparse(new, cols, words, drop_first=False).orderBy("id").collect()
    want = plain([("unseen", "x"), ("a", "unseen")], cols, names, 0)
    assert [(r["categories"].indices.tolist(), r["categories"].size) for r in rows] == want
    assert ca.one_hot_sparse(df.limit(0), cols).count() == 0


def test_wide_columns_are_bounded(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(ValueError):
        fe.fit_categories(df, ["k"], most=49)
    assert len(fe.fit_categories(df, ["k"], most=50)["k"]) == 50
