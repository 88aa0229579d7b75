import zlib

import numpy as np
import pytest

from tidemark.llm import quality, toxicity
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def measures(rows, labels, out_of):
    pairs = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % out_of[0] == out_of[1])
    s, p, y = map(np.array, zip(*pairs))
    good, bad = s[y == 1][:, None], s[y == 0][None, :]
    auc = ((good > bad) + 0.5 * (good == bad)).mean()
    return auc, (p == y).mean(), len(y)


@pytest.mark.parametrize("key,label,out_of", [("op4_toxicity", "toxic", (4, 2)), ("op8_quality", "quality", (5, 0))])
def test_held_out(spark, key, label, out_of):
    rows = QUERIES[key](spark, SF).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    auc, right, n = measures(rows, labels, out_of)
    print(key, auc, right, n)
    assert n > 500 and auc > 0.97 and right > 0.95


def brute_segments(scores):
    """Maximal scoring segments by their recursive definition: the best one, then left and right of it."""
    total = np.concatenate([[0], np.cumsum(scores)])
    best = max(((total[j] - total[i], -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)),
               default=(0,))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return [*brute_segments(scores[:i]), (i, j, best[0]), *[(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]]


def test_segments():
    r = np.random.default_rng(1)
    for _ in range(200):
        s = r.normal(-0.2, 1, r.integers(0, 30))
        assert [(a, b, round(x, 9)) for a, b, x in toxicity.segments(s)] == [(a, b, round(x, 9)) for a, b, x in brute_segments(s)]
    assert toxicity.segments(np.zeros(0)) == [] and toxicity.segments(np.full(5, -1.0)) == []


def test_features():
    data = np.frombuffer(bytes(np.random.default_rng(2).integers(0, 9, 5000, dtype=np.uint8)), np.uint8)
    whole = quality.features(data)
    run, quality.RUN = quality.RUN, 64
    try:
        assert np.array_equal(quality.features(data), whole)
    finally:
        quality.RUN = run
    assert len(quality.features(data[:0])) == len(quality.features(data[:1])) == 0 and len(quality.features(data[:2])) == 1


@pytest.mark.parametrize("judge,label", [(quality.judge_quality, "quality"), (toxicity.judge_toxicity, "toxic")])
def test_edges(spark, judge, label):
    docs = [(i, f"{'awful rubbish' if i % 2 else 'fine words'} number {i} ends", 0) for i in range(200)]
    docs += [(200, None, 1), (201, "", 1), (None, "fine", 1), (202, "fine words " * 20_000, 1), (0, docs[0][1], 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = [(i, i % 2, i % 2, 7) for i in range(200)] + [(3, None, None, 7), (None, 1, 1, 7), (5, 9, 9, 7), (4, 0, 0, 7)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")
    rows = judge(docs, labels).collect()
    assert len(rows) == 205 and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[201]["score"] == by[200]["score"]
    assert by[1]["score"] > 0.5 > by[2]["score"]
    assert judge(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in judge(docs, labels.limit(0)).collect()} == {0.5}
    one = judge(docs, labels.filter(f"{label} = 1")).collect()
    assert len(one) == 205 and min(r["score"] for r in one) >= 0.5


def test_fit_keeps_no_second_copy_of_the_features():
    """Beside the rows' features, the fit holds arrays of the weights' size only."""
    import tracemalloc
    r = np.random.default_rng(6)
    rows = [np.sort(r.choice(quality.DIMS, 1000, replace=False)).astype(np.int32) for _ in range(4000)]
    y = r.integers(0, 2, 4000)
    tracemalloc.start()
    ratio = quality.log_count_ratio(rows, y)
    quality.dual_descent(rows, y, ratio)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(x.nbytes for x in rows) + 2 * ratio.nbytes
    counts = np.bincount(np.concatenate([x for x, v in zip(rows, y) if v]), minlength=quality.DIMS) + 1.0
    other = np.bincount(np.concatenate([x for x, v in zip(rows, y) if not v]), minlength=quality.DIMS) + 1.0
    assert np.array_equal(ratio, np.log((counts / counts.sum()) / (other / other.sum())))


def test_scores_in_blocks(spark, monkeypatch):
    """Scores don't depend on how a batch is cut, other columns don't pass through Python, and a column named score is kept."""
    weights = np.random.default_rng(7).normal(size=quality.DIMS).astype(np.float32)
    model = quality.QualityModel(weights, 0.1, 1.5, -0.2)
    texts = ["", None, "a", "word " * 300, "é" * 50, *(f"line {i} of text" for i in range(40))]
    df = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts)], "doc_id long, text string, score long").repartition(2)
    want = {i: model.score(quality.features(np.frombuffer((t or "").encode(), np.uint8))) for i, t in enumerate(texts)}
    for size in (1 << 20, 1, 100):
        monkeypatch.setattr(quality, "BLOCK", size)
        out = quality.score_quality(df.drop("score"), model, keep=("doc_id",))
        assert {r["doc_id"]: r["score"] for r in out.collect()} == want
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(quality, "fit_quality", lambda *a, **k: model)
    kept = quality.keep_quality(df, None, threshold=0.5)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(i, t, i * 2) for i, t in enumerate(texts) if want[i] >= 0.5]
