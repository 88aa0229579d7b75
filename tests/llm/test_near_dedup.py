import random

import numpy as np
import pyarrow as pa

from tidemark.llm import near_dedup as N
from tidemark.llm.components import components


def jaccard(a, b):
    n = len(np.intersect1d(a, b))
    return n / (len(a) + len(b) - n) if len(a) + len(b) else 1.0


def units_of(texts):
    return list(N.units_by_row(pa.array(texts, pa.string())))


def classes_of(docs):
    """Smallest id of each row's class, by comparing all pairs."""
    units = units_of([t for _, t in docs])
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = units[i], units[j]
            if min(len(a), len(b)) >= N.SIMILARITY * max(len(a), len(b)) and jaccard(a, b) >= N.SIMILARITY:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(docs))]


def text_of(r, n):
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def test_signatures_agree_as_often_as_weighted_jaccard_says():
    r = random.Random(1)
    for n, changes in ((40, 2), (400, 10), (3000, 200), (3000, 900)):
        agree, true = [], []
        for _ in range(12):
            a = text_of(r, n)
            a += a[: n // 4]  # repeated shingles weigh more
            b = list(a)
            for i in r.sample(range(len(b)), changes):
                b[i] = "other"
            ua, ub = units_of([" ".join(x) for x in (a, b)])
            agree.append((N.signatures([ua])[0] == N.signatures([ub, ua])[0]).mean())
            true.append(jaccard(ua, ub))
        assert abs(np.mean(agree) - np.mean(true)) < 0.05
    for n in (1, 2, 5, 20_000):
        assert (N.signatures(units_of([" ".join(text_of(r, n))])) != 0).all()


def test_words_by_row(monkeypatch):
    r = random.Random(9)
    texts = [None, "", "a", "A  b,c!", "É é x", "one two three four five six", " . ", *(" ".join(text_of(r, r.randint(0, 60))) for _ in range(50))]
    whole = units_of(texts)
    assert np.array_equal(units_of(["a B c"])[0], units_of(["A, b; C"])[0])
    assert np.array_equal(units_of(["É x"])[0], units_of(["é x"])[0])
    assert [len(u) for u in whole[:7]] == [0, 0, 1, 1, 1, 2, 0]
    monkeypatch.setattr(N, "RUN", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, units_of(texts), strict=True))


def test_components(spark):
    r = random.Random(2)
    edges = [(f"{i:04}", f"{i + 1:04}") for i in range(0, 40)] + [("0100", f"{i:04}") for i in range(101, 160)]
    edges += [(b, a) for a, b in edges[:10]] + [("0200", "0200")]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{i:04}": "0000" for i in range(41)} | {f"{i:04}": "0100" for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_against_all_pairs(spark):
    r = random.Random(7)
    docs = []
    for _ in range(30):
        base = text_of(r, r.choice([4, 8, 30, 120, 400]))
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for i in r.sample(range(len(copy)), int(len(copy) * r.choice([0, 0.01, 0.03, 0.08]))):
                copy[i] = f"x{r.randrange(1000)}"
            docs.append(" ".join(copy) if r.random() < 0.7 else "  ".join(copy).upper() + ".")
    chain = text_of(r, 300)  # a chain of texts, each near to the next only
    for i in range(12):
        docs.append(" ".join(chain[i * 12:i * 12 + 200]))
    docs += ["", None, " \n", "one", "one", "One!", "long " * 5000, "long " * 5001]
    r.shuffle(docs)
    docs = [(i, t) for i, t in enumerate(docs)] + [(None, docs[0]), (None, "alone with a null id here")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, kept string, _bag int").repartition(4)
    got = N.near_duplicates(df).collect()
    want = classes_of(docs)
    assert sorted((str(x["doc_id"]), str(x["class_id"])) for x in got) == sorted((str(d), str(c)) for (d, _), c in zip(docs, want))
    assert all(x["kept"] == (x["doc_id"] == x["class_id"]) for x in got)
    left = N.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(str(x["doc_id"]) for x in left.collect()) == sorted(str(d) for (d, _), c in zip(docs, want) if d == c or d is None)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_buckets_of_many_components(spark, monkeypatch):
    """Texts that share a long passage fall into the same buckets; few of them are near to each other."""
    monkeypatch.setattr(N, "BLOCK", 4)
    r = random.Random(12)
    passage = text_of(r, 120)
    docs = []
    for _ in range(40):
        own = text_of(r, r.choice([25, 40, 60]))
        for _ in range(r.choice([1, 1, 2, 3])):
            copy = list(own)
            for i in r.sample(range(len(copy)), r.choice([0, 1, 2, 4])):
                copy[i] = f"x{r.randrange(1000)}"
            docs.append(" ".join(passage + copy))
    r.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["class_id"] for x in N.near_duplicates(df).collect()}
    assert got == {d: c for (d, _), c in zip(docs, classes_of(docs))}


def test_prefix_filter_loses_no_pair(spark, monkeypatch):
    """Of random bags with a common passage every near pair of different roots is a candidate, in the last
    round all of them, before it a part that grows with the roots only."""
    monkeypatch.setattr(N, "BLOCK", 16)
    r = random.Random(21)
    bags, passage = [], r.sample(range(10 ** 6), 60)
    for _ in range(25):
        base = r.sample(range(10 ** 6, 10 ** 9), r.choice([1, 2, 5, 9, 30, 60])) + passage[:r.choice([0, 5, 60])]
        for _ in range(r.randint(1, 5)):
            kept = [u for u in base if r.random() > r.choice([0, 0.05, 0.1])] or base
            bags.append(sorted(set(kept + [r.randrange(10 ** 9) for _ in range(r.choice([0, 0, 1, 5]))])))
    rows = [(i.to_bytes(16, "big"), b, bytes(r.randrange(2) for _ in range(100)), (i % 7).to_bytes(16, "big")) for i, b in enumerate(bags)]
    df = spark.createDataFrame(rows, "_bag binary, _units array<long>, _sign binary, _root binary")
    members = N.prefixes(df.select("_bag", "_units"), 0.8).join(df.select("_bag", "_sign", "_root"), "_bag")
    near = {(i, j) for j in range(len(bags)) for i in range(j) if i % 7 != j % 7 and jaccard(bags[i], bags[j]) >= 0.8}
    schema = "a binary, b binary, ra binary, rb binary"
    found = {best: {(int.from_bytes(x["a"]), int.from_bytes(x["b"])) for x in
                    N.split_groups(members).mapInArrow(N._pairs(0.8, best), schema).collect()} for best in (None, 1)}
    assert near and near <= found[None] and found[1] < found[None]
    assert all(i % 7 != j % 7 for i, j in found[None])
    ids = lambda pairs: spark.createDataFrame([tuple(x.to_bytes(16, "big") for x in p) for p in pairs], "a binary, b binary")
    checked = N.verified(ids(found[None]), df, 0.8).collect()
    assert {(int.from_bytes(x["a"]), int.from_bytes(x["b"])) for x in checked} == near


def test_query_against_all_pairs(spark):
    from tidemark.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {x["doc_id"]: x["class_id"] for x in QUERIES["op7_near_dedup"](spark, sf).collect()}
    assert got == {d: c for (d, _), c in zip(docs, classes_of(docs))}


def test_counts_of_units_however_frequent(spark, monkeypatch):
    """Every row gets its unit's count by joins that keep the rows, so frequent units make no more rows than others."""
    from collections import Counter
    r = random.Random(8)
    rows = [(bytes([b]), u) for b in range(60) for u in {0, 1, *(r.randrange(2, 40) for _ in range(8)), 1000 + b}]
    count = Counter(u for _, u in rows)
    df = spark.createDataFrame(rows, "_bag binary, _unit long")
    for hot in (0, 20, 1 << 40):
        monkeypatch.setattr(N, "HOT", hot)
        out = N.counted(df)
        assert sorted((bytes(x["_bag"]), x["_n"], x["_unit"]) for x in out.collect()) == sorted((b, count[u], u) for b, u in rows)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" not in plan and "LeftAnti" not in plan
    assert N.counted(df.limit(0)).count() == 0
