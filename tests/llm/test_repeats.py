import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import repeats as R


def brute(rows, length):
    seen = Counter()
    data = [(t or "").encode() for _, t in rows]
    for t in data:
        seen.update(t[i:i + length] for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, data):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((str(d), len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(r):
    def words(n):
        return " ".join("".join(r.choice("abcdeginorstéü") for _ in range(r.randint(1, 8))) for _ in range(n))
    passage, line = words(90), words(12)
    rows = [(i, words(r.randint(0, 150))) for i in range(40)]
    rows += [(100 + i, words(30) + " " + passage[r.randrange(200):] + words(20)) for i in range(25)]
    rows += [(200 + i, line + words(60) + line) for i in range(25)]
    base = words(200).split(" ")
    for i in range(20):
        copy = list(base)
        for k in r.sample(range(len(copy)), 2):
            copy[k] = "zz"
        rows.append((300 + i, " ".join(copy)))
    rows += [(400, "a" * 1000), (401, "a" * 199), (402, "a" * 200), (403, "ab" * 300), (404, "xyz" * 150), (405, None),
             (406, ""), (407, words(100)), (407, rows[0][1]), (None, rows[1][1]), (408, "\0" * 300), (409, passage[:230])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard,run", [(4096, 1 << 20), (7, 700)])
def test_against_brute_force(spark, monkeypatch, shard, run):
    monkeypatch.setattr(R, "RUN", run)
    rows = corpus(random.Random(3))
    df = spark.createDataFrame([(d, t, "x", b"k") for d, t in rows], "doc_id long, text string, n_bytes string, _key binary")
    out = R.remove_repeats(df.repartition(3), shard=shard, kept=True).collect()
    assert sorted((str(x["doc_id"]), *tuple(x)[1:5]) for x in out) == brute(rows, 200)
    assert all(hashlib.sha256(x["kept"]).hexdigest() == x["kept_sha256"] for x in out)
    if shard == 4096:
        assert R.remove_repeats(df.limit(0)).count() == 0
        assert sorted((str(x[0]), *tuple(x)[1:5]) for x in R.remove_repeats(df, length=64).collect()) == brute(rows, 64)


def test_suffix_order_and_common_prefixes():
    r = np.random.default_rng(4)
    for n, letters in ((1, 2), (200, 2), (500, 3), (300, 1)):
        text = r.integers(0, letters, n).astype(np.uint16)
        order = R.suffix_order(text)
        t = text.tolist()
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:])
        lcp = R.common_prefixes(text, order, np.array([0]), np.array([n]), 600)
        for a, b in zip(order[1:].tolist(), order[:-1].tolist()):
            k = 0
            while max(a, b) + k < n and t[a + k] == t[b + k]:
                k += 1
            assert lcp[a] == k


def test_query_against_brute_force(spark):
    from tidemark.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = QUERIES["op9_suffix_dedup"](spark, sf).collect()
    assert sorted((str(x["doc_id"]), *tuple(x)[1:]) for x in out) == brute(rows, 200)


def test_suffixes_in_groups_of_equal_starts():
    """The order goes no further than the windows do, and equal windows form one group of it."""
    r = np.random.default_rng(5)
    for n, letters, depth in ((0, 2, 8), (1, 2, 8), (300, 2, 5), (400, 1, 64), (500, 2, 7), (600, 3, 20), (100, 2, 300)):
        text = r.integers(0, letters, n).astype(np.uint16)
        text[n // 2:] = text[:n - n // 2]  # long repeats
        order, border = R.suffix_groups(text, depth)
        starts = [text[i:i + depth].tolist() for i in range(n)]
        assert sorted(order.tolist()) == list(range(n))
        assert [starts[i] for i in order] == sorted(starts)
        assert border.tolist() == [k == 0 or starts[order[k]] != starts[order[k - 1]] for k in range(n)]
