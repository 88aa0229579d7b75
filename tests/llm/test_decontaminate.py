import random

import numpy as np

from tidemark.llm import decontaminate as D
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def edits(item, text):
    """Fewest edits of the item against any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def words(r, n):
    return " ".join("".join(r.choice("abcdeginorst") for _ in range(r.randint(2, 9))) for _ in range(n))


def damaged(r, text, n):
    text = list(text)
    for _ in range(n):
        i = r.randrange(len(text))
        kind = r.random()
        if kind < 0.34:
            text[i] = r.choice("xyz")
        elif kind < 0.67:
            text.insert(i, r.choice("xyz"))
        else:
            del text[i]
    return "".join(text)


def test_against_full_alignment(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, words(r, r.randint(6, 30))) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (53, "é" * 40)]
    docs = []
    for i in range(160):
        text = words(r, r.randint(0, 40))
        if i % 2:
            k, item = r.choice(items[:12])
            text += " " + damaged(r, item, r.randint(0, int(len(item) * 0.14))) + " " + words(r, r.randint(0, 20))
        docs.append((i, text.upper() if i % 5 == 0 else text, "item"))
    docs += [(900, None, ""), (901, "", ""), (902, items[0][1], ""), (902, items[0][1], ""), (None, items[1][1], ""),
             (903, words(r, 3000) + items[2][1] + words(r, 2000), ""), (904, "x" * 20 + "é" * 40, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    fold = lambda t: bytes(D.folded(np.frombuffer(t.encode(), np.uint8)))
    want = set()
    for d, text, _ in docs:
        if d == 903:
            want.add((903, 2, 0))
            continue
        for k, item in items:
            if item and len(item.encode()) >= D.LEAST_ITEM and text:
                size = len(item.encode())
                n = edits(fold(item), fold(text))
                if n <= size // 10:
                    want.add((d, k, n))
    got = [tuple(x)[:3] for x in D.contaminated(df, bench).collect()]
    assert set(got) == want and len(got) == len(want) + 1
    assert {tuple(x)[:3] for x in D.contaminated(df, bench, block_bytes=300).collect()} == want
    left = D.drop_contaminated(df, bench)
    assert left.columns == df.columns
    assert {x["doc_id"] for x in left.collect()} == {d for d, _, _ in docs} - {d for d, _, _ in want}
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0


def test_short_items_have_the_whole_budget(spark):
    r = random.Random(8)
    items = [(1, "kilogram"), (2, "seven blue cats"), (3, "sixteen bytes ok"), (4, "a passage of 28 bytes, whole"), (5, "short"),
             (6, "Ünï cöde"), (7, None), (8, "blue cats sleep at sea"), (9, "thirty-one bytes of a passage !"), (10, "ten bytes!"),
             (11, "go"), (12, ""), (13, "x7q")]
    docs = [(0, "a KILOGRAM of it"), (1, "kilo gram"), (2, "seven, blue cats"), (3, "xseven blue catsx"), (4, "seven blve cats"),
            (5, "short"), (6, "ünï cöde Ünï cöde"), (7, None), (8, ""), (9, "kilogra"), (10, "see blxe cats sleep az sea, "),
            (11, "x"), (12, "an x7q"), (13, "ago")]
    docs += [(20 + i, words(r, 5) + damaged(r, items[i % 10][1] or "none at all", i % 5) + words(r, 5)) for i in range(200)]
    fold = lambda t: bytes(D.folded(np.frombuffer(t.encode(), np.uint8)))
    want = {(d, k, edits(fold(item), fold(text))) for d, text in docs for k, item in items if text and item}
    want = {(d, k, n) for d, k, n in want if n <= len(dict(items)[k].encode()) // 10}
    assert {(0, 1, 0), (3, 2, 0), (4, 2, 1), (6, 6, 0), (10, 8, 2), (13, 11, 0)} <= want
    assert {(8, 2), (9, 3), (10, 1)} <= {(k, n) for _, k, n in want}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(x)[:3] for x in D.contaminated(df, bench, least_item=1).collect()} == want
    long = {k for k, t in items if t and len(t.encode()) >= D.LEAST_ITEM}
    assert {tuple(x)[:3] for x in D.contaminated(df, bench).collect()} == {x for x in want if x[1] in long}


def test_long_rows_in_runs(monkeypatch):
    r = random.Random(6)
    monkeypatch.setattr(D, "RUN", 512)
    items = [(i, words(r, 20).encode()) for i in range(4)]
    rows = [(words(r, 100) + damaged(r, items[0][1].decode(), 6) + words(r, 150) + items[3][1].decode()).encode(),
            items[1][1], b"", words(r, 400).encode()]
    data = np.frombuffer(b"".join(rows), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    index, = D.ItemIndex.build(items)
    assert [(a, b) for a, b, _, _ in D.find_items(data, offsets, index)] == [(0, 0), (0, 3), (1, 1)]


def test_query_finds_passages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontaminate"](spark, SF).collect()}
    assert want and want <= got and len(got) <= len(want) + 3
