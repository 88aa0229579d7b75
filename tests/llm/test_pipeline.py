"""The corpus pipeline: each stage against brute force on its own input, and the whole run."""

import random
from collections import Counter

from test_decontaminate import damaged, edits, words
from test_near_dedup import classes_of
from tokenizers import Tokenizer as Library

import corpus_pipeline
import numpy as np
import public_tokenizers
from tidemark.llm import decontaminate, quality

DOCS, LABELS, ITEMS = "doc_id long, text string, lang string, n int", "doc_id long, quality int", "item_id long, text string"


def tables(spark, folder, docs, labels, items):
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("benchmark", items, ITEMS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def folded(text):
    return bytes(decontaminate.folded(np.frombuffer(text.encode(), np.uint8)))


def leaks(text, items):
    for _, item in items:
        size = len((item or "").encode())
        if size >= decontaminate.LEAST_ITEM and text and edits(folded(item), folded(text)) <= size // 10:
            return True
    return False


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    bad = lambda n: " ".join(r.choice(["zzz", "qqq!", "vvv", "xxx9", "wwww"]) for _ in range(n))
    items = [(1, words(r, 8)), (2, words(r, 6)), (3, None), (4, "")]
    docs = [(i, bad(40) if i % 4 == 0 else words(r, 40), "en", i) for i in range(60)]
    text = dict((d, t) for d, t, _, _ in docs)
    docs += [(60, text[1], "de", None), (61, text[2] + " more", None, 1), (62, words(r, 30) + " " + items[0][1].upper(), "en", 2),
             (63, words(r, 30) + " " + damaged(r, items[1][1], 2) + " " + words(r, 30), "en", 2), (64, None, "en", 3),
             (65, "", "en", 3), (66, words(r, 30), "en", 4), (None, words(r, 35), None, None)]
    docs.append(docs[-2])
    labels = [(i, int(i % 4 != 0)) for i in range(60)] + [(None, 1), (5, None)]
    sf = tables(spark, tmp_path / "sf", docs, labels, items)
    now, marks, rows = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), None
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [tuple(x) for x in now.collect()]
        if number == 0:
            good = {(x["doc_id"]) for x in quality.judge_quality(now, marks).filter("predicted = 1").collect()}
            want = [x for x in rows if x[0] in good]
            assert not {x[0] for x in want} & set(range(0, 60, 4)) and {1, 2, 62, 63} <= good
        elif number == 1:
            top = {}
            for d, t, *_ in rows:
                top[t or ""] = max((x for x in (top.get(t or ""), d) if x is not None), default=None)
            want = [x for x in rows if top[x[1] or ""] == x[0]]
        elif number == 2:
            least = classes_of([(d, t or "") for d, t, *_ in rows])
            kept = {x[0] for x, d in zip(rows, least) if x[0] == d}
            want = [x for x in rows if x[0] in kept]
        elif number == 3:
            want = [x for x in rows if not leaks(x[1], items)]
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{number}")
        columns, now = now.columns, spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert now.columns == columns and Counter(tuple(x) for x in now.collect()) == Counter(want), number
            assert 0 < len(want) < len(rows), number
    lib = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((d, tuple(lib.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)
    last = now.collect()
    assert Counter((x["doc_id"], tuple(x["ids"])) for x in last) == want
    assert Counter(map(repr, corpus_pipeline.run(spark, sf).collect())) == Counter(map(repr, last))


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path / "sf", [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    docs = spark.createDataFrame([(1, "a text", "en", 1), (None, None, None, None)], DOCS)
    assert corpus_pipeline.decontamination(spark, docs, sf).count() == 2
