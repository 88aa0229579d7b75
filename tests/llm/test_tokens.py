import hashlib
import json
import random

import pytest
from tokenizers import Tokenizer as Library

import public_tokenizers
from tidemark.llm import tokens
from tidemark.llm.bpe import Cache, MergeList, pieces, tokenizer

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a  b ", "a\n \nb", "x   ", "\n\n", "ΑΣ Σ ΟΔΟΣ", "İstanbul", "é café", "it's IT'S don't 've",
       "<|endoftext|>hi<|startoftext|> <|endoftext|>", "a\x1cb \x1f c", "日本語 한국어", "12 345²Ⅷ", "a\x85b\u2028c",
       "ab" * 3000, "a" * 1500, "!!!! " + "=" * 300, "foo \n bar\n  baz\t\tq  ", " ́x", "👩‍👩‍👧 é", "a b  c",
       "a \0b", " \0", "x \0word", "\0", "\0a \0\0 b", "a\u0558b c\u058bd", "a\u1c89b", "1\U00010d40\u00b2"]


def noise(n, seed=1, alphabet="ab 'sre\n\t é́.<|endoftext|>Z9\0\u0558"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_encoder_equals_library():
    t, lib = tokenizer(WORD), Library.from_file(WORD)
    cache = Cache(t.entry, entries=50)
    for x in ODD + noise(500):
        runs, want = list(t.encode_words(x, cache)), lib.encode(x, add_special_tokens=False).ids
        assert " ".join(r[0] for r in runs) == " ".join(map(str, want))
        assert " ".join(r[1] for r in runs) == lib.decode(want, skip_special_tokens=False)


def test_counter_equals_library():
    t, lib = tokenizer(BYTE), Library.from_file(BYTE)
    cache = Cache(t.length, entries=50)
    for x in ODD + noise(500):
        assert t.count(x, cache) == len(lib.encode(x, add_special_tokens=False).ids), x


def test_every_code_point_is_split_like_the_library():
    """Letters and numbers are those of the library, for both files, at every code point that can be in a text."""
    for path in (WORD, BYTE):
        pattern, lib = tokenizer(path).pattern, Library.from_file(path).pre_tokenizer
        marked = [f"a{chr(c)}b1{chr(c)}2" for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
        wrong = [x for x in marked if [len(w.encode()) for w in pattern.findall(x)] != [len(o) for o, _ in lib.pre_tokenize_str(x)]]
        assert not wrong, wrong[:20]
    encoder, lib = tokenizer(WORD), Library.from_file(WORD)
    cache = Cache(encoder.entry)
    for x in (f"e{chr(c)} {chr(c)}'s" for c in range(0x80, 0x1FA00) if not 0xD800 <= c < 0xF900 and not 0x3500 <= c < 0x9F00):
        assert " ".join(r[0] for r in encoder.encode_words(x, cache)) == " ".join(map(str, lib.encode(x, add_special_tokens=False).ids)), x


def test_lookahead_is_sufficient():
    """Streamed tokens equal those of merging the whole, for random proper merge lists and the real one."""
    r = random.Random(3)
    for _ in range(60):
        alphabet, merges, seen = "abc", [], ["a", "b", "c"]
        for _ in range(12):
            m = (r.choice(seen), r.choice(seen))
            if m not in merges and len("".join(m)) <= 6:
                merges.append(m)
                seen.append("".join(m))
        ml = MergeList(merges, {s: i for i, s in enumerate(dict.fromkeys(seen))})
        text = [r.choice(alphabet) for _ in range(600)]
        assert list(ml.stream(text)) == ml.merge(text)
        short = ml.merge(text[:300])
        ends, whole = set(), ml.merge(text)
        at = 0
        for x in whole:
            at += len(x)
            ends.add(at)
        at = 0
        for x in short:
            at += len(x)
            if at <= 300 - ml.lookahead:
                assert at in ends
    ml = tokenizer(BYTE).merges
    text = [r.choice("thealo") for _ in range(4000)]
    assert list(ml.stream(text)) == ml.merge(text)


def test_pieces_and_round_trip():
    text = "the cat sat é on 日本 the mat " * 50
    assert "".join(pieces(text, 100)) == text
    t, lib = tokenizer(BYTE), Library.from_file(BYTE)
    ids = lib.encode(text, add_special_tokens=False).ids + [50256]
    assert "".join(t.decode(ids)) == text + "<|endoftext|>"
    w = tokenizer(WORD)
    ids = [int(i) for run in w.encode_words(text, Cache(w.entry)) for i in run[0].split(" ")]
    assert "".join(w.decode(ids)).split() == text.split()


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate([*ODD, None, ODD[7], "word " * 30_000])] + [(None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _id int")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_encode_decode_rows(spark, odd_docs):
    lib = Library.from_file(WORD)
    got = {r["doc_id"]: r for r in tokens.encode_decode(odd_docs, WORD, ids=True).collect()}
    for row in odd_docs.collect():
        want = lib.encode(row["text"] or "", add_special_tokens=False).ids
        r = got[row["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["ids"]) == (len(want), sha(" ".join(map(str, want))), want)
        assert r["decoded_sha256"] == sha(lib.decode(want, skip_special_tokens=False))
    texts = {r["doc_id"]: r["text"] for r in tokens.decode_ids(tokens.encode_decode(odd_docs, WORD, ids=True), WORD).collect()}
    assert texts[len(ODD)] == "" and texts[None].split() == ["null", "id"]
    assert tokens.encode_decode(odd_docs.limit(0), WORD).count() == 0


def test_decoding_reads_the_ids(spark, tmp_path):
    """Two strings share an id, so only what is decoded from ids shows the second one."""
    path = tmp_path / "shared.json"
    model = {"merges": [], "vocab": {"a</w>": 0, "b</w>": 1, "z</w>": 0}, "end_of_word_suffix": "</w>"}
    path.write_text(json.dumps({"model": model, "added_tokens": [{"content": "<s>", "id": 2}]}))
    docs = spark.createDataFrame([(1, "a b<s>a"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in tokens.encode_decode(docs, str(path), ids=True).collect()}
    assert got[1]["ids"] == [0, 1, 2, 0] and got[1]["decoded_sha256"] == sha("z</w> b</w> <s> z</w>")
    assert got[2]["ids"] == [] and got[2]["decoded_sha256"] == sha("")


def test_token_counts_rows(spark, odd_docs):
    lib = Library.from_file(BYTE)
    for table in (None, [], ["word", "a", "zz"]):
        got = {r["doc_id"]: r for r in tokens.token_counts(odd_docs, BYTE, pieces=table).collect()}
        for row in odd_docs.collect():
            text = row["text"] or ""
            n = len(lib.encode(text, add_special_tokens=False).ids)
            assert tuple(got[row["doc_id"]]) == (row["doc_id"], len(text.encode()), n, n > 1024)
    assert tokens.token_counts(odd_docs.limit(0), BYTE).count() == 0


def test_queries_equal_library(spark):
    from tidemark.llm.queries import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    lw, lb = Library.from_file(WORD), Library.from_file(BYTE)
    a = {r["doc_id"]: r for r in QUERIES["op3_bpe_codec"](spark, "/root/testdata/sf0.001").collect()}
    b = {r["doc_id"]: r for r in QUERIES["op5_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert len(a) == len(b) == len(docs)
    for d in docs:
        ids = lw.encode(d["text"], add_special_tokens=False).ids
        assert a[d["doc_id"]]["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert a[d["doc_id"]]["decoded_sha256"] == sha(lw.decode(ids, skip_special_tokens=False))
        assert b[d["doc_id"]]["n_tokens"] == len(lb.encode(d["text"], add_special_tokens=False).ids)


def test_a_worker_takes_a_batch_in_slices(spark, monkeypatch):
    """Of a large batch, a worker holds the results of about a megabyte of text at a time; all rows come back in order."""
    import pyarrow as pa
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    kind, taken, own = type(docs), [], type(docs).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, *a, **k: taken.append(f) or own(self, f, schema, *a, **k))
    tokens.encode_decode(docs, WORD, ids=True)
    texts = [None, "", *(f"word{i % 7} of " * 100 for i in range(4000))]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["_id", "_text"])
    out = list(taken[0](iter([batch])))
    assert len(out) > 3 and max(b.num_rows for b in out) < len(texts) / 2
    table = pa.Table.from_batches(out)
    assert table["_id"].to_pylist() == list(range(len(texts)))
    assert table["ids"].type == pa.list_(pa.int32())
    ids = table["ids"].to_pylist()
    assert [len(x) for x in ids] == table["n_tokens"].to_pylist() and ids[0] == ids[1] == [] and ids[2] == ids[9] != ids[3]
