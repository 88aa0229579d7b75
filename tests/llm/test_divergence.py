"""Source divergence: SQL oracle, brute force, and the parts of a pair task."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import divergence
from tidemark.llm.queries import ORACLE, QUERIES
from tools.oracle_check import duck, rows_of

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def test_oracle(spark):
    df = QUERIES["op11_source_audit"](spark, SF)
    res = duck(SF).execute(ORACLE["op11_source_audit"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in res.description], res.fetchall())


def brute(rows, least, top):
    occ, inside, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        occ[lang, source].update(terms)
        inside[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in inside[lang].items() if n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 5) // total for t in kept}
        own = shares(occ[lang, source])
        whole = shares(sum((occ[g] for g in groups if g[0] == lang), Counter()))
        others = {b: shares(occ[a, b]) for a, b in groups if a == lang and b != source}
        pair = sorted(((-sum(abs(own[t] - q[t]) for t in kept), b.encode()) for b, q in others.items()))
        term = sorted((whole[t] - own[t], t.encode()) for t in kept if occ[lang, source][t] and own[t] > whole[t])
        for part, items in (("pair", pair), ("term", term[:top])):
            out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("bits", [2, 16])
def test_brute_force(spark, bits):
    rng = random.Random(bits)
    vocabulary = ["Word", "wORD", "a", "b-c", "éa", "É", "über", "漢字", "x1y", "\U0001f600z", "z", "zz", "qu'il", "\x00nul", "Z[", "k_k"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))), rng.choice(["en", "de", None, ""]),
             rng.choice(["s1", "s2", "S3", "ä", None, ""])) for _ in range(300)]
    rows += [(None, "en", "s1"), ("", "fr", "alone"), ("!!", "fr", "two"), ("rare", "nl", "one")] + [("copy of a text", "en", "hot")] * 200
    rows += [("word " * 400_000 + "x" * 2_000_000, "en", "long")]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "text string, lang string, source string, term string, n int")
    got = sorted(tuple(r) for r in divergence.audit_sources(docs, least_docs=7, top=4, block_bits=bits).collect())
    assert got == brute(rows, 7, 4)
    assert divergence.audit_sources(docs.limit(0)).count() == 0


def test_pieces_keep_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    text = b"ab cdefghijkl  m n opq rstuvw" * 3
    assert [t for p in divergence._pieces(text) for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text)


def test_gallop_is_an_intersection():
    rng = np.random.default_rng(1)
    for n, m in [(0, 5), (5, 0), (1, 1), (3, 5000), (600, 600), (300, 20_000), (1000, 1500)]:
        a, b = (np.sort(rng.choice(25_000, k, replace=False)) for k in (n, m))
        at_a, at_b = divergence.gallop(a, b)
        assert np.array_equal(a[at_a], np.intersect1d(a, b)) and np.array_equal(b[at_b], np.intersect1d(a, b))
    assert [len(x) for x in divergence.gallop(np.array([5, 9]), np.array([1, 2]))] == [0, 0]


def test_shares_are_exact():
    counts = [0, 1, 7, 10 ** 12, 3 * 10 ** 14]
    for v in (1, 3, 10 ** 6):
        got = divergence.shares(np.array(counts), sum(counts), v, 5)
        assert got.tolist() == [1 + 10 ** 9 * (c + 5) // (sum(counts) + 5 * v) for c in counts]
