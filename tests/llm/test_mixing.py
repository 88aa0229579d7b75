"""Mixing: targets against rounds of resharing, dependent rounding against its invariants and a replay."""

import contextlib
import io
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def reshared(sizes, weights=(3, 1, 2)):
    """Targets by the contract's own words, with fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    rest, target, open_ = Fraction(3, 2) * sum(sizes.values()), dict.fromkeys(names, Fraction(0)), set(names)
    while rest and open_:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / whole
        above = {s for s in names if target[s] > 2 * sizes[s]}
        rest = sum((target[s] - 2 * sizes[s] for s in above), Fraction(0))
        for s in above:
            target[s] = Fraction(2 * sizes[s])
        open_ -= above
    return {s: float(t) for s, t in target.items()}


def held(rows):
    """Checks of any mix; the mass taken by source."""
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["taken"] == r["copies"] * r["size"] and int(rate) <= r["copies"] <= int(rate) + (rate > int(rate))
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    for s, t in reshared(dict(sizes)).items():
        assert target[s] == pytest.approx(t, rel=1e-9) and abs(taken[s] - t) <= largest[s] + 1e-6
    return taken


def test_query(spark):
    df = QUERIES["op12_source_mixing"](spark, SF)
    rows = df.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter(
        (d["doc_id"], len(re.findall("[^\x20\x09-\x0d]+", d["text"] or ""))) for d in docs)
    held(rows)
    again = QUERIES["op12_source_mixing"](spark, SF).collect()
    assert sorted(rows) == sorted(again)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    assert not any(x in out.getvalue() for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def fixture(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(1 + i * 7 % 40), "hot") for i in range(900)]
    rows += [(1000 + i, words(1 + i % 11), "b") for i in range(300)] + [(2000 + i, words(5), "é") for i in range(40)]
    rows += [(3000, words(3), "tiny"), (3001, None, "none"), (3002, "", "none"), (3003, "\t \x0b\n", "hot"), (None, words(4), "hot")]
    rows += [(4000 + i, words(2), None) for i in range(30)] + [(5000, words(6), "")] * 25 + [(None, words(9), None)] * 40
    rows += [(6000, "a\x1cb c d\x0be", "b"), (6001, words(200_000), "b")]
    return spark.createDataFrame([(*r, 1.0, 0, "k") for r in rows],
                                 "doc_id long, text string, source string, target double, n int, _key string")


def test_small_buckets_make_a_tree(spark):
    docs = fixture(spark)
    rows = mixing.mix_sources(docs, fan=8).collect()
    assert len(rows) == docs.count()
    held(rows)
    assert {r["size"] for r in rows if r["doc_id"] in (3001, 3002, 3003)} == {0}
    assert [r["size"] for r in rows if r["doc_id"] == 6000] == [3]
    moved = mixing.mix_sources(docs.repartition(7, "text").orderBy(F.rand(3)), fan=8)
    assert sorted(map(str, rows)) == sorted(map(str, moved.collect()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert [tuple(r)[2:] for r in mixing.mix_sources(docs.filter("doc_id = 3001")).collect()] == [(0, 0, 0.0, 0, 0)]


def test_like_rows_in_large_numbers(spark):
    docs = spark.range(1_200_000).select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(spark.range(10, 14).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("t").alias("source")))
    got = mixing.mix_sources(docs).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert {r["source"]: r["n"] for r in got} == {"s": 1_200_000, "t": 4}
    assert all(abs(r["t"] - r["g"]) <= 3 for r in got)


def test_expectation_is_kept(spark):
    sizes, rate, draws = [1 + 3 * i for i in range(12)] + [200], 0.3, 2000
    kind = "struct<id:bigint,size:bigint,n:bigint,whole:bigint,mass:double,h:bigint,u:double>"
    units = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(s).cast("long").alias("size"), F.lit(1).cast("long").alias("n"),
                               F.lit(0).cast("long").alias("whole"), F.lit(rate * s).alias("mass"), F.lit(i).cast("long").alias("h"),
                               F.rand(i).alias("u")) for i, s in enumerate(sizes)])
    states = spark.range(draws).select(mixing._fold(units, kind).alias("s")).collect()
    mass = Counter()
    for r in states:
        for unit in [*r["s"]["done"], *filter(None, [r["s"]["held"]])]:
            mass[unit["id"]] += unit["mass"]
    assert all(abs(mass[i] / draws / s - rate) < 5 * (rate * (1 - rate) / draws) ** 0.5 for i, s in enumerate(sizes))


def test_a_bucket_against_a_replay(spark):
    units = [(i, 5 + i * 13 % 30, 1, 0, ((i * 7 % 19) + 0.5) / 20 * (5 + i * 13 % 30), i, (i * 37 % 101) / 101) for i in range(60)]
    kind = "struct<id:bigint,size:bigint,n:bigint,whole:bigint,mass:double,h:bigint,u:double>"
    df = spark.createDataFrame([(units,)], f"units array<{kind}>")
    state = df.select(mixing._fold(F.col("units"), kind).alias("s")).first()["s"]
    done, last = {}, None
    for id_, size, _, _, mass, _, u in units:
        if last is None:
            last = (id_, size, mass)
            continue
        (i, s, a), (j, t, b) = last, (id_, size, mass)
        up, down = min(s - a, b), min(a, t - b)
        if u * (up + down) < down:
            a, b = (float(s) if up == s - a else a + up), (0.0 if up == b else b - up)
        else:
            a, b = (0.0 if down == a else a - down), (float(t) if down == t - b else b + down)
        last = None
        for x in ((i, s, a), (j, t, b)):
            if 0 < x[2] < x[1]:
                last = x
            else:
                done[x[0]] = x[2]
    assert {r["id"]: r["mass"] for r in state["done"]} == done and len(done) >= 59
    assert (state["held"] and (state["held"]["id"], state["held"]["mass"])) == (last and (last[0], last[2]))
    assert sum(done.values()) + (last[2] if last else 0) == pytest.approx(sum(u[4] for u in units))
