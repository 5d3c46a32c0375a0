"""Search over posting blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import postings as pb

QUERIES = "query_id string, workspace_id string, text string"


def units(spark, rows):
    """(unit, workspace, text[, asset, page]) as units with slots and their index."""
    full = [(r[0], r[1], r[2], r[3] if len(r) > 3 else r[0], r[4] if len(r) > 4 else 1) for r in rows]
    frame = spark.createDataFrame(full, "unit_id string, workspace_id string, text string, asset_id string, page_number int").withColumn(
        "location_key", F.concat(F.lit("p"), F.col("page_number").cast("string"))
    )
    placed = pb.slots(frame).cache()
    return placed, pb.index(placed).cache()


def found(hits, placed):
    top = pb.top_units(hits, placed, 100)
    return {(r["query_id"], r["unit_id"]): round(r["score"], 6) for r in top.collect()}


@pytest.mark.parametrize("block", [1, 4000])
def test_simple_scores_with_cjk_and_whole_query(spark, monkeypatch, block):
    monkeypatch.setattr(pb, "TERM_BLOCK", block)
    queries = spark.createDataFrame([("q1", "w", "检索增强"), ("q2", "w", "big Straße"), ("q3", "w", "a"), ("q4", "w", ""), ("q5", "w", None)], QUERIES)
    placed, rows = units(spark, [("u1", "w", "关于检索增强的说明"), ("u2", "w", "a BIG STRASSE here"), ("u3", "w", "zzz"), ("u4", "v", "检索增强"), ("u5", "w", None)])
    got = found(pb.simple_hits(queries, rows, placed, 100), placed)
    # ASCII words only: the query splits at its non-ASCII letter.
    assert got[("q1", "u1")] == 2.0 and got[("q2", "u2")] == 2.0 and got[("q3", "u2")] == 2.0
    assert ("q1", "u4") not in got and not [k for k in got if k[1] in ("u3", "u5") or k[0] in ("q4", "q5")]


@pytest.mark.parametrize("block", [1, 4000])
def test_long_terms_match_inside_words(spark, monkeypatch, block):
    monkeypatch.setattr(pb, "TERM_BLOCK", block)
    queries = spark.createDataFrame([("q", "w", "tion station")], QUERIES)
    placed, rows = units(spark, [("u1", "w", "substations"), ("u2", "w", "notion"), ("u3", "w", "ti on")])
    assert found(pb.simple_hits(queries, rows, placed, 100), placed) == {("q", "u1"): 1.0, ("q", "u2"): 0.5}


def test_bm25_counts_each_query_term_once(spark):
    placed, rows = units(spark, [("u1", "w", "apple apple pear"), ("u2", "w", "pear")])
    one = spark.createDataFrame([("q", "w", "apple apple")], QUERIES)
    two = spark.createDataFrame([("q", "w", "apple")], QUERIES)
    assert pb.bm25_hits(one, rows, placed, 5).collect() == pb.bm25_hits(two, rows, placed, 5).collect()


@pytest.mark.parametrize("size", [3, 4096])
def test_bm25_equals_its_formula_over_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(pb, "BLOCK_UNITS", size)
    pick = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    texts = {f"u{i:02}": [pick.choice(words[: 3 + i % 10]) for _ in range(pick.randrange(1, 30))] for i in range(40)}
    placed, rows = units(spark, [(u, "w", " ".join(t), f"a{int(u[1:]) // 2}", int(u[1:]) % 2) for u, t in texts.items()])
    asked = {"q1": ["w1", "w9"], "q2": ["w0", "w2", "w11"], "q3": ["nowhere"]}
    chosen = spark.createDataFrame([("r1", f"a{k}") for k in range(0, 20, 3)], "query_id string, asset_id string")
    queries = spark.createDataFrame(
        [(q, "w", " ".join(t), False) for q, t in asked.items()] + [("r1", "w", "w1 w9", True), ("r2", "w", "w1", True)], QUERIES + ", restricted boolean"
    )
    got = {}
    for r in pb.page_best(pb.bm25_hits(queries, rows, placed, 4, chosen), placed, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["asset_id"], r["page_number"], round(r["score"], 6)))
    for q, terms in [*asked.items(), ("r1", asked["q1"])]:
        own = {u: t for u, t in texts.items() if q != "r1" or int(u[1:]) // 2 % 3 == 0}
        mean = sum(map(len, own.values())) / len(own)
        scores = []
        for u, t in own.items():
            value = 0.0
            for term in terms:
                df, tf = sum(term in x for x in own.values()), t.count(term)
                value += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            if value:
                scores.append((-round(value, 9), f"a{int(u[1:]) // 2}", int(u[1:]) % 2))
        want = [(i + 1, a, p, round(-s, 6)) for i, (s, a, p) in enumerate(sorted(scores)[:4])]
        assert sorted(got.get(q, [])) == want
    assert "r2" not in got


def brute_covers(lists):
    places = sorted(p for one in lists for p in one)
    total = 0.0
    for p in places:
        ends = [q for q in places if q >= p and all(any(p <= x <= q for x in one) for one in lists)]
        if ends and not any(
            r > p and all(any(r <= x <= ends[0] for x in one) for one in lists) for r in places
        ):
            inside = sum(p <= x <= ends[0] for x in places)
            total += 0.1 / (1 + (ends[0] - p) - (inside - 1))
    return total


def test_cover_density_of_all_words():
    pick = random.Random(2)
    for _ in range(300):
        places = pick.sample(range(1, 40), 12)
        lists = [sorted(places[:4]), sorted(places[4:7]), sorted(places[7 : 8 + pick.randrange(5)])][: pick.randrange(1, 4)]
        arrays = [np.array(one, np.int32) for one in lists]
        assert pb.cover_density(arrays, every=True) == pytest.approx(brute_covers(lists))
    assert pb.cover_density([np.arange(1, 1001)]) == pytest.approx(25.6)  # 256 places a word are kept
    assert pb.cover_density([np.array([20_000, 30_000]), np.array([5])]) == pytest.approx(0.2)  # late places fall together


def test_word_similarity_is_the_best_stretch():
    pick = random.Random(3)
    for _ in range(200):
        grams = [pick.choice("abcdefg") for _ in range(pick.randrange(1, 25))]
        wanted = set(pick.sample("abcdefghi", pick.randrange(1, 6)))
        best = max(
            (len(wanted & set(grams[i:j])) / len(wanted | set(grams[i:j])) for i in range(len(grams)) for j in range(i + 1, len(grams) + 1)),
            default=0.0,
        )
        assert pb.word_similarity(wanted, grams) == pytest.approx(best)


def test_similarity_ranks_all_units_and_the_rule_follows_the_script(spark):
    placed, rows = units(spark, [(f"u{i}", "w", t) for i, t in enumerate(["其他", "检索", "无关", "more 检索 words"])])
    queries = spark.createDataFrame([("q", "w", "检索"), ("p", "w", "more"), ("x", "w", "é?")], QUERIES)
    top = pb.top_units(pb.similar_hits(queries.where("query_id = 'q'"), placed, 3), placed, 3).orderBy("rank").collect()
    assert [(r["unit_id"], r["score"]) for r in top] == [("u1", 1.0), ("u3", 1.0), ("u0", 0.0)]
    both = found(pb.production_hits(queries, rows, placed, 2), placed)
    assert {k: v for k, v in both.items() if k[0] == "p"} == {("p", "u3"): 1.1}
    assert {k[0] for k in both} == {"p", "q"}


def test_scopes_are_tested_inside_the_blocks(spark):
    placed, rows = units(spark, [(f"u{i}", "w", "same words", f"a{i}", 1) for i in range(50)])
    queries = spark.createDataFrame([("all", "w", "same", False), ("some", "w", "same", True), ("none", "w", "same", True)], QUERIES + ", restricted boolean")
    chosen = spark.createDataFrame([("some", "a7"), ("some", "a33"), ("all", "a1"), ("some", "elsewhere")], "query_id string, asset_id string")
    for hits in (pb.simple_hits(queries, rows, placed, 100, chosen), pb.latin_hits(queries, rows, placed, 100, chosen=chosen)):
        got = found(hits, placed)
        assert {u for q, u in got if q == "some"} == {"u7", "u33"} and len([1 for q, _ in got if q == "all"]) == 50
        assert not [1 for q, _ in got if q == "none"]
