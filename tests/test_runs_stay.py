"""Substring search brings questions to the stored runs; neither runs nor texts are moved."""

import random

import pytest
from pyspark.sql import functions as F

from test_postings import QUERIES, found, units
from test_texts_move_once import moved, plain  # noqa: F401 - a fixture
from tracelode.operators import postings as pb
from tracelode.plans import lexical_plans as lp

HEAVY = {"text", "texts", "units", "positions", "runs"}


def heavy(frame):
    """Shuffles of units with texts or index rows; questions may move."""
    return [columns for columns in moved(frame) if HEAVY & set(columns) and {"unit_id", "block"} & set(columns)]


def test_hybrid_search_moves_no_index(plain):  # noqa: F811
    assert not heavy(lp.hybrid_lexical(plain, 10))


def test_evidence_moves_no_texts(plain):  # noqa: F811
    assert not heavy(lp.evidence(plain))


def brute(queries, texts):
    out = {}
    for q, asked in queries.items():
        terms = list(dict.fromkeys(asked.split()))
        for u, body in texts.items():
            n = sum(t in body for t in terms)
            if n:
                out[q, u] = round(n / len(terms) + (asked in body), 6)
    return out


@pytest.mark.parametrize(("chars", "marks"), [(1 << 24, 1 << 24), (0, 1 << 24), (1 << 24, 50)])
def test_substrings_equal_brute_force(spark, monkeypatch, chars, marks):
    monkeypatch.setattr(pb, "BLOCK_UNITS", 16)
    monkeypatch.setattr(pb, "BROADCAST_CHARS", chars)
    monkeypatch.setattr(pb, "MARKS", marks)
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abc1") for _ in range(pick.randrange(1, 5)))
    texts = {f"u{i:02}": " ".join(word() for _ in range(pick.randrange(1, 9))) for i in range(60)} | {"blank": "", "signs": "?!"}
    asked = {f"q{i}": " ".join(word() for _ in range(pick.randrange(1, 4))) for i in range(12)} | {"one": "a", "two": "a b"}
    placed, rows = units(spark, [(u, "w", t) for u, t in texts.items()])
    queries = spark.createDataFrame([(q, "w", t) for q, t in asked.items()], QUERIES)
    assert found(pb.simple_hits(queries, rows, placed, 100), placed) == brute(asked, texts)
    few = pb.top_units(pb.simple_hits(queries.where("query_id = 'two'"), rows, placed, 3), placed, 3).select("unit_id", F.round("score", 6)).collect()
    want = sorted((-s, u) for (q, u), s in brute(asked, texts).items() if q == "two")[:3]
    assert sorted((-r[1], r[0]) for r in few) == want
