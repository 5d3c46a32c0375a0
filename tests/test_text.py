import re

import pytest
from pyspark.sql import functions as F

from tracelode.functions import records as rc
from tracelode.functions import text as tx


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("r")).first()[0]


def test_chunks_overlap_and_cover(spark):
    body = " ".join(f"word{i}" for i in range(400)) + "\n" + "x" * 900
    rows = tx.chunk(spark.createDataFrame([(1, body)], "id int, t string"), "t", ["id"], 400).orderBy("char_start").collect()
    assert rows[0]["char_start"] == 0 and rows[-1]["char_end"] == len(body)
    for a, b in zip(rows, rows[1:]):
        assert b["char_start"] == max(a["char_end"] - 200, a["char_start"] + 1)
        assert a["text"] == body[a["char_start"] : a["char_end"]].strip()


def test_chunk_size_bounds(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    with pytest.raises(ValueError):
        tx.chunk(df, "t", ["id"], 100)


def test_chunk_offsets_are_code_points(spark):
    body = "𝒳" * 500
    rows = tx.chunk(spark.createDataFrame([(1, body)], "id int, t string"), "t", ["id"], 400).collect()
    assert [(r["char_start"], r["char_end"]) for r in rows] == [(0, 400), (200, 500)]


@pytest.mark.parametrize(
    "text,count", [("", 1), ("abc 12 déjà", 3), ("a-b", 3), ("图表one", 3), ("one图two", 3), ("  ", 1)]
)
def test_token_estimate(spark, text, count):
    assert one(spark, text, tx.token_estimate) == count


def test_terms_of_mixed_and_cjk_queries(spark):
    assert one(spark, "RAG 检索 rag x1", tx.lexical_terms) == ["rag", "x1"]
    assert one(spark, "检索增强", tx.lexical_terms) == ["检索增强", "检索", "索增", "增强"]
    assert one(spark, "检" * 13, tx.lexical_terms) == ["检检"]
    assert one(spark, "Ab 图表", tx.bm25_tokens) == ["ab", "图", "表", "图表"]


def test_normal_answer_and_phrases(spark):
    assert one(spark, "Ｒｅｓｕｌｔ： ﬁne [1], Straße!", tx.normal_output) == "result fine strasse"
    df = spark.createDataFrame([("the red fox",)], "t string")
    assert df.select(tx.has_phrase(F.col("t"), F.lit("red fox"))).first()[0]
    assert not df.select(tx.has_phrase(F.col("t"), F.lit("re"))).first()[0]


def test_event_stream_text(spark):
    text = 'event: meta\ndata: {"a": 1}\n\ndata: x\ndata: y\n\n: ping\n\nevent: done\ndata: {"cut'
    df = spark.createDataFrame([(1, text)], "id int, s string")
    rows = rc.stream_events(df, "id", "s").orderBy("event_order").collect()
    assert [(r["name"], r["data"], r["is_json"]) for r in rows] == [("meta", '{"a": 1}', True), ("message", "x\ny", False)]
    assert df.select(rc.stream_remainder(F.col("s"))).first()[0].startswith("event: done")


def test_markdown_tables(spark):
    df = spark.createDataFrame([([["h", "k"], ["", ""], ["1"], ["2", "3"]],), ([["only"], ["one"]],)], "c array<array<string>>")
    got = [r[0] for r in df.select(rc.table_markdown(F.col("c"))).collect()]
    assert got == ["| h | k |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |", None]


def test_prompt_evidence_numbers_must_run(spark):
    text = "[1] a.pdf, pdf_page\nfirst\n\nstill first\n\n[3] b, image_region\nsecond"
    rows = rc.prompt_evidence(spark.createDataFrame([(1, text)], "id int, c string"), "id", "c").orderBy("position").collect()
    assert [(r["title"], r["valid"]) for r in rows] == [("a.pdf", True), ("b", False)]
    assert rows[0]["excerpt"] == "first\n\nstill first"


def test_slug(spark):
    assert one(spark, "  My  New\tTag - ", lambda c: tx.slug(c, F.lit("fallback"))) == "my-new-tag"
    assert one(spark, " - ", lambda c: tx.slug(c, F.lit("fallback"))) == "fallback"


@pytest.mark.parametrize("text", ["Straße ﬁne ﬃ ŉ ǰ", "ΣΑΣ ς", "ſet ẞ", "plain ASCII", "µ ϐ", "Ꭰ ꭰ ᏸ և ᾳ µß", "été Größe"])
def test_casefold_is_full(spark, text):
    assert one(spark, text, tx.casefold) == text.casefold()


def test_late_folds_lie_in_the_ranges():
    late = re.compile(tx.LATE_FOLDS)
    assert all(late.match(c) for c in tx._folded() if c not in "µß")
