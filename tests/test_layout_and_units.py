import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import layout as ly
from tracelode.operators import study
from tracelode.operators import units as ub


def test_words_map_or_the_page_is_rejected(spark):
    pages = spark.createDataFrame([(1, "foo bar\nbaz"), (2, "foo bar"), (3, "foobar")], "page_id int, text string")
    words = spark.createDataFrame(
        [(1, 0, "foo"), (1, 1, "bar"), (1, 2, "baz"), (2, 0, "foo"), (3, 0, "foo"), (3, 1, "bar")], "page_id int, word_no int, word string"
    )
    got = {(r["page_id"], r["char_start"], r["char_end"]) for r in ly.word_ranges(pages, words).collect()}
    assert got == {(1, 0, 3), (1, 4, 7), (1, 8, 11), (3, 0, 3), (3, 3, 6)}


def test_figures_merge_transitively_in_any_order(spark):
    boxes = [(1, f"b{i}", 0.1 + 0.03 * i, 0.1, 0.1, 0.1) for i in range(5)] + [(1, "far", 0.7, 0.7, 0.1, 0.1)]
    random.Random(1).shuffle(boxes)
    df = spark.createDataFrame(boxes, "page int, item string, x double, y double, width double, height double")
    got = sorted((r["component"], r["n_boxes"], round(r["x1"], 2)) for r in ly.merge_figures(df, "page", "item").collect())
    assert got == [("b0", 5, 0.32), ("far", 1, 0.8)]


def test_caption_with_continuation(spark):
    figure = spark.createDataFrame([(1, "f", 0.0, 0.0, 200.0, 100.0)], "page_id int, figure_id string, f_x0 double, f_y0 double, f_x1 double, f_y1 double")
    lines = spark.createDataFrame(
        [(1, "a", 10.0, 110.0, 190.0, 120.0, "Figure 2: growth"), (1, "b", 10.0, 125.0, 190.0, 135.0, "Source: survey"),
         (1, "c", 10.0, 140.0, 190.0, 150.0, "Unrelated text"), (1, "d", 10.0, 155.0, 190.0, 165.0, "Note: late")],
        "page_id int, line_id string, x0 double, y0 double, x1 double, y1 double, text string",
    )
    row = ly.captions_below(figure, lines).first()
    assert row["caption"] == "Figure 2: growth\nSource: survey\nNote: late" and row["n_lines"] == 3


def test_claims_equal_the_sequential_walk(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), f"i{n}", rng.randrange(5), s, s + rng.randrange(5, 60)) for n, s in enumerate(rng.randrange(400) for _ in range(150))]
    df = spark.createDataFrame(rows, "page int, item string, gap int, s int, e int").withColumn("priority", F.struct("gap", "item"))
    got = {r["item"] for r in ly.claim_ranges(df, "page").collect()}
    want, claimed = set(), {}
    for page, item, gap, s, e in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if all(not (a < e and b > s) for a, b in claimed.get(page, [])):
            claimed.setdefault(page, []).append((s, e))
            want.add(item)
    assert got == want


def test_claims_of_several_ranges(spark):
    rng = random.Random(8)
    rows = []
    for n in range(400):
        spans = [(s, s + rng.randrange(0, 9)) for s in (rng.randrange(2000) for _ in range(rng.randrange(0, 5)))]
        rows.append((rng.randrange(3), f"i{n:03}", rng.randrange(5), spans))
    df = spark.createDataFrame(rows, "page int, item string, gap int, ranges array<struct<s:int,e:int>>").withColumn("priority", F.struct("gap", "item"))
    want, claimed = set(), {}
    for page, item, _, spans in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if not any(a < e and b > s and s < e for s, e in spans for a, b in claimed.get(page, [])):
            claimed.setdefault(page, []).extend(x for x in spans if x[0] < x[1])
            want.add(item)
    assert {r["item"] for r in ly.claim_ranges(df.repartition(5), "page").collect()} == want and len(want) < 400


def test_many_claims_on_one_page(spark):
    df = spark.range(100_000).select(
        F.lit(1).alias("page"), F.col("id").alias("item"), F.struct("id").alias("priority"), (F.col("id") * 7919 % 100_003 * 3).alias("s"),
    ).withColumn("e", F.col("s") + 2)
    assert ly.claim_ranges(df, "page").count() == 100_000


def test_pdf_units_by_kind(spark):
    pages = spark.createDataFrame([(1, "layout", "head\nTABLE ROW\ntail"), (2, "ocr", "seen"), (3, "ocr", "seen unseen")], "page_id int, source_kind string, text string")
    regions = spark.createDataFrame([(2, 0, 4), (3, 0, 4)], "page_id int, region_start int, region_end int")
    artifacts = spark.createDataFrame([(1, 0, "pdf_table", "| T |", 5, 14)], "page_id int, artifact_order int, unit_kind string, text string, s int, e int")
    got = {(r["page_id"], r["unit_kind"], r["text"], r["char_start"]) for r in ub.pdf_units(pages, regions, artifacts).collect()}
    assert got == {(1, "pdf_text_chunk", "head\n         \ntail", 0), (1, "pdf_table", "| T |", None), (2, "pdf_ocr_region", "seen", 0), (3, "pdf_text_chunk", "seen unseen", 0)}


def test_questions_are_embedded_behind_their_instruction(spark):
    queries = spark.createDataFrame([(1, "what is it"), (2, None)], "query_id int, text string")
    got = {r["query_id"]: r["embedding"] for r in ub.embed_queries(queries, ub.hashing_embedder(16), 16, "Find passages").collect()}
    want = ub.hashing_embedder(16)(["Instruct: Find passages\nQuery: what is it", "Instruct: Find passages\nQuery: "])
    assert got == {"1": pytest.approx(want[0]), "2": pytest.approx(want[1])}


def test_embedder_contract(spark):
    units = spark.createDataFrame([("u", "a b")], "unit_id string, text string")
    assert len(ub.embed(units, ub.hashing_embedder(8), 8).first()["embedding"]) == 8
    with pytest.raises(Exception, match="wrong vector length"):
        ub.embed(units, ub.hashing_embedder(4), 8).collect()
    with pytest.raises(Exception, match="wrong number"):
        ub.embed(units, lambda texts: [], 8).collect()


@pytest.mark.parametrize("people,status", [(4, "not_evaluable"), (5, "pass")])
def test_readiness_threshold(spark, people, status):
    rows = [(i * 100 + j, i, j, "table" if j % 2 else "no_answer", w, 100.0 if w == "manual" else 50.0, True, "pass", True, True, False, "table")
            for i in range(people) for j in range(5) for w in ("manual", "assisted")]
    results = spark.createDataFrame(rows, "line_no int, participant_id int, task_id int, task_type string, workflow string, duration_seconds double, supported boolean, locator_accuracy string, opened_citation boolean, saved_note boolean, has_unsupported boolean, region_gap string")
    links = spark.createDataFrame([(j, j) for j in range(5)], "task_id int, asset_id int")
    assets = spark.createDataFrame([(j, "pdf" if j < 3 else "image", "real_project", True, f"s{j % 2}", f"l{j % 2}") for j in range(5)],
                                   "asset_id int, modality string, origin string, complex boolean, source_group string, layout_group string")
    gates = {r["gate"]: r["status"] for r in study.readiness_gates(results, links, assets).collect()}
    assert gates["overall"] == status and gates["minimumTargetUsers"] == ("pass" if people >= 5 else "not_evaluable")
