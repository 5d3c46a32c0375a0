"""The data source of extracted assets and the table functions."""

import json

import pytest
from pyspark.sql import functions as F

from tracelode.functions import tables
from tracelode.functions import text as tx
from tracelode.sources import page_records as pr
from tracelode.streaming import jobs as st


def put(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records), encoding="utf-8")


def page(asset, number, text, generation=1):
    return {"asset_id": asset, "generation": generation, "page_number": number, "text": text}


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_batches_are_cut_at_line_ends(spark, tmp_path, size):
    pr.register(spark)
    rows = [page(f"a{k}", k % 5 + 1, f"é text {k} " * (k % 4)) for k in range(60)]
    put(tmp_path / "in", "pages-1.json", rows[:45])
    put(tmp_path / "in", "pages-2.json", rows[45:])
    (tmp_path / "in" / "_SUCCESS").write_text("")
    (tmp_path / "in" / "pages-3.json").write_text("\n  \n")
    df = spark.read.format("extracted_assets").option("bytes_per_partition", size).load(str(tmp_path / "in"))
    assert sorted((r["asset_id"], r["page_number"], r["text"]) for r in df.collect()) == sorted((r["asset_id"], r["page_number"], r["text"]) for r in rows)
    assert spark.read.format("extracted_assets").load(str(tmp_path / "none")).count() == 0


def test_the_kind_chooses_the_adapter(spark, tmp_path):
    pr.register(spark)
    put(tmp_path / "in", "1.json", [{"asset_id": "i1", "lines": ["one", " ", "two"], "caption": "three"}, {"asset_id": "i2", "generation": 4}])
    df = spark.read.format("extracted_assets").option("kind", "image").load(str(tmp_path / "in"))
    assert sorted(map(tuple, df.collect()), key=str) == [("i1", 1, 1, "one\ntwo\nthree"), ("i2", 4, 1, None)]
    with pytest.raises(Exception, match="no adapter for asset kind"):
        spark.read.format("extracted_assets").option("kind", "sound").load(str(tmp_path / "in")).collect()
    with pytest.raises(Exception, match="no record of this kind"):
        spark.read.format("extracted_assets").option("kind", "pdf").load(str(tmp_path / "in")).collect()
    with pytest.raises(ValueError):
        pr.register_adapter("pdf", pr.image_pages)


def test_a_stream_goes_on_behind_the_last_file(spark, tmp_path):
    pr.register(spark)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.format("extracted_assets").load(str(tmp_path / "in"))
        return sorted((r["asset_id"], r["page_number"]) for r in st.drain_append(stream, "pages", out, state).collect())

    for k in range(5):
        put(tmp_path / "in", f"pages-{k:04}.json", [page("a", k, "x"), page("b", k, "y")])
    assert run() == sorted((a, k) for a in "ab" for k in range(5))
    assert run() == sorted((a, k) for a in "ab" for k in range(5))
    put(tmp_path / "in", "pages-0005.json", [page("c", 9, "z")])
    assert run() == sorted([*((a, k) for a in "ab" for k in range(5)), ("c", 9)])


def test_chunks_from_sql_equal_the_chunker(spark):
    tables.register(spark)
    pages = [("a", 2, "word " * 300), ("a", 1, "x" * 500 + "\n" + "y" * 90), ("b", 1, None), ("c", 1, " \n ")]
    df = spark.createDataFrame(pages, "asset_id string, page_number int, text string")
    df.createOrReplaceTempView("chunk_pages")
    got = spark.sql("SELECT * FROM chunk_text(TABLE(chunk_pages) PARTITION BY asset_id ORDER BY page_number, size => 400)")
    want = tx.chunk(df, "text", ["asset_id", "page_number"], 400)
    columns = ["asset_id", "page_number", "char_start", "char_end", "text"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    orders = [(r["page_number"], r["unit_order"]) for r in got.orderBy("unit_order").collect()]
    assert [o for _, o in orders] == list(range(len(orders))) and orders == sorted(orders)
    with pytest.raises(Exception, match="chunk size"):
        spark.sql("SELECT * FROM chunk_text(TABLE(chunk_pages) PARTITION BY asset_id, size => 5)").collect()
    with pytest.raises(Exception, match="column text"):
        spark.sql("SELECT * FROM chunk_text(TABLE(SELECT 1 AS a) WITH SINGLE PARTITION)").collect()
