"""Texts that no visible unit needs do not move."""

from pyspark.sql import functions as F

from test_texts_move_once import explained, moved, plain  # noqa: F401 - a fixture
from tracelode import scale


def test_sifting_loses_no_wanted_row_and_few_others_pass(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 50 != 7, F.concat(F.lit("k"), "id")).alias("k"), "id")
    wanted = df.where("id % 3 = 0").select("k")
    kept = scale.sift(df, "k", wanted)
    assert kept.columns == df.columns
    ids = {r["id"] for r in kept.collect()}
    want = {r["id"] for r in df.where("id % 3 = 0 AND k IS NOT NULL").collect()}
    assert want <= ids and len(ids - want) < 50


def test_many_keys_in_few_bits_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(scale, "SIFT_BITS", 64)
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    assert scale.sift(df, "k", df.where("k < '3'")).where("k < '3'").count() == df.where("k < '3'").count()


def test_stored_texts_are_sifted_before_they_move(plain):  # noqa: F811
    plan = plain._plan("v_slots")
    assert "bitmap_construct_agg" in explained(plan) and sum("text" in columns for columns in moved(plan)) == 1
