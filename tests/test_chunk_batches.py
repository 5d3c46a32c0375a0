"""Chunks leave a task in small batches."""

from tracelode.functions import text as tx


def test_chunks_leave_a_batch_in_few_rows(spark):
    texts = spark.createDataFrame([(i, "word " * 1000 if i % 2 else None) for i in range(300)], "id int, body string").coalesce(1)
    chunks = tx.chunk(texts, "body", ["id"])
    assert chunks.where("id % 2 = 0").count() == 0 and chunks.where("id = 1").count() == 5
    assert chunks.schema["char_start"].dataType.simpleString() == "int"
    assert "MapInArrow" in chunks._jdf.queryExecution().executedPlan().toString()
