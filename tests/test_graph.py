import pytest

from tracelode.operators import graph

SCHEMA = "thread_id long, message_id long, parent_id long, turn long, role string, content string, status string"


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(1, i, i - 1 if i > 1 else None, i, "user" if i % 2 else "assistant", "c", "completed") for i in range(1, 151)]
    rows += [(2, 1001, 1003, 1, "user", "c", "completed"), (2, 1002, 1001, 2, "assistant", "c", "completed"), (2, 1003, 1002, 3, "user", "c", "completed")]
    rows += [(3, 2001, 2999, 1, "user", "c", "completed"), (3, 2002, 2001, 2, "assistant", "c", "failed")]
    rows += [(4, 3001, None, 1, "user", "c", "completed")]
    return spark.createDataFrame(rows, SCHEMA)


def test_deep_thread_has_its_whole_path(spark, messages):
    leaves = spark.createDataFrame([(1, 150)], "thread_id long, leaf_id long")
    rows = graph.active_path(messages, leaves).orderBy("depth").collect()
    assert [r["message_id"] for r in rows] == list(range(1, 151))


def test_integrity_findings(spark, messages):
    leaves = spark.createDataFrame([(1, 150), (2, 1003), (3, 2002), (4, None)], "thread_id long, leaf_id long")
    got = {(r["thread_id"], r["problem"]) for r in graph.integrity(messages, leaves).collect()}
    assert got == {(2, "cycle"), (3, "dangling_parent"), (4, "no_leaf")}
    assert graph.active_path(messages, leaves).where("thread_id = 2").count() == 0


def test_lineage_leaves_out_failed_answers(spark, messages):
    leaves = spark.createDataFrame([(3, 2002)], "thread_id long, leaf_id long")
    assert [r["message_id"] for r in graph.lineage(messages, leaves).collect()] == [2001]


def test_repair_and_latest_leaf(spark):
    rows = [(1, 5, None, 7, "assistant", "c", "failed"), (1, 6, None, 7, "user", "c", "completed"), (2, 9, None, 1, "user", "c", "failed")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["thread_id"]: r["leaf_id"] for r in graph.latest_leaf(df).collect()} == {1: 5, 2: 9}
    assert {r["thread_id"]: r["leaf_id"] for r in graph.repaired_leaf(df).collect()} == {1: 6, 2: None}
    chained = {r["message_id"]: r["chained_parent"] for r in graph.chain_parents(df).collect()}
    assert chained == {6: None, 5: 6, 9: None}
