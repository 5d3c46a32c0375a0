"""Streams over tables that are folders of part files."""

import duckdb

from tracelode.plans import CHECKS, QUERIES
from tracelode.sources.views import BASE_TABLES

SMALL = "/root/testdata/sf0.001"


def in_parts(spark, tmp_path):
    """The small tables, documents and conversations as folders of three files."""
    for name in BASE_TABLES:
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        table.repartition(3 if name in ("documents", "conversations") else 1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def expected(name):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return con.execute(CHECKS[name]).fetchall()


def test_documents_in_parts_are_ingested(spark, tmp_path):
    found = QUERIES["st_incremental_ingest"](spark, in_parts(spark, tmp_path))
    rows = found.select("asset_id", "n_units", "n_chars", "embedded").collect()
    assert sorted(map(tuple, rows)) == sorted(expected("st_incremental_ingest"))


def test_conversations_in_parts_are_assembled(spark, tmp_path):
    found = QUERIES["st_answer_assembly"](spark, in_parts(spark, tmp_path))
    rows = found.select("message_id", "status", "answer_hash").collect()
    assert rows and sorted(map(tuple, rows)) == sorted(expected("st_answer_assembly"))


def test_odd_conversations_are_assembled(spark, tmp_path):
    """Null texts and keys, blanks beyond ASCII, and threads of over 1,000 turns, whose numbers meet the next thread's."""
    texts = [(1, 0, None), (1, 1, "\u00a0x\u2003"), (1, 2, "\u000bv\u001c"), (1, 3, ""), (1, 6, "a\u2028"), (2, 1000, "one"), (3, 0, "two"), (6, 15, None),
             (8, 1, None), (4, None, "no turn"), (None, 3, "no thread"), (77, 0, "paused"), (77, 5, "last")]
    rows = [(c, t, "assistant", x) for c, t, x in texts] + [(5, 1, None, "no role"), (5, 2, "user", "asked")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(CHECKS["st_answer_assembly"]).fetchall()
    found = QUERIES["st_answer_assembly"](spark, str(tmp_path)).select("message_id", "status", "answer_hash").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
