"""The order-free fingerprint of whole tables."""

import datetime

from pyspark.sql import functions as F

from tracelode.operators import aggregates as ag

SCHEMA = "i long, s string, d double, t timestamp, v array<float>, b boolean"
ROWS = [
    (1, "a|b", 0.1, datetime.datetime(2026, 1, 1), [0.5, None], True), (2, None, -3.5, None, [], False),
    (3, "", float("nan"), datetime.datetime(2026, 1, 2, 3, 4, 5, 678), None, None), (3, "", 1e19, None, [1.0], True),
]


def mark(df):
    return tuple(ag.fingerprint(df, "t").first())


def test_any_changed_cell_changes_it(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    seen = {mark(df)}
    assert mark(df.repartition(3).orderBy(F.desc("i"))) in seen
    other = {"i": [9, 9, 9, 9], "s": ["a|c", "", None, " "], "d": [0.1 + 2**-56, 3.5, 0.0, 2e19], "t": [None] + [datetime.datetime(2027, 1, 1)] * 3,
             "v": [[0.5], None, [], [1.0, 1.0]], "b": [None, None, True, False]}
    for row in range(len(ROWS)):
        for k, name in enumerate(other):
            changed = [list(r) for r in ROWS]
            changed[row][k] = other[name][row]
            found = mark(spark.createDataFrame([tuple(r) for r in changed], SCHEMA))
            assert found not in seen, (row, name)
            seen.add(found)
    assert mark(df.union(df.limit(1))) not in seen and mark(df.limit(0))[1:] == (0, 0, 0)


def test_replaced_rows_update_it_without_the_rest(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    gone, new = df.where("i = 3"), df.where("i = 1").withColumn("s", F.lit("new"))
    after = df.where("i <> 3").unionByName(new)
    assert ag.updated_fingerprint(ag.fingerprint(df, "t"), gone, new).first() == ag.fingerprint(after, "t").first()
