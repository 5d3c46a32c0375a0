"""The recall that is measured is that of both candidate lists."""

from test_whole_union import Given

from tracelode.plans import CHECKS, dense_plans


def test_recall_is_that_of_the_union(spark):
    t = Given(spark)  # its sign words say nothing
    assert dense_plans.top_ann_recall(t).first()["n_shared"] == 10


def test_the_sql_has_both_lists():
    assert dense_plans.candidates_sql("distance", 10) in CHECKS["top_ann_recall"]
