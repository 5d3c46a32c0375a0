"""Texts pass through few shuffles on their way to the stored tables."""

import re

import pytest

from tracelode.operators import postings as pb
from tracelode.sources.views import Tables

SMALL = "/root/testdata/sf0.001"


def explained(frame):
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def moved(frame):
    """Columns of each shuffle of the plan."""
    return [re.findall(r"(\w+)#", line) for line in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", explained(frame))]


@pytest.fixture
def plain(spark):
    """The small tables, without size-based broadcasts, as those end with larger ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Tables(spark, SMALL)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_visible_units_move_texts_once(plain):
    from tracelode.operators import scope

    seen = scope.visible_units(*[plain(n) for n in ("v_unit", "v_asset", "v_representation", "v_locator", "v_signature")])
    assert sum("text" in columns for columns in moved(seen)) == 1
    assert seen.columns == scope.VISIBLE


def test_vectors_move_no_texts(plain):
    assert not any("text" in columns for columns in moved(plain._plan("v_dense")))


def test_index_moves_one_form_of_a_text(plain):
    shuffles = moved(pb.index(plain("v_slots")))
    assert len(shuffles) == 1 and "text" in shuffles[0] and not {"lowered", "folded"} & set(shuffles[0])


def test_counts_move_no_positions(plain):
    counted = pb.match_counts(plain("v_query"), plain("v_postings"))
    read = explained(counted)
    assert "ReadSchema" in read and not re.search(r"ReadSchema: .*positions", read)
