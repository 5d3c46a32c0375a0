"""The approximate search takes the cosine candidates as well as those of the sign words."""

import random

from tracelode.operators import dense
from tracelode.plans import CHECKS, dense_plans, source_plans


class Given:
    """Tables of one workspace whose sign words say nothing: all vectors have the same signs."""

    def __init__(self, spark):
        rng = random.Random(3)
        vectors = [[rng.uniform(0.1, 1.0) for _ in range(64)] for _ in range(400)]
        rows = [(f"u{i:03}", "w", f"a{i}", f"l{i}", v) for i, v in enumerate(vectors)]
        self.corpus = spark.createDataFrame(rows, "unit_id string, workspace_id string, asset_id string, location_key string, embedding array<double>")
        self.probe = spark.createDataFrame([("w#0", "w", vectors[390])], "query_id string, workspace_id string, embedding array<double>")
        self.placed = dense.place(self.corpus)

    def __call__(self, name):
        if name == "v_vector_blocks":
            return dense.vector_blocks(self.placed, 64)
        return {"v_probe": self.probe, "v_dense": self.corpus, "v_vector_slots": self.placed}[name]


def test_nearest_vector_is_found_where_signs_say_nothing(spark):
    found = dense_plans.top_dense_ann(Given(spark)).orderBy("rank").collect()
    assert found[0]["unit_id"] == "u390"


def test_gates_take_the_union(spark):
    for name in ("top_dense_ann", "agg_capacity_gates"):
        assert dense_plans.candidates_sql("distance", 10) in CHECKS[name]
    assert "top_approximate" in source_plans.agg_capacity_gates.__code__.co_names
