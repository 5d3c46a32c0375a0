import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import dense, fusion
from tracelode.operators import evaluation as ev

SCHEMA = "unit_id string, workspace_id string, asset_id string, location_key string, embedding array<double>"


def corpus(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(query, rows, k):
    def distance(v):
        if v is None or len(v) != len(query):
            return 1.0
        n = np.linalg.norm(query) * np.linalg.norm(v)
        return round(1 - float(np.dot(query, v)) / n, 9) if n else 1.0

    seen, out = set(), []
    for d, u, loc in sorted((distance(r[4]), r[0], (r[2], r[3])) for r in rows):
        if loc not in seen:
            seen.add(loc)
            out.append(u)
    return out[:k]


def queries(spark, vectors):
    return spark.createDataFrame([(f"q{i}", "w", list(map(float, v))) for i, v in enumerate(vectors)], "query_id string, workspace_id string, embedding array<double>")


def test_exact_search_equals_brute_force_with_one_hot_location(spark):
    rng = np.random.default_rng(1)
    rows = [
        (f"u{i:04d}", "w", "a", "hot" if i % 3 == 0 else f"p{i // 4}", rng.normal(size=8).tolist()) for i in range(900)
    ] + [("zero", "w", "z", "z", [0.0] * 8), ("short", "w", "s", "s", [1.0]), ("other", "v", "o", "o", [1.0] * 8)]
    asked = rng.normal(size=(5, 8))
    df = corpus(spark, rows).repartition(7)
    got = dense.top_locations(queries(spark, asked), df, 8, 12).orderBy("query_id", "rank").collect()
    mine = [r for r in rows if r[1] == "w"]
    for i, q in enumerate(asked):
        assert [r["unit_id"] for r in got if r["query_id"] == f"q{i}"] == brute(q, mine, 12)


@pytest.mark.parametrize("size", [16, 4096])
def test_restricted_queries_see_their_assets(spark, monkeypatch, size):
    monkeypatch.setattr(dense, "BLOCK_VECTORS", size)
    rng = np.random.default_rng(5)
    rows = [(f"u{i:03d}", "w", f"a{i // 3}", f"p{i}", rng.normal(size=8).tolist()) for i in range(150)]
    asked = spark.createDataFrame(
        [(q, "w", rng.normal(size=8).tolist(), closed) for q, closed in (("all", None), ("some", True), ("none", True))],
        "query_id string, workspace_id string, embedding array<double>, restricted boolean",
    )
    chosen = spark.createDataFrame([("some", f"a{k}") for k in (2, 7, 31)] + [("all", "a1")], "query_id string, asset_id string")
    got = dense.top_locations(asked, corpus(spark, rows), 8, 5, chosen).orderBy("query_id", "rank").collect()
    vectors = {r["query_id"]: r["embedding"] for r in asked.collect()}
    assert [r["unit_id"] for r in got if r["query_id"] == "all"] == brute(vectors["all"], rows, 5)
    own = [r for r in rows if r[2] in ("a2", "a7", "a31")]
    assert [r["unit_id"] for r in got if r["query_id"] == "some"] == brute(vectors["some"], own, 5)
    assert not [r for r in got if r["query_id"] == "none"]


def test_blocks_do_not_depend_on_arrival(spark):
    rng = np.random.default_rng(6)
    rows = [(f"u{i:03d}", "w", f"a{i // 3}", f"p{i}", rng.normal(size=70).tolist()) for i in range(90)]
    one, two = (dense.vector_blocks(dense.place(corpus(spark, r).repartition(n)), 70).collect() for r, n in ((rows, 1), (rows[::-1], 7)))
    assert one == two and len(one) == 1 and len(one[0]["words"]) == 90 * 2 * 8


def test_hamming_counts_words():
    rng = np.random.default_rng(7)
    q, c = rng.normal(size=(3, 130)), rng.normal(size=(9, 130))
    assert (dense._hamming_words(q, dense._sign_words(c)) == ((q > 0)[:, None] != (c > 0)[None]).sum(-1)).all()


def test_salted_path_gives_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"u{i:04d}", "w", "a", f"p{i}", rng.normal(size=4).tolist()) for i in range(300)]
    q = queries(spark, rng.normal(size=(4, 4)))
    wide = dense.top_locations(q, corpus(spark, rows), 4, 5).collect()
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 32)
    salted = dense.top_locations(q, corpus(spark, rows), 4, 5).collect()
    assert sorted(wide) == sorted(salted)


def test_zero_and_wrong_length_vectors_are_at_distance_one(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [1.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(dense.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 1.0, 0.0]


def test_sign_words_distance(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=130), rng.normal(size=130)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    words = df.select(dense.sign_words(F.col("a")).alias("a"), dense.sign_words(F.col("b")).alias("b")).first()
    assert len(words["a"]) == 3
    distance = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(words["a"], words["b"]))
    assert distance == int(((a > 0) != (b > 0)).sum())


def test_window_rounds(spark):
    top = spark.createDataFrame([("q", i) for i in range(10)] + [("r", 1)], "query_id string, rank int")
    counts = spark.createDataFrame([("q", 500, 33), ("r", 7, 0)], "query_id string, n_rows long, n_upto long")
    got = {r["query_id"]: (r["rounds"], r["rows_ranked"]) for r in dense.window_rounds(top, counts, 10).collect()}
    # 10, 20, 40 rows until the tenth location at row 33; a source of 7 rows is exhausted at once.
    assert got == {"q": (3, 70), "r": (1, 7)}


def test_fusion_keeps_two_regions_of_one_page_and_prefers_dense(spark):
    d = spark.createDataFrame([("q", "a", "r1", "du", 1), ("q", "a", "r2", "dv", 2)], "query_id string, asset_id string, location_key string, unit_id string, rank int")
    l = spark.createDataFrame([("q", "a", "r2", "lx", 1), ("q", "b", "r3", "ly", 2)], "query_id string, asset_id string, location_key string, unit_id string, rank int")
    got = fusion.rrf(d, l, ["asset_id", "location_key"], 10).orderBy("rank").collect()
    assert [(r["location_key"], r["unit_id"]) for r in got] == [("r2", "dv"), ("r1", "du"), ("r3", "ly")]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_case_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, page string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "x"), ("none", "y")], "query_id string, page string")
    got = {r["query_id"]: r for r in ev.case_metrics(ranked, relevant, ["page"], 2).collect()}
    q = got["q"]
    assert (q["recall"], q["mrr"], q["hit"]) == (0.5, 0.5, 1.0)
    assert q["ndcg"] == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)))
    assert (got["none"]["recall"], got["none"]["hit"]) == (0.0, 0.0)


def test_approximate_recall_on_generated_corpus(spark):
    from tracelode.operators import corpus as gc

    rows = gc.scaled_corpus(spark.range(300).withColumnRenamed("id", "seed")).where("cohort = 'visible'")
    units = rows.select(
        F.concat_ws(":", "signature", "profile", "source_order").alias("unit_id"), F.lit("w").alias("workspace_id"), F.col("signature").alias("asset_id"),
        F.concat_ws("/", "profile", F.col("locator_order").cast("string")).alias("location_key"), "embedding",
    )
    asked = units.where("unit_id LIKE '%:D1:150' OR unit_id LIKE '%:D1:0'").select(F.col("unit_id").alias("query_id"), "workspace_id", "embedding")
    exact = dense.top_locations(asked, units, 64, 10).select("query_id", "asset_id", "location_key")
    near = dense.top_approximate(asked, units, 64, 10, 10).select("query_id", "asset_id", "location_key")
    assert exact.intersect(near).count() / exact.count() >= 0.95


def test_nan_counts_as_zero_everywhere(spark):
    rows = [("u1", "w", "a", "p1", [1.0, float("nan")]), ("u2", "w", "a", "p2", [0.0, 1.0])]
    got = {r["unit_id"]: r["distance"] for r in dense.top_locations(queries(spark, np.array([[1.0, 0.0]])), corpus(spark, rows), 2, 2).collect()}
    df = spark.createDataFrame([(r[0], [1.0, 0.0], r[4]) for r in rows], "unit_id string, a array<double>, b array<double>")
    assert got == {r["unit_id"]: r["d"] for r in df.select("unit_id", dense.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()} == {"u1": 0.0, "u2": 1.0}
