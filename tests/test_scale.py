"""Hot-key helpers against plain windows on data where one key holds most rows."""

import random
import statistics

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.operators import ranges as rg
from tracelode.scale import hot_lag, hot_ordinal, hot_percentiles


def rows(spark, n=3000):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", rng.randrange(500), i, round(rng.expovariate(0.1), 2)) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, o int, id int, v double")


def test_ordinal_and_lag(spark):
    _, df = rows(spark)
    plain = Window.partitionBy("k").orderBy("o", "id")
    want = df.select("id", F.row_number().over(plain).alias("n"), F.lag("id").over(plain).alias("p")).collect()
    bucket = F.floor(F.col("o") / 37)
    a = hot_ordinal(df, ["k"], [F.col("o"), F.col("id")], bucket).select("id", "ordinal").collect()
    b = hot_lag(df, ["k"], ["o", "id"], "id", bucket, "p").select("id", "p").collect()
    assert {(r["id"], r["n"]) for r in want} == {(r["id"], r["ordinal"]) for r in a}
    assert {(r["id"], r["p"]) for r in want} == {(r["id"], r["p"]) for r in b}


def test_percentiles(spark):
    data, df = rows(spark)
    got = {r["k"]: r for r in hot_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "m": "median"}, accuracy=16).collect()}
    for k in {d[0] for d in data}:
        values = sorted(d[3] for d in data if d[0] == k)
        nearest = lambda q: values[max(0, -(-int(q * 100) * len(values) // 100) - 1)]
        assert got[k]["p50"] == nearest(0.5) and got[k]["p95"] == nearest(0.95)
        assert abs(got[k]["m"] - statistics.median(values)) < 1e-9


def test_percentiles_of_constant_values(spark):
    df = spark.createDataFrame([("a", 3.0)] * 5, "k string, v double")
    assert hot_percentiles(df, ["k"], "v", {"p": 0.95, "m": "median"}).first()[1:] == (3.0, 3.0)


def test_percentiles_with_an_outlier_look_at_few_rows(spark):
    n = 20_000
    df = spark.range(n).select((F.col("id") % 2).alias("k"), F.when(F.col("id") == 7, 1e12).otherwise((F.col("id") * 7919) % 10_007 / 7.0).alias("v"))
    wanted = {"p50": 0.5, "p99": 0.99, "m": "median"}
    got = {r["k"]: r for r in hot_percentiles(df, ["k"], "v", wanted, accuracy=1_000).collect()}
    for k in (0, 1):
        values = sorted(1e12 if i == 7 else i * 7919 % 10_007 / 7.0 for i in range(k, n, 2))
        assert (got[k]["p50"], got[k]["p99"]) == (values[4999], values[9899]) and abs(got[k]["m"] - statistics.median(values)) < 1e-9
    # what is ordered lies between two bounds of the sketch: a small share, though one value spans the whole width
    sketch = df.groupBy("k").agg(F.percentile_approx("v", [0.497, 0.503], 1_000).alias("b"))
    between = df.join(sketch, "k").where((F.col("v") >= F.col("b")[0]) & (F.col("v") <= F.col("b")[1])).count()
    assert between < n / 50


def test_interval_join(spark):
    rng = random.Random(6)
    left = [(rng.randrange(2), s, s + rng.randrange(1, 400)) for s in (rng.randrange(3000) for _ in range(120))]
    right = [(rng.randrange(2), s, s + rng.randrange(1, 90)) for s in (rng.randrange(3000) for _ in range(150))]
    l = spark.createDataFrame(left, "k int, a int, b int")
    r = spark.createDataFrame(right, "k int, c int, d int")
    got = sorted(tuple(x) for x in rg.overlap_join(l, r, ["k"], ("a", "b"), ("c", "d"), 64).collect())
    want = sorted((k, a, b, c, d) for k, a, b in left for q, c, d in right if k == q and c < b and d > a)
    assert got == want


def test_rectangles_touching_edges_do_not_overlap(spark):
    l = spark.createDataFrame([(1, 0.0, 0.0, 0.5, 0.5)], "k int, l_x double, l_y double, l_width double, l_height double")
    r = spark.createDataFrame([(1, 0.5, 0.0, 0.5, 0.5), (1, 0.4, 0.4, 0.6, 0.6)], "k int, r_x double, r_y double, r_width double, r_height double")
    assert [x["r_x"] for x in rg.rect_overlap_join(l, r, ["k"]).collect()] == [0.4]


def test_coverage_needs_every_visible_character(spark):
    chunks = spark.createDataFrame([(1, 0, 11, "ab cd\nef gh"), (2, 0, 5, "ab cd")], "k int, char_start int, char_end int, t string")
    regions = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 9, 11), (2, 0, 3)], "k int, region_start int, region_end int")
    got = {r["k"]: r["covered"] for r in rg.char_coverage(chunks, regions, "k", "t").collect()}
    assert got == {1: True, 2: False}
