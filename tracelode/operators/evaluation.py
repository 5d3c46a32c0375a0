"""Retrieval quality: per-case metrics, means, comparisons, verdicts and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MIN_GAIN = 0.03
MAX_P95_RATIO = 2.0
MAX_P95_INCREASE_MS = 100.0
CAPACITY = {"recall": 0.95, "dense_p95": 100.0, "lexical_p95": 150.0, "hybrid_p95": 250.0,
            "throughput": 20.0, "rounds": 4, "rows": 150}


def ideal_dcg(k: int, relevant: Column) -> Column:
    """DCG of a perfect ranking of min(k, relevant) hits."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), relevant)).cast("int")),
        F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1),
    )


def case_metrics(ranked: DataFrame, relevant: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Recall@k, MRR, nDCG@k and hit@k per query.

    ranked: query_id, keys, rank (already one row per key). relevant: query_id, keys; every query
    with relevant rows gets a line, also without results.
    """
    labels = relevant.select("query_id", *keys).distinct()
    sizes = labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    hits = ranked.where(F.col("rank") <= k).join(labels, ["query_id", *keys], "left_semi")
    scored = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_hits"), F.min("rank").alias("_first"),
        F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("_dcg"),
    )
    return sizes.join(scored, "query_id", "left").select(
        "query_id",
        (F.coalesce("_hits", F.lit(0)) / F.col("_n")).alias("recall"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("_dcg", F.lit(0.0)) / ideal_dcg(k, F.col("_n"))).alias("ndcg"),
        F.when(F.col("_hits") > 0, 1.0).otherwise(0.0).alias("hit"),
    )


def mean_metrics(cases: DataFrame, by: list[str]) -> DataFrame:
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cases"),
        *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg", "hit")],
    )


def verdict(metrics: DataFrame, latencies: DataFrame, stability: DataFrame) -> DataFrame:
    """Hybrid against dense: one row of gains, latency ratios and pass flags.

    Inputs have one row per strategy.
    """
    m = metrics.agg(*[
        F.max(F.when(F.col("strategy") == s, F.col(c))).alias(f"{s}_{c}")
        for s in ("dense", "hybrid") for c in ("recall", "hit")
    ])
    p = latencies.agg(*[F.max(F.when(F.col("strategy") == s, F.col("p95"))).alias(f"{s}_p95") for s in ("dense", "hybrid")])
    c = stability.agg(F.bool_and((F.col("errors") == 0) & (F.col("drifted") == 0)).alias("concurrency_passed"))
    one = m.join(p).join(c)
    recall_gain = F.col("hybrid_recall") - F.col("dense_recall")
    hit_gain = F.col("hybrid_hit") - F.col("dense_hit")
    increase = F.col("hybrid_p95") - F.col("dense_p95")
    quality = (recall_gain >= MIN_GAIN) & (hit_gain >= MIN_GAIN)
    latency = (F.col("hybrid_p95") <= F.col("dense_p95") * MAX_P95_RATIO) & (increase <= MAX_P95_INCREASE_MS)
    return one.select(
        F.round(recall_gain, 6).alias("recall_gain"), F.round(hit_gain, 6).alias("hit_gain"),
        F.round(F.try_divide(F.col("hybrid_p95"), F.col("dense_p95")), 6).alias("p95_ratio"),
        F.round(increase, 6).alias("p95_increase"),
        quality.alias("quality_passed"), latency.alias("latency_passed"), "concurrency_passed",
        (quality & latency & F.col("concurrency_passed")).alias("eligible"),
    )


def capacity_gates(recall: DataFrame, latencies: DataFrame, stability: DataFrame, visible: DataFrame) -> DataFrame:
    """(gate, observed, passed) from one-row recall and visibility, and per-strategy latency and stability."""
    p = latencies.agg(*[F.max(F.when(F.col("strategy") == s, F.col("p95"))).alias(f"{s}_p95") for s in ("dense", "hybrid")])
    s = stability.agg(F.min("throughput").alias("throughput"), F.sum(F.col("errors") + F.col("drifted")).alias("unstable"))
    one = recall.join(p).join(s).join(visible)
    rows = [
        ("annRecall", F.round("recall", 6), F.col("recall") >= CAPACITY["recall"]),
        ("denseP95", F.col("dense_p95"), F.col("dense_p95") <= CAPACITY["dense_p95"]),
        ("hybridP95", F.col("hybrid_p95"), F.col("hybrid_p95") <= CAPACITY["hybrid_p95"]),
        ("throughput", F.round("throughput", 6), F.col("throughput") >= CAPACITY["throughput"]),
        ("stability", F.col("unstable").cast("double"), F.col("unstable") == 0),
        ("scopeAndCurrentChain", F.when(F.col("visible"), 1.0).otherwise(0.0), F.col("visible")),
    ]
    cells = F.array(*[F.struct(F.lit(n).alias("gate"), o.cast("double").alias("observed"), c.alias("passed")) for n, o, c in rows])
    return one.select(F.explode(cells).alias("g")).select("g.*")
