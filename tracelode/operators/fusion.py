"""Rank fusion, strategies, and what is made of ranked evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as tx
from tracelode.scale import top_per

# Fixed values.
RRF_CONSTANT = 60
TOP_K = 6
CANDIDATE_K = 10
CONTEXT_CHARS = 4000
SELECTION_CHARS = 12000
EXCERPT_CHARS = 800


def lexical_distance(score: Column) -> Column:
    return 1.0 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def rrf(dense: DataFrame, lexical: DataFrame, keys: list[str], limit: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """Sum of 1/(constant + rank) over both lists; the dense item stands for a shared key.

    Both inputs: query_id, the key columns, rank, and the same payload columns.
    """
    both = dense.withColumn("_channel", F.lit(0)).unionByName(lexical.withColumn("_channel", F.lit(1)), True)
    payload = [c for c in both.columns if c not in {"query_id", "rank", "_channel", *keys}]
    summed = both.groupBy("query_id", *keys).agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"),
        F.min_by(F.struct(*payload) if payload else F.lit(1), "_channel").alias("_item"),
    )
    ranked = top_per(summed, ["query_id"], [F.desc("score"), *[F.col(k) for k in keys]], limit)
    return ranked.select("query_id", *keys, "score", "rank", *[F.col(f"_item.{p}").alias(p) for p in payload])


def context(ranked: DataFrame) -> DataFrame:
    """Numbered evidence sections of each query, at most the ranked few, joined by blank lines.

    ranked: query_id, rank, title, locator_kind, text. The list per query is limited by its top-k.
    """
    section = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit(", "), "locator_kind",
        F.lit("\n"), F.substring("text", 1, CONTEXT_CHARS),
    )
    return ranked.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", section.alias("s")))), lambda r: r["s"]), "\n\n"
        ).alias("context")
    )


def user_prompt(question: Column, context_text: Column, selection: Column | None = None) -> Column:
    picked = F.lit("")
    if selection is not None:
        trimmed = tx.strip(selection)
        picked = F.when(
            F.coalesce(trimmed, F.lit("")) != "",
            F.concat(F.lit("\n\nSelected text from the PDF:\n"), F.substring(trimmed, 1, SELECTION_CHARS)),
        ).otherwise("")
    return F.concat(F.lit("Question:\n"), question, picked, F.lit("\n\nAsset evidence context:\n"), context_text)


def citations(ranked: DataFrame) -> DataFrame:
    """Ranked evidence frozen as citation rows."""
    return ranked.select(
        "query_id", (F.col("rank") - 1).cast("long").alias("citation_index"), "unit_id", "asset_id", "asset_kind",
        "title", F.substring("text", 1, EXCERPT_CHARS).alias("excerpt"), "representation_id", "generator_version",
        F.col("current_generation").alias("generation"), "index_version",
    )


def refused(queries: DataFrame, ranked: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Queries with neither results nor selected targets."""
    out = queries.join(ranked.select("query_id"), "query_id", "left_anti")
    if targets is not None:
        out = out.join(targets.select("query_id"), "query_id", "left_anti")
    return out.withColumn("reason", F.lit("no_retrieval_results"))
