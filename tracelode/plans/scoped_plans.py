"""Searches in which a query may be limited to selected assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators import dense, fusion
from tracelode.operators import postings as pb
from tracelode.plans.dense_plans import DIMS, K, rank_long, stored
from tracelode.plans.lexical_plans import COVERS, SHARE, top_ranked, words_and_runs
from tracelode.plans.registry import query
from tracelode.sources.views import Tables

# Of three queries one searches everything, one the assets with even numbers, one an empty selection.
SEEN = "(turn % 3 = 0 OR turn % 3 = 1 AND CAST(asset_id AS BIGINT) % 2 = 0)"


def chosen_assets(queries: DataFrame, units: DataFrame, number: str) -> tuple[DataFrame, DataFrame]:
    """Queries marked as restricted or not, and the (query_id, asset_id) rows that the restricted ones selected."""
    flagged = queries.withColumn("restricted", F.col(number) % 3 != 0)
    assets = units.select("workspace_id", "asset_id").distinct().where("CAST(asset_id AS BIGINT) % 2 = 0")
    chosen = flagged.where(F.col(number) % 3 == 1).select("query_id", "workspace_id").join(assets, "workspace_id")
    return flagged, chosen.select("query_id", "asset_id")


def ranked_cte(source: str, order: str) -> str:
    """A table `top` of ranked locations among what each question may see."""
    return f"""top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, unit_id) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, asset_id, location_key ORDER BY {order}, unit_id) AS seen_before FROM ({source}) WHERE {SEEN}) WHERE seen_before = 1)"""


def ranked(source: str, order: str, k: int, columns: str) -> str:
    return f"""SELECT {columns}, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, unit_id) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, asset_id, location_key ORDER BY {order}, unit_id) AS seen_before FROM ({source}) WHERE {SEEN}) WHERE seen_before = 1) WHERE rank <= {k}"""


@query(
    "top_dense_scoped",
    ranked("SELECT *, query_label AS turn FROM v_scored", "distance", K, "query_id, asset_id, location_key, unit_id, round(distance, 6) AS distance"),
)
def top_dense_scoped(t: Tables) -> DataFrame:
    probes, chosen = chosen_assets(t("v_probe"), t("v_dense"), "label")
    top = dense.top_locations(probes, t("v_dense"), DIMS, K, chosen, stored(t))
    return rank_long(top).withColumn("distance", F.round("distance", 6))


@query(
    "top_lexical_scoped",
    ranked("SELECT *, CAST(query_id AS BIGINT) AS turn FROM v_simple", "score DESC", fusion.CANDIDATE_K, "query_id, asset_id, location_key, unit_id, round(score, 6) AS score"),
)
def top_lexical_scoped(t: Tables) -> DataFrame:
    return rank_long(scoped_lexical(t, t("v_query"), "item_id", fusion.CANDIDATE_K)).select(
        "query_id", "asset_id", "location_key", "unit_id", F.round("score", 6).alias("score"), "rank"
    )


def scoped_lexical(t: Tables, queries: DataFrame, number: str, k: int) -> DataFrame:
    asked, chosen = chosen_assets(queries, t("v_visible"), number)
    return pb.top_units(pb.simple_hits(asked, t("v_runs"), t("v_slots"), k, chosen), t("v_slots"), k)


@query(
    "top_latin_scoped",
    f"""WITH {COVERS}, {ranked_cte(f"SELECT l.*, CAST(l.query_id AS BIGINT) AS turn, round({SHARE} + density, 9) AS score FROM v_lexed l JOIN covers c ON c.query_id = l.query_id AND c.unit_id = l.unit_id", "score DESC")}
    SELECT query_id, unit_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM top WHERE rank <= {K}""",
)
def top_latin_scoped(t: Tables) -> DataFrame:
    asked, chosen = chosen_assets(t("v_query"), t("v_visible"), "item_id")
    hits = pb.latin_hits(asked, words_and_runs(t), t("v_slots"), K, chosen=chosen)
    return top_ranked(t, hits, K)


# Of the units that each question may see: document frequencies, lengths and scores are those of its scope.
SCOPED_BM25 = """seen AS (SELECT q.query_id, v.unit_id, v.asset_id, v.page_number, regexp_extract_all(lower(v.text), '[a-z0-9]+') AS w,
      list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')) AS terms
    FROM v_query q JOIN v_visible v ON v.workspace_id = q.workspace_id
    WHERE q.item_id % 3 = 0 OR q.item_id % 3 = 1 AND CAST(v.asset_id AS BIGINT) % 2 = 0),
  stats AS (SELECT query_id, count(*) AS n, avg(len(w)) AS avg_len FROM seen GROUP BY 1),
  tf AS (SELECT query_id, unit_id, asset_id, page_number, len(w) AS n_tokens, term, len([x for x in w if x = term]) AS tf
    FROM (SELECT *, unnest(terms) AS term FROM seen)),
  df AS (SELECT query_id, term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY 1, 2),
  sc AS (SELECT tf.query_id, unit_id, asset_id, page_number, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
      / (tf + 1.2 * (0.25 + 0.75 * n_tokens / avg_len))), 9) AS score
    FROM tf JOIN df ON df.query_id = tf.query_id AND df.term = tf.term JOIN stats s ON s.query_id = tf.query_id WHERE tf > 0 GROUP BY ALL)"""


@query(
    "top_bm25_scoped",
    f"""WITH {SCOPED_BM25} SELECT query_id, asset_id, CAST(page_number AS BIGINT) AS page_number, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asset_id, page_number) AS rank FROM (
        SELECT query_id, asset_id, page_number, max(score) AS score FROM sc GROUP BY 1, 2, 3)) WHERE rank <= 24""",
)
def top_bm25_scoped(t: Tables) -> DataFrame:
    asked, chosen = chosen_assets(t("v_query"), t("v_visible"), "item_id")
    hits = pb.bm25_hits(asked, t("v_postings"), t("v_slots"), 24, chosen)
    return rank_long(pb.page_best(hits, t("v_slots"), 24)).select(
        "query_id", "asset_id", F.col("page_number").cast("long").alias("page_number"), F.round("score", 6).alias("score"), "rank"
    )


SCOPED_HYBRID = f"""d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, unit_id) AS rank FROM (
    SELECT h.query_id, s.unit_id, s.asset_id, s.location_key, s.distance,
      row_number() OVER (PARTITION BY h.query_id, s.asset_id, s.location_key ORDER BY s.distance, s.unit_id) AS lr
    FROM v_hquery h JOIN v_scored s ON s.query_id = h.workspace_id || '#' || h.label
    WHERE h.item_id % 3 = 0 OR h.item_id % 3 = 1 AND CAST(s.asset_id AS BIGINT) % 2 = 0) WHERE lr = 1),
  {ranked_cte("SELECT s.*, h.item_id AS turn FROM v_simple s JOIN v_hquery h ON h.query_id = s.query_id", "score DESC")},
  f AS (SELECT query_id, asset_id, location_key, round(sum(1.0 / (60 + rank)), 12) AS score, arg_min(unit_id, channel) AS unit_id FROM (
    SELECT query_id, asset_id, location_key, unit_id, rank, 0 AS channel FROM d WHERE rank <= 10
    UNION ALL SELECT query_id, asset_id, location_key, unit_id, rank, 1 FROM top WHERE rank <= 10) GROUP BY 1, 2, 3)"""


@query(
    "top_hybrid_scoped",
    f"""WITH {SCOPED_HYBRID} SELECT query_id, unit_id, round(score, 9) AS score, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asset_id, location_key) AS rank FROM f) WHERE rank <= {K}""",
)
def top_hybrid_scoped(t: Tables) -> DataFrame:
    n = fusion.CANDIDATE_K
    probes, chosen = chosen_assets(t("v_hquery"), t("v_dense"), "item_id")
    columns = ["query_id", "asset_id", "location_key", "unit_id", "rank"]
    merged = fusion.rrf(
        dense.top_locations(probes, t("v_dense"), DIMS, n, chosen, stored(t)).select(*columns),
        scoped_lexical(t, t("v_hquery"), "item_id", n).select(*columns), ["asset_id", "location_key"], K,
    )
    return rank_long(merged).select("query_id", "unit_id", F.round("score", 9).alias("score"), "rank")
