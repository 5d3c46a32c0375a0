"""Filters, projections and scope joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators import relations as rel
from tracelode.operators import scope
from tracelode.plans.registry import query
from tracelode.sources.views import BASE_TABLES, Tables


@query(
    "src_tables",
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM {t}" for t in BASE_TABLES
    ),
)
def src_tables(t: Tables) -> DataFrame:
    out = None
    for name in BASE_TABLES:
        one = t(name).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "flt_signature",
    """SELECT u.unit_id, u.unit_kind, l.locator_kind FROM v_unit u
    JOIN v_asset a ON a.asset_id = u.asset_id JOIN v_representation r ON r.representation_id = u.representation_id
    JOIN v_locator l ON l.locator_id = u.locator_id
    WHERE EXISTS (SELECT 1 FROM v_signature s WHERE s.channel = 'text' AND s.asset_kind = a.asset_kind
      AND s.unit_kind = u.unit_kind AND s.representation_kind = r.representation_kind
      AND s.locator_kind = l.locator_kind)""",
)
def flt_signature(t: Tables) -> DataFrame:
    kinds = (
        t("v_unit")
        .join(t("v_asset").select("asset_id", "asset_kind"), "asset_id")
        .join(t("v_representation").select("representation_id", "representation_kind"), "representation_id")
        .join(t("v_locator").select("locator_id", "locator_kind"), "locator_id")
    )
    return scope.registered(kinds, t("v_signature")).select("unit_id", "unit_kind", "locator_kind")


# Each benchmark question asks for the labelled good documents of its workspace.
SCOPE_SQL = """SELECT q.query_id, CAST(d.doc_id AS STRING) AS asset_id
  FROM v_query q JOIN documents d ON d.source = q.workspace_id JOIN labels b ON b.doc_id = d.doc_id
  WHERE b.quality = 1"""


@query(
    "flt_selected_assets",
    f"""WITH sc AS ({SCOPE_SQL})
    SELECT q.query_id, a.asset_id, a.status FROM v_query q JOIN v_asset a ON a.workspace_id = q.workspace_id
    WHERE EXISTS (SELECT 1 FROM sc WHERE sc.query_id = q.query_id AND sc.asset_id = a.asset_id)""",
)
def flt_selected_assets(t: Tables) -> DataFrame:
    return scope.selected_assets(t("v_query"), t("v_asset"), t.sql(SCOPE_SQL)).select(
        "query_id", "asset_id", "status"
    )


@query(
    "flt_embedding_scope",
    """SELECT embedding_id, unit_id, workspace_id FROM v_embedding WHERE is_current AND embedding_space = 'text'
    AND provider = 'main' AND model = 'base' AND version = 'v1' AND dimensions = 64""",
)
def flt_embedding_scope(t: Tables) -> DataFrame:
    return scope.embedding_scope(
        t("v_embedding"), space="text", provider="main", model="base", version="v1", dimensions=64
    ).select("embedding_id", "unit_id", "workspace_id")


@query(
    "flt_soft_delete",
    "SELECT asset_id, workspace_id, title FROM v_asset WHERE status = 'ready' AND is_deleted = false",
)
def flt_soft_delete(t: Tables) -> DataFrame:
    return scope.live_assets(t("v_asset")).select("asset_id", "workspace_id", "title")


@query("flt_viewable", "SELECT asset_id, status FROM v_asset WHERE status IN ('ready', 'chunked')")
def flt_viewable(t: Tables) -> DataFrame:
    return scope.viewable(t("v_asset")).select("asset_id", "status")


@query(
    "prj_locator_key",
    """SELECT locator_id, asset_id, CASE WHEN locator_kind = 'pdf_page' THEN 'pdf_page:' || page_number
    ELSE locator_id END AS location_key FROM v_locator""",
)
def prj_locator_key(t: Tables) -> DataFrame:
    return t("v_locator").select(
        "locator_id", "asset_id",
        scope.location_key(F.col("locator_kind"), F.col("page_number"), F.col("locator_id")).alias("location_key"),
    )


@query(
    "prj_source_available",
    """SELECT c.citation_id, c.asset_id, a.asset_id IS NOT NULL AND NOT a.is_deleted AS source_available
    FROM v_citation c LEFT JOIN v_asset a ON a.asset_id = c.asset_id""",
)
def prj_source_available(t: Tables) -> DataFrame:
    return rel.source_available(t("v_citation"), t("v_asset")).select(
        "citation_id", "asset_id", "source_available"
    )


COHORT_SQL = """CASE WHEN u.workspace_id = 'elsewhere' THEN 'outside'
  WHEN r.generation <> a.current_generation THEN 'old_generation'
  WHEN u.index_version <> a.current_index THEN 'old_index'
  WHEN e.provider <> 'main' THEN 'wrong_provider' ELSE 'visible' END"""
COHORT_FROM = """FROM v_unit u JOIN v_asset a ON a.asset_id = u.asset_id
  JOIN v_representation r ON r.representation_id = u.representation_id
  JOIN v_locator l ON l.locator_id = u.locator_id JOIN v_embedding e ON e.unit_id = u.unit_id"""


def cohort_rows(t: Tables) -> DataFrame:
    """Embedded units with all four kinds and their cohort."""
    joined = (
        t("v_unit")
        .select("unit_id", "workspace_id", "asset_id", "representation_id", "locator_id", "unit_kind",
                "index_version", "text")
        .join(t("v_asset").select("asset_id", "asset_kind", "current_generation", "current_index",
                                  "status", "is_deleted"), "asset_id")
        .join(t("v_representation").select("representation_id", "representation_kind", "generation"),
              "representation_id")
        .join(t("v_locator").select("locator_id", "locator_kind", "page_number"), "locator_id")
        .join(t("v_embedding").select("unit_id", "provider", "is_current"), "unit_id")
    )
    return joined.withColumn(
        "cohort",
        scope.cohort(
            F.col("workspace_id") == "elsewhere", F.col("generation"), F.col("current_generation"),
            F.col("index_version"), F.col("current_index"), F.col("provider"), "main",
        ),
    )


@query("prj_kind_case", f"SELECT u.unit_id, {COHORT_SQL} AS cohort {COHORT_FROM}")
def prj_kind_case(t: Tables) -> DataFrame:
    return cohort_rows(t).select("unit_id", "cohort")


@query(
    "prj_note_ui",
    """SELECT n.note_id, coalesce(nullif(trim(n.title), ''), 'Untitled note') AS title,
      s.first_asset, CAST(coalesce(g.n_tags, 0) AS BIGINT) AS n_tags, g.first_tag
    FROM v_note n
    LEFT JOIN (SELECT note_id, arg_min(asset_id, source_order) AS first_asset FROM v_note_source GROUP BY 1) s
      ON s.note_id = n.note_id
    LEFT JOIN (SELECT note_id, count(*) AS n_tags, min(tag) AS first_tag FROM v_note_tag GROUP BY 1) g
      ON g.note_id = n.note_id""",
)
def prj_note_ui(t: Tables) -> DataFrame:
    return rel.note_cards(t("v_note"), t("v_note_source"), t("v_note_tag")).select(
        "note_id", "title", "first_asset", "n_tags", "first_tag"
    )


@query(
    "flt_note_search",
    """SELECT n.note_id FROM v_note n
    WHERE (lower(coalesce(n.title, '')) LIKE '%urgent%' OR lower(coalesce(n.body, '')) LIKE '%urgent%')
      AND EXISTS (SELECT 1 FROM v_note_tag g WHERE g.note_id = n.note_id AND g.tag IN ('Brand#11', 'Brand#22', 'Brand#1', 'Brand#2'))""",
)
def flt_note_search(t: Tables) -> DataFrame:
    return rel.note_search(
        t("v_note"), t("v_note_tag"), "Urgent", ["Brand#11", "Brand#22", "Brand#1", "Brand#2"]
    ).select("note_id")


@query(
    "prj_locator_summary",
    """WITH k AS (SELECT locator_id, count(*) AS n FROM v_rect GROUP BY 1)
    SELECT l.locator_id, CASE l.locator_kind WHEN 'pdf_page' THEN 'PDF p.' || l.page_number
      WHEN 'pdf_region' THEN 'PDF p.' || l.page_number || ' · ' || CASE WHEN k.n > 1 THEN k.n || ' regions' ELSE 'region' END
      ELSE 'Image · ' || CASE WHEN k.n > 1 THEN k.n || ' regions' ELSE 'region' END END AS summary
    FROM v_locator l LEFT JOIN k ON k.locator_id = CAST(l.asset_id AS BIGINT)""",
)
def prj_locator_summary(t: Tables) -> DataFrame:
    counts = t("v_rect").groupBy("locator_id").agg(F.count(F.lit(1)).alias("n_regions"))
    located = t("v_locator").join(
        counts.select(F.col("locator_id").cast("string").alias("asset_id"), "n_regions"), "asset_id", "left"
    )
    return located.select(
        "locator_id",
        rel.locator_summary(F.col("locator_kind"), F.col("page_number"), F.col("n_regions")).alias("summary"),
    )


CHAIN_CHECK = """SELECT unit_id, workspace_id, asset_id, representation_kind, locator_kind, location_key,
  CAST(length(text) AS BIGINT) AS n_chars FROM v_visible"""


@query("join_visible_chain", CHAIN_CHECK)
def join_visible_chain(t: Tables) -> DataFrame:
    return scope.visible_units(
        t("v_unit"), t("v_asset"), t("v_representation"), t("v_locator"), t("v_signature")
    ).select(
        "unit_id", "workspace_id", "asset_id", "representation_kind", "locator_kind", "location_key",
        F.length("text").cast("long").alias("n_chars"),
    )


@query("join_embedding_projection", "SELECT unit_id, embedding_id, workspace_id, CAST(label AS BIGINT) AS label FROM v_dense")
def join_embedding_projection(t: Tables) -> DataFrame:
    vectors = scope.embedding_scope(
        t("v_embedding"), space="text", provider="main", model="base", version="v1", dimensions=64
    )
    return scope.with_embeddings(t("v_visible").select(
        "unit_id", "asset_id", "workspace_id", "current_generation", "index_version"), vectors
    ).select("unit_id", "embedding_id", "workspace_id", F.col("label").cast("long").alias("label"))


@query(
    "join_generation_units",
    """SELECT u.unit_id, u.asset_id, CAST(u.unit_order AS BIGINT) AS unit_order FROM v_unit u
    JOIN v_asset a ON a.asset_id = u.asset_id AND a.workspace_id = u.workspace_id
    JOIN v_representation r ON r.representation_id = u.representation_id AND r.workspace_id = u.workspace_id
      AND r.asset_id = u.asset_id
    JOIN v_locator l ON l.locator_id = u.locator_id AND l.workspace_id = u.workspace_id
      AND l.asset_id = u.asset_id AND l.representation_id = u.representation_id
    WHERE r.generation = 2 AND l.generation = 2 AND u.index_version = a.current_index""",
)
def join_generation_units(t: Tables) -> DataFrame:
    chained = scope.chain(t("v_unit"), t("v_asset"), t("v_representation"), t("v_locator"))
    return scope.at_generation(chained, F.lit(2)).select(
        "unit_id", "asset_id", F.col("unit_order").cast("long").alias("unit_order")
    )


MEMBER_SQL = """SELECT DISTINCT o_custkey AS user_id, c_nationkey AS workspace_id,
  CASE WHEN o_orderstatus = 'F' THEN 'owner' ELSE 'member' END AS role
  FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(
    "join_membership",
    f"""SELECT m.user_id, w.n_nationkey AS workspace_id, w.n_name AS name, m.role FROM nation w
    JOIN ({MEMBER_SQL}) m ON m.workspace_id = w.n_nationkey WHERE w.n_regionkey <> 4""",
)
def join_membership(t: Tables) -> DataFrame:
    workspaces = t("nation").select(
        F.col("n_nationkey").alias("workspace_id"), F.col("n_name").alias("name"),
        (F.col("n_regionkey") == 4).alias("is_archived"),
    )
    return rel.memberships(workspaces, t.sql(MEMBER_SQL))
