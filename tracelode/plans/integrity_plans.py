"""Integrity audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions import records as rc
from tracelode.operators import fusion
from tracelode.operators import golden as gd
from tracelode.operators import integrity as dq
from tracelode.plans.registry import query
from tracelode.sources.views import Tables


def codes(*pairs: tuple[str, str]) -> str:
    """SQL of comma-joined codes."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + ")"


DRIFT = codes(
    ("u.unit_id IS NULL", "unit_missing"),
    ("e.workspace_id IS DISTINCT FROM u.workspace_id", "workspace"),
    ("e.asset_id IS DISTINCT FROM u.asset_id", "asset"),
    ("e.index_version IS DISTINCT FROM u.index_version", "index"),
    ("r.asset_id IS DISTINCT FROM u.asset_id", "representation_asset"),
    ("r.workspace_id IS DISTINCT FROM u.workspace_id", "representation_workspace"),
    ("r.generation IS DISTINCT FROM e.generation", "representation_generation"),
    ("l.asset_id IS DISTINCT FROM u.asset_id", "locator_asset"),
    ("l.workspace_id IS DISTINCT FROM u.workspace_id", "locator_workspace"),
    ("l.representation_id IS DISTINCT FROM r.representation_id", "locator_representation"),
    ("l.generation IS DISTINCT FROM e.generation", "locator_generation"),
    ("a.current_generation IS DISTINCT FROM e.generation", "asset_generation"),
    ("a.current_index IS DISTINCT FROM e.index_version", "asset_index"),
)


@query(
    "dq_embedding_drift",
    f"""SELECT * FROM (SELECT e.embedding_id, {DRIFT} AS drift FROM v_embedding e LEFT JOIN v_unit u ON u.unit_id = e.unit_id
    LEFT JOIN v_representation r ON r.representation_id = u.representation_id LEFT JOIN v_locator l ON l.locator_id = u.locator_id
    LEFT JOIN v_asset a ON a.asset_id = u.asset_id WHERE e.is_current) WHERE drift <> ''""",
)
def dq_embedding_drift(t: Tables) -> DataFrame:
    return dq.embedding_drift(
        t("v_embedding"), t("v_unit"), t("v_representation"), t("v_locator"), t("v_asset")
    ).select("embedding_id", "drift")


KEYS = {
    "unit_place": ("v_unit", ["asset_id", "representation_id", "locator_id", "unit_order", "index_version"]),
    "embedding_unit": ("v_embedding", ["unit_id", "embedding_space", "provider", "model", "version"]),
    "representation_kind": ("v_representation", ["asset_id", "representation_kind", "generation"]),
    "note_source_order": ("lineitem", ["l_orderkey", "l_linenumber"]),
    "message": ("v_message", ["thread_id", "turn"]),
    "citation_index": ("v_citation", ["thread_id", "citation_index"]),
    "page": ("v_locator", ["asset_id", "representation_id", "page_number"]),
}


@query(
    "dq_unique_keys",
    "\nUNION ALL\n".join(
        f"SELECT '{n}' AS rule, CAST(count(*) AS BIGINT) AS n_keys, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_rows FROM (SELECT count(*) AS c FROM {v} GROUP BY {', '.join(k)} HAVING count(*) > 1)"
        for n, (v, k) in KEYS.items()
    ),
)
def dq_unique_keys(t: Tables) -> DataFrame:
    return dq.union_all([dq.duplicate_keys(t(v), n, k) for n, (v, k) in KEYS.items()])


LINKS = {
    "embedding_document": ("embeddings", "vec_id", "documents", "doc_id"),
    "line_order": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "line_part": ("lineitem", "l_partkey", "part", "p_partkey"),
    "order_customer": ("orders", "o_custkey", "customer", "c_custkey"),
    "message_parent": ("v_message", "parent_id", "v_message", "message_id"),
    "citation_asset": ("v_citation", "asset_id", "v_asset", "asset_id"),
    "citation_locator": ("v_citation", "locator_id", "v_locator", "locator_id"),
    "embedding_unit": ("v_embedding", "unit_id", "v_visible", "unit_id"),
}


@query(
    "dq_foreign_keys",
    "\nUNION ALL\n".join(
        f"SELECT '{n}' AS rule, CAST(c.{k} AS VARCHAR) AS missing_key, CAST(count(*) AS BIGINT) AS n_rows FROM {v} c WHERE c.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{pk} = c.{k}) GROUP BY 2"
        for n, (v, k, p, pk) in LINKS.items()
    ),
)
def dq_foreign_keys(t: Tables) -> DataFrame:
    return dq.union_all([dq.orphans(t(v), k, t(p), pk, n) for n, (v, k, p, pk) in LINKS.items()])


WIDE = """SELECT l_orderkey AS locator_id, l_linenumber AS region_order, l_partkey AS part_id, abs(l_discount) * 11 AS x, abs(l_tax) * 10 - 0.1 AS y,
  l_quantity / 45 AS width, l_quantity / 40 - 0.05 AS height FROM lineitem"""


@query(
    "dq_region_bounds",
    f"""SELECT errors, CAST(count(*) AS BIGINT) AS n_regions FROM (SELECT {codes(("x < 0 OR x > 1", "x"), ("y < 0 OR y > 1", "y"),
      ("width <= 0 OR width > 1", "width"), ("height <= 0 OR height > 1", "height"), ("x + width > 1", "x_width"), ("y + height > 1", "y_height"))} AS errors FROM ({WIDE})) WHERE errors <> '' GROUP BY 1""",
)
def dq_region_bounds(t: Tables) -> DataFrame:
    checked = t.sql(WIDE).select(
        dq.region_errors(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("errors")
    )
    return checked.where("errors <> ''").groupBy("errors").agg(F.count(F.lit(1)).alias("n_regions"))


@query(
    "dq_locator_snapshot",
    f"""SELECT * FROM (SELECT l.locator_id, {codes(("l.locator_version <> 1", "version"), ("r.representation_id IS NULL", "representation_missing"),
      ("r.workspace_id <> l.workspace_id", "workspace"), ("r.asset_id <> l.asset_id", "asset"), ("r.generation <> l.generation", "generation"),
      ("NOT CASE WHEN l.locator_kind IN ('pdf_page', 'pdf_region') THEN r.representation_kind LIKE 'pdf%' ELSE r.representation_kind IN ('image_ocr', 'image_caption') END", "representation_kind"))} AS errors
    FROM v_locator l LEFT JOIN v_representation r ON r.representation_id = l.representation_id) WHERE errors <> ''""",
)
def dq_locator_snapshot(t: Tables) -> DataFrame:
    return dq.locator_snapshots(t("v_locator"), t("v_representation")).select("locator_id", "errors")


TARGET_FLAGS = """SELECT g.case_id, bool_or(f.fixture_id IS NULL) AS unknown_fixture,
  bool_or(coalesce(f.modality = 'image' AND g.locator_kind <> 'image_region', false)) AS pdf_locator,
  bool_or(coalesce(f.modality = 'pdf' AND g.locator_kind = 'image_region', false)) AS image_locator,
  bool_or(coalesce(f.modality = 'pdf' AND g.locator_kind <> 'image_region' AND f.page_label <> g.page_label, false)) AS page_label,
  bool_or(coalesce(f.modality = 'pdf' AND g.locator_kind <> 'image_region' AND f.page_number <> g.page_number, false)) AS page_number,
  bool_or(coalesce(g.locator_kind <> 'pdf_page' AND g.region_index >= f.n_regions, false)) AS region_index,
  bool_or(f.modality = 'pdf') AS has_pdf, bool_or(f.modality = 'image') AS has_image
  FROM v_golden_target g LEFT JOIN v_golden_fixture f ON f.fixture_id = g.fixture_id GROUP BY 1"""


@query(
    "dq_golden_suite",
    f"""SELECT * FROM (SELECT c.case_id, {codes(("c.disposition = 'answer' AND x.case_id IS NULL", "no_targets"),
      *((f"coalesce(x.{n}, false)", n) for n in ("unknown_fixture", "pdf_locator", "image_locator", "page_label", "page_number", "region_index")),
      ("c.disposition = 'answer' AND CASE WHEN x.has_pdf AND x.has_image THEN 'mixed' WHEN x.has_pdf THEN 'pdf' WHEN x.has_image THEN 'image' END <> c.modality", "modality"),
      ("c.disposition <> 'answer' AND (c.layer <> 'answer' OR c.task_type <> 'no_answer')", "refusal_layer"))} AS errors
    FROM v_golden_case c LEFT JOIN ({TARGET_FLAGS}) x ON x.case_id = c.case_id) WHERE errors <> ''""",
)
def dq_golden_suite(t: Tables) -> DataFrame:
    return gd.suite_errors(t("v_golden_case"), t("v_golden_target"), t("v_golden_fixture")).select("case_id", "errors")


@query(
    "dq_execution_complete",
    f"""WITH w AS (SELECT c.case_id, c.layer, c.modality, count(g.case_id) AS n_targets FROM v_golden_case c LEFT JOIN v_golden_target g ON g.case_id = c.case_id GROUP BY 1, 2, 3),
    x AS (SELECT case_id, count(*) AS runs, arg_min(layer, layer || modality) AS layer, arg_min(modality, layer || modality) AS modality, max(target_count) AS targets,
      bool_and(passed) AS passed, bool_and(adapters_ran) AS adapters FROM v_execution GROUP BY 1)
    SELECT * FROM (SELECT coalesce(w.case_id, x.case_id) AS case_id, {codes(("x.case_id IS NULL", "not_executed"), ("w.case_id IS NULL", "unknown_case"), ("x.runs > 1", "duplicate"),
      ("x.layer <> w.layer", "layer"), ("x.modality <> w.modality", "modality"), ("x.targets <> w.n_targets", "target_count"), ("w.case_id IS NOT NULL AND NOT x.passed", "failed"),
      ("w.n_targets > 0 AND NOT x.adapters", "adapters"))} AS errors FROM w FULL OUTER JOIN x ON x.case_id = w.case_id) WHERE errors <> ''""",
)
def dq_execution_complete(t: Tables) -> DataFrame:
    return gd.execution_gaps(t("v_golden_case"), t("v_golden_target"), t("v_execution")).select("case_id", "errors")


REQUESTS = """SELECT user_id AS asset_id, CASE event_id % 4 WHEN 0 THEN 'retry' WHEN 1 THEN 'reindex' WHEN 2 THEN 'delete' ELSE 'delete_retry' END AS action,
  CASE WHEN event_id % 5 = 0 THEN 'member' ELSE 'owner' END AS role, event_id AS request_id FROM events"""
JOB_ASSET = """SELECT DISTINCT user_id AS asset_id, CASE user_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'ready' WHEN 2 THEN 'deleting' WHEN 3 THEN 'chunked'
  WHEN 4 THEN 'uploaded' WHEN 5 THEN 'failed' ELSE 'ready' END AS status FROM events WHERE user_id % 13 <> 5"""
OPEN_JOBS = """SELECT job_id, asset_id, job_type, queued_at, CASE WHEN (asset_id % 3 = 1 OR (job_type = 'delete_cleanup' AND asset_id % 3 <> 0)) AND status IN ('queued', 'running') THEN 'failed' ELSE status END AS status FROM v_job"""
JOB_UNITS = "SELECT DISTINCT user_id AS asset_id FROM events WHERE user_id % 9 <> 4"


@query(
    "dq_job_eligibility",
    f"""WITH j AS ({OPEN_JOBS}), s AS (SELECT asset_id, bool_or(status IN ('queued', 'running') AND job_type = 'delete_cleanup') AS del,
      bool_or(status IN ('queued', 'running') AND job_type = 'ingest') AS ing, bool_or(status IN ('queued', 'running') AND job_type = 'embed_chunks') AS emb,
      arg_max(job_type, (queued_at, job_id)) AS lt, arg_max(status, (queued_at, job_id)) AS ls FROM j GROUP BY 1)
    SELECT q.request_id, CASE WHEN q.action IN ('delete', 'delete_retry') AND q.role <> 'owner' THEN 'owner_only' WHEN a.asset_id IS NULL THEN 'asset_not_found'
      WHEN q.action <> 'delete_retry' AND a.status IN ('deleting', 'deleted') THEN 'being_deleted'
      WHEN q.action = 'retry' AND a.status <> 'failed' THEN 'not_failed'
      WHEN q.action = 'reindex' AND a.status IN ('pending_upload', 'uploaded', 'parsing', 'chunking') THEN 'not_ready'
      WHEN q.action = 'delete_retry' AND a.status <> 'deleting' THEN 'no_failed_deletion' WHEN coalesce(s.del, false) THEN 'deletion_running'
      WHEN q.action = 'retry' AND coalesce(s.ing, false) THEN 'ingest_running' WHEN q.action = 'reindex' AND coalesce(s.emb, false) THEN 'reindex_running'
      WHEN q.action = 'reindex' AND u.asset_id IS NULL THEN 'no_units'
      WHEN q.action = 'delete_retry' AND NOT coalesce(s.lt = 'delete_cleanup' AND s.ls = 'failed', false) THEN 'no_failed_deletion' ELSE 'allowed' END AS decision
    FROM ({REQUESTS}) q LEFT JOIN ({JOB_ASSET}) a ON a.asset_id = q.asset_id LEFT JOIN s ON s.asset_id = q.asset_id LEFT JOIN ({JOB_UNITS}) u ON u.asset_id = q.asset_id""",
)
def dq_job_eligibility(t: Tables) -> DataFrame:
    return dq.job_eligibility(t.sql(REQUESTS), t.sql(JOB_ASSET), t.sql(OPEN_JOBS), t.sql(JOB_UNITS)).select(
        "request_id", "decision"
    )


@query(
    "dq_restore_semantics",
    """SELECT 'activeKinds' AS rule, (SELECT count(DISTINCT asset_kind) = 2 FROM v_asset WHERE status = 'ready' AND NOT is_deleted) AS passed
    UNION ALL SELECT 'deletedKinds', (SELECT count(DISTINCT asset_kind) = 2 FROM v_asset WHERE is_deleted)
    UNION ALL SELECT 'failedCovered', (SELECT count(*) > 0 FROM v_asset WHERE status = 'failed')
    UNION ALL SELECT 'historicCitations', (SELECT count(DISTINCT l.generation = a.current_generation) = 2 FROM v_locator l JOIN v_asset a ON a.asset_id = l.asset_id)
    UNION ALL SELECT 'citationOrder', (SELECT bool_and(citation_index BETWEEN 0 AND 2) FROM v_citation)
    UNION ALL SELECT 'deletedObjectsAbsent', (SELECT count(*) FILTER (WHERE is_deleted AND status = 'ready') = 0 FROM v_asset)""",
)
def dq_restore_semantics(t: Tables) -> DataFrame:
    live = (F.col("status") == "ready") & ~F.col("is_deleted")
    kind = F.col("asset_kind")

    def both(where: F.Column) -> F.Column:
        return F.bool_or(where & (kind == "pdf")) & F.bool_or(where & (kind == "image"))

    assets = gd.checks(
        t("v_asset"),
        [
            ("activeKinds", both(live)),
            ("deletedKinds", both(F.col("is_deleted"))),
            ("failedCovered", F.bool_or(F.col("status") == "failed")),
            ("deletedObjectsAbsent", F.count_if(F.col("is_deleted") & (F.col("status") == "ready")) == 0),
        ],
    )
    same = F.col("generation") == F.col("current_generation")
    history = gd.checks(
        t("v_locator").join(t("v_asset").select("asset_id", "current_generation"), "asset_id"),
        [("historicCitations", F.bool_or(same) & F.bool_or(~same))],
    )
    order = gd.checks(t("v_citation"), [("citationOrder", F.bool_and(F.col("citation_index").between(0, 2)))])
    return dq.union_all([assets, history, order])


@query(
    "top_uncite",
    """SELECT c.citation_id, c.message_id, c.locator_id FROM v_citation c WHERE c.message_id NOT IN (SELECT message_id FROM v_message WHERE status = 'failed')""",
)
def top_uncite(t: Tables) -> DataFrame:
    failed = t("v_message").where("status = 'failed'").select("message_id")
    return t("v_citation").join(failed, "message_id", "left_anti").select("citation_id", "message_id", "locator_id")


LOCATED = """SELECT l.locator_id, locator_kind, page_number, CASE WHEN locator_kind = 'image_region' THEN CASE WHEN char_start % 47 = 11 THEN 'other' ELSE 'image_normalized_top_left_v1' END
    WHEN locator_kind = 'pdf_region' THEN CASE WHEN char_start % 53 = 9 THEN 'other' ELSE 'pdf_normalized_top_left_v1' END END AS space,
  CAST(CASE WHEN locator_kind = 'pdf_region' THEN char_start % 5 END AS DOUBLE) AS crop_x0_points,
  CAST(CASE WHEN locator_kind = 'pdf_region' THEN char_start % 7 END AS DOUBLE) AS crop_y0_points,
  CAST(CASE WHEN locator_kind <> 'pdf_region' OR char_start % 37 = 5 THEN NULL ELSE 612 END AS DOUBLE) AS crop_x1_points,
  CAST(CASE WHEN locator_kind = 'pdf_region' THEN 792 END AS DOUBLE) AS crop_y1_points,
  CAST(CASE WHEN locator_kind <> 'pdf_region' OR char_start % 41 = 6 THEN NULL ELSE char_start % 4 * 90 END AS BIGINT) AS rotation_degrees,
  CAST(CASE WHEN locator_kind = 'pdf_region' THEN CASE WHEN char_start % 2 = 0 THEN 612 ELSE 792 END END AS DOUBLE) AS display_width_points,
  CAST(CASE WHEN locator_kind = 'pdf_region' THEN CASE WHEN char_start % 2 = 0 THEN 792 ELSE 612 END END AS DOUBLE) AS display_height_points,
  CAST(g.width_pixels AS BIGINT) AS width_pixels, CAST(g.height_pixels AS BIGINT) AS height_pixels, g.orientation_applied,
  CAST(l.asset_id AS BIGINT) AS region_key FROM v_locator l LEFT JOIN v_geometry g ON g.asset_id = l.asset_id AND l.locator_kind = 'image_region'"""
GEOMETRY = ", ".join(f"d.{c}" for c in dq.PDF_GEOMETRY)
# Regions in their order, as whole millionths.
REGION_TEXT = "string_agg(concat_ws(':', CAST(region_order AS VARCHAR), {}), ',' ORDER BY region_order, x, y, width, height)".format(
    ", ".join(f"CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR)" for c in ("x", "y", "width", "height"))
)
# The filled struct as text: whole numbers only, so both engines print it alike.
STRUCT_TEXT = """CASE WHEN e <> '' THEN NULL WHEN d.locator_kind = 'pdf_page' THEN concat('page ', CAST(d.page_number AS VARCHAR))
  WHEN d.locator_kind = 'pdf_region' THEN concat_ws(' ', 'region', CAST(d.page_number AS VARCHAR), d.space, {}, d.regions)
  ELSE concat_ws(' ', 'image', d.space, CAST(d.width_pixels AS VARCHAR), CAST(d.height_pixels AS VARCHAR), d.regions) END""".format(
    ", ".join(f"CAST(CAST(d.{c} AS BIGINT) AS VARCHAR)" for c in dq.PDF_GEOMETRY)
)
TYPED = f"""k AS (SELECT locator_id, count(*) AS n, {REGION_TEXT} AS regions FROM v_rect GROUP BY 1),
    d AS (SELECT d.*, CAST(coalesce(k.n, 0) AS BIGINT) AS n, k.regions, d.locator_kind = 'pdf_region' AND ({" OR ".join(f"d.{c} IS NULL" for c in dq.PDF_GEOMETRY)}) AS bare
      FROM ({LOCATED}) d LEFT JOIN k ON k.locator_id = d.region_key),
    typed AS (SELECT d.*, e, {STRUCT_TEXT} AS evidence FROM (SELECT *, {codes(
      ("locator_kind = 'pdf_page' AND n > 0", "page_has_regions"), ("locator_kind <> 'pdf_page' AND n = 0", "regions_missing"),
      ("locator_kind = 'pdf_region' AND space <> 'pdf_normalized_top_left_v1'", "coordinate_space"),
      ("locator_kind = 'image_region' AND space <> 'image_normalized_top_left_v1'", "coordinate_space"), ("bare", "geometry_missing"),
      ("locator_kind = 'image_region' AND NOT (coalesce(width_pixels, 0) > 0 AND coalesce(height_pixels, 0) > 0)", "geometry_missing"),
      ("locator_kind = 'image_region' AND NOT coalesce(orientation_applied, false)", "not_oriented"))} AS e FROM d) d)"""


def typed(t: Tables) -> DataFrame:
    regions = dq.ordered_regions(t("v_rect"), "locator_id").withColumnRenamed("locator_id", "region_key")
    return dq.typed_locators(t.sql(LOCATED).join(regions, "region_key", "left"))


def evidence_text() -> F.Column:
    """The filled struct as text, read from the struct alone."""
    whole = lambda c: F.col(c).cast("long").cast("string")
    micro = lambda v: F.round(v * 1_000_000).cast("long").cast("string")

    def regions(name: str) -> F.Column:
        parts = F.transform(F.col(f"{name}.regions"), lambda r: F.concat_ws(
            ":", r["region_order"].cast("string"), *[micro(r[c]) for c in ("x", "y", "width", "height")]
        ))
        return F.array_join(parts, ",")

    box = [F.col("region.geometry.crop_box_points")[i].cast("long").cast("string") for i in range(4)]
    rest = [whole(f"region.geometry.{c}") for c in dq.PDF_GEOMETRY[4:]]
    return (
        F.when(F.col("page").isNotNull(), F.concat(F.lit("page "), whole("page.page_number")))
        .when(F.col("region").isNotNull(), F.concat_ws(
            " ", F.lit("region"), whole("region.page_number"), F.col("region.space"), *box, *rest, regions("region")
        ))
        .when(F.col("image").isNotNull(), F.concat_ws(
            " ", F.lit("image"), F.col("image.space"), whole("image.width_pixels"), whole("image.height_pixels"), regions("image")
        ))
    )


@query(
    "prj_evidence_struct",
    f"WITH {TYPED} SELECT locator_id, e AS errors, n AS n_regions, md5(evidence) AS evidence_hash FROM typed",
)
def prj_evidence_struct(t: Tables) -> DataFrame:
    return typed(t).select(
        "locator_id", "errors", F.coalesce(F.size("regions"), F.lit(0)).cast("long").alias("n_regions"), F.md5(evidence_text()).alias("evidence_hash")
    )


@query(
    "top_clone_locators",
    f"""WITH {TYPED} SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS locator_id,
      source_id, locator_kind, CAST(generation AS BIGINT) AS generation, evidence_hash FROM (
      SELECT md5('citation:' || c.citation_id) AS h, l.locator_id AS source_id, l.locator_kind, l.generation, md5(d.evidence) AS evidence_hash FROM v_citation c
      JOIN v_locator l ON l.locator_id = c.locator_id JOIN typed d ON d.locator_id = l.locator_id AND d.e = ''
      JOIN v_representation r ON r.representation_id = l.representation_id AND r.workspace_id = l.workspace_id
        AND r.asset_id = l.asset_id AND r.generation = l.generation
      WHERE l.locator_version = 1 AND CASE WHEN l.locator_kind = 'image_region' THEN r.representation_kind IN ('image_ocr', 'image_caption') ELSE r.representation_kind LIKE 'pdf%' END)""",
)
def top_clone_locators(t: Tables) -> DataFrame:
    """Copies of what citations point to: a sound locator with its details and regions under a new id."""
    broken = dq.locator_snapshots(t("v_locator"), t("v_representation")).select("locator_id")
    details = typed(t).where("errors = ''").select("locator_id", "page", "region", "image")
    sound = t("v_locator").join(broken, "locator_id", "left_anti").select("locator_id", "locator_kind", "generation").join(details, "locator_id")
    copies = dq.cloned_locators(t("v_citation"), sound, rc.stable_uuid("citation", F.col("citation_id")))
    return copies.select(
        "locator_id", "source_id", "locator_kind", F.col("generation").cast("long").alias("generation"),
        F.md5(evidence_text()).alias("evidence_hash"),
    )
