"""Lineage, notes, tags, representations, intervals, rectangles, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators import ranges as rg
from tracelode.operators import relations as rel
from tracelode.operators import integrity as dq
from tracelode.plans.registry import query
from tracelode.sources.views import Tables

WANTED = """SELECT citation_id, workspace_id FROM v_citation
  UNION ALL SELECT CONCAT('x', CAST(conv_id AS STRING)) AS citation_id, 'w0' AS workspace_id
  FROM conversations WHERE role = 'user'"""
OWNED = """SELECT message_id, thread_id,
  CASE WHEN thread_id % 30 = 0 THEN 'w9' WHEN thread_id % 6 = 0 THEN 'w1' ELSE 'w0' END AS workspace_id FROM v_message"""
THREADS = """SELECT DISTINCT thread_id, CASE WHEN thread_id % 6 = 0 THEN 'w1' ELSE 'w0' END AS workspace_id FROM v_message"""


@query(
    "join_citation_lineage",
    f"""SELECT w.citation_id, w.workspace_id, m.message_id, m.thread_id, m.message_id IS NOT NULL AS found
    FROM ({WANTED}) w LEFT JOIN (
      SELECT c.citation_id, c.workspace_id, c.message_id, c.thread_id FROM v_citation c
      JOIN ({OWNED}) m ON m.message_id = c.message_id AND m.workspace_id = c.workspace_id AND m.thread_id = c.thread_id
      JOIN ({THREADS}) h ON h.thread_id = m.thread_id AND h.workspace_id = c.workspace_id
    ) m ON m.citation_id = w.citation_id AND m.workspace_id = w.workspace_id""",
)
def join_citation_lineage(t: Tables) -> DataFrame:
    return rel.citation_lineage(t.sql(WANTED), t("v_citation"), t.sql(OWNED), t.sql(THREADS))


@query(
    "join_note_relations",
    """SELECT s.note_id, CAST(row_number() OVER (PARTITION BY s.note_id ORDER BY s.source_order, s.asset_id, s.kind) AS BIGINT) AS position,
      s.asset_id, s.kind, p.p_brand AS brand
    FROM v_note_source s JOIN v_note n ON n.note_id = s.note_id AND NOT n.is_archived
    LEFT JOIN part p ON p.p_partkey = s.asset_id""",
)
def join_note_relations(t: Tables) -> DataFrame:
    parts = t("part").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("brand"))
    return rel.note_sources_in_order(t("v_note"), t("v_note_source"), parts).select(
        "note_id", F.col("position").cast("long").alias("position"), "asset_id", "kind", "brand"
    )


ASSET_TAG = "SELECT p_brand AS tag, p_partkey AS asset_id FROM part"
PART_ASSET = "SELECT p_partkey AS asset_id, p_size % 7 = 0 AS is_deleted FROM part"
TAGS = "SELECT DISTINCT p_brand AS tag FROM part UNION ALL SELECT DISTINCT p_type AS tag FROM part"


@query(
    "join_tag_bindings",
    f"""WITH g AS ({TAGS}), n AS (SELECT x.tag, x.note_id FROM v_note_tag x JOIN v_note n ON n.note_id = x.note_id WHERE NOT n.is_archived),
      a AS (SELECT x.tag, x.asset_id FROM ({ASSET_TAG}) x JOIN ({PART_ASSET}) p ON p.asset_id = x.asset_id WHERE NOT p.is_deleted)
    SELECT g.tag, CAST((SELECT count(*) FROM n WHERE n.tag = g.tag) AS BIGINT) AS n_notes,
      CAST((SELECT count(*) FROM a WHERE a.tag = g.tag) AS BIGINT) AS n_assets,
      (SELECT min(note_id) FROM n WHERE n.tag = g.tag) AS first_note,
      (SELECT max(asset_id) FROM a WHERE a.tag = g.tag) AS last_asset FROM g""",
)
def join_tag_bindings(t: Tables) -> DataFrame:
    return rel.tag_bindings(
        t.sql(TAGS), t("v_note_tag"), t("v_note"), t.sql(ASSET_TAG), t.sql(PART_ASSET)
    ).select("tag", "n_notes", "n_assets", "first_note", "last_asset")


@query(
    "join_preferred_repr",
    """WITH best AS (SELECT asset_id, representation_id FROM (
      SELECT a.asset_id, r.representation_id, row_number() OVER (PARTITION BY a.asset_id
        ORDER BY CASE WHEN r.representation_kind = 'pdf_page_layout' THEN 0 ELSE 1 END, r.representation_id) AS rn
      FROM v_asset a JOIN v_representation r ON r.asset_id = a.asset_id AND r.workspace_id = a.workspace_id
        AND r.generation = a.current_generation
      WHERE a.asset_kind = 'pdf' AND r.representation_kind IN ('pdf_page_layout', 'pdf_text_legacy')) WHERE rn = 1)
    SELECT b.asset_id, b.representation_id, CAST(count(p.page_number) AS BIGINT) AS n_pages
    FROM best b LEFT JOIN v_study_page p ON p.representation_id = b.representation_id GROUP BY 1, 2""",
)
def join_preferred_repr(t: Tables) -> DataFrame:
    best = rel.preferred_representation(t("v_asset"), t("v_representation"))
    pages = t("v_study_page").groupBy("representation_id").agg(F.count("page_number").alias("n_pages"))
    return best.join(pages, "representation_id", "left").fillna(0, ["n_pages"]).select(
        "asset_id", "representation_id", "n_pages"
    )


@query(
    "join_oriented_repr",
    """SELECT a.asset_id, r.representation_id,
      CASE WHEN r.representation_id IS NULL OR r.object_key IS NULL OR r.object_key = '' THEN 'representation_missing'
        WHEN g.asset_id IS NULL THEN 'geometry_missing'
        WHEN g.width_pixels <= 0 OR g.height_pixels <= 0 OR NOT g.orientation_applied THEN 'geometry_invalid' ELSE 'ok' END AS reason
    FROM v_asset a LEFT JOIN v_representation r ON r.asset_id = a.asset_id AND r.representation_kind = 'image_oriented'
      AND r.generation = a.current_generation
    LEFT JOIN v_geometry g ON g.representation_id = r.representation_id WHERE a.asset_kind = 'image'""",
)
def join_oriented_repr(t: Tables) -> DataFrame:
    return rel.oriented_representation(t("v_asset"), t("v_representation"), t("v_geometry")).select(
        "asset_id", "representation_id", "reason"
    )


def text_lines(t: Tables, whole: bool = False) -> DataFrame:
    """Lines of every document with their code-point range; unless `whole`, one in seven is not recognised."""
    split = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    ends = F.sum(F.length("line") + 1).over(order)
    return (
        split.withColumn("region_end", (ends - 1).cast("int"))
        .withColumn("region_start", (F.col("region_end") - F.length("line")).cast("int"))
        .where((F.length("line") > 0) & (F.lit(whole) | ((F.col("line_no") + F.col("doc_id")) % 7 != 3)))
        .select("doc_id", F.col("line_no").cast("long").alias("line_no"), "region_start", "region_end")
    )


LINES_CTE = """pieces AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
    unnest(string_split(text, chr(10))) AS line FROM documents),
  placed AS (SELECT doc_id, line_no, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS e FROM pieces),
  regions AS (SELECT doc_id, line_no, CAST(e - length(line) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed
    WHERE length(line) > 0 AND (line_no + doc_id) % 7 <> 3)"""


@query(
    "join_char_overlap",
    f"""WITH {LINES_CTE.replace(" AND (line_no + doc_id) % 7 <> 3", "")}
    SELECT u.doc_id, CAST(u.char_start AS BIGINT) AS char_start, r.line_no, r.s AS region_start, r.e AS region_end
    FROM v_unit_base u JOIN regions r ON r.doc_id = u.doc_id AND r.s < u.char_end AND r.e > u.char_start""",
)
def join_char_overlap(t: Tables) -> DataFrame:
    chunks = t("v_unit").select("doc_id", "char_start", "char_end")
    pairs = rg.overlap_join(
        chunks, text_lines(t, whole=True), ["doc_id"], ("char_start", "char_end"), ("region_start", "region_end")
    )
    return pairs.select(
        "doc_id", F.col("char_start").cast("long").alias("char_start"), "line_no",
        F.col("region_start").cast("long").alias("region_start"), F.col("region_end").cast("long").alias("region_end"),
    )


@query(
    "join_char_coverage",
    f"""WITH {LINES_CTE}, chars AS (
      SELECT u.doc_id, u.char_start, unnest(range(u.char_start, u.char_end)) AS pos,
        unnest(string_split(substr(d.text, u.char_start + 1, u.char_end - u.char_start), '')) AS c
      FROM v_unit_base u JOIN documents d ON d.doc_id = u.doc_id),
    hits AS (SELECT c.doc_id, c.char_start, r.e IS NOT NULL AND c.pos < r.e AS ok FROM
      (SELECT * FROM chars WHERE NOT regexp_matches(c, '\\s')) c ASOF LEFT JOIN regions r ON r.doc_id = c.doc_id AND c.pos >= r.s)
    SELECT doc_id, CAST(char_start AS BIGINT) AS char_start, bool_and(ok) AS covered FROM hits GROUP BY 1, 2""",
)
def join_char_coverage(t: Tables) -> DataFrame:
    chunks = t("v_unit").select("doc_id", "char_start", "char_end").join(
        t("documents").select("doc_id", "text"), "doc_id"
    ).select(
        "doc_id", "char_start", "char_end",
        F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("span"),
    )
    return rg.char_coverage(chunks, text_lines(t).drop("line_no"), "doc_id", "span").select(
        "doc_id", F.col("char_start").cast("long").alias("char_start"), "covered"
    )


def rects(t: Tables, flag: str) -> DataFrame:
    return t("v_rect").where(F.col("flag") == flag)


@query(
    "join_rect_overlap",
    """SELECT a.locator_id, a.part_id AS selected_part, a.region_order AS selected_order, b.part_id AS unit_part, b.region_order AS unit_order
    FROM v_rect a JOIN v_rect b ON a.locator_id = b.locator_id AND a.flag = 'R' AND b.flag = 'A'
    WHERE least(a.x + a.width, b.x + b.width) > greatest(a.x, b.x)
      AND least(a.y + a.height, b.y + b.height) > greatest(a.y, b.y)""",
)
def join_rect_overlap(t: Tables) -> DataFrame:
    columns = ["part_id", "region_order", "x", "y", "width", "height"]
    pairs = rg.rect_overlap_join(
        rg.prefixed(rects(t, "R").drop("flag"), "l_", columns),
        rg.prefixed(rects(t, "A").drop("flag"), "r_", columns),
        ["locator_id"],
    )
    return pairs.select(
        "locator_id", F.col("l_part_id").alias("selected_part"), F.col("l_region_order").alias("selected_order"),
        F.col("r_part_id").alias("unit_part"), F.col("r_region_order").alias("unit_order"),
    )


REGION_ID = "region_order * 100000000 + part_id"


@query(
    "join_region_excerpt",
    f"""WITH sel AS (SELECT *, {REGION_ID} AS region_id FROM v_rect WHERE flag = 'R'),
    un AS (SELECT *, {REGION_ID} AS unit_id, 'part ' || part_id AS unit_text FROM v_rect WHERE flag = 'A'),
    pairs AS (SELECT s.locator_id, s.region_id, u.unit_id, u.region_order AS unit_order, u.unit_text FROM sel s JOIN un u ON s.locator_id = u.locator_id
      WHERE least(s.x + s.width, u.x + u.width) > greatest(s.x, u.x) AND least(s.y + s.height, u.y + u.height) > greatest(s.y, u.y)),
    firsts AS (SELECT locator_id, unit_id, unit_order, unit_text, min(region_id) AS rid FROM pairs GROUP BY ALL),
    j AS (SELECT locator_id, string_agg(unit_text, chr(10) ORDER BY rid, unit_order, unit_id) AS joined FROM firsts GROUP BY 1),
    w AS (SELECT locator_id, count(DISTINCT region_id) AS n FROM sel GROUP BY 1),
    h AS (SELECT locator_id, count(DISTINCT region_id) AS n FROM pairs GROUP BY 1)
    SELECT w.locator_id, coalesce(h.n = w.n, false) AS from_units,
      substr(CASE WHEN coalesce(h.n = w.n, false) THEN j.joined ELSE 'Order ' || w.locator_id END, 1, 4000) AS excerpt
    FROM w LEFT JOIN h ON h.locator_id = w.locator_id LEFT JOIN j ON j.locator_id = w.locator_id""",
)
def join_region_excerpt(t: Tables) -> DataFrame:
    region_id = F.expr(REGION_ID)
    selected = rects(t, "R").withColumn("region_id", region_id)
    units = rects(t, "A").select(
        "locator_id", F.col("region_order").alias("unit_order"), region_id.alias("unit_id"),
        F.concat(F.lit("part "), F.col("part_id").cast("string")).alias("unit_text"), "x", "y", "width", "height",
    )
    captions = t("orders").select(
        F.col("o_orderkey").alias("locator_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("caption"),
    ).dropDuplicates(["locator_id"])
    return rg.region_excerpt(selected, units, captions, "locator_id")


TARGETS = """SELECT doc_id AS target_id, CASE WHEN doc_id % 21 = 4 THEN 'nowhere' ELSE source END AS workspace_id,
  CAST(doc_id AS STRING) AS asset_id, CAST(CASE WHEN doc_id % 20 = 4 THEN 9 ELSE 1 + doc_id % 2 END AS INT) AS generation
  FROM documents"""


@query(
    "join_region_target_checks",
    f"""WITH cap AS (SELECT u.asset_id, r.generation, u.workspace_id,
        count(*) FILTER (WHERE r.representation_kind = 'image_caption') AS n_caption,
        count(DISTINCT CASE WHEN r.representation_kind = 'image_ocr' THEN r.representation_id END) AS n_ocr
      FROM v_unit u JOIN v_representation r ON r.representation_id = u.representation_id
      JOIN v_asset a ON a.asset_id = u.asset_id AND u.index_version = a.current_index
      WHERE r.representation_kind IN ('image_ocr', 'image_caption') GROUP BY 1, 2, 3)
    SELECT x.target_id, CASE
      WHEN a.asset_id IS NULL THEN 'asset_unavailable' WHEN a.current_generation <> x.generation THEN 'generation_changed'
      WHEN r.representation_id IS NULL OR g.representation_id IS NULL THEN 'display_missing'
      WHEN g.width_pixels < 1 OR g.height_pixels < 1 OR NOT g.orientation_applied OR coalesce(r.object_key, '') = ''
        OR r.content_hash IS NULL THEN 'geometry_invalid'
      WHEN coalesce(c.n_caption, 0) <> 1 THEN 'content_invalid' WHEN c.n_ocr > 1 THEN 'representation_ambiguous'
      ELSE 'ok' END AS outcome
    FROM ({TARGETS}) x
    LEFT JOIN v_asset a ON a.asset_id = x.asset_id AND a.workspace_id = x.workspace_id AND a.asset_kind = 'image'
      AND a.status = 'ready' AND NOT a.is_deleted
    LEFT JOIN v_representation r ON r.asset_id = x.asset_id AND r.workspace_id = x.workspace_id
      AND r.representation_kind = 'image_oriented' AND r.generation = x.generation
    LEFT JOIN v_geometry g ON g.representation_id = r.representation_id AND g.workspace_id = x.workspace_id
    LEFT JOIN cap c ON c.asset_id = x.asset_id AND c.generation = x.generation AND c.workspace_id = x.workspace_id""",
)
def join_region_target_checks(t: Tables) -> DataFrame:
    return dq.region_targets(
        t.sql(TARGETS), t("v_asset"), t("v_representation"), t("v_geometry"), t("v_unit")
    ).select("target_id", "outcome")


LABELLED = """SELECT doc_id, source AS workspace_id, CONCAT('doc-', CAST(doc_id AS STRING),
  CASE WHEN doc_id % 14 = 3 THEN '.txt' ELSE '.pdf' END) AS source_filename FROM documents"""


@query(
    "join_case_assets",
    f"""SELECT l.doc_id, CAST(count(a.asset_id) AS BIGINT) AS n_assets,
      CASE WHEN count(a.asset_id) = 1 THEN min(a.asset_id) END AS resolved
    FROM ({LABELLED}) l LEFT JOIN v_asset a ON a.workspace_id = l.workspace_id AND a.source_filename = l.source_filename
      AND a.asset_kind = 'pdf' AND a.status = 'ready' AND NOT a.is_deleted GROUP BY 1""",
)
def join_case_assets(t: Tables) -> DataFrame:
    return rel.case_assets(t.sql(LABELLED), t("v_asset")).select("doc_id", "n_assets", "resolved")


# The ratio an execution report claims: none for some targets, all or nothing for the others.
REPORTED = """SELECT locator_id, CAST(CASE WHEN locator_id % 3 = 0 THEN 0.0 WHEN locator_id % 3 = 1 THEN 1.0000004 ELSE 1.0 END AS DOUBLE) AS reported
  FROM (SELECT DISTINCT locator_id FROM v_rect WHERE flag = 'R' AND locator_id % 7 <> 2) x"""


@query(
    "join_coverage_ratio",
    f"""WITH a AS (SELECT *, {REGION_ID} AS rid FROM v_rect WHERE flag = 'R'), b AS (SELECT * FROM v_rect WHERE flag = 'A'),
    best AS (SELECT a.locator_id, a.rid, max(CASE WHEN b.locator_id IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x))
      * greatest(0.0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) / (a.width * a.height)) END) AS ratio
      FROM a LEFT JOIN b ON a.locator_id = b.locator_id GROUP BY 1, 2)
    SELECT b.locator_id, round(min(ratio), 6) AS min_ratio, min(ratio) >= 0.08 AS passed, any_value(r.reported) AS reported,
      coalesce(abs(min(ratio) - any_value(r.reported)) <= 1e-6, false) AS agrees
    FROM best b LEFT JOIN ({REPORTED}) r ON r.locator_id = b.locator_id GROUP BY 1""",
)
def join_coverage_ratio(t: Tables) -> DataFrame:
    approved = rects(t, "R").withColumn("region_id", F.expr(REGION_ID))
    ratios = rg.coverage_ratio(approved, rects(t, "A"), "locator_id", "region_id")
    return rg.against_reported(ratios, t.sql(REPORTED), "locator_id").select(
        "locator_id", F.round("min_ratio", 6).alias("min_ratio"), (F.col("min_ratio") >= 0.08).alias("passed"), "reported", "agrees"
    )


KNOWN_P = "SELECT participant_id FROM v_participant WHERE participant_id % 50 <> 7"
KNOWN_T = """SELECT task_id, CASE WHEN task_id = 4 THEN 'table' ELSE task_type END AS task_type
  FROM v_study_task WHERE task_id <> 13"""


@query(
    "join_manifest_refs",
    f"""SELECT r.line_no, CASE WHEN p.participant_id IS NULL THEN 'unknown_participant'
      WHEN k.task_id IS NULL THEN 'unknown_task' ELSE 'task_type_mismatch' END AS problem
    FROM v_task_result r LEFT JOIN ({KNOWN_P}) p ON p.participant_id = r.participant_id
    LEFT JOIN ({KNOWN_T}) k ON k.task_id = r.task_id
    WHERE p.participant_id IS NULL OR k.task_id IS NULL OR k.task_type <> r.task_type""",
)
def join_manifest_refs(t: Tables) -> DataFrame:
    return rel.manifest_references(t("v_task_result"), t.sql(KNOWN_P), t.sql(KNOWN_T)).select("line_no", "problem")


@query(
    "join_scalar_lookup",
    """SELECT c.citation_id, CAST(coalesce((SELECT a.current_index FROM v_asset a
      WHERE a.asset_id = c.asset_id AND a.asset_kind = 'pdf'), 0) AS BIGINT) AS index_version FROM v_citation c""",
)
def join_scalar_lookup(t: Tables) -> DataFrame:
    return t.sql(
        """SELECT c.citation_id, CAST(coalesce((SELECT max(a.current_index) FROM v_asset a
        WHERE a.asset_id = c.asset_id AND a.asset_kind = 'pdf'), 0) AS BIGINT) AS index_version FROM v_citation c"""
    )


AFTER = """SELECT asset_id, CASE WHEN CAST(asset_id AS BIGINT) % 10 = 1 THEN 'deleting' ELSE status END AS status,
  CASE WHEN CAST(asset_id AS BIGINT) % 15 = 1 THEN CONCAT(title, '!') ELSE title END AS title,
  current_generation FROM v_asset WHERE CAST(asset_id AS BIGINT) % 50 <> 8
  UNION ALL SELECT CONCAT('new', asset_id) AS asset_id, status, title, current_generation FROM v_asset WHERE is_deleted"""


@query(
    "join_snapshot_diff",
    f"""WITH b AS ({AFTER}), j AS (SELECT coalesce(a.asset_id, b.asset_id) AS asset_id,
      CASE WHEN a.asset_id IS NULL THEN 'added' WHEN b.asset_id IS NULL THEN 'removed' ELSE 'changed' END AS status,
      concat_ws(',', CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END,
        CASE WHEN a.title IS DISTINCT FROM b.title THEN 'title' END,
        CASE WHEN a.current_generation IS DISTINCT FROM b.current_generation THEN 'current_generation' END) AS fields
      FROM v_asset a FULL OUTER JOIN b ON a.asset_id = b.asset_id)
    SELECT * FROM j WHERE status <> 'changed' OR fields <> ''""",
)
def join_snapshot_diff(t: Tables) -> DataFrame:
    return rel.snapshot_diff(t("v_asset"), t.sql(AFTER), "asset_id", ["status", "title", "current_generation"])


EXPECTED = """SELECT object_key, NOT is_deleted AS expected_exists, md5(title) AS hash, byte_size AS size FROM v_asset"""
LISTED = """SELECT CASE WHEN created_seq % 33 = 2 THEN CONCAT(object_key, '.tmp') ELSE object_key END AS object_key,
  CASE WHEN created_seq % 21 = 5 THEN 'x' ELSE md5(title) END AS hash, byte_size AS size FROM v_asset
  WHERE NOT is_deleted OR created_seq % 26 = 0"""


@query(
    "join_object_closure",
    f"""SELECT coalesce(e.object_key, l.object_key) AS object_key, CASE WHEN e.object_key IS NULL THEN 'unexpected_object'
      WHEN e.expected_exists AND l.object_key IS NULL THEN 'missing_object'
      WHEN NOT e.expected_exists AND l.object_key IS NOT NULL THEN 'deleted_object_present' ELSE 'content_mismatch' END AS problem
    FROM ({EXPECTED}) e FULL OUTER JOIN ({LISTED}) l ON e.object_key = l.object_key
    WHERE e.object_key IS NULL OR (e.expected_exists AND l.object_key IS NULL)
      OR (l.object_key IS NOT NULL AND (NOT e.expected_exists OR e.hash <> l.hash OR e.size <> l.size))""",
)
def join_object_closure(t: Tables) -> DataFrame:
    return rel.object_closure(t.sql(EXPECTED), t.sql(LISTED)).select("object_key", "problem")
