"""Builders of units, representations, embeddings, and migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions import records as rc
from tracelode.operators import corpus as gc
from tracelode.operators import scope
from tracelode.operators import units as ub
from tracelode.plans.join_plans import LINES_CTE, text_lines
from tracelode.plans.registry import query
from tracelode.sources.views import Tables

# Documents as single pages: every third one was read by OCR; the lines that text_lines leaves out
# are table text of layout pages.
KIND = "CASE WHEN doc_id % 3 = 1 THEN 'ocr' ELSE 'layout' END"


def page_parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = t("documents").select(F.col("doc_id").alias("page_id"), F.expr(KIND).alias("source_kind"), "text")
    regions = text_lines(t).withColumnRenamed("doc_id", "page_id").drop("line_no")
    split = t("documents").where("doc_id % 3 <> 1").select(
        F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    order = F.sum(F.length("line") + 1)
    from pyspark.sql import Window

    ends = order.over(Window.partitionBy("page_id").orderBy("line_no")) - 1
    artifacts = (
        split.withColumn("e", ends).withColumn("s", F.col("e") - F.length("line"))
        .where((F.length(F.trim("line")) > 0) & ((F.col("line_no") + F.col("page_id")) % 7 == 3))
        .select("page_id", F.col("line_no").alias("artifact_order"), F.lit("pdf_table").alias("unit_kind"),
                F.trim("line").alias("text"), F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))
    )
    return pages, regions, artifacts


CUT = """cut AS (
 SELECT doc_id, text, length(text) AS n, 0 AS st, CASE WHEN 1200 >= length(text) THEN length(text) ELSE coalesce(nullif(
    CASE WHEN strpos(reverse(substr(text,601,600)),chr(10))>0 THEN 1200-strpos(reverse(substr(text,601,600)),chr(10))
         WHEN strpos(reverse(substr(text,601,600)),' ')>0 THEN 1200-strpos(reverse(substr(text,601,600)),' ') ELSE 0 END,0),1200) END AS e FROM masked WHERE length(text) > 0
 UNION ALL
 SELECT doc_id, text, n, nx, CASE WHEN nx+1200>=n THEN n ELSE coalesce(nullif(
    CASE WHEN strpos(reverse(substr(text,nx+601,600)),chr(10))>0 THEN nx+1200-strpos(reverse(substr(text,nx+601,600)),chr(10))
         WHEN strpos(reverse(substr(text,nx+601,600)),' ')>0 THEN nx+1200-strpos(reverse(substr(text,nx+601,600)),' ') ELSE 0 END,0),nx+1200) END
 FROM (SELECT *, greatest(e-200,st+1) AS nx FROM cut WHERE e < n))"""


@query(
    "bld_pdf_units",
    f"""WITH RECURSIVE {LINES_CTE}, masked AS (SELECT doc_id, string_agg(CASE WHEN doc_id % 3 <> 1 AND length(trim(line)) > 0 AND (line_no + doc_id) % 7 = 3
        THEN regexp_replace(line, '[^\\r]', ' ', 'g') ELSE line END, chr(10) ORDER BY line_no) AS text FROM pieces GROUP BY 1), {CUT},
    ch AS (SELECT doc_id, st, e, regexp_replace(substr(text,st+1,e-st),'^\\s+|\\s+$','','g') AS body, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS o FROM cut
      WHERE length(regexp_replace(substr(text,st+1,e-st),'\\s','','g')) > 0),
    chars AS (SELECT c.doc_id, c.st, unnest(range(c.st, c.e)) AS pos, unnest(string_split(substr(d.text, c.st + 1, c.e - c.st), '')) AS x FROM ch c JOIN documents d ON d.doc_id = c.doc_id WHERE c.doc_id % 3 = 1),
    cov AS (SELECT c.doc_id, c.st, bool_and(r.e IS NOT NULL AND c.pos < r.e) AS covered FROM (SELECT * FROM chars WHERE NOT regexp_matches(x, '\\s')) c
      ASOF LEFT JOIN regions r ON r.doc_id = c.doc_id AND c.pos >= r.s GROUP BY 1, 2)
    SELECT ch.doc_id AS page_id, CASE WHEN coalesce(cov.covered, false) THEN 'pdf_ocr_region' ELSE 'pdf_text_chunk' END AS unit_kind, CAST(o AS BIGINT) AS unit_order, md5(body) AS text_hash,
      CAST(ch.st AS BIGINT) AS char_start, CAST(ch.e AS BIGINT) AS char_end FROM ch LEFT JOIN cov ON cov.doc_id = ch.doc_id AND cov.st = ch.st
    UNION ALL SELECT doc_id, 'pdf_table', CAST(line_no AS BIGINT), md5(trim(line)), NULL, NULL FROM pieces WHERE doc_id % 3 <> 1 AND length(trim(line)) > 0 AND (line_no + doc_id) % 7 = 3""",
)
def bld_pdf_units(t: Tables) -> DataFrame:
    return ub.pdf_units(*page_parts(t)).select(
        "page_id", "unit_kind", F.col("unit_order").cast("long").alias("unit_order"), F.md5("text").alias("text_hash"),
        F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"),
    )


@query(
    "bld_image_units",
    """SELECT CAST(l_orderkey AS BIGINT) AS asset_id, 'image_ocr_region' AS unit_kind, CAST(l_linenumber AS BIGINT) AS unit_order, l_returnflag || ' ' || l_partkey AS text,
      round(abs(l_discount) * 5, 6) AS x, round(0.05 + l_quantity / 125, 6) AS width FROM lineitem
    UNION ALL SELECT o_orderkey, 'image_caption', CAST(0 AS BIGINT), 'Order ' || o_orderpriority, 0.0, 1.0 FROM orders""",
)
def bld_image_units(t: Tables) -> DataFrame:
    regions = t("v_rect").select(
        F.col("locator_id").alias("asset_id"), "region_order",
        F.concat(F.lit(" "), "flag", F.lit(" "), F.col("part_id").cast("string"), F.lit("\n")).alias("text"), "x", "y", "width", "height",
    )
    captions = t("orders").select(F.col("o_orderkey").alias("asset_id"), F.concat(F.lit("Order "), "o_orderpriority").alias("caption"))
    return ub.image_units(regions, captions).select(
        "asset_id", "unit_kind", "unit_order", "text", F.round("x", 6).alias("x"), F.round("width", 6).alias("width")
    )


@query(
    "bld_representations",
    """SELECT DISTINCT doc_id AS asset_id, CAST(1 + doc_id % 2 AS BIGINT) AS generation, k AS representation_kind,
      CASE k WHEN 'pdf_page_layout' THEN 'pdf-layout-v1' WHEN 'pdf_ocr' THEN 'rapidocr-region-v1' ELSE 'pymupdf-table-v1' END AS generator_version
    FROM (SELECT doc_id, 'pdf_page_layout' AS k FROM documents UNION ALL SELECT doc_id, 'pdf_ocr' FROM documents WHERE doc_id % 3 = 1
      UNION ALL SELECT doc_id, 'pdf_table' FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE doc_id % 3 <> 1 AND length(trim(line)) > 0 AND (i + doc_id) % 7 = 3)""",
)
def bld_representations(t: Tables) -> DataFrame:
    pages, _, artifacts = page_parts(t)
    generation = F.lit(1) + F.col("page_id") % 2
    return ub.representations(
        pages.select(F.col("page_id").alias("asset_id"), generation.alias("generation"), "source_kind"),
        artifacts.select(F.col("page_id").alias("asset_id"), generation.alias("generation"), "unit_kind"),
    )


CONFIG = {"embedding_space": "text", "provider": "main", "model": "base", "version": "v1"}


@query(
    "bld_embeddings",
    """WITH u AS (SELECT v.unit_id, v.asset_id, v.current_generation AS g, v.index_version AS i FROM v_visible v),
    p AS (SELECT DISTINCT asset_id, g, i FROM u)
    SELECT e.unit_id, e.provider, CAST(e.generation AS BIGINT) AS generation, e.is_current AND (p.asset_id IS NULL OR (e.generation = p.g AND e.index_version = p.i)) AS is_current, false AS fresh
    FROM v_embedding e LEFT JOIN p ON p.asset_id = e.asset_id WHERE NOT (e.provider = 'main' AND e.unit_id IN (SELECT unit_id FROM u))
    UNION ALL SELECT unit_id, 'main', CAST(g AS BIGINT), true, true FROM u""",
)
def bld_embeddings(t: Tables) -> DataFrame:
    units = t("v_visible").select("unit_id", "workspace_id", "asset_id", F.col("current_generation").alias("generation"), "index_version", "text")
    vectors = ub.embed(units, ub.hashing_embedder(32), 32)
    existing = t("v_embedding").withColumn("embedding", F.col("embedding").cast("array<float>"))
    out = ub.publish_embeddings(existing, units.drop("text"), vectors, CONFIG)
    return out.select(
        "unit_id", "provider", F.col("generation").cast("long").alias("generation"), "is_current", (F.size("embedding") == 32).alias("fresh")
    )


@query(
    "bld_current_backfill",
    """WITH c AS (SELECT u.unit_id, u.workspace_id, l.generation, u.index_version, l.generation = a.current_generation AND u.index_version = a.current_index AS cur
      FROM v_unit u JOIN v_asset a ON a.asset_id = u.asset_id AND a.workspace_id = u.workspace_id
      JOIN v_representation r ON r.representation_id = u.representation_id AND r.workspace_id = u.workspace_id AND r.asset_id = u.asset_id
      JOIN v_locator l ON l.locator_id = u.locator_id AND l.workspace_id = u.workspace_id AND l.asset_id = u.asset_id AND l.representation_id = r.representation_id AND l.generation = r.generation)
    SELECT e.embedding_id, CAST(c.generation AS BIGINT) AS generation, CAST(c.index_version AS BIGINT) AS index_version, coalesce(c.cur, false) AS is_current, c.unit_id IS NULL AS invalid
    FROM v_embedding e LEFT JOIN c ON c.unit_id = e.unit_id AND c.workspace_id = e.workspace_id""",
)
def bld_current_backfill(t: Tables) -> DataFrame:
    chained = scope.chain(t("v_unit"), t("v_asset"), t("v_representation"), t("v_locator"))
    bare = t("v_embedding").select("embedding_id", "unit_id", "workspace_id")
    return ub.current_backfill(bare, chained).select(
        "embedding_id", F.col("generation").cast("long").alias("generation"), F.col("index_version").cast("long").alias("index_version"),
        "is_current", F.col("generation").isNull().alias("invalid"),
    )


OLD_CHUNKS = """SELECT CAST(u.doc_id AS STRING) || ':' || CAST(u.char_start AS STRING) AS chunk_id, CAST(u.doc_id AS STRING) AS document_id,
  CASE WHEN u.char_start % 11 = 3 THEN NULL ELSE CAST(u.doc_id AS STRING) || '/' || CAST(u.unit_order AS STRING) END AS page_id,
  v.embedding, CASE WHEN u.doc_id % 19 = 1 THEN NULL ELSE 64 END AS dimensions, 'main' AS provider, 'v1' AS version
  FROM v_unit_base u LEFT JOIN embeddings v ON v.vec_id = u.doc_id"""
OLD_PAGES = "SELECT CAST(doc_id AS STRING) || '/' || CAST(unit_order AS STRING) AS page_id, unit_order + 1 AS page_number FROM v_unit_base"
OLD_DOCS = "SELECT CAST(doc_id AS STRING) AS document_id, source AS workspace_id, 1 + doc_id % 2 AS generation FROM documents"
OLD_CITES = "SELECT CASE WHEN conv_id % 15 = 2 THEN NULL ELSE conv_id END AS document_id, CASE WHEN turn = 3 THEN NULL ELSE turn END AS page_number FROM conversations WHERE role = 'assistant'"


def uuid_sql(space: str, expr: str) -> str:
    h = f"md5('{space}:' || {expr})"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


@query(
    "bld_legacy_migrate",
    f"""WITH c AS ({OLD_CHUNKS}), p AS ({OLD_PAGES}), d AS ({OLD_DOCS}), q AS ({OLD_CITES})
    SELECT c.chunk_id AS unit_id, d.workspace_id, {uuid_sql('content-unit', 'c.chunk_id')} AS locator_id, CASE WHEN c.embedding IS NOT NULL THEN {uuid_sql('embedding', 'c.chunk_id')} END AS embedding_id,
      CAST(p.page_number AS BIGINT) AS page_number, CAST(d.generation AS BIGINT) AS generation
    FROM c JOIN d ON d.document_id = c.document_id LEFT JOIN p ON p.page_id = c.page_id
    UNION ALL SELECT 'preflight:embedding_configuration', NULL, NULL, NULL, CAST(count(*) AS BIGINT), NULL FROM c WHERE embedding IS NOT NULL AND dimensions IS NULL
    UNION ALL SELECT 'preflight:citation_snapshot', NULL, NULL, NULL, CAST(count(*) AS BIGINT), NULL FROM q WHERE document_id IS NULL OR page_number IS NULL""",
)
def bld_legacy_migrate(t: Tables) -> DataFrame:
    chunks = t.sql(OLD_CHUNKS)
    moved = ub.migrate_chunks(t.sql(OLD_DOCS), chunks, t.sql(OLD_PAGES)).select(
        "unit_id", "workspace_id", "locator_id", "embedding_id", F.col("page_number").cast("long").alias("page_number"),
        F.col("generation").cast("long").alias("generation"),
    )
    gaps = ub.migration_gaps(chunks, t.sql(OLD_CITES)).select(
        F.concat(F.lit("preflight:"), "rule").alias("unit_id"), *[F.lit(None).cast("string").alias(c) for c in ("workspace_id", "locator_id", "embedding_id")],
        F.col("n").alias("page_number"), F.lit(None).cast("long").alias("generation"),
    )
    return moved.unionByName(gaps)


SIG = """sg AS (SELECT * FROM (VALUES (0, 'pdf-text-legacy'), (1, 'pdf-page-layout'), (2, 'pdf-text-ocr'), (3, 'pdf-ocr-region'), (4, 'pdf-table'), (5, 'pdf-figure'), (6, 'image-ocr'), (7, 'image-caption')) v(pos, signature)),
  co AS (SELECT * FROM (VALUES ('visible', 2, 2), ('outside', 2, 2), ('old_generation', 1, 2), ('old_index', 2, 1), ('wrong_provider', 2, 2)) v(cohort, generation, index_version))"""


@query(
    "gen_corpus",
    f"""WITH {SIG}, b AS (SELECT d.doc_id, sg.signature, co.cohort, co.generation, co.index_version, CASE WHEN co.cohort <> 'visible' THEN 'D8' WHEN d.doc_id % 3 = 0 THEN 'D1' WHEN d.doc_id % 3 = 1 THEN 'D8' ELSE 'D64' END AS profile,
      CASE WHEN co.cohort = 'visible' THEN d.doc_id // 3 ELSE d.doc_id END AS po FROM documents d CROSS JOIN sg CROSS JOIN co),
    f AS (SELECT *, CASE profile WHEN 'D1' THEN 1 WHEN 'D8' THEN 8 ELSE 64 END AS dup FROM b)
    SELECT cohort, signature, profile, CAST(count(*) AS BIGINT) AS n_units, CAST(count(DISTINCT po // dup) AS BIGINT) AS n_locations, CAST(sum(po % dup) AS BIGINT) AS order_sum,
      CAST(min(generation) AS BIGINT) AS generation, CAST(min(index_version) AS BIGINT) AS index_version, true AS vectors_ok FROM f GROUP BY 1, 2, 3""",
)
def gen_corpus(t: Tables) -> DataFrame:
    corpus = gc.scaled_corpus(t("documents").select(F.col("doc_id").alias("seed")))
    close = (F.size("embedding") == gc.DIMENSIONS) & (F.element_at("embedding", F.col("position") + 1) == gc.CENTROID_WEIGHT) & (
        F.array_max(F.transform("embedding", lambda v, i: F.when(i == F.col("position"), 0.0).otherwise(F.abs(v)))) <= gc.PERTURBATION
    )
    return corpus.groupBy("cohort", "signature", "profile").agg(
        F.count(F.lit(1)).alias("n_units"), F.count_distinct("locator_order").alias("n_locations"),
        F.sum("unit_order").alias("order_sum"), F.min("generation").cast("long").alias("generation"),
        F.min("index_version").cast("long").alias("index_version"), F.bool_and(close).alias("vectors_ok"),
    )
