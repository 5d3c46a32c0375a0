"""Scalar, text, JSON and geometry functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions import geometry as geo
from tracelode.functions import records as rc
from tracelode.functions import tables as tf
from tracelode.functions import text as tx
from tracelode.operators import fusion
from tracelode.operators import ranges as rg
from tracelode.operators import units as ub
from tracelode.plans.integrity_plans import codes
from tracelode.plans.join_plans import LINES_CTE, rects, text_lines
from tracelode.plans.lexical_plans import evidence
from tracelode.plans.registry import query
from tracelode.sources.views import Tables

BLANK = "\\s"


@query(
    "fn_chunk",
    """SELECT doc_id, CAST(unit_order AS BIGINT) AS unit_order, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, md5(text) AS text_hash
    FROM v_unit_base""",
)
def fn_chunk(t: Tables) -> DataFrame:
    return t("v_unit_base").select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("unit_order", "char_start", "char_end")], F.md5("text").alias("text_hash")
    )


@query(
    "fn_chunk_table",
    """SELECT doc_id, source, CAST(unit_order AS BIGINT) AS unit_order, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, md5(text) AS text_hash
    FROM v_unit_base""",
)
def fn_chunk_table(t: Tables) -> DataFrame:
    """The chunker as a table function over the documents."""
    tf.register(t.spark)
    return t.spark.sql(
        """SELECT doc_id, source, CAST(unit_order AS BIGINT) AS unit_order, CAST(char_start AS BIGINT) AS char_start,
          CAST(char_end AS BIGINT) AS char_end, md5(text) AS text_hash
        FROM chunk_text(TABLE(SELECT doc_id, source, text FROM {documents}) PARTITION BY doc_id ORDER BY source)""",
        documents=t("documents"),
    )


@query(
    "fn_token_estimate",
    """SELECT doc_id, CAST(greatest(1, len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}]|[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]'))) AS BIGINT) AS n_tokens FROM documents""",
)
def fn_token_estimate(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", tx.token_estimate(F.col("text")).cast("long").alias("n_tokens"))


@query(
    "fn_tokenize_bm25",
    "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)), ' ') AS tokens FROM documents",
)
def fn_tokenize_bm25(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.array_join(tx.bm25_tokens(F.col("text")), " ").alias("tokens"))


@query(
    "fn_lexical_distance",
    "SELECT event_id, round(1 - least(1, greatest(0, value / 20 - 0.5)), 6) AS distance FROM events",
)
def fn_lexical_distance(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.round(fusion.lexical_distance(F.col("value") / 20 - 0.5), 6).alias("distance"))


@query(
    "fn_mask_ranges",
    f"""WITH {LINES_CTE} SELECT p.doc_id, md5(string_agg(CASE WHEN r.line_no IS NULL THEN p.line ELSE regexp_replace(p.line, '[^\\r]', ' ', 'g') END, chr(10) ORDER BY p.line_no)) AS masked_hash
    FROM pieces p LEFT JOIN regions r ON r.doc_id = p.doc_id AND r.line_no = p.line_no GROUP BY 1""",
)
def fn_mask_ranges(t: Tables) -> DataFrame:
    # The ranges of one document are bounded by its text, which is one row.
    ranges = text_lines(t).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("region_start").alias("s"), F.col("region_end").alias("e")))).alias("ranges")
    )
    masked = t("documents").join(ranges, "doc_id", "left").select(
        "doc_id", F.coalesce(rc.mask_ranges(F.col("text"), F.col("ranges")), F.col("text")).alias("masked")
    )
    return masked.select("doc_id", F.md5("masked").alias("masked_hash"))


@query(
    "fn_merge_ranges",
    f"""WITH {LINES_CTE}, x AS (SELECT r.*, lag(r.e) OVER (PARTITION BY r.doc_id ORDER BY r.s) AS pe, d.text FROM regions r JOIN documents d ON d.doc_id = r.doc_id),
    y AS (SELECT *, sum(CASE WHEN pe IS NOT NULL AND regexp_full_match(substr(text, pe + 1, s - pe), '\\s+') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM x)
    SELECT doc_id, min(s) AS range_start, max(e) AS range_end, CAST(count(*) AS BIGINT) AS n_ranges FROM y GROUP BY doc_id, g""",
)
def fn_merge_ranges(t: Tables) -> DataFrame:
    lines = text_lines(t).select("doc_id", F.col("region_start").alias("s"), F.col("region_end").alias("e"))
    merged = ub.merge_ranges(lines, t("documents").select("doc_id", "text"), "doc_id")
    return merged.select("doc_id", F.col("s").cast("long").alias("range_start"), F.col("e").cast("long").alias("range_end"), "n_ranges")


SPAN_A = "SELECT l_orderkey AS k, l_partkey AS s, l_partkey + CAST(l_quantity * 12 AS BIGINT) AS e FROM lineitem WHERE l_returnflag = 'R'"
SPAN_B = "SELECT l_orderkey AS k, l_suppkey * 20 AS s2, l_suppkey * 20 + CAST(l_quantity * 10 AS BIGINT) AS e2 FROM lineitem WHERE l_returnflag = 'A'"


@query(
    "fn_ranges_overlap",
    f"""WITH a AS ({SPAN_A}), b AS ({SPAN_B}) SELECT DISTINCT a.k, EXISTS (SELECT 1 FROM a x JOIN b ON b.k = x.k AND x.s < b.e2 AND x.e > b.s2 WHERE x.k = a.k) AS overlaps FROM a""",
)
def fn_ranges_overlap(t: Tables) -> DataFrame:
    left = t.sql(SPAN_A)
    hits = rg.overlap_join(left, t.sql(SPAN_B), ["k"], ("s", "e"), ("s2", "e2"), 512).select("k").distinct()
    return left.select("k").distinct().join(hits.withColumn("_h", F.lit(True)), "k", "left").select(
        "k", F.col("_h").isNotNull().alias("overlaps")
    )


TRIMMED = "[[trim(c) for c in string_split(l, ', ')] for l in string_split(text, chr(10))]"


@query(
    "fn_table_markdown",
    f"""WITH m AS (SELECT doc_id, [r for r in {TRIMMED} if len([c for c in r if c <> '']) > 0] AS rows FROM documents),
    w AS (SELECT *, list_max([len(r) for r in rows]) AS width FROM m),
    p AS (SELECT doc_id, rows, width, ['| ' || array_to_string(list_concat(r, list_resize(CAST([] AS VARCHAR[]), width - len(r), '')), ' | ') || ' |' for r in rows] AS lines FROM w)
    SELECT doc_id, md5(lines[1] || chr(10) || '| ' || array_to_string(list_resize(CAST([] AS VARCHAR[]), width, '---'), ' | ') || ' |' || chr(10) || array_to_string(lines[2:], chr(10))) AS markdown_hash
    FROM p WHERE len(rows) >= 2 AND len([r for r in rows if len([c for c in r if c <> '']) >= 2]) >= 2""",
)
def fn_table_markdown(t: Tables) -> DataFrame:
    cells = F.transform(F.split("text", "\n"), lambda l: F.split(l, ", "))
    return t("documents").select("doc_id", rc.table_markdown(cells).alias("m")).where("m IS NOT NULL").select(
        "doc_id", F.md5("m").alias("markdown_hash")
    )


POLYGON = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * 14 - 50 AS xa, l_quantity * 14 - 50 + l_partkey % 40 AS xb, l_extendedprice / 60 - 100 AS ya,
  l_extendedprice / 60 - 100 + l_suppkey % 30 AS yb, CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE 600 END AS INT) AS w, CAST(800 AS INT) AS h FROM lineitem"""


@query(
    "fn_bbox_normalize",
    f"""WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, w, h, greatest(0.0, least(1.0, xa / nullif(w, 0))) AS x0, greatest(0.0, least(1.0, xb / nullif(w, 0))) AS x1,
      greatest(0.0, least(1.0, ya / h)) AS y0, greatest(0.0, least(1.0, yb / h)) AS y1 FROM ({POLYGON}))
    SELECT l_orderkey, l_partkey, l_suppkey, round(x0, 9) AS x0, round(y0, 9) AS y0, round(x1, 9) AS x1, round(y1, 9) AS y1 FROM b WHERE w > 0 AND x1 > x0 AND y1 > y0""",
)
def fn_bbox_normalize(t: Tables) -> DataFrame:
    xs, ys = F.array("xa", "xb", "xb", "xa"), F.array("ya", "ya", "yb", "yb")
    boxed = t.sql(POLYGON).where("w > 0").withColumn("b", geo.normal_box(xs, ys, F.col("w"), F.col("h"))).where("b IS NOT NULL")
    return boxed.select(
        "l_orderkey", "l_partkey", "l_suppkey", *[F.round(f"b.{c}", 9).alias(c) for c in ("x0", "y0", "x1", "y1")]
    )


@query(
    "fn_lines_offsets",
    """WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
    k AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM p WHERE line <> '')
    SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, CAST(upto - 1 - length(line) AS BIGINT) AS char_start, CAST(upto - 1 AS BIGINT) AS char_end FROM k""",
)
def fn_lines_offsets(t: Tables) -> DataFrame:
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return ub.line_offsets(lines, "doc_id").select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("char_start").cast("long").alias("char_start"),
        F.col("char_end").cast("long").alias("char_end"),
    )


@query(
    "fn_rect_math",
    """SELECT a.locator_id, a.part_id AS left_part, b.part_id AS right_part,
      round((least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) / least(a.width, b.width), 6) AS horizontal,
      round((least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) / least(a.width * a.height, b.width * b.height), 6) AS area
    FROM v_rect a JOIN v_rect b ON a.locator_id = b.locator_id AND a.flag = 'R' AND b.flag = 'N'
    WHERE least(a.x + a.width, b.x + b.width) > greatest(a.x, b.x) AND least(a.y + a.height, b.y + b.height) > greatest(a.y, b.y)""",
)
def fn_rect_math(t: Tables) -> DataFrame:
    columns = ["part_id", "region_order", "x", "y", "width", "height"]
    pairs = rg.rect_overlap_join(
        rg.prefixed(rects(t, "R").drop("flag"), "l_", columns), rg.prefixed(rects(t, "N").drop("flag"), "r_", columns), ["locator_id"]
    )
    smaller = F.least(F.col("l_width") * F.col("l_height"), F.col("r_width") * F.col("r_height"))
    return pairs.select(
        "locator_id", F.col("l_part_id").alias("left_part"), F.col("r_part_id").alias("right_part"),
        F.round(geo.horizontal_ratio(F.col("l_x"), F.col("l_width"), F.col("r_x"), F.col("r_width")), 6).alias("horizontal"),
        F.round(rg.intersection_area() / smaller, 6).alias("area"),
    )


EXACT = "CAST(CAST({c} AS VARCHAR) AS DECIMAL(27,18))"


@query(
    "fn_pixel_bounds",
    f"""SELECT locator_id, part_id, region_order, CAST(floor({EXACT.format(c="x")} * CAST(1187 AS DECIMAL(9,0))) AS BIGINT) AS x0,
      CAST(ceil(({EXACT.format(c="x")} + {EXACT.format(c="width")}) * CAST(1187 AS DECIMAL(9,0))) AS BIGINT) AS x1 FROM v_rect""",
)
def fn_pixel_bounds(t: Tables) -> DataFrame:
    size = F.lit(1187)
    return t("v_rect").select(
        "locator_id", "part_id", "region_order", geo.pixel_floor(F.col("x"), size).alias("x0"),
        geo.pixel_ceil(F.col("x"), F.col("width"), size).alias("x1"),
    )


PAGES = """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber - CASE WHEN l_partkey % 31 = 0 THEN 7 ELSE 0 END AS INT) AS page,
  CAST((l_linenumber % 5) * 90 + CASE WHEN l_partkey % 29 = 0 THEN 45 ELSE 0 END AS INT) AS rotation, 612.0D0 AS mw, 792.0D0 AS mh,
  l_quantity * 2 AS cx, l_quantity AS cy, CASE WHEN l_partkey % 23 = 0 THEN 640.0D0 ELSE 500.0D0 END AS cx1, CASE WHEN l_partkey % 19 = 0 THEN 0.5D0 ELSE 700.0D0 END AS cy1,
  CASE WHEN l_partkey % 17 = 0 THEN 0.02D0 ELSE 0.0D0 END AS off FROM lineitem"""
PAGES = PAGES.replace("D0", "")
WANT_W = "CASE WHEN rotation IN (90, 270) THEN cy1 - cy ELSE cx1 - cx END"
WANT_H = "CASE WHEN rotation IN (90, 270) THEN cx1 - cx ELSE cy1 - cy END"


@query(
    "fn_geometry_rules",
    f"""SELECT errors, CAST(count(*) AS BIGINT) AS n_pages FROM (SELECT {codes(("page < 1", "page_number"), ("rotation NOT IN (0, 90, 180, 270)", "rotation"), ("mw <= 0 OR mh <= 0", "media_box"),
      ("cx1 <= cx OR cy1 <= cy", "crop_box"), ("NOT (0 <= cx AND cx1 <= mw AND 0 <= cy AND cy1 <= mh)", "crop_outside"),
      (f"{WANT_W} + off <= 0 OR {WANT_H} <= 0", "display"), ("abs(off) > 0.01", "display_width"))} AS errors FROM ({PAGES})) GROUP BY 1""",
)
def fn_geometry_rules(t: Tables) -> DataFrame:
    pages = t.sql(PAGES)

    def box(x0, y0, x1, y1) -> F.Column:
        return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))

    zero = F.lit(0.0)
    errors = geo.page_errors(
        box(zero, zero, F.col("mw"), F.col("mh")), box(F.col("cx"), F.col("cy"), F.col("cx1"), F.col("cy1")),
        F.col("rotation"), F.expr(f"{WANT_W} + off"), F.expr(WANT_H), F.col("page"),
    )
    return pages.select(errors.alias("errors")).groupBy("errors").agg(F.count(F.lit(1)).alias("n_pages"))


@query(
    "fn_rotate_crop",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, CAST(cx AS DOUBLE) AS x0, round(CAST(mh - cy1 AS DOUBLE), 6) AS y0, CAST(cx1 AS DOUBLE) AS x1, round(CAST(mh - cy AS DOUBLE), 6) AS y1 FROM ({PAGES})""",
)
def fn_rotate_crop(t: Tables) -> DataFrame:
    crop = F.struct(*[F.col(c).cast("double").alias(n) for c, n in (("cx", "x0"), ("cy", "y0"), ("cx1", "x1"), ("cy1", "y1"))])
    turned = t.sql(PAGES).withColumn("b", geo.rotated_crop(crop, F.col("mh").cast("double")))
    return turned.select(
        "l_orderkey", "l_partkey", "l_suppkey", "b.x0", F.round("b.y0", 6).alias("y0"), "b.x1", F.round("b.y1", 6).alias("y1")
    )


NORMAL = "trim(regexp_replace(replace(lower({c}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g'))"


@query("fn_norm_answer", f"SELECT doc_id, md5({NORMAL.format(c='text')}) AS normal_hash FROM documents")
def fn_norm_answer(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.md5(tx.normal_answer(F.col("text"))).alias("normal_hash"))


ACCEPTED = "SELECT CONCAT('g', CAST(doc_id AS STRING)) AS case_id, CONCAT(UPPER(lang), ': ', source, ' [1].') AS accepted, CASE WHEN doc_id % 9 = 2 THEN 'refuse' ELSE 'answer' END AS disposition FROM documents"


@query(
    "fn_answer_oracle",
    f"""SELECT m.case_id, {NORMAL.format(c="m.output")} = {NORMAL.format(c="regexp_replace(a.accepted, '\\[\\d+\\]', ' ', 'g')")} AS passed,
      {NORMAL.format(c="m.output")} = {NORMAL.format(c="regexp_replace(a.accepted, '\\[\\d+\\]', ' ', 'g')")} AND a.disposition = 'refuse' AS refusal_matched
    FROM v_model_answer m JOIN ({ACCEPTED}) a ON a.case_id = m.case_id""",
)
def fn_answer_oracle(t: Tables) -> DataFrame:
    accepted = t.sql(ACCEPTED).withColumn("accepted", tx.normal_output(F.col("accepted")))
    said = t("v_model_answer").withColumn("output", tx.normal_output(F.col("output")))
    hits = said.join(accepted, "case_id").groupBy("case_id").agg(
        F.bool_or(F.col("output") == F.col("accepted")).alias("passed"), F.first("disposition").alias("disposition")
    )
    return hits.select("case_id", "passed", (F.col("passed") & (F.col("disposition") == "refuse")).alias("refusal_matched"))


@query(
    "fn_parse_prompt_evidence",
    """SELECT h.query_id, CAST(h.rank AS BIGINT) AS position, v.title, v.locator_kind AS kind, md5(v.text) AS excerpt_hash, true AS valid
    FROM v_hybrid h JOIN v_visible v ON v.unit_id = h.unit_id""",
)
def fn_parse_prompt_evidence(t: Tables) -> DataFrame:
    contexts = fusion.context(evidence(t))
    return rc.prompt_evidence(contexts, "query_id", "context").select(
        "query_id", F.col("position").cast("long").alias("position"), "title", "kind", F.md5("excerpt").alias("excerpt_hash"), "valid"
    )


CONCEPTS = [["the", "der", "le"], ["tion", "ment", "heit"]]


@query(
    "fn_prompt_contract",
    f"""WITH p AS (SELECT h.query_id, string_agg(v.text, chr(10) ORDER BY h.rank) AS ctx, bool_and(CAST(substr(v.title, 5) AS BIGINT) % 3 <> 1) AS in_scope,
      bool_or(v.locator_kind = 'pdf_page') AS has_target FROM v_hybrid h JOIN v_visible v ON v.unit_id = h.unit_id GROUP BY 1),
    n AS (SELECT *, ' ' || {NORMAL.format(c="ctx")} || ' ' AS body FROM p)
    SELECT query_id, in_scope, has_target, (contains(body, ' the ') OR contains(body, ' der ') OR contains(body, ' le '))
      AND (contains(body, ' tion ') OR contains(body, ' ment ') OR contains(body, ' heit ')) AS concepts, contains(body, ' und ') AS forbidden FROM n""",
)
def fn_prompt_contract(t: Tables) -> DataFrame:
    rows = evidence(t).withColumn("allowed", F.expr("CAST(substring(title, 5) AS BIGINT) % 3 <> 1"))
    joined = rows.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]), "\n").alias("ctx"),
        F.bool_and("allowed").alias("in_scope"), F.bool_or(F.col("locator_kind") == "pdf_page").alias("has_target"),
    ).withColumn("body", tx.normal_answer(F.col("ctx")))
    concepts = F.lit(True)
    for alternatives in CONCEPTS:
        any_of = F.lit(False)
        for a in alternatives:
            any_of = any_of | tx.has_phrase(F.col("body"), F.lit(a))
        concepts = concepts & any_of
    return joined.select(
        "query_id", "in_scope", "has_target", concepts.alias("concepts"), F.rlike("body", F.lit("\\bund\\b")).alias("forbidden")
    )


@query(
    "fn_canonical_json_hash",
    """SELECT message_id, sha256('[' || CAST(to_json({content: content, role: role}) AS VARCHAR) || ']') AS hash FROM v_message""",
)
def fn_canonical_json_hash(t: Tables) -> DataFrame:
    return t("v_message").select(
        "message_id", rc.canonical_json_sha(("role", F.col("role")), ("content", F.col("content"))).alias("hash")
    )


@query(
    "fn_slug",
    """SELECT page_id, CASE WHEN s <> '' THEN s ELSE 'tag-' || page_id END AS slug FROM (SELECT page_id,
      regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))), '\\s+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)""",
)
def fn_slug(t: Tables) -> DataFrame:
    title = F.regexp_replace("html", "<[^>]*>", " ")
    return t("pages").select("page_id", tx.slug(title, F.concat(F.lit("tag-"), F.col("page_id").cast("string"))).alias("slug"))


@query(
    "fn_det_uuid",
    """SELECT locator_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid
    FROM (SELECT locator_id, md5('content-unit:' || locator_id) AS h FROM v_locator)""",
)
def fn_det_uuid(t: Tables) -> DataFrame:
    return t("v_locator").select("locator_id", rc.stable_uuid("content-unit", F.col("locator_id")).alias("uuid"))


@query(
    "fn_iso_ts",
    """WITH x AS (SELECT event_id, ts, ts + to_microseconds(CAST(round((value - 5) * 1000000) AS BIGINT)) AS done, event_id % 9 <> 4 AS zoned FROM events)
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS iso,
      CASE WHEN NOT zoned THEN 'offset_required' WHEN done <= ts THEN 'not_after_start' ELSE 'ok' END AS outcome,
      CASE WHEN zoned AND done > ts THEN round((epoch_us(done) - epoch_us(ts)) / 1e6, 6) END AS seconds FROM x""",
)
def fn_iso_ts(t: Tables) -> DataFrame:
    done = F.expr("timestampadd(MICROSECOND, CAST(round((value - 5) * 1000000) AS BIGINT), CAST(ts AS TIMESTAMP))")
    zone = F.when(F.col("event_id") % 9 != 4, rc.iso_utc(done)).otherwise(F.regexp_replace(rc.iso_utc(done), "\\+00:00$", ""))
    rows = t("events").select("event_id", rc.iso_utc(F.col("ts").cast("timestamp")).alias("iso"), zone.alias("done"))
    return rc.parse_times(rows, "iso", "done").select("event_id", "iso", "outcome", F.round("seconds", 6).alias("seconds"))


@query(
    "fn_ratio_round",
    "SELECT ps AS k, round(a / nullif(b, 0), 6) AS share FROM (SELECT l_partkey AS ps, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY 1)",
)
def fn_ratio_round(t: Tables) -> DataFrame:
    counts = t("lineitem").groupBy(F.col("l_partkey").alias("k")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_linestatus") == "O").alias("b")
    )
    return counts.select("k", rc.share(F.col("a"), F.col("b")).alias("share"))


@query("fn_split_part", "SELECT unit_id, split_part(text, ' ', 4) AS word FROM v_unit")
def fn_split_part(t: Tables) -> DataFrame:
    return t("v_unit").select("unit_id", F.split_part("text", F.lit(" "), F.lit(4)).alias("word"))


@query(
    "fn_json_snapshot",
    """SELECT event_id, event_id % 6 = 1 AS collides, CASE WHEN event_id % 6 = 1 THEN NULL ELSE CAST(5 AS BIGINT) END AS n_keys,
      CASE WHEN event_id % 6 = 1 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS setting,
      event_id % 6 <> 1 AND event_id % 10 = 3 AS mismatch FROM events""",
)
def fn_json_snapshot(t: Tables) -> DataFrame:
    model = F.when(F.col("event_id") % 10 == 3, "old").otherwise("base")
    base = F.create_map(F.lit("source"), "event_type", F.lit("embeddingModel"), model, F.lit("chunkSize"), F.lit("1200"))
    name = F.when(F.col("event_id") % 6 == 1, "chunkSize").otherwise("captionModel")
    extension = F.create_map(name, F.get_json_object("props", "$.k"), F.lit("captionVersion"), F.lit("v1"))
    built = t("events").select("event_id", rc.job_snapshot(base, extension).alias("s"))
    return built.select(
        "event_id", F.col("s").isNull().alias("collides"), F.when(F.col("s").isNotNull(), F.size("s").cast("long")).alias("n_keys"),
        F.try_element_at("s", F.lit("captionModel")).alias("setting"),
        F.coalesce(rc.snapshot_mismatch(F.col("s"), {"embeddingModel": F.lit("base")}), F.lit(False)).alias("mismatch"),
    )


ANSWERS = "SELECT message_id, turn, CONCAT(content, ' [1] and [', CAST(turn AS STRING), '] or [99999999999999999999].') AS answer FROM v_message"


@query(
    "fn_citation_markers",
    f"""WITH m AS (SELECT message_id, generate_subscripts(n, 1) - 1 AS mark_order, TRY_CAST(unnest(n) AS BIGINT) AS number FROM (SELECT message_id, regexp_extract_all(answer, '\\[(\\d+)\\]', 1) AS n FROM ({ANSWERS})))
    SELECT m.message_id, CAST(m.mark_order AS BIGINT) AS mark_order, m.number, c.citation_id FROM m LEFT JOIN v_citation c ON c.message_id = m.message_id AND c.citation_index + 1 = m.number""",
)
def fn_citation_markers(t: Tables) -> DataFrame:
    return rc.citation_marks(t.sql(ANSWERS), t("v_citation")).select(
        "message_id", F.col("mark_order").cast("long").alias("mark_order"), "number", "citation_id"
    )


@query(
    "fn_sse_events",
    """SELECT message_id, CAST(0 AS BIGINT) AS event_order, 'meta' AS name, '{"id":' || message_id || '}' AS data, true AS is_json FROM v_message
    UNION ALL SELECT message_id, CAST(2 AS BIGINT), 'delta', replace(content, chr(10), ' '), false FROM v_message
    UNION ALL SELECT message_id, CAST(3 AS BIGINT), 'message', '{"a":1}' || chr(10) || '{"b":2}', false FROM v_message""",
)
def fn_sse_events(t: Tables) -> DataFrame:
    stream = F.concat(
        F.lit('event: meta\ndata: {"id":'), F.col("message_id").cast("string"), F.lit("}\n\n: ping\n\nevent: delta\r\ndata: "),
        F.replace("content", F.lit("\n"), F.lit(" ")), F.lit('\r\n\r\ndata: {"a":1}\ndata: {"b":2}\n\nevent: done\ndata: {"cut'),
    )
    return rc.stream_events(t("v_message").select("message_id", stream.alias("stream")), "message_id", "stream").withColumn(
        "event_order", F.col("event_order").cast("long")
    )
