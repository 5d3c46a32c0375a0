"""Windows, sets, message trees, display orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators import graph, sets
from tracelode.plans.registry import query
from tracelode.scale import hot_ordinal
from tracelode.sources.views import Tables

PRIORITY = "CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END"


@query(
    "win_parent_lag",
    f"SELECT thread_id, message_id, lag(message_id) OVER (PARTITION BY thread_id ORDER BY turn, {PRIORITY}, message_id) AS parent FROM v_message",
)
def win_parent_lag(t: Tables) -> DataFrame:
    return graph.chain_parents(t("v_message")).select("thread_id", "message_id", F.col("chained_parent").alias("parent"))


@query("win_latest_leaf", "SELECT thread_id, arg_max(message_id, turn) AS leaf_id FROM v_message GROUP BY 1")
def win_latest_leaf(t: Tables) -> DataFrame:
    return graph.latest_leaf(t("v_message"))


@query(
    "win_repair_leaf",
    "SELECT thread_id, arg_max(message_id, turn) FILTER (WHERE status = 'completed') AS leaf_id FROM v_message GROUP BY 1",
)
def win_repair_leaf(t: Tables) -> DataFrame:
    return graph.repaired_leaf(t("v_message"))


@query(
    "win_positions",
    """SELECT note_id, asset_id, kind, CAST(row_number() OVER (PARTITION BY note_id ORDER BY CASE WHEN kind = 'O' THEN 0 ELSE 1 END, source_order, asset_id) - 1 AS BIGINT) AS source_order
    FROM v_note_source""",
)
def win_positions(t: Tables) -> DataFrame:
    part = F.when(F.col("kind") == "O", 0).otherwise(1)
    rows = t("v_note_source").withColumn("_part", part)
    placed = hot_ordinal(
        rows, ["note_id"], [F.col("_part"), F.col("source_order"), F.col("asset_id")],
        F.struct("_part", F.floor(F.col("source_order") / 1_000_000_000).alias("b")), "_position",
    )
    return placed.select("note_id", "asset_id", "kind", (F.col("_position") - 1).cast("long").alias("source_order"))


@query(
    "win_unit_span_gap",
    """WITH x AS (SELECT doc_id, char_start, max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_unit_base)
    SELECT doc_id, CAST(count(*) FILTER (WHERE char_start < reach) AS BIGINT) AS n_overlaps, CAST(count(*) FILTER (WHERE char_start > reach) AS BIGINT) AS n_gaps,
      CAST(max(reach - char_start) AS BIGINT) AS widest_overlap FROM x GROUP BY 1""",
)
def win_unit_span_gap(t: Tables) -> DataFrame:
    # A document is one row of the source, so its spans are bounded by that row.
    order = Window.partitionBy("doc_id").orderBy("char_start", "char_end")
    reach = F.max("char_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = t("v_unit").select("doc_id", "char_start", "char_end").withColumn("reach", reach)
    return spans.groupBy("doc_id").agg(
        F.count_if(F.col("char_start") < F.col("reach")).alias("n_overlaps"),
        F.count_if(F.col("char_start") > F.col("reach")).alias("n_gaps"),
        F.max(F.col("reach") - F.col("char_start")).cast("long").alias("widest_overlap"),
    )


REGISTERED = """SELECT DISTINCT 'asset' AS family, asset_kind AS kind FROM v_signature UNION ALL SELECT DISTINCT 'unit', unit_kind FROM v_signature
  UNION ALL SELECT DISTINCT 'representation', representation_kind FROM v_signature UNION ALL SELECT DISTINCT 'locator', locator_kind FROM v_signature
  UNION ALL SELECT DISTINCT 'space', channel FROM v_signature"""
STORED = """SELECT DISTINCT 'asset' AS family, asset_kind AS kind FROM v_asset UNION ALL SELECT DISTINCT 'unit', unit_kind FROM v_unit
  UNION ALL SELECT DISTINCT 'representation', representation_kind FROM v_representation UNION ALL SELECT DISTINCT 'locator', locator_kind FROM v_locator
  UNION ALL SELECT DISTINCT 'space', embedding_space FROM v_embedding"""


@query(
    "set_catalog_drift",
    f"""SELECT *, 'registered_only' AS side FROM (({REGISTERED}) EXCEPT ALL ({STORED})) UNION ALL
    SELECT *, 'stored_only' AS side FROM (({STORED}) EXCEPT ALL ({REGISTERED}))""",
)
def set_catalog_drift(t: Tables) -> DataFrame:
    return sets.drift(t.sql(REGISTERED), t.sql(STORED))


@query(
    "set_missing_ids",
    """SELECT note_id, asset_id, CAST(row_number() OVER (PARTITION BY note_id ORDER BY o, asset_id) AS BIGINT) AS position FROM (
      SELECT note_id, asset_id, min(source_order) AS o FROM v_note_source GROUP BY 1, 2)
    WHERE asset_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)""",
)
def set_missing_ids(t: Tables) -> DataFrame:
    known = t("part").where("p_size < 40").select(F.col("p_partkey").alias("asset_id"))
    gone = sets.missing(
        t("v_note_source"), known, "note_id", "asset_id", "source_order", F.floor(F.col("source_order") / 1_000_000_000)
    )
    return gone.select("note_id", "asset_id", F.col("position").cast("long").alias("position"))


SCOPE_REQUESTS = """SELECT DISTINCT source AS request_id, source AS workspace_id,
  CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'all_ready' ELSE 'selected' END AS mode FROM documents"""
SCOPE_PICKS = """SELECT d.source AS request_id, CAST(d.doc_id AS STRING) AS asset_id, 1000000 - d.doc_id AS asset_order
  FROM documents d JOIN labels b ON b.doc_id = d.doc_id WHERE (b.quality = 1 AND d.n_chars > 9000) OR (b.toxic = 1 AND b.quality = 0)"""


@query(
    "set_scope_resolution",
    f"""WITH r AS ({SCOPE_REQUESTS}), s AS ({SCOPE_PICKS}), bad AS (SELECT DISTINCT r.request_id FROM r JOIN s ON s.request_id = r.request_id
      LEFT JOIN v_asset a ON a.asset_id = s.asset_id AND a.workspace_id = r.workspace_id
      WHERE r.mode = 'selected' AND NOT coalesce(a.status = 'ready' AND NOT a.is_deleted, false)),
    rows AS (SELECT r.request_id, a.asset_id, a.created_seq AS o FROM r JOIN v_asset a ON a.workspace_id = r.workspace_id AND r.mode = 'all_ready' AND a.status = 'ready' AND NOT a.is_deleted
      UNION ALL SELECT r.request_id, s.asset_id, s.asset_order FROM r JOIN s ON s.request_id = r.request_id WHERE r.mode = 'selected' AND r.request_id NOT IN (SELECT request_id FROM bad))
    SELECT request_id, 'ok' AS outcome, CAST(row_number() OVER (PARTITION BY request_id ORDER BY o, asset_id) AS BIGINT) AS position, asset_id FROM rows
    UNION ALL SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM bad) THEN 'invalid_asset_scope' ELSE 'empty_asset_scope' END, NULL, NULL
      FROM r WHERE request_id NOT IN (SELECT request_id FROM rows)""",
)
def set_scope_resolution(t: Tables) -> DataFrame:
    return sets.resolve_scopes(t.sql(SCOPE_REQUESTS), t.sql(SCOPE_PICKS), t("v_asset")).withColumn(
        "position", F.col("position").cast("long")
    )


def scope_parts(t: Tables, flag: str) -> DataFrame:
    return t("v_rect").where(F.col("flag") == flag).select(
        F.col("locator_id").alias("request_id"), F.col("part_id").alias("asset_id"), F.col("region_order").alias("item_order")
    )


@query(
    "set_scope_build",
    """WITH u AS (SELECT locator_id AS request_id, part_id AS asset_id, min(CASE WHEN flag = 'R' THEN region_order ELSE 1000 + region_order END) AS o
      FROM v_rect WHERE flag IN ('R', 'A') GROUP BY 1, 2)
    SELECT request_id, 'selected' AS mode, CAST(row_number() OVER (PARTITION BY request_id ORDER BY o, asset_id) AS BIGINT) AS position, asset_id FROM u
    UNION ALL SELECT o_orderkey, 'all_ready', NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT request_id FROM u)""",
)
def set_scope_build(t: Tables) -> DataFrame:
    requests = t("orders").select(F.col("o_orderkey").alias("request_id"))
    return sets.build_scopes(requests, scope_parts(t, "R"), scope_parts(t, "A")).withColumn(
        "position", F.col("position").cast("long")
    )


OLD_THREADS = """SELECT CASE WHEN thread_id % 3 = 0 THEN 'w2' WHEN thread_id % 3 = 1 THEN 'w1' ELSE 'w0' END AS workspace_id, thread_id,
  CONCAT('t', CAST(thread_id AS STRING)) AS title, count(*) AS n_messages FROM v_message GROUP BY 1, 2, 3"""
NEW_THREADS = """SELECT CASE WHEN thread_id % 3 = 1 THEN 'w1' ELSE 'w0' END AS workspace_id, thread_id + CASE WHEN thread_id % 8 = 1 THEN 100000 ELSE 0 END AS thread_id,
  CONCAT('n', CAST(thread_id AS STRING)) AS title, sum(CASE WHEN thread_id % 4 = 2 THEN 0 ELSE 1 END) AS n_messages FROM v_message
  WHERE thread_id % 3 <> 0 AND thread_id % 7 <> 2 GROUP BY 1, 2, 3"""


@query(
    "set_thread_upsert",
    f"""WITH o AS ({OLD_THREADS}), n AS ({NEW_THREADS})
    SELECT workspace_id, thread_id, title, CAST(n_messages AS BIGINT) AS n_messages FROM o WHERE workspace_id NOT IN ('w0', 'w1')
    UNION ALL SELECT n.workspace_id, n.thread_id, n.title, CAST(CASE WHEN n.n_messages = 0 AND o.n_messages IS NOT NULL THEN o.n_messages ELSE n.n_messages END AS BIGINT)
    FROM n LEFT JOIN o ON o.workspace_id = n.workspace_id AND o.thread_id = n.thread_id""",
)
def set_thread_upsert(t: Tables) -> DataFrame:
    incoming = t.sql(NEW_THREADS)
    return sets.upsert_threads(t.sql(OLD_THREADS), incoming, incoming.select("workspace_id").distinct())


REBIND = "SELECT l_orderkey AS note_id, p_type AS tag FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'"


@query(
    "set_bind_replace",
    f"""WITH q AS ({REBIND}) SELECT note_id, tag FROM v_note_tag WHERE note_id NOT IN (SELECT note_id FROM q)
    UNION ALL SELECT DISTINCT note_id, tag FROM q""",
)
def set_bind_replace(t: Tables) -> DataFrame:
    requests = t.sql(REBIND)
    return sets.replace_bindings(t("v_note_tag"), requests, requests.select("note_id").distinct(), "note_id", "tag")


@query(
    "set_tag_delete",
    """SELECT note_id AS owner_id, tag, 'note' AS kind FROM v_note_tag WHERE tag NOT IN (SELECT p_brand FROM part WHERE p_size = 50)
    UNION ALL SELECT p_partkey, p_brand, 'asset' FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)""",
)
def set_tag_delete(t: Tables) -> DataFrame:
    deleted = t("part").where("p_size = 50").select(F.col("p_brand").alias("tag")).distinct()
    notes = t("v_note_tag").select(F.col("note_id").alias("owner_id"), "tag", F.lit("note").alias("kind"))
    assets = t("part").select(F.col("p_partkey").alias("owner_id"), F.col("p_brand").alias("tag"), F.lit("asset").alias("kind"))
    return notes.unionByName(assets).join(deleted, "tag", "left_anti").select("owner_id", "tag", "kind")


LEAVES = "leaves AS (SELECT thread_id, arg_max(message_id, turn) AS leaf FROM v_message GROUP BY 1)"
WALK = """walk AS (SELECT u.thread_id, u.leaf, m.message_id, m.parent_id, m.status, 0 AS d FROM leaves u JOIN v_message m ON m.message_id = u.leaf
  UNION ALL SELECT w.thread_id, w.leaf, m.message_id, m.parent_id, m.status, d + 1 FROM walk w JOIN v_message m ON m.message_id = w.parent_id AND m.thread_id = w.thread_id)"""


@query(
    "gr_active_path",
    f"""WITH RECURSIVE {LEAVES}, {WALK} SELECT thread_id, message_id, CAST(max(d) OVER (PARTITION BY thread_id) - d AS BIGINT) AS depth FROM walk""",
)
def gr_active_path(t: Tables) -> DataFrame:
    return graph.active_path(t("v_message"), graph.latest_leaf(t("v_message"))).select("thread_id", "message_id", "depth")


@query(
    "gr_lineage",
    f"WITH RECURSIVE {LEAVES}, {WALK} SELECT thread_id, message_id, CAST(d AS BIGINT) AS distance FROM walk WHERE status = 'completed'",
)
def gr_lineage(t: Tables) -> DataFrame:
    return graph.lineage(t("v_message"), graph.latest_leaf(t("v_message"))).select("thread_id", "message_id", "distance")


@query(
    "gr_integrity",
    f"""WITH RECURSIVE leaves AS (SELECT thread_id, CASE WHEN thread_id % 23 = 4 THEN NULL WHEN thread_id % 29 = 5 THEN thread_id * 1000 + 555 ELSE arg_max(message_id, turn) END AS leaf FROM v_message GROUP BY 1), {WALK}
    SELECT DISTINCT thread_id, 'dangling_parent' AS problem FROM walk WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT message_id FROM v_message)
    UNION ALL SELECT thread_id, 'missing_leaf' FROM leaves WHERE leaf IS NOT NULL AND leaf NOT IN (SELECT message_id FROM v_message)
    UNION ALL SELECT thread_id, 'no_leaf' FROM leaves WHERE leaf IS NULL""",
)
def gr_integrity(t: Tables) -> DataFrame:
    thread = F.col("thread_id")
    leaves = graph.latest_leaf(t("v_message")).withColumn(
        "leaf_id",
        F.when(thread % 23 == 4, None).when(thread % 29 == 5, thread * 1000 + 555).otherwise(F.col("leaf_id")),
    )
    return graph.integrity(t("v_message"), leaves)


PARENT_REQUESTS = """SELECT message_id AS request_id, thread_id, CASE WHEN turn % 3 = 0 THEN message_id END AS edit_id,
  CASE WHEN turn % 3 = 1 THEN parent_id + CASE WHEN thread_id % 17 = 2 THEN 500 ELSE 0 END END AS wanted_parent FROM v_message"""


@query(
    "gr_parent_rules",
    f"""WITH {LEAVES}, x AS (SELECT q.request_id, q.edit_id, e.message_id AS e_id, e.role AS e_role, e.status AS e_status, e.parent_id AS e_parent,
      coalesce(q.wanted_parent, l.leaf) AS cand, p.message_id AS p_id, p.role AS p_role, p.status AS p_status FROM ({PARENT_REQUESTS}) q
      LEFT JOIN leaves l ON l.thread_id = q.thread_id LEFT JOIN v_message e ON e.message_id = q.edit_id AND e.thread_id = q.thread_id
      LEFT JOIN v_message p ON p.message_id = coalesce(q.wanted_parent, l.leaf) AND p.thread_id = q.thread_id),
    y AS (SELECT *, CASE WHEN edit_id IS NOT NULL AND (e_id IS NULL OR e_role <> 'user' OR e_status <> 'completed') THEN 'invalid_edit_message'
      WHEN edit_id IS NULL AND cand IS NOT NULL AND NOT coalesce(p_status = 'completed' OR (p_role = 'assistant' AND p_status = 'failed'), false) THEN 'invalid_parent_message'
      ELSE 'ok' END AS outcome FROM x)
    SELECT request_id, outcome, CASE WHEN outcome = 'ok' THEN CASE WHEN edit_id IS NOT NULL THEN e_parent ELSE cand END END AS parent_id FROM y""",
)
def gr_parent_rules(t: Tables) -> DataFrame:
    return graph.parent_choice(
        t.sql(PARENT_REQUESTS), t("v_message"), graph.latest_leaf(t("v_message"))
    ).select("request_id", "outcome", "parent_id")


# What each list shows, and the numbers it is ordered by: the smaller first, then the id.
LISTS = {
    "notes": """SELECT CAST(workspace_id AS STRING) AS owner, CAST(note_id AS STRING) AS item, CAST(CASE WHEN is_pinned THEN 0 ELSE 1 END AS BIGINT) AS a,
      -CAST({micros} AS BIGINT) AS b, -CAST(note_id AS BIGINT) AS c FROM v_note WHERE NOT is_archived""",
    "threads": """SELECT CAST(thread_id % 5 AS STRING) AS owner, CAST(thread_id AS STRING) AS item, -CAST(max(turn) AS BIGINT) AS a, -CAST(min(message_id) AS BIGINT) AS b,
      CAST(0 AS BIGINT) AS c FROM v_message GROUP BY thread_id""",
    "workspaces": """SELECT 'all' AS owner, workspace_id AS item, -CAST(max(created_seq) AS BIGINT) AS a, -CAST(min(created_seq) AS BIGINT) AS b, CAST(0 AS BIGINT) AS c
      FROM v_asset GROUP BY workspace_id""",
    "assets": """SELECT workspace_id AS owner, asset_id AS item, -CAST(created_seq AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c
      FROM v_asset WHERE NOT is_deleted""",
    "tags": "SELECT 'all' AS owner, p_brand AS item, CAST(min(p_partkey) AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM part GROUP BY p_brand",
}
#: Values of the first order that share a bucket.
LIST_BUCKET = 1_024


def list_sql(micros: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS list, owner, item, a, b, c FROM ({sql.format(micros=micros)}) x" for name, sql in LISTS.items())


@query(
    "ord_lists",
    f"""SELECT list, owner, item, CAST(row_number() OVER (PARTITION BY list, owner ORDER BY a, b, c, item) AS BIGINT) AS position
      FROM ({list_sql("epoch_us(updated_at)")})""",
)
def ord_lists(t: Tables) -> DataFrame:
    """The places of notes, threads, workspaces, assets and tags in their lists; no list is sorted in one task."""
    rows = t.sql(list_sql("unix_micros(CAST(updated_at AS TIMESTAMP))"))
    # pinned notes come first, then days: both are in order with (a, b)
    day = F.floor(F.col("b") / 86_400_000_000)
    bucket = F.when(F.col("list") == "notes", F.col("a") * 10_000_000 + day).otherwise(F.floor(F.col("a") / LIST_BUCKET))
    order = [F.col(c) for c in ("a", "b", "c", "item")]
    return hot_ordinal(rows, ["list", "owner"], order, bucket, "position").select(
        "list", "owner", "item", F.col("position").cast("long").alias("position")
    )


@query(
    "top_scope_freeze",
    """SELECT r.locator_id AS message_id, CAST(row_number() OVER (PARTITION BY r.locator_id ORDER BY r.o, r.part_id) - 1 AS BIGINT) AS asset_order,
      p.p_type AS kind_snapshot, p.p_name AS title_snapshot FROM (SELECT locator_id, part_id, min(region_order) AS o FROM v_rect WHERE flag = 'R' GROUP BY 1, 2) r
    JOIN part p ON p.p_partkey = r.part_id""",
)
def top_scope_freeze(t: Tables) -> DataFrame:
    once = sets.first_requests(scope_parts(t, "R"), "request_id", "asset_id", "item_order")
    known = t("part").select(F.col("p_partkey").alias("asset_id"), F.col("p_type").alias("kind_snapshot"), F.col("p_name").alias("title_snapshot"))
    placed = hot_ordinal(
        once.join(known, "asset_id"), ["request_id"], [F.col("item_order"), F.col("asset_id")],
        F.floor(F.col("item_order") / 4096), "_position",
    )
    return placed.select(
        F.col("request_id").alias("message_id"), (F.col("_position") - 1).cast("long").alias("asset_order"), "kind_snapshot", "title_snapshot"
    )
