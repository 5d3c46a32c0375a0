"""Aggregations over workspaces, corpus, jobs, metrics and golden suites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as tx
from tracelode.operators import aggregates as ag
from tracelode.operators import golden as gd
from tracelode.operators import scope
from tracelode.operators import postings as pb
from tracelode.plans.registry import query
from tracelode.plans.scope_plans import COHORT_FROM, COHORT_SQL, cohort_rows
from tracelode.sources.views import Tables


def L(name: str) -> F.Column:
    return F.col(name).cast("long").alias(name)


@query(
    "agg_workspace_counts",
    """SELECT n_nationkey AS workspace_id,
      CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 0) AS BIGINT) AS n_assets,
      CAST((SELECT count(*) FROM v_note WHERE workspace_id = n_nationkey AND NOT is_archived) AS BIGINT) AS n_notes,
      CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS BIGINT) AS n_threads FROM nation""",
)
def agg_workspace_counts(t: Tables) -> DataFrame:
    return ag.counts_per(
        t("nation").select(F.col("n_nationkey").alias("workspace_id")),
        "workspace_id",
        n_assets=t("customer").where("c_acctbal >= 0").select(F.col("c_nationkey").alias("workspace_id")),
        n_notes=t("v_note").where("NOT is_archived").select("workspace_id"),
        n_threads=t("supplier").select(F.col("s_nationkey").alias("workspace_id")),
    )


@query(
    "agg_job_status",
    """SELECT s.status, CAST(count(j.job_id) AS BIGINT) AS n FROM (VALUES ('queued'), ('running'), ('succeeded'), ('failed'), ('cancelled')) s(status)
    LEFT JOIN v_job j ON j.status = s.status GROUP BY 1""",
)
def agg_job_status(t: Tables) -> DataFrame:
    return ag.counts_over(t("v_job"), "status", ag.JOB_STATUSES)


# Titles as stored with a thread: some have one, some a blank one, most none.
TITLES = """SELECT thread_id, CASE WHEN thread_id % 8 = 1 THEN '  ' ELSE CONCAT(' Thread ', CAST(thread_id AS STRING), ' ') END AS title
  FROM (SELECT DISTINCT thread_id FROM v_message WHERE thread_id % 4 = 1) x"""


@query(
    "agg_thread_rollup",
    f"""SELECT m.thread_id, coalesce(any_value(nullif(trim(s.title), '')), substr(arg_min(m.content, m.turn) FILTER (WHERE m.role = 'user'), 1, 80)) AS title,
      max(m.turn) AS last_turn, CAST(count(*) AS BIGINT) AS n_messages FROM v_message m LEFT JOIN ({TITLES}) s ON s.thread_id = m.thread_id GROUP BY 1""",
)
def agg_thread_rollup(t: Tables) -> DataFrame:
    return ag.thread_rollup(t("v_message"), t.sql(TITLES))


@query(
    "agg_next_attempt",
    "SELECT asset_id, job_type, CAST(max(attempt) + 1 AS BIGINT) AS next_attempt FROM v_job GROUP BY 1, 2",
)
def agg_next_attempt(t: Tables) -> DataFrame:
    return ag.next_attempt(t("v_job")).select("asset_id", "job_type", L("next_attempt"))


CURRENT_UNITS = """FROM v_unit u JOIN v_asset a ON a.asset_id = u.asset_id AND a.workspace_id = u.workspace_id AND a.current_index = u.index_version
  JOIN v_representation r ON r.representation_id = u.representation_id AND r.workspace_id = u.workspace_id AND r.generation = a.current_generation
  JOIN v_locator l ON l.locator_id = u.locator_id AND l.workspace_id = u.workspace_id AND l.generation = a.current_generation"""


@query(
    "agg_embed_coverage",
    f"""SELECT u.asset_id, CASE WHEN bool_and(e.unit_id IS NOT NULL) THEN 'ready' ELSE 'chunked' END AS available_status,
      CAST(count(*) AS BIGINT) AS n_units {CURRENT_UNITS}
    LEFT JOIN v_embedding e ON e.unit_id = u.unit_id AND e.workspace_id = u.workspace_id AND e.generation = a.current_generation
      AND e.index_version = u.index_version AND e.is_current AND e.embedding_space = 'text' AND e.provider = 'main'
      AND e.model = 'base' AND e.version = 'v1' AND e.dimensions = 64 GROUP BY 1""",
)
def agg_embed_coverage(t: Tables) -> DataFrame:
    chained = scope.chain(t("v_unit"), t("v_asset"), t("v_representation"), t("v_locator"))
    current = scope.at_generation(chained, F.col("current_generation"))
    vectors = scope.embedding_scope(
        t("v_embedding"), space="text", provider="main", model="base", version="v1", dimensions=64
    )
    return ag.embed_status(current, vectors)


@query(
    "agg_corpus_counts",
    """SELECT 'physical_units' AS measure, CAST(count(*) AS BIGINT) AS n FROM v_unit
    UNION ALL SELECT 'embeddings', CAST(count(*) AS BIGINT) FROM v_embedding
    UNION ALL SELECT 'current_embeddings', CAST(count(*) FILTER (WHERE is_current) AS BIGINT) FROM v_embedding
    UNION ALL SELECT 'invalid_current', CAST(count(*) AS BIGINT) FROM v_embedding e JOIN v_unit u ON u.unit_id = e.unit_id
      JOIN v_locator l ON l.locator_id = u.locator_id JOIN v_asset a ON a.asset_id = u.asset_id
      WHERE e.is_current AND (e.workspace_id <> u.workspace_id OR e.asset_id <> u.asset_id OR e.generation <> l.generation
        OR e.index_version <> u.index_version OR e.generation <> a.current_generation OR e.index_version <> a.current_index)
    UNION ALL SELECT 'lexical_visible', CAST(count(*) AS BIGINT) FROM v_visible
    UNION ALL SELECT 'dense_eligible', CAST(count(*) AS BIGINT) FROM v_dense""",
)
def agg_corpus_counts(t: Tables) -> DataFrame:
    invalid = (
        t("v_embedding").where("is_current").alias("e")
        .join(t("v_unit").alias("u"), F.col("e.unit_id") == F.col("u.unit_id"))
        .join(t("v_locator").alias("l"), F.col("l.locator_id") == F.col("u.locator_id"))
        .join(t("v_asset").alias("a"), F.col("a.asset_id") == F.col("u.asset_id"))
        .where(
            """e.workspace_id <> u.workspace_id OR e.asset_id <> u.asset_id OR e.generation <> l.generation
            OR e.index_version <> u.index_version OR e.generation <> a.current_generation OR e.index_version <> a.current_index"""
        )
    )

    def one(name: str, df: DataFrame, what=F.count(F.lit(1))) -> DataFrame:
        return df.agg(what.alias("n")).select(F.lit(name).alias("measure"), "n")

    frames = [
        one("physical_units", t("v_unit")),
        one("embeddings", t("v_embedding")),
        one("current_embeddings", t("v_embedding"), F.count_if("is_current")),
        one("invalid_current", invalid),
        one("lexical_visible", t("v_visible")),
        one("dense_eligible", t("v_dense")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


PROFILE = "CASE u.unit_order % 3 WHEN 0 THEN 'D1' WHEN 1 THEN 'D8' ELSE 'D64' END"


@query(
    "agg_signature_profile",
    f"""SELECT cohort, asset_kind || '/' || unit_kind || '/' || representation_kind || '/' || locator_kind AS signature, profile,
      CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT page_key) AS BIGINT) AS n_locations
    FROM (SELECT {COHORT_SQL} AS cohort, a.asset_kind, u.unit_kind, r.representation_kind, l.locator_kind, {PROFILE} AS profile,
      a.asset_id || '#' || l.page_number AS page_key {COHORT_FROM})
    GROUP BY GROUPING SETS ((cohort, asset_kind, unit_kind, representation_kind, locator_kind, profile),
      (asset_kind, unit_kind, representation_kind, locator_kind), (profile))""",
)
def agg_signature_profile(t: Tables) -> DataFrame:
    rows = cohort_rows(t).join(t("v_unit").select("unit_id", "unit_order"), "unit_id").select(
        "cohort", F.concat_ws("/", *scope.KINDS).alias("signature"),
        F.expr(PROFILE.replace("u.", "")).alias("profile"),
        F.concat("asset_id", F.lit("#"), F.col("page_number").cast("string")).alias("page_key"),
    )
    sets = [
        [F.col("cohort"), F.col("signature"), F.col("profile")], [F.col("signature")], [F.col("profile")]
    ]
    return rows.groupingSets(sets, "cohort", "signature", "profile").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("page_key").alias("n_locations")
    )


@query(
    "agg_text_distribution",
    """WITH x AS (SELECT length(text) AS n, text, row_number() OVER (ORDER BY length(text)) AS rn, count(*) OVER () AS c FROM v_unit)
    SELECT CAST(count(*) AS BIGINT) AS n, round(avg(n), 6) AS mean, CAST(min(n) AS BIGINT) AS minimum, CAST(max(n) AS BIGINT) AS maximum,
      CAST(max(n) FILTER (WHERE rn = greatest(1, ceil(0.5 * c))) AS BIGINT) AS p50,
      CAST(max(n) FILTER (WHERE rn = greatest(1, ceil(0.95 * c))) AS BIGINT) AS p95,
      CAST(count(*) FILTER (WHERE contains(text, 'the')) AS BIGINT) AS n_marked FROM x""",
)
def agg_text_distribution(t: Tables) -> DataFrame:
    sized = t("v_unit").select(F.length("text").cast("long").alias("size"), F.contains(F.col("text"), F.lit("the")).alias("marked"))
    spread = ag.distribution(sized, "size", {"p50": 0.5, "p95": 0.95})
    return spread.join(sized.agg(F.count_if("marked").alias("n_marked"))).select(
        "n", F.round("mean", 6).alias("mean"), "minimum", "maximum", L("p50"), L("p95"), "n_marked"
    )


@query(
    "agg_poison_counts",
    f"""SELECT {COHORT_SQL} AS cohort, CAST(count(*) FILTER (WHERE u.unit_order < 4) AS BIGINT) AS nearest_rows,
      CAST(count(*) FILTER (WHERE contains(u.text, 'tion')) AS BIGINT) AS token_rows {COHORT_FROM} GROUP BY 1""",
)
def agg_poison_counts(t: Tables) -> DataFrame:
    rows = cohort_rows(t).join(t("v_unit").select("unit_id", "unit_order"), "unit_id")
    return rows.groupBy("cohort").agg(
        F.count_if(F.col("unit_order") < 4).alias("nearest_rows"),
        F.count_if(F.contains(F.col("text"), F.lit("tion"))).alias("token_rows"),
    )


@query(
    "agg_seed_contract",
    f"""WITH c AS (SELECT {COHORT_SQL} AS cohort, e.is_current, u.index_version = a.current_index AND r.generation = a.current_generation AS chain_ok,
      contains(u.text, 'tion') AS marked {COHORT_FROM})
    SELECT 'everyCohortPresent' AS rule, (SELECT count(DISTINCT cohort) = 5 FROM c) AS passed
    UNION ALL SELECT 'visibleIsLargest', (SELECT count(*) FILTER (WHERE cohort = 'visible') > count(*) / 2 FROM c)
    UNION ALL SELECT 'currentMatchesChain', (SELECT bool_and(chain_ok) FROM c WHERE is_current)
    UNION ALL SELECT 'poisonCarriesToken', (SELECT count(DISTINCT cohort) FILTER (WHERE marked) = 5 FROM c)
    UNION ALL SELECT 'everySignatureKnown', (SELECT bool_and(s.channel IS NOT NULL) {COHORT_FROM}
      LEFT JOIN v_signature s ON s.asset_kind = a.asset_kind AND s.unit_kind = u.unit_kind AND s.representation_kind = r.representation_kind AND s.locator_kind = l.locator_kind)""",
)
def agg_seed_contract(t: Tables) -> DataFrame:
    return gd.seed_contract(cohort_rows(t), t("v_signature"), "tion")


# All columns of all given tables, with their types.
KEY, NUMBER, REAL, TEXT, TIME, VECTOR = "bigint", "int", "double", "string", "timestamp", "array<float>"
COLUMNS = {
    "region": {"r_regionkey": NUMBER, "r_name": TEXT},
    "nation": {"n_nationkey": NUMBER, "n_name": TEXT, "n_regionkey": NUMBER},
    "customer": {"c_custkey": KEY, "c_name": TEXT, "c_nationkey": NUMBER, "c_acctbal": REAL, "c_mktsegment": TEXT},
    "supplier": {"s_suppkey": KEY, "s_name": TEXT, "s_nationkey": NUMBER, "s_acctbal": REAL},
    "part": {"p_partkey": KEY, "p_name": TEXT, "p_brand": TEXT, "p_type": TEXT, "p_size": NUMBER, "p_retailprice": REAL},
    "orders": {
        "o_orderkey": KEY, "o_custkey": KEY, "o_orderstatus": TEXT, "o_totalprice": REAL, "o_orderdate": TIME, "o_orderpriority": TEXT,
    },
    "lineitem": {
        "l_orderkey": KEY, "l_partkey": KEY, "l_suppkey": KEY, "l_linenumber": NUMBER, "l_quantity": REAL, "l_extendedprice": REAL,
        "l_discount": REAL, "l_tax": REAL, "l_returnflag": TEXT, "l_linestatus": TEXT, "l_shipdate": TIME,
    },
    "events": {"event_id": KEY, "ts": TIME, "user_id": KEY, "event_type": TEXT, "value": REAL, "props": TEXT},
    "documents": {"doc_id": KEY, "text": TEXT, "lang": TEXT, "source": TEXT, "n_chars": KEY},
    "embeddings": {"vec_id": KEY, "embedding": VECTOR, "label": NUMBER},
    "pages": {"page_id": KEY, "url": TEXT, "html": TEXT},
    "benchmark": {"item_id": KEY, "text": TEXT},
    "labels": {"doc_id": KEY, "quality": NUMBER, "toxic": NUMBER},
    "conversations": {"conv_id": KEY, "turn": KEY, "role": TEXT, "text": TEXT},
}


def cell_sql(name: str, kind: str) -> str:
    """`cell_text` in the words of the checking engine."""
    if kind == VECTOR:
        return f"array_to_string(list_transform({name}, lambda x: COALESCE({ag.cell_text('x', 'float')}, '~')), ',')"
    return f"CAST(epoch_us({name}) AS STRING)" if kind == TIME else ag.cell_text(name, kind)


def half_sql(at: int) -> str:
    return f"CAST(sum(CAST(CAST('0x' || substr(h, {at}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)"


@query(
    "agg_fingerprint",
    "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, {half_sql(1)} AS high, {half_sql(17)} AS low FROM (
          SELECT md5(CONCAT_WS('|', {", ".join(f"COALESCE({cell_sql(c, kind)}, '~')" for c, kind in columns.items())})) AS h FROM {name})"""
        for name, columns in COLUMNS.items()
    ),
)
def agg_fingerprint(t: Tables) -> DataFrame:
    out = None
    for name, columns in COLUMNS.items():
        one = ag.fingerprint(t(name).select(*columns), name)
        out = one if out is None else out.unionByName(one)
    return out.select("table_name", "n_rows", F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"))


@query(
    "agg_task_type_counts",
    "SELECT task_type, CAST(count(*) AS BIGINT) AS n FROM v_task_result GROUP BY 1",
)
def agg_task_type_counts(t: Tables) -> DataFrame:
    return t("v_task_result").groupBy("task_type").agg(F.count(F.lit(1)).alias("n"))


RANKS = """x AS (SELECT strategy, duration_ms AS v, row_number() OVER (PARTITION BY strategy ORDER BY duration_ms) AS rn,
  count(*) OVER (PARTITION BY strategy) AS c FROM v_metric)"""


@query(
    "agg_latency",
    f"""WITH {RANKS} SELECT strategy, round(avg(v), 6) AS mean, min(v) AS minimum, max(v) AS maximum,
      max(v) FILTER (WHERE rn = ceil(0.5 * c)) AS p50, max(v) FILTER (WHERE rn = ceil(0.95 * c)) AS p95,
      max(v) FILTER (WHERE rn = ceil(0.99 * c)) AS p99, round(median(v), 6) AS true_median FROM x GROUP BY 1""",
)
def agg_latency(t: Tables) -> DataFrame:
    out = ag.distribution(
        t("v_metric"), "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "true_median": "median"}, ["strategy"]
    )
    return out.select(
        "strategy", F.round("mean", 6).alias("mean"), "minimum", "maximum", "p50", "p95", "p99",
        F.round("true_median", 6).alias("true_median"),
    )


@query(
    "agg_run_stability",
    """WITH k AS (SELECT strategy, string_agg(error_type, ',' ORDER BY error_type) AS error_types
      FROM (SELECT DISTINCT strategy, error_type FROM v_metric WHERE error_type IS NOT NULL) GROUP BY 1)
    SELECT m.strategy, CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE m.error_type IS NULL) AS BIGINT) AS completed,
      CAST(count(m.error_type) AS BIGINT) AS errors,
      CAST(count(*) FILTER (WHERE m.error_type IS NULL AND m.result_hash <> md5(CAST(m.case_id AS VARCHAR))) AS BIGINT) AS drifted,
      any_value(k.error_types) AS error_types,
      round(count(*) FILTER (WHERE m.error_type IS NULL) / (epoch_us(max(m.ts)) - epoch_us(min(m.ts))) * 1e6, 6) AS throughput
    FROM v_metric m LEFT JOIN k ON k.strategy = m.strategy GROUP BY 1""",
)
def agg_run_stability(t: Tables) -> DataFrame:
    expected = t("v_metric").select("case_id").distinct().withColumn(
        "result_hash", F.md5(F.col("case_id").cast("string"))
    )
    return ag.run_stability(t("v_metric"), expected).withColumn("throughput", F.round("throughput", 6))


@query(
    "agg_metric_histogram",
    "\nUNION ALL\n".join(
        [
            f"""SELECT 'duration' AS metric, strategy, outcome, CAST({b} AS DOUBLE) AS le,
      CAST(count(*) FILTER (WHERE duration_ms / 1000 <= {b}) AS BIGINT) AS n FROM v_metric GROUP BY 2, 3"""
            for b in ag.RETRIEVAL_SECONDS
        ]
        + [
            f"""SELECT 'results' AS metric, strategy, 'success' AS outcome, CAST({b} AS DOUBLE) AS le,
      CAST(count(*) FILTER (WHERE result_count <= {b}) AS BIGINT) AS n FROM v_metric WHERE outcome = 'success' GROUP BY 2"""
            for b in ag.RETRIEVAL_RESULTS
        ]
    ),
)
def agg_metric_histogram(t: Tables) -> DataFrame:
    m = t("v_metric")
    durations = ag.histogram(m, ["strategy", "outcome"], F.col("duration_ms") / 1000, ag.RETRIEVAL_SECONDS)
    results = ag.histogram(
        m.where(F.col("outcome") == "success"), ["strategy", "outcome"], F.col("result_count"), ag.RETRIEVAL_RESULTS
    )
    return durations.withColumn("metric", F.lit("duration")).unionByName(
        results.withColumn("metric", F.lit("results"))
    ).select("metric", "strategy", "outcome", "le", "n")


@query(
    "agg_term_stats",
    """WITH tok AS (SELECT workspace_id, unit_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term FROM v_visible),
    tf AS (SELECT workspace_id, unit_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    len AS (SELECT workspace_id, sum(n) / count(*) AS avg_len FROM (SELECT workspace_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n FROM v_visible) GROUP BY 1)
    SELECT tf.workspace_id, tf.term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf.tf) AS BIGINT) AS tf, round(any_value(len.avg_len), 6) AS avg_len
    FROM tf JOIN len ON len.workspace_id = tf.workspace_id GROUP BY 1, 2""",
)
def agg_term_stats(t: Tables) -> DataFrame:
    rows = t("v_postings").where("field = 'bm25'")
    per_term = rows.groupBy("workspace_id", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("tf"))
    return per_term.join(pb.corpus_stats(t("v_postings"), t("v_slots")), "workspace_id").select(
        "workspace_id", "term", "df", "tf", F.round("avg_len", 6).alias("avg_len")
    )


@query(
    "agg_quality_coverage",
    """WITH w AS (SELECT * FROM (VALUES ('layer', 'retrieval'), ('layer', 'evidence'), ('layer', 'answer'), ('modality', 'pdf'), ('modality', 'image'),
      ('modality', 'mixed'), ('task_type', 'chart'), ('task_type', 'cross_document_compare'), ('task_type', 'exact_fact'), ('task_type', 'image'),
      ('task_type', 'method_constraints'), ('task_type', 'no_answer'), ('task_type', 'table'), ('disposition', 'refuse')) v(dimension, value)),
    c AS (SELECT 'layer' AS dimension, layer AS value FROM v_golden_case UNION ALL SELECT 'modality', modality FROM v_golden_case
      UNION ALL SELECT 'task_type', task_type FROM v_golden_case UNION ALL SELECT 'disposition', disposition FROM v_golden_case)
    SELECT w.dimension, w.value, CAST(count(c.value) AS BIGINT) AS n FROM w LEFT JOIN c ON c.dimension = w.dimension AND c.value = w.value GROUP BY 1, 2""",
)
def agg_quality_coverage(t: Tables) -> DataFrame:
    return gd.coverage(t("v_golden_case"))


@query(
    "agg_quality_minimums",
    """WITH l AS (SELECT layer, count(*) AS n, count(DISTINCT modality) AS m FROM v_golden_case GROUP BY 1)
    SELECT 'minimumCases' AS rule, (SELECT count(*) >= 20 FROM v_golden_case) AS passed
    UNION ALL SELECT 'minimumPerLayer', (SELECT count(*) FILTER (WHERE n >= 6) = 3 FROM l)
    UNION ALL SELECT 'layersCoverModalities', (SELECT count(*) FILTER (WHERE m = 3) = 3 FROM l)
    UNION ALL SELECT 'allModalities', (SELECT count(DISTINCT modality) = 3 FROM v_golden_case)
    UNION ALL SELECT 'allTaskTypes', (SELECT count(DISTINCT task_type) = 7 FROM v_golden_case)
    UNION ALL SELECT 'minimumRefusals', (SELECT count(*) FILTER (WHERE disposition = 'refuse') >= 2 FROM v_golden_case)""",
)
def agg_quality_minimums(t: Tables) -> DataFrame:
    return gd.minimums(t("v_golden_case"))


@query(
    "agg_release_report",
    f"""WITH r AS (SELECT locator_id, max(width * height) AS ratio FROM v_rect WHERE flag = 'R' GROUP BY 1),
    a AS (SELECT case_id, lower(output) = lower(d.lang || ' ' || d.source) AS ok FROM v_model_answer m
      JOIN documents d ON m.case_id = 'g' || d.doc_id),
    s AS (SELECT g.case_id, g.layer, e.n > 0 AND e.ok AS engineered, coalesce(a.ok, false) AS answered, r.ratio FROM v_golden_case g
      LEFT JOIN (SELECT case_id, count(*) AS n, bool_and(passed) AS ok FROM v_execution GROUP BY 1) e ON e.case_id = g.case_id
      LEFT JOIN a ON a.case_id = g.case_id LEFT JOIN r ON r.locator_id = g.doc_id)
    SELECT CASE WHEN NOT coalesce(engineered, false) THEN 'failed' WHEN layer <> 'answer' OR answered THEN 'passed'
      ELSE 'engineering_pass_model_pending' END AS status, layer,
      CAST(count(*) AS BIGINT) AS n_cases, round(min(ratio), 6) AS min_coverage,
      bool_and(coalesce(engineered, false) AND (layer <> 'answer' OR answered)) AS release_passed
    FROM s GROUP BY 1, 2""",
)
def agg_release_report(t: Tables) -> DataFrame:
    ratios = t("v_rect").where("flag = 'R'").groupBy(F.col("locator_id").alias("doc_id")).agg(
        F.max(F.col("width") * F.col("height")).alias("ratio")
    )
    accepted = t("documents").select(
        F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("case_id"),
        F.concat("lang", F.lit(" "), "source").alias("accepted"),
    )
    answers = t("v_model_answer").join(accepted, "case_id").select(
        "case_id", (tx.normal_output(F.col("output")) == tx.normal_answer(F.col("accepted"))).alias("answered")
    )
    return gd.release_report(t("v_golden_case").join(ratios, "doc_id", "left"), t("v_execution"), answers).withColumn(
        "min_coverage", F.round("min_coverage", 6)
    )
