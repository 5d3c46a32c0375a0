"""Vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators import dense, scope
from tracelode.operators import evaluation as ev
from tracelode.plans.registry import query
from tracelode.sources.views import Tables

DIMS = 64
K = 6


def rank_long(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


def stored(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The blocks of vectors that are kept with the corpus."""
    return t("v_vector_slots"), t("v_vector_blocks")


def top_dense(t: Tables, k: int) -> DataFrame:
    return dense.top_locations(t("v_probe"), t("v_dense"), DIMS, k, stored=stored(t))


@query(
    "top_dense_exact",
    f"SELECT query_id, asset_id, location_key, unit_id, round(distance, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM v_top_dense WHERE rank <= {K}",
)
def top_dense_exact(t: Tables) -> DataFrame:
    return rank_long(top_dense(t, K)).withColumn("distance", F.round("distance", 6))


@query(
    "win_location_dedupe",
    f"SELECT query_id, asset_id, location_key, unit_id FROM v_top_dense WHERE rank <= 20",
)
def win_location_dedupe(t: Tables) -> DataFrame:
    return top_dense(t, 20).select("query_id", "asset_id", "location_key", "unit_id")


def scoped_vectors(t: Tables) -> DataFrame:
    """Vectors in scope before the visible chain is applied, located by their own id."""
    return scope.embedding_scope(
        t("v_embedding"), space="text", provider="main", model="base", version="v1", dimensions=DIMS
    ).withColumn("location_key", F.col("embedding_id"))


@query(
    "top_binary_candidates",
    """SELECT query_id, embedding_id, CAST(hamming AS BIGINT) AS hamming, CAST(rn AS BIGINT) AS rank FROM (
      SELECT q.query_id, e.embedding_id, e.hamming, row_number() OVER (PARTITION BY q.query_id ORDER BY e.hamming, e.embedding_id) AS rn
      FROM (SELECT query_id FROM v_probe) q JOIN (SELECT p.query_id, x.embedding_id,
        bit_count(xor(CAST(array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END for x in p.embedding], '') AS BIT),
          CAST(array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END for x in x.embedding], '') AS BIT))) AS hamming
        FROM v_probe p JOIN v_embedding x ON x.workspace_id = p.workspace_id WHERE x.is_current AND x.provider = 'main') e ON e.query_id = q.query_id)
    WHERE rn <= 30""",
)
def top_binary_candidates(t: Tables) -> DataFrame:
    found = dense.top_rows(t("v_probe"), scoped_vectors(t), "embedding_id", DIMS, 30, "hamming")
    return found.select(
        "query_id", "embedding_id", F.col("distance").cast("long").alias("hamming"), F.col("rank").cast("long").alias("rank")
    )


def candidates_sql(measure: str, n: int) -> str:
    return f"""SELECT query_id, unit_id FROM (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY {measure}, unit_id) AS r FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, asset_id, location_key ORDER BY {measure}, unit_id) AS l FROM v_scored) WHERE l = 1) WHERE r <= {n}"""


def ann_sql() -> str:
    return f"""cand AS ({candidates_sql('distance', 10)} UNION {candidates_sql('hamming', 30)}),
  ann AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, unit_id) AS rank FROM (
    SELECT s.*, row_number() OVER (PARTITION BY s.query_id, s.asset_id, s.location_key ORDER BY s.distance, s.unit_id) AS lr
    FROM v_scored s JOIN cand c ON c.query_id = s.query_id AND c.unit_id = s.unit_id) WHERE lr = 1))"""


@query(
    "top_dense_ann",
    f"""WITH {ann_sql()}
    SELECT query_id, asset_id, location_key, unit_id, round(distance, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM ann WHERE rank <= {K}""",
)
def top_dense_ann(t: Tables) -> DataFrame:
    found = dense.top_approximate(t("v_probe"), t("v_dense"), DIMS, 10, K, stored=stored(t))
    return rank_long(found).withColumn("distance", F.round("distance", 6))


@query(
    "top_expand_window",
    "SELECT query_id, CAST(count(*) AS BIGINT) AS n_found, CAST(max(rank) AS BIGINT) AS last_rank FROM v_top_dense WHERE rank <= 24 GROUP BY 1",
)
def top_expand_window(t: Tables) -> DataFrame:
    """Scope and dedupe come first and the rank last, so no window has to grow."""
    return top_dense(t, 24).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_found"), F.max("rank").cast("long").alias("last_rank")
    )


@query(
    "top_window_rounds",
    f"""WITH n AS (SELECT query_id, count(*) AS n_rows FROM v_scored GROUP BY 1),
    lim AS (SELECT query_id, count(*) AS n_locations, max(distance) FILTER (WHERE rank = {K}) AS d, max(unit_id) FILTER (WHERE rank = {K}) AS u
      FROM v_top_dense WHERE rank <= {K} GROUP BY 1),
    r AS (SELECT n.query_id, n.n_rows, lim.n_locations, (SELECT count(*) FROM v_scored s WHERE s.query_id = n.query_id
        AND (s.distance < lim.d OR (s.distance = lim.d AND s.unit_id <= lim.u))) AS n_upto FROM n JOIN lim ON lim.query_id = n.query_id),
    x AS (SELECT *, 1 + greatest(0, CAST(ceil(log2(CASE WHEN n_locations >= {K} THEN n_upto ELSE n_rows + 1 END / {K}) - 1e-12) AS BIGINT)) AS rounds FROM r)
    SELECT query_id, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_locations AS BIGINT) AS n_locations, CAST(rounds AS BIGINT) AS rounds,
      CAST((SELECT sum(least(n_rows, CAST(pow(2, i) AS BIGINT) * {K})) FROM unnest(range(0, rounds)) q(i)) AS BIGINT) AS rows_ranked FROM x""",
)
def top_window_rounds(t: Tables) -> DataFrame:
    top = top_dense(t, K)
    last = top.where(F.col("rank") == K).select(
        "query_id", F.col("distance").alias("limit_distance"), F.col("unit_id").alias("limit_unit")
    )
    counts = dense.rows_upto(t("v_probe"), t("v_dense"), last, DIMS)
    return dense.window_rounds(top, counts, K).select(
        "query_id", "n_rows", "n_locations", F.col("rounds").cast("long").alias("rounds"), "rows_ranked"
    )


@query(
    "top_ann_recall",
    f"""WITH {ann_sql()}, ex AS (SELECT * FROM v_top_dense WHERE rank <= 10), ap AS (SELECT * FROM ann WHERE rank <= 10)
    SELECT ex.query_id, CAST(count(*) AS BIGINT) AS n_exact, CAST(count(ap.unit_id) AS BIGINT) AS n_shared,
      round(count(ap.unit_id) / count(*), 6) AS recall
    FROM ex LEFT JOIN ap ON ap.query_id = ex.query_id AND ap.asset_id = ex.asset_id AND ap.location_key = ex.location_key GROUP BY 1""",
)
def top_ann_recall(t: Tables) -> DataFrame:
    exact = top_dense(t, 10)
    near = dense.top_approximate(t("v_probe"), t("v_dense"), DIMS, 10, 10, stored=stored(t))
    shared = exact.join(
        near.select("query_id", "asset_id", "location_key", F.lit(1).alias("_in")), ["query_id", "asset_id", "location_key"], "left"
    )
    return shared.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("_in").alias("n_shared"),
        F.round(F.count("_in") / F.count(F.lit(1)), 6).alias("recall"),
    )


@query(
    "set_union_candidates",
    """SELECT query_id, unit_id FROM (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, unit_id) AS a,
      row_number() OVER (PARTITION BY query_id ORDER BY hamming, unit_id) AS b FROM v_scored) WHERE a <= 10 OR b <= 30""",
)
def set_union_candidates(t: Tables) -> DataFrame:
    near = dense.top_rows(t("v_probe"), t("v_dense"), "unit_id", DIMS, 10, "cosine", stored(t)).select("query_id", "unit_id")
    bits = dense.top_rows(t("v_probe"), t("v_dense"), "unit_id", DIMS, 30, "hamming", stored(t)).select("query_id", "unit_id")
    return near.union(bits).distinct()


def relevant_by_label(t: Tables) -> DataFrame:
    """Locations of the probe's own workspace and label."""
    return t("v_dense").select(
        F.concat("workspace_id", F.lit("#"), F.col("label").cast("string")).alias("query_id"), "asset_id", "location_key"
    )


METRICS = f"""rel AS (SELECT DISTINCT workspace_id || '#' || label AS query_id, asset_id, location_key FROM v_dense),
  n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
  h AS (SELECT t.query_id, t.rank FROM v_top_dense t JOIN rel r ON r.query_id = t.query_id AND r.asset_id = t.asset_id AND r.location_key = t.location_key WHERE t.rank <= {K}),
  m AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM h GROUP BY 1),
  cases AS (SELECT n.query_id, coalesce(m.hits, 0) / n.n AS recall, coalesce(1 / m.first, 0.0) AS mrr,
    coalesce(m.dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM unnest(range(1, least({K}, n.n) + 1)) q(i)) AS ndcg, CASE WHEN m.hits > 0 THEN 1.0 ELSE 0.0 END AS hit
    FROM n LEFT JOIN m ON m.query_id = n.query_id)"""


def dense_cases(t: Tables) -> DataFrame:
    return ev.case_metrics(top_dense(t, K), relevant_by_label(t), ["asset_id", "location_key"], K)


@query(
    "agg_case_metrics",
    f"WITH {METRICS} SELECT query_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, CAST(hit AS DOUBLE) AS hit FROM cases",
)
def agg_case_metrics(t: Tables) -> DataFrame:
    return dense_cases(t).select(
        "query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "hit"
    )


@query(
    "agg_mean_metrics",
    f"""WITH {METRICS} SELECT split_part(query_id, '#', 1) AS workspace_id, CAST(count(*) AS BIGINT) AS n_cases, round(avg(recall), 6) AS recall,
      round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit FROM cases GROUP BY 1""",
)
def agg_mean_metrics(t: Tables) -> DataFrame:
    cases = dense_cases(t).withColumn("workspace_id", F.split_part(F.col("query_id"), F.lit("#"), F.lit(1)))
    return ev.mean_metrics(cases, ["workspace_id"])


@query(
    "fn_cosine",
    """SELECT v.vec_id, round(list_cosine_distance(CAST(v.embedding AS DOUBLE[]), p.embedding), 6) AS distance FROM embeddings v
    JOIN documents d ON d.doc_id = v.vec_id JOIN v_probe p ON p.workspace_id = d.source AND p.label = v.label""",
)
def fn_cosine(t: Tables) -> DataFrame:
    rows = t("embeddings").join(t("documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("workspace_id")), "vec_id")
    probes = t("v_probe").select("workspace_id", "label", F.col("embedding").alias("probe"))
    return rows.join(probes, ["workspace_id", "label"]).select(
        "vec_id", F.round(dense.cosine_distance(F.col("embedding"), F.col("probe")), 6).alias("distance")
    )


@query(
    "fn_binary_quantize",
    """SELECT vec_id, array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END for x in embedding], '') AS bits,
      CAST(len([x for x in embedding if x > 0]) AS BIGINT) AS n_set FROM embeddings""",
)
def fn_binary_quantize(t: Tables) -> DataFrame:
    return t("embeddings").select(
        "vec_id", dense.sign_bits(F.col("embedding")).alias("bits"),
        F.aggregate(dense.sign_words(F.col("embedding")), F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w)).alias("n_set"),
    )


@query(
    "fn_dcg",
    """SELECT query_id, n, round(dcg, 6) AS dcg, round((SELECT sum(1 / log2(i + 1)) FROM unnest(range(1, least(10, n) + 1)) q(i)), 6) AS ideal
    FROM (SELECT query_id, CAST(count(*) AS BIGINT) AS n, sum(1 / log2(rank + 1)) AS dcg FROM v_top_dense WHERE rank <= 10 GROUP BY 1)""",
)
def fn_dcg(t: Tables) -> DataFrame:
    return top_dense(t, 10).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(1.0 / F.log2(F.col("rank") + 1)), 6).alias("dcg")
    ).withColumn("ideal", F.round(ev.ideal_dcg(10, F.col("n")), 6))
