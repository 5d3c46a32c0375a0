"""Lexical search, fusion, evaluation of strategies, and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as tx
from tracelode.operators import aggregates as ag
from tracelode.operators import dense, fusion, graph
from tracelode.operators import evaluation as ev
from tracelode.operators import lexical as lx
from tracelode.operators import postings as pb
from tracelode.plans.dense_plans import DIMS, rank_long, stored
from tracelode.plans.registry import query
from tracelode.scale import fits
from tracelode.sources.views import Tables

K = fusion.TOP_K
FOUND_ROWS = 500_000  # of results of about 100 bytes, as they are broadcast


def few(t: Tables, found: DataFrame, k: int) -> DataFrame:
    """`found`, at most k rows per question: broadcast unless questions are many, so that what it is joined with stays where it is."""
    return F.broadcast(found) if fits(t("v_query").select("query_id"), FOUND_ROWS // k) else found


@query(
    "top_lexical_terms",
    """SELECT query_id, array_to_string(list_distinct_ordered, ' ') AS terms, CAST(len(list_distinct_ordered) AS BIGINT) AS n_terms FROM (
      SELECT query_id, [t for t, i in w if list_position(w, t) = i] AS list_distinct_ordered
      FROM (SELECT query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM v_query))""",
)
def top_lexical_terms(t: Tables) -> DataFrame:
    terms = tx.lexical_terms(F.col("text"))
    return t("v_query").select(
        "query_id", F.array_join(terms, " ").alias("terms"), F.size(terms).cast("long").alias("n_terms")
    )


@query(
    "top_lexical_simple",
    f"SELECT query_id, unit_id, asset_id, location_key, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM v_top_simple WHERE rank <= {fusion.CANDIDATE_K}",
)
def top_lexical_simple(t: Tables) -> DataFrame:
    hits = pb.simple_hits(t("v_query"), t("v_runs"), t("v_slots"), fusion.CANDIDATE_K)
    return rank_long(pb.top_units(hits, t("v_slots"), fusion.CANDIDATE_K)).withColumn("score", F.round("score", 6))


# Words of a text with their places, as a text search vector keeps them: 256 places a word, none beyond 16383.
SPOTS = """spots AS (SELECT workspace_id, unit_id, w AS term, i AS place FROM (
    SELECT workspace_id, unit_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT workspace_id, unit_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM v_visible))
    QUALIFY row_number() OVER (PARTITION BY unit_id, w ORDER BY i) <= 256)"""
# With alternatives every place of a word is the shortest cover of the question at that place.
COVERS = f"""{SPOTS}, covers AS (SELECT x.query_id, s.unit_id, 0.1 * count(DISTINCT least(s.place, 16383)) AS density
    FROM (SELECT query_id, workspace_id, unnest(terms) AS term FROM (SELECT DISTINCT query_id, workspace_id, terms FROM v_lexed)) x
    JOIN spots s ON s.workspace_id = x.workspace_id AND s.term = x.term GROUP BY 1, 2)"""
RANKED = """d AS (SELECT *, row_number() OVER (PARTITION BY query_id, asset_id, location_key ORDER BY score DESC, unit_id) AS lr FROM sc)
    SELECT query_id, unit_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM d WHERE lr = 1) WHERE rank <= """
SHARE = "CASE WHEN len(terms) = 1 THEN 1.0 ELSE len([x for x in terms if contains(body, x)]) / len(terms) END"


def words_and_runs(t: Tables) -> DataFrame:
    return t("v_postings").unionByName(t("v_runs"))


def top_ranked(t: Tables, hits: DataFrame, k: int, slots: str = "v_slots") -> DataFrame:
    return rank_long(pb.top_units(hits, t(slots), k)).select("query_id", "unit_id", F.round("score", 6).alias("score"), "rank")


@query(
    "top_lexical_latin",
    f"""WITH {COVERS}, sc AS (SELECT l.*, round({SHARE} + density, 9) AS score FROM v_lexed l JOIN covers c ON c.query_id = l.query_id AND c.unit_id = l.unit_id),
    {RANKED}{K}""",
)
def top_lexical_latin(t: Tables) -> DataFrame:
    return top_ranked(t, pb.latin_hits(t("v_query"), words_and_runs(t), t("v_slots"), K), K)


# Covers of all words of a question: for every place the latest start that still has them all, each start once.
EVERY = f"""asked AS (SELECT query_id, workspace_id, list_distinct(regexp_extract_all(text, '[a-z]+')) AS terms FROM (
      SELECT query_id, workspace_id, lower(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+', 0)) AS text FROM v_query) WHERE text <> ''),
    {SPOTS}, merged AS (SELECT a.query_id, len(a.terms) AS n, s.unit_id, s.term, least(s.place, 16383) AS place FROM asked a JOIN spots s
      ON s.workspace_id = a.workspace_id AND list_contains(a.terms, s.term)),
    ends AS (SELECT e.query_id, e.unit_id, e.n, e.place AS p, b.term, max(b.place) AS last FROM merged e JOIN merged b
      ON b.query_id = e.query_id AND b.unit_id = e.unit_id AND b.place <= e.place GROUP BY ALL),
    starts AS (SELECT query_id, unit_id, p, min(last) AS start FROM ends GROUP BY query_id, unit_id, p, n HAVING count(*) = n),
    shortest AS (SELECT query_id, unit_id, start, min(p) AS p FROM starts GROUP BY ALL),
    noise AS (SELECT c.query_id, c.unit_id, c.start, any_value(c.p) - c.start - (count(*) - 1) AS noise FROM shortest c JOIN merged m
      ON m.query_id = c.query_id AND m.unit_id = c.unit_id AND m.place BETWEEN c.start AND c.p GROUP BY 1, 2, 3),
    covers AS (SELECT query_id, unit_id, sum(0.1 / (1 + noise)) AS density FROM noise GROUP BY 1, 2)"""


@query(
    "top_lexical_every",
    f"""WITH {EVERY}, sc AS (SELECT c.query_id, c.unit_id, v.asset_id, v.location_key, round(1.0 + density, 9) AS score
      FROM covers c JOIN v_visible v ON v.unit_id = c.unit_id), {RANKED}{K}""",
)
def top_lexical_every(t: Tables) -> DataFrame:
    """Two words that must both occur, ranked by how close together they stand."""
    asked = t("v_query").withColumn("text", F.lower(F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0))).where("text <> ''")
    return top_ranked(t, pb.latin_hits(asked, words_and_runs(t), t("v_slots"), K, every=True), K)


HITS = """hits AS (SELECT *, (SELECT count(*) FROM unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) w(x) WHERE list_contains(terms, x)) AS n_hits FROM v_lexed)"""


@query(
    "top_lexical_match_count",
    f"WITH {HITS} SELECT query_id, CAST(count(*) AS BIGINT) AS n_units FROM hits WHERE n_hits > 0 GROUP BY 1",
)
def top_lexical_match_count(t: Tables) -> DataFrame:
    return pb.match_counts(t("v_query"), t("v_postings"))


# Trigrams of the words of a text, in order.
GRAMS = """flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')])"""
# Word similarity: the best stretch of the text's trigrams, from one that the question has to another. A trigram counts
# as a different one in a stretch that starts at i if it stood last before i.
SIMILAR = f"""cq AS (SELECT query_id, workspace_id, list_distinct({GRAMS.format(c="text")}) AS q FROM v_mixed_query WHERE item_id % 2 = 0 AND length(text) > 1),
    cu AS (SELECT workspace_id, unit_id, x, i, coalesce(lag(i) OVER (PARTITION BY unit_id, x ORDER BY i), 0) AS before FROM (
      SELECT workspace_id, unit_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM (SELECT workspace_id, unit_id, {GRAMS.format(c="text")} AS g FROM v_mixed_unit))),
    cl AS (SELECT unit_id, list(before ORDER BY i) AS b FROM cu GROUP BY 1),
    meets AS (SELECT c.query_id, len(c.q) AS n, u.unit_id, u.i, u.before FROM cu u JOIN (SELECT query_id, workspace_id, q, unnest(q) AS x FROM cq) c
      ON c.workspace_id = u.workspace_id AND c.x = u.x),
    ml AS (SELECT query_id, unit_id, n, list(i ORDER BY i) AS spot, list(before ORDER BY i) AS b FROM meets GROUP BY 1, 2, 3),
    starts AS (SELECT m.query_id, m.unit_id, m.n, m.spot[k] AS i, m.spot[k:] AS ends, m.b[k:] AS mb, c.b AS ub
      FROM (SELECT *, unnest(range(1, len(spot) + 1)) AS k FROM ml) m JOIN cl c ON c.unit_id = m.unit_id),
    fresh AS (SELECT query_id, unit_id, n, i, ends, list_filter(ends, lambda e: ub[e] < i) AS shared,
      list_filter(range(i, list_last(ends) + 1), lambda x: ub[x] < i) AS seen FROM starts),
    marks AS (SELECT query_id, unit_id, n, i, x, 0 AS kind, row_number() OVER (PARTITION BY query_id, unit_id, i ORDER BY x) AS c FROM (
      SELECT query_id, unit_id, n, i, unnest(seen) AS x FROM fresh)),
    best AS (SELECT s.query_id, s.unit_id, max(s.shared / (s.n + m.c - s.shared)) AS similarity FROM (
        SELECT query_id, unit_id, n, i, unnest(shared) AS x, generate_subscripts(shared, 1) AS shared FROM fresh) s
      JOIN marks m ON m.query_id = s.query_id AND m.unit_id = s.unit_id AND m.i = s.i AND m.x = s.x GROUP BY 1, 2),
    alike AS (SELECT c.query_id, v.unit_id, v.asset_id, v.location_key, round(coalesce(b.similarity, 0), 9) AS score
      FROM cq c JOIN v_mixed_unit v ON v.workspace_id = c.workspace_id LEFT JOIN best b ON b.query_id = c.query_id AND b.unit_id = v.unit_id)"""
MIXED_SPOTS = SPOTS.replace("v_visible", "v_mixed_unit")
MIXED = f"""{SIMILAR}, {MIXED_SPOTS},
    lexed AS (SELECT q.query_id, q.workspace_id, q.terms, v.unit_id, v.asset_id, v.location_key, replace(lower(v.text), 'ß', 'ss') AS body
      FROM (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS terms FROM v_mixed_query WHERE item_id % 2 = 1) q
      JOIN v_mixed_unit v ON v.workspace_id = q.workspace_id),
    covers AS (SELECT x.query_id, s.unit_id, 0.1 * count(DISTINCT least(s.place, 16383)) AS density
      FROM (SELECT query_id, workspace_id, unnest(terms) AS term FROM (SELECT DISTINCT query_id, workspace_id, terms FROM lexed)) x
      JOIN spots s ON s.workspace_id = x.workspace_id AND s.term = x.term GROUP BY 1, 2),
    sc AS (SELECT * FROM alike UNION ALL SELECT l.query_id, l.unit_id, asset_id, location_key, round({SHARE} + density, 9) FROM lexed l
      JOIN covers c ON c.query_id = l.query_id AND c.unit_id = l.unit_id)"""


@query("top_lexical_cjk", f"WITH {SIMILAR}, sc AS (SELECT * FROM alike), {RANKED}{K}")
def top_lexical_cjk(t: Tables) -> DataFrame:
    asked = t("v_mixed_query").where("item_id % 2 = 0 AND length(text) > 1")
    return top_ranked(t, pb.similar_hits(asked, t("v_mixed_slots"), K), K, "v_mixed_slots")


@query("top_lexical_production", f"WITH {MIXED}, {RANKED}{K}")
def top_lexical_production(t: Tables) -> DataFrame:
    """Latin and CJK questions in one plan, each by its rule."""
    hits = pb.production_hits(t("v_mixed_query"), t("v_mixed_postings"), t("v_mixed_slots"), K)
    return top_ranked(t, hits, K, "v_mixed_slots")


def bm25_pages(t: Tables, k: int) -> DataFrame:
    return pb.page_best(pb.bm25_hits(t("v_query"), t("v_postings"), t("v_slots"), k), t("v_slots"), k)


@query(
    "top_bm25",
    "SELECT query_id, asset_id, CAST(page_number AS BIGINT) AS page_number, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM v_top_bm25 WHERE rank <= 24",
)
def top_bm25(t: Tables) -> DataFrame:
    return rank_long(bm25_pages(t, 24)).select(
        "query_id", "asset_id", F.col("page_number").cast("long").alias("page_number"), F.round("score", 6).alias("score"), "rank"
    )


@query(
    "win_page_best",
    "SELECT query_id, asset_id, CAST(page_number AS BIGINT) AS page_number, round(max(score), 6) AS score FROM v_bm25 GROUP BY 1, 2, 3",
)
def win_page_best(t: Tables) -> DataFrame:
    hits = pb.bm25_hits(t("v_query"), t("v_postings"), t("v_slots"), None)
    return pb.page_best(hits, t("v_slots"), None).select(
        "query_id", "asset_id", F.col("page_number").cast("long").alias("page_number"), F.round("score", 6).alias("score")
    )


def hybrid_dense(t: Tables, k: int) -> DataFrame:
    return dense.top_locations(t("v_hquery"), t("v_dense"), DIMS, k, stored=stored(t))


def hybrid_lexical(t: Tables, k: int) -> DataFrame:
    return pb.top_units(pb.simple_hits(t("v_hquery"), t("v_runs"), t("v_slots"), k), t("v_slots"), k)


def hybrid(t: Tables, k: int = K, candidates: int = fusion.CANDIDATE_K) -> DataFrame:
    n = max(k, candidates)
    columns = ["query_id", "asset_id", "location_key", "unit_id", "rank"]
    return fusion.rrf(
        hybrid_dense(t, n).select(*columns), hybrid_lexical(t, n).select(*columns), ["asset_id", "location_key"], k
    )


@query(
    "top_rrf_location",
    "SELECT query_id, asset_id, location_key, unit_id, round(score, 9) AS score, CAST(rank AS BIGINT) AS rank FROM v_hybrid",
)
def top_rrf_location(t: Tables) -> DataFrame:
    return rank_long(hybrid(t)).withColumn("score", F.round("score", 9))


def pages(ranked: DataFrame, t: Tables) -> DataFrame:
    """First occurrence of each page in rank order, ranked again."""
    placed = few(t, ranked.select("query_id", "unit_id", "rank"), 24).join(
        t("v_visible").select("unit_id", "asset_id", "page_number"), "unit_id"
    )
    first = placed.groupBy("query_id", "asset_id", "page_number").agg(F.min("rank").alias("_r"))
    return first.withColumn("rank", lx.rank_of(["query_id"], F.col("_r"))).drop("_r")


def fused_pages(t: Tables) -> DataFrame:
    bm = bm25_pages(t, 24).join(t("v_hquery").select("query_id"), "query_id", "left_semi")
    columns = ["query_id", "asset_id", "page_number", "rank"]
    return fusion.rrf(
        pages(hybrid_dense(t, 24), t).select(*columns), bm.select(*columns), ["asset_id", "page_number"], K
    )


RRF_PAGES = """rp AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asset_id, page_number) AS BIGINT) AS rank FROM (
  SELECT query_id, asset_id, page_number, round(sum(1.0 / (60 + rank)), 12) AS score FROM (
    SELECT query_id, asset_id, page_number, rank FROM v_hpages UNION ALL
    SELECT b.query_id, b.asset_id, b.page_number, b.rank FROM v_top_bm25 b JOIN v_hquery h ON h.query_id = b.query_id WHERE b.rank <= 24) GROUP BY 1, 2, 3))"""


@query(
    "top_rrf_page",
    f"WITH {RRF_PAGES} SELECT query_id, asset_id, CAST(page_number AS BIGINT) AS page_number, round(score, 9) AS score, rank FROM rp WHERE rank <= {K}",
)
def top_rrf_page(t: Tables) -> DataFrame:
    return rank_long(fused_pages(t)).select(
        "query_id", "asset_id", F.col("page_number").cast("long").alias("page_number"), F.round("score", 9).alias("score"), "rank"
    )


@query(
    "win_rank",
    "SELECT query_id, asset_id, CAST(page_number AS BIGINT) AS page_number, rank FROM v_hpages",
)
def win_rank(t: Tables) -> DataFrame:
    return rank_long(pages(hybrid_dense(t, 24), t)).withColumn("page_number", F.col("page_number").cast("long"))


@query(
    "top_hybrid",
    f"""SELECT 'dense' AS strategy, query_id, unit_id, CAST(rank AS BIGINT) AS rank FROM v_hdense WHERE rank <= {K}
    UNION ALL SELECT 'hybrid', query_id, unit_id, CAST(rank AS BIGINT) FROM v_hybrid""",
)
def top_hybrid(t: Tables) -> DataFrame:
    def named(df: DataFrame, name: str) -> DataFrame:
        return rank_long(df).select(F.lit(name).alias("strategy"), "query_id", "unit_id", "rank")

    return named(hybrid_dense(t, K), "dense").unionByName(named(hybrid(t), "hybrid"))


def relevant_pages(t: Tables) -> DataFrame:
    return t("v_hquery").select("query_id", "workspace_id", "label").join(
        t("v_dense").select("workspace_id", "label", "asset_id", "page_number"), ["workspace_id", "label"]
    ).select("query_id", "asset_id", "page_number").distinct()


def case_sql(ranked: str, name: str) -> str:
    """SQL of the per-case metrics of one ranked page list."""
    return f"""SELECT '{name}' AS strategy, n.query_id, coalesce(m.hits, 0) / n.n AS recall, coalesce(1 / m.first, 0.0) AS mrr,
      coalesce(m.dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM unnest(range(1, least({K}, n.n) + 1)) q(i)) AS ndcg,
      CASE WHEN m.hits > 0 THEN 1.0 ELSE 0.0 END AS hit
    FROM (SELECT query_id, count(*) AS n FROM v_relevant GROUP BY 1) n LEFT JOIN (
      SELECT x.query_id, count(*) AS hits, min(x.rank) AS first, sum(1 / log2(x.rank + 1)) AS dcg FROM {ranked} x
      JOIN v_relevant r ON r.query_id = x.query_id AND r.asset_id = x.asset_id AND r.page_number = x.page_number WHERE x.rank <= {K} GROUP BY 1) m
    ON m.query_id = n.query_id"""


def cases_of(t: Tables, ranked: DataFrame, name: str) -> DataFrame:
    return ev.case_metrics(ranked, relevant_pages(t), ["asset_id", "page_number"], K).withColumn("strategy", F.lit(name))


ROUNDED = "round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, CAST(hit AS DOUBLE) AS hit"
MEANS = """SELECT strategy, CAST(count(*) AS BIGINT) AS n_cases, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr,
  round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit FROM c GROUP BY 1"""


@query("eval_dense", f"WITH c AS ({case_sql('v_hpages', 'dense')}) SELECT query_id, {ROUNDED} FROM c")
def eval_dense(t: Tables) -> DataFrame:
    return cases_of(t, pages(hybrid_dense(t, 24), t), "dense").select(
        "query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "hit"
    )


@query(
    "eval_compare",
    f"""WITH {RRF_PAGES}, c AS ({case_sql('v_hpages', 'dense')} UNION ALL {case_sql('v_top_bm25', 'bm25')} UNION ALL {case_sql('rp', 'rrf')}) {MEANS}""",
)
def eval_compare(t: Tables) -> DataFrame:
    cases = (
        cases_of(t, pages(hybrid_dense(t, 24), t), "dense")
        .unionByName(cases_of(t, bm25_pages(t, 24), "bm25"))
        .unionByName(cases_of(t, fused_pages(t), "rrf"))
    )
    return ev.mean_metrics(cases, ["strategy"])


PRODUCTION = f"{case_sql('(SELECT * FROM v_hpages)', 'dense')} UNION ALL {case_sql('v_hybrid_pages', 'hybrid')}"


def production_cases(t: Tables) -> DataFrame:
    return cases_of(t, pages(hybrid_dense(t, 24), t), "dense").unionByName(
        cases_of(t, pages(hybrid(t), t), "hybrid")
    )


@query("eval_production", f"WITH c AS ({PRODUCTION}) {MEANS}")
def eval_production(t: Tables) -> DataFrame:
    return ev.mean_metrics(production_cases(t), ["strategy"])


P95 = """pl AS (SELECT strategy, max(v) FILTER (WHERE rn = ceil(0.95 * c)) AS p95 FROM (SELECT strategy, duration_ms AS v,
  row_number() OVER (PARTITION BY strategy ORDER BY duration_ms) AS rn, count(*) OVER (PARTITION BY strategy) AS c FROM v_metric) GROUP BY 1)"""
STABLE = """st AS (SELECT count(*) FILTER (WHERE error_type IS NOT NULL) = 0 AND
  count(*) FILTER (WHERE error_type IS NULL AND result_hash <> md5(CAST(case_id AS VARCHAR))) = 0 AS ok FROM v_metric)"""


@query(
    "agg_strategy_verdict",
    f"""WITH c AS ({PRODUCTION}), m AS ({MEANS}), {P95}, {STABLE},
    x AS (SELECT (SELECT recall FROM m WHERE strategy = 'hybrid') - (SELECT recall FROM m WHERE strategy = 'dense') AS rg,
      (SELECT hit FROM m WHERE strategy = 'hybrid') - (SELECT hit FROM m WHERE strategy = 'dense') AS hg,
      (SELECT p95 FROM pl WHERE strategy = 'hybrid') AS hp, (SELECT p95 FROM pl WHERE strategy = 'dense') AS dp, (SELECT ok FROM st) AS ok)
    SELECT round(rg, 6) AS recall_gain, round(hg, 6) AS hit_gain, round(hp / dp, 6) AS p95_ratio, round(hp - dp, 6) AS p95_increase,
      rg >= 0.03 AND hg >= 0.03 AS quality_passed, hp <= dp * 2 AND hp - dp <= 100 AS latency_passed, ok AS concurrency_passed,
      rg >= 0.03 AND hg >= 0.03 AND hp <= dp * 2 AND hp - dp <= 100 AND ok AS eligible FROM x""",
)
def agg_strategy_verdict(t: Tables) -> DataFrame:
    metrics = ev.mean_metrics(production_cases(t), ["strategy"])
    latencies = ag.distribution(t("v_metric"), "duration_ms", {"p95": 0.95}, ["strategy"])
    return ev.verdict(metrics, latencies, stability(t))


def stability(t: Tables) -> DataFrame:
    expected = t("v_metric").select("case_id").distinct().withColumn("result_hash", F.md5(F.col("case_id").cast("string")))
    return ag.run_stability(t("v_metric"), expected)


@query(
    "set_intersect_hits",
    f"""SELECT h.query_id, CAST(count(*) AS BIGINT) AS n_retrieved, CAST(count(r.asset_id) AS BIGINT) AS n_shared FROM v_hpages h
    LEFT JOIN v_relevant r ON r.query_id = h.query_id AND r.asset_id = h.asset_id AND r.page_number = h.page_number WHERE h.rank <= {K} GROUP BY 1""",
)
def set_intersect_hits(t: Tables) -> DataFrame:
    keys = ["query_id", "asset_id", "page_number"]
    retrieved = pages(hybrid_dense(t, 24), t).where(F.col("rank") <= K).select(*keys)
    shared = retrieved.intersect(relevant_pages(t).select(*keys)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_shared"))
    return retrieved.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_retrieved")).join(
        shared, "query_id", "left"
    ).fillna(0, ["n_shared"])


def evidence(t: Tables) -> DataFrame:
    """Hybrid results with everything citations and prompts need, joined late by unit."""
    return few(t, hybrid(t).select("query_id", "unit_id", "rank"), K).join(t("v_visible"), "unit_id")


@query(
    "top_context",
    """SELECT h.query_id, string_agg('[' || h.rank || '] ' || v.title || ', ' || v.locator_kind || chr(10) || substr(v.text, 1, 4000), chr(10) || chr(10) ORDER BY h.rank) AS context
    FROM v_hybrid h JOIN v_visible v ON v.unit_id = h.unit_id GROUP BY 1""",
)
def top_context(t: Tables) -> DataFrame:
    return fusion.context(evidence(t))


@query(
    "top_citations",
    """SELECT h.query_id, CAST(h.rank - 1 AS BIGINT) AS citation_index, h.unit_id, v.asset_id, v.asset_kind, v.title, substr(v.text, 1, 800) AS excerpt,
      v.representation_id, v.generator_version, CAST(v.current_generation AS BIGINT) AS generation, CAST(v.index_version AS BIGINT) AS index_version
    FROM v_hybrid h JOIN v_visible v ON v.unit_id = h.unit_id""",
)
def top_citations(t: Tables) -> DataFrame:
    return fusion.citations(evidence(t)).withColumns(
        {"generation": F.col("generation").cast("long"), "index_version": F.col("index_version").cast("long")}
    )


@query(
    "top_refusal",
    """SELECT q.query_id, 'no_retrieval_results' AS reason FROM v_query q WHERE NOT EXISTS (SELECT 1 FROM v_hybrid h WHERE h.query_id = q.query_id)
      AND q.item_id % 3 <> 0""",
)
def top_refusal(t: Tables) -> DataFrame:
    targets = t("v_query").where(F.col("item_id") % 3 == 0)
    return fusion.refused(t("v_query"), hybrid(t), targets).select("query_id", "reason")


# Each question continues the conversation whose number equals its item number.
@query(
    "top_prompt_messages",
    """WITH RECURSIVE up AS (SELECT thread_id, arg_max(message_id, turn) AS leaf FROM v_message WHERE turn % 4 <> 3 OR turn < 4 GROUP BY 1),
    walk AS (SELECT u.thread_id, m.message_id, m.parent_id, m.role, m.content, m.status, 0 AS d FROM up u JOIN v_message m ON m.message_id = u.leaf
      UNION ALL SELECT w.thread_id, m.message_id, m.parent_id, m.role, m.content, m.status, d + 1 FROM walk w JOIN v_message m ON m.message_id = w.parent_id),
    ctx AS (SELECT h.query_id, string_agg('[' || h.rank || '] ' || v.title || ', ' || v.locator_kind || chr(10) || substr(v.text, 1, 4000), chr(10) || chr(10) ORDER BY h.rank) AS context
      FROM v_hybrid h JOIN v_visible v ON v.unit_id = h.unit_id GROUP BY 1),
    parts AS (SELECT c.query_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS o, 'system' AS role, 'Answer from the evidence.' AS content FROM ctx c
      UNION ALL SELECT c.query_id, 1, -w.d, w.role, w.content FROM ctx c JOIN walk w ON w.thread_id = CAST(c.query_id AS BIGINT) AND w.status = 'completed'
      UNION ALL SELECT c.query_id, 2, 0, 'user', 'Question:' || chr(10) || q.text || chr(10) || chr(10) || 'Asset evidence context:' || chr(10) || c.context FROM ctx c JOIN v_query q ON q.query_id = c.query_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k, o) - 1 AS BIGINT) AS ordinal, role, md5(content) AS content_hash FROM parts""",
)
def top_prompt_messages(t: Tables) -> DataFrame:
    leaves = t("v_message").where("turn % 4 <> 3 OR turn < 4").groupBy("thread_id").agg(
        F.max_by("message_id", "turn").alias("leaf_id")
    )
    lineage = graph.lineage(t("v_message"), leaves)
    contexts = fusion.context(evidence(t)).join(t("v_query").select("query_id", "text"), "query_id")
    return graph.prompt_messages(contexts, lineage, t("v_message"), "Answer from the evidence.").select(
        "query_id", "ordinal", "role", F.md5("content").alias("content_hash")
    )
