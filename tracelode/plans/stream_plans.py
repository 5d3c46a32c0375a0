"""Streams drained over the given tables, each checked against its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators import units as ub
from tracelode.plans.registry import query
from tracelode.sources.views import VIEW_SQL, Tables
from tracelode.streaming import jobs as st


def stream_of(t: Tables, table: str) -> DataFrame:
    return st.read_stream(t.spark, t.folder, f"{table}.parquet", t(table).schema)


def event_stream(t: Tables) -> DataFrame:
    """Events with a time zone aware time, as watermarks need."""
    return stream_of(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def shaped(t: Tables, view: str) -> DataFrame:
    """A derived table computed over the event stream."""
    return t.spark.sql(VIEW_SQL[view].replace("FROM events", "FROM {events}"), events=event_stream(t))


@query("st_job_counts", "SELECT status, CAST(count(*) AS BIGINT) AS n FROM v_job GROUP BY 1")
def st_job_counts(t: Tables) -> DataFrame:
    return st.drain_updates(st.job_counts(shaped(t, "v_job")), ["status"], "counts")


@query(
    "st_latest_job",
    """SELECT asset_id, arg_max(job_id, (queued_at, job_id)) AS job_id, arg_max(status, (queued_at, job_id)) AS status, arg_max(job_type, (queued_at, job_id)) AS job_type,
      CAST(count(*) - 1 AS BIGINT) AS n_superseded FROM v_job GROUP BY 1""",
)
def st_latest_job(t: Tables) -> DataFrame:
    return st.drain_updates(st.latest_jobs(shaped(t, "v_job")), ["asset_id"], "latest")


def window_sql(size: int, slide: int) -> str:
    return f"""SELECT strftime(make_timestamp((epoch_us(ts) // {slide * 1000000} - k) * {slide * 1000000}), '%Y-%m-%d %H:%M:%S') AS window_start, {size} AS seconds, strategy, outcome,
      CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(duration_ms * 100) AS BIGINT)) AS BIGINT) AS total_hundredths, CAST(count(*) FILTER (WHERE duration_ms <= 10) AS BIGINT) AS n_within_10
      FROM v_metric, (SELECT unnest(range(0, {size // slide})) AS k) GROUP BY ALL"""


@query("st_metric_windows", f"{window_sql(300, 300)} UNION ALL {window_sql(3600, 1200)}")
def st_metric_windows(t: Tables) -> DataFrame:
    keys = ["window_start", "window_end", "strategy", "outcome"]

    def drained(size: str, slide: str | None, seconds: int) -> DataFrame:
        out = st.drain_updates(st.metric_windows(shaped(t, "v_metric"), size, slide), keys, "windows")
        return out.select(
            F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.lit(seconds).alias("seconds"),
            "strategy", "outcome", "n", "total_hundredths", "n_within_10",
        )

    return drained("5 minutes", None, 300).unionByName(drained("1 hour", "20 minutes", 3600))


STREAM_ASSETS = """SELECT user_id AS asset_id, user_id % 10 = 3 AS is_deleted, CASE WHEN user_id % 4 = 1 THEN max(event_id) END AS latest_job_id
  FROM events WHERE user_id % 11 <> 2 GROUP BY 1, 2"""


@query(
    "st_lease_timeout",
    f"""WITH x AS (SELECT job_id, asset_id, attempt FROM v_job WHERE status = 'running' AND (started_at IS NULL
        OR epoch_us(started_at) + 900000000 <= (SELECT max(epoch_us(started_at)) FROM v_job WHERE status = 'running' AND started_at IS NOT NULL) // 1000 * 1000 - 600000000))
    SELECT x.job_id, x.asset_id, CASE WHEN dead THEN 'cancelled' ELSE 'queued' END AS status, CAST(x.attempt + CASE WHEN dead THEN 0 ELSE 1 END AS BIGINT) AS attempt FROM (
      SELECT x.*, a.asset_id IS NULL OR a.is_deleted OR coalesce(a.latest_job_id <> x.job_id, false) AS dead FROM x LEFT JOIN ({STREAM_ASSETS}) a ON a.asset_id = x.asset_id) x""",
)
def st_lease_timeout(t: Tables) -> DataFrame:
    expired = st.drain_append(st.expired_leases(shaped(t, "v_job")), "lease")
    unstarted = st.drain_append(st.never_started(shaped(t, "v_job")), "unstarted")
    return st.recover(expired.unionByName(unstarted), t.sql(STREAM_ASSETS))


# Each assistant turn arrives as a start, one delta per half of its text, and mostly an end. Threads of over 1,000 turns share
# message numbers with the next one, so the stream is keyed by both.
REPLY = """SELECT concat(conv_id, ':', turn) AS message_id, e.event_order, e.name, e.data,
  timestamp_micros((conv_id * 7200 + turn * 60 + e.event_order) * 1000000) AS ts
  FROM {conversations} LATERAL VIEW explode(array(
    named_struct('event_order', 0, 'name', 'meta', 'data', '{{}}'),
    named_struct('event_order', 1, 'name', 'delta', 'data', CASE WHEN (conv_id + turn) % 11 = 3 THEN ' ' ELSE substring(text, 1, CAST(length(text) / 2 AS INT)) END),
    named_struct('event_order', 2, 'name', 'delta', 'data', CASE WHEN (conv_id + turn) % 11 = 3 THEN '' ELSE substring(text, CAST(length(text) / 2 AS INT) + 1) END),
    named_struct('event_order', 3, 'name', CASE WHEN (conv_id + turn) % 9 = 0 THEN 'error' WHEN (conv_id + turn) % 7 = 0 THEN 'meta' ELSE 'done' END, 'data', 'model unavailable'))) AS e
  WHERE role = 'assistant'"""


@query(
    "st_answer_assembly",
    """WITH m AS (SELECT conv_id * 1000 + turn AS message_id, conv_id * 7200 + turn * 60 + 3 AS last, trim(regexp_replace(CASE WHEN (conv_id + turn) % 11 = 3 THEN '' ELSE text END, '^\\s+|\\s+$', '', 'g')) AS body, conv_id + turn AS k
      FROM conversations WHERE role = 'assistant')
    SELECT message_id, CASE WHEN k % 9 = 0 THEN 'failed' WHEN k % 7 = 0 THEN 'interrupted' WHEN body = '' THEN 'failed' ELSE 'completed' END AS status,
      md5(CASE WHEN k % 9 = 0 THEN 'model unavailable' ELSE body END) AS answer_hash FROM m WHERE k % 9 = 0 OR k % 7 <> 0 OR last + 300 <= (SELECT max(last) FROM m)""",
)
def st_answer_assembly(t: Tables) -> DataFrame:
    events = t.spark.sql(REPLY, conversations=stream_of(t, "conversations"))
    ended = st.drain_append(st.answers(events, "0 seconds"), "answers")
    number = F.split_part("message_id", F.lit(":"), F.lit(1)).cast("long") * 1000 + F.split_part("message_id", F.lit(":"), F.lit(2)).cast("long")
    return ended.select(number.alias("message_id"), "status", F.md5("answer").alias("answer_hash"))


@query(
    "st_incremental_ingest",
    """SELECT CAST(doc_id AS VARCHAR) AS asset_id, CAST(count(*) * CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_units,
      CAST(sum(char_end - char_start) * CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_chars, true AS embedded FROM v_unit_base GROUP BY doc_id""",
)
def st_incremental_ingest(t: Tables) -> DataFrame:
    """Every third asset has a second page with the same text."""
    pages = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    records = stream_of(t, "documents").select(
        F.col("doc_id").cast("string").alias("asset_id"), (F.lit(1) + F.col("doc_id") % 2).alias("generation"),
        F.explode(pages).alias("page_number"), "text",
    )
    units = st.ingest_stream(records, ub.hashing_embedder(32), 32)
    return units.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum(F.col("char_end") - F.col("char_start")).alias("n_chars"),
        F.bool_and(F.size("embedding") == 32).alias("embedded"),
    )
