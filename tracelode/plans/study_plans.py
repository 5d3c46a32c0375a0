"""User study analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators import study
from tracelode.plans.registry import query
from tracelode.sources.views import Tables

ELIGIBLE = """el AS (SELECT r.* FROM v_task_result r
  JOIN v_participant p ON p.participant_id = r.participant_id AND p.kind = 'target_user' AND p.confirmed
  JOIN v_study_task k ON k.task_id = r.task_id AND k.origin = 'real_project' AND k.scoreable
  WHERE NOT EXISTS (SELECT 1 FROM v_study_task_asset x JOIN v_study_asset a ON a.asset_id = x.asset_id
    WHERE x.task_id = r.task_id AND a.origin <> 'real_project'))"""
SUMMARY = """sm AS (SELECT workflow, count(*) AS n_tasks, count(*) FILTER (WHERE supported) AS n_supported,
  count(*) FILTER (WHERE locator_accuracy <> 'not_applicable') AS n_scored, count(*) FILTER (WHERE locator_accuracy = 'pass') AS n_accurate,
  count(*) FILTER (WHERE locator_accuracy <> 'not_applicable' AND opened_citation) AS n_opened,
  count(*) FILTER (WHERE saved_note) AS n_notes, count(*) FILTER (WHERE has_unsupported) AS n_unsupported,
  count(*) FILTER (WHERE task_type = 'no_answer') AS n_no_answer,
  count(*) FILTER (WHERE task_type = 'no_answer' AND supported AND NOT has_unsupported) AS n_refused,
  count(*) FILTER (WHERE task_type = 'no_answer' AND has_unsupported) AS n_fabricated,
  count(*) FILTER (WHERE region_gap <> 'none') AS n_gaps, round(median(duration_seconds), 6) AS median_seconds FROM el GROUP BY 1)"""
PAIRED = """pr AS (SELECT participant_id, round((m - s) / m, 6) AS reduction, m, s FROM (SELECT participant_id,
  median(duration_seconds) FILTER (WHERE workflow = 'manual') AS m, median(duration_seconds) FILTER (WHERE workflow = 'assisted') AS s FROM el GROUP BY 1)
  WHERE m > 0 AND s IS NOT NULL)"""
COUNTS = """ct AS (SELECT (SELECT count(DISTINCT participant_id) FROM el) AS eligible_participants,
  (SELECT count(*) FROM (SELECT DISTINCT participant_id, task_id FROM el)) AS completions, count(*) AS complex_assets,
  count(*) FILTER (WHERE modality = 'pdf') AS pdf_assets, count(*) FILTER (WHERE modality = 'image') AS image_assets,
  count(DISTINCT source_group) AS source_groups, count(DISTINCT layout_group) AS layout_groups
  FROM v_study_asset WHERE origin = 'real_project' AND complex AND asset_id IN (SELECT asset_id FROM v_study_task_asset WHERE task_id IN (SELECT task_id FROM el)))"""
NAMES = ["n_tasks", "n_supported", "n_scored", "n_accurate", "n_opened", "n_notes", "n_unsupported",
         "n_no_answer", "n_refused", "n_fabricated", "n_gaps"]


def eligible(t: Tables) -> DataFrame:
    return study.eligible_results(
        t("v_task_result"), t("v_participant"), t("v_study_task"), t("v_study_task_asset"), t("v_study_asset")
    )


@query(
    "win_first_completion",
    "SELECT participant_id, task_id, min(line_no) AS line_no, arg_min(workflow, line_no) AS workflow FROM v_task_result GROUP BY 1, 2",
)
def win_first_completion(t: Tables) -> DataFrame:
    return study.first_completions(t("v_task_result")).select("participant_id", "task_id", "line_no", "workflow")


@query(
    "agg_workflow_summary",
    f"""WITH {ELIGIBLE}, {SUMMARY}, g AS (SELECT workflow, string_agg(region_gap || ':' || n, ',' ORDER BY region_gap) AS gap_breakdown
      FROM (SELECT workflow, region_gap, count(*) AS n FROM el WHERE region_gap <> 'none' GROUP BY 1, 2) GROUP BY 1)
    SELECT sm.workflow, {", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in NAMES)}, median_seconds,
      round(n_supported / n_tasks, 6) AS supported_rate, round(n_accurate / nullif(n_scored, 0), 6) AS accuracy_rate,
      round(n_opened / nullif(n_scored, 0), 6) AS open_rate, round(n_notes / n_tasks, 6) AS note_rate,
      round(n_refused / nullif(n_no_answer, 0), 6) AS refusal_rate, round(n_gaps / n_tasks, 6) AS gap_rate,
      coalesce(g.gap_breakdown, '') AS gap_breakdown FROM sm LEFT JOIN g ON g.workflow = sm.workflow""",
)
def agg_workflow_summary(t: Tables) -> DataFrame:
    return study.workflow_summary(eligible(t))


@query(
    "agg_paired_reduction",
    f"""WITH {ELIGIBLE}, {PAIRED} SELECT CAST(participant_id AS BIGINT) AS participant_id, reduction FROM pr
    UNION ALL SELECT CAST(-1 AS BIGINT), round(median(reduction), 6) FROM pr""",
)
def agg_paired_reduction(t: Tables) -> DataFrame:
    pairs = study.paired_reduction(eligible(t)).select("participant_id", "reduction")
    overall = study.median_of(pairs, "reduction", "reduction").select(
        F.lit(-1).cast("long").alias("participant_id"), "reduction"
    )
    return pairs.unionByName(overall)


@query(
    "agg_eligibility",
    f"WITH {ELIGIBLE}, {COUNTS} SELECT CAST(COLUMNS(*) AS BIGINT) FROM ct",
)
def agg_eligibility(t: Tables) -> DataFrame:
    return study.eligibility(eligible(t), t("v_study_task_asset"), t("v_study_asset"))


def _ready(gate: str, column: str, target: int) -> str:
    return (
        f"SELECT '{gate}' AS gate, CAST({column} AS DOUBLE) AS observed, CAST({target} AS DOUBLE) AS target, "
        f"CASE WHEN {column} >= {target} THEN 'pass' ELSE 'not_evaluable' END AS status FROM ct"
    )


def _gate(gate: str, value: str, target: float, test: str, when: str = "true") -> str:
    return (
        f"SELECT '{gate}', CAST({value} AS DOUBLE), CAST({target} AS DOUBLE), CASE WHEN ready AND {when} AND "
        f"coalesce({test}, false) THEN 'pass' WHEN ready AND {when} THEN 'fail' ELSE 'not_evaluable' END FROM al"
    )


_QUALITY = [
    _gate("minimumTableOrChartTasks", "tc", 2, "tc >= 2"),
    _gate("minimumNoAnswerTasks", "na", 2, "na >= 2"),
    _gate("assistedSupportedConclusionRate", "sr", 0.8, "sr >= 0.8"),
    _gate("assistedCitationLocatorAccuracyRate", "ar", 0.9, "ar >= 0.9"),
    _gate("assistedNoAnswerFabrications", "nf", 0, "nf <= 0", "nn > 0"),
    _gate("medianDurationReductionRate", "rd", 0.25, "rd >= 0.25"),
    _gate("minimumRegionGapTasks", "ng", 3, "ng >= 3"),
]


@query(
    "agg_readiness_gates",
    f"""WITH {ELIGIBLE}, {SUMMARY}, {COUNTS}, fc AS (SELECT participant_id, task_id, arg_min(task_type, line_no) AS tt FROM el GROUP BY 1, 2),
    al AS (SELECT eligible_participants >= 5 AND completions >= 20 AND pdf_assets >= 3 AND image_assets >= 2 AND source_groups >= 2 AND layout_groups >= 2 AS ready,
      (SELECT count(*) FILTER (WHERE tt IN ('table', 'chart')) FROM fc) AS tc, (SELECT count(*) FILTER (WHERE tt = 'no_answer') FROM fc) AS na,
      (SELECT round(n_supported / n_tasks, 6) FROM sm WHERE workflow = 'assisted') AS sr,
      (SELECT round(n_accurate / nullif(n_scored, 0), 6) FROM sm WHERE workflow = 'assisted') AS ar,
      coalesce((SELECT n_fabricated FROM sm WHERE workflow = 'assisted'), 0) AS nf, coalesce((SELECT n_no_answer FROM sm WHERE workflow = 'assisted'), 0) AS nn,
      coalesce((SELECT n_gaps FROM sm WHERE workflow = 'assisted'), 0) AS ng,
      (SELECT round((m.median_seconds - s.median_seconds) / m.median_seconds, 6) FROM sm m, sm s WHERE m.workflow = 'manual' AND s.workflow = 'assisted' AND m.median_seconds > 0) AS rd FROM ct),
    gates AS ({" UNION ALL ".join(_ready(g, c, n) for g, (c, n) in study.READINESS.items())} UNION ALL {" UNION ALL ".join(_QUALITY)})
    SELECT * FROM gates UNION ALL SELECT 'overall', NULL, 0.0, CASE WHEN NOT (SELECT ready FROM al) THEN 'not_evaluable'
      WHEN (SELECT bool_and(status = 'pass') FROM gates) THEN 'pass' ELSE 'fail' END""",
)
def agg_readiness_gates(t: Tables) -> DataFrame:
    return study.readiness_gates(eligible(t), t("v_study_task_asset"), t("v_study_asset"))
