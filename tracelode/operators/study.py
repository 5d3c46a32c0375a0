"""Analytics of a user study: eligibility, workflow summaries, readiness and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.scale import hot_percentiles

# Gate targets.
READINESS = {
    "minimumTargetUsers": ("eligible_participants", 5),
    "minimumQualifiedTaskCompletions": ("completions", 20),
    "minimumComplexPdfAssets": ("pdf_assets", 3),
    "minimumComplexImageAssets": ("image_assets", 2),
    "minimumSourceGroups": ("source_groups", 2),
    "minimumLayoutGroups": ("layout_groups", 2),
}


def ratio(part: Column, whole: Column) -> Column:
    """Null-safe share rounded to six digits, half to even."""
    return F.bround(F.try_divide(part, whole), 6)


def eligible_results(
    results: DataFrame, participants: DataFrame, tasks: DataFrame, task_assets: DataFrame, assets: DataFrame
) -> DataFrame:
    """Results of confirmed target users on real, scoreable tasks whose assets are all real."""
    users = participants.where((F.col("kind") == "target_user") & F.col("confirmed")).select("participant_id")
    unreal = task_assets.join(
        assets.where(F.col("origin") == "real_project").select("asset_id"), "asset_id", "left_anti"
    ).select("task_id")
    good = (
        tasks.where((F.col("origin") == "real_project") & F.col("scoreable")).select("task_id")
        .join(unreal, "task_id", "left_anti")
    )
    return results.join(users, "participant_id", "left_semi").join(good, "task_id", "left_semi")


def first_completions(results: DataFrame) -> DataFrame:
    """First result per participant and task in input order."""
    return results.groupBy("participant_id", "task_id").agg(
        F.min_by(F.struct("line_no", "task_type", "workflow"), "line_no").alias("r")
    ).select("participant_id", "task_id", "r.line_no", "r.task_type", "r.workflow")


def workflow_summary(results: DataFrame) -> DataFrame:
    """Counts, rates and the median duration per workflow."""
    scored = F.col("locator_accuracy") != "not_applicable"
    none = F.col("task_type") == "no_answer"
    gap = F.col("region_gap") != "none"
    base = results.groupBy("workflow").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if("supported").alias("n_supported"),
        F.count_if(scored).alias("n_scored"),
        F.count_if(F.col("locator_accuracy") == "pass").alias("n_accurate"),
        F.count_if(scored & F.col("opened_citation")).alias("n_opened"),
        F.count_if("saved_note").alias("n_notes"),
        F.count_if("has_unsupported").alias("n_unsupported"),
        F.count_if(none).alias("n_no_answer"),
        F.count_if(none & F.col("supported") & ~F.col("has_unsupported")).alias("n_refused"),
        F.count_if(none & F.col("has_unsupported")).alias("n_fabricated"),
        F.count_if(gap).alias("n_gaps"),
    )
    gaps = (
        results.where(gap).groupBy("workflow", "region_gap").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("workflow").agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("region_gap", "_n"))),
                    lambda g: F.concat(g["region_gap"], F.lit(":"), g["_n"].cast("string")),
                ),
                ",",
            ).alias("gap_breakdown")
        )
    )
    median = hot_percentiles(results, ["workflow"], "duration_seconds", {"median_seconds": "median"})
    return (
        base.join(median, "workflow", "left").join(gaps, "workflow", "left")
        .withColumn("median_seconds", F.bround("median_seconds", 6))
        .withColumn("supported_rate", ratio(F.col("n_supported"), F.col("n_tasks")))
        .withColumn("accuracy_rate", ratio(F.col("n_accurate"), F.col("n_scored")))
        .withColumn("open_rate", ratio(F.col("n_opened"), F.col("n_scored")))
        .withColumn("note_rate", ratio(F.col("n_notes"), F.col("n_tasks")))
        .withColumn("refusal_rate", ratio(F.col("n_refused"), F.col("n_no_answer")))
        .withColumn("gap_rate", ratio(F.col("n_gaps"), F.col("n_tasks")))
        .withColumn("gap_breakdown", F.coalesce("gap_breakdown", F.lit("")))
    )


def reduction(manual: Column, assisted: Column) -> Column:
    return F.when(manual > 0, F.bround((manual - assisted) / manual, 6))


def paired_reduction(results: DataFrame, assisted: str = "assisted") -> DataFrame:
    """Per participant: how much shorter the assisted median is than the manual one."""
    medians = hot_percentiles(
        results, ["participant_id", "workflow"], "duration_seconds", {"m": "median"}
    )
    wide = medians.groupBy("participant_id").agg(
        F.max(F.when(F.col("workflow") == "manual", F.col("m"))).alias("manual"),
        F.max(F.when(F.col("workflow") == assisted, F.col("m"))).alias("assisted"),
    )
    return wide.withColumn("reduction", reduction(F.col("manual"), F.col("assisted"))).where(
        F.col("reduction").isNotNull()
    )


def median_of(df: DataFrame, column: str, name: str) -> DataFrame:
    one = hot_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], column, {name: "median"})
    return one.select(F.bround(name, 6).alias(name))


def eligibility(results: DataFrame, task_assets: DataFrame, assets: DataFrame) -> DataFrame:
    """One row of readiness counts from eligible results."""
    done = results.select("participant_id", "task_id").distinct()
    people = done.agg(
        F.count(F.lit(1)).alias("completions"), F.count_distinct("participant_id").alias("eligible_participants")
    )
    used = (
        task_assets.join(done.select("task_id").distinct(), "task_id", "left_semi").select("asset_id").distinct()
        .join(assets.where((F.col("origin") == "real_project") & F.col("complex")), "asset_id")
    )
    things = used.agg(
        F.count(F.lit(1)).alias("complex_assets"),
        F.count_if(F.col("modality") == "pdf").alias("pdf_assets"),
        F.count_if(F.col("modality") == "image").alias("image_assets"),
        F.count_distinct("source_group").alias("source_groups"),
        F.count_distinct("layout_group").alias("layout_groups"),
    )
    return people.join(things)


def _gate_rows(df: DataFrame, rows: list[tuple[str, Column, float, Column]]) -> DataFrame:
    structs = [
        F.struct(
            F.lit(name).alias("gate"), observed.cast("double").alias("observed"),
            F.lit(float(target)).alias("target"), status.alias("status"),
        )
        for name, observed, target, status in rows
    ]
    return df.select(F.explode(F.array(*structs)).alias("g")).select("g.*")


def readiness_gates(
    results: DataFrame, task_assets: DataFrame, assets: DataFrame, assisted: str = "assisted"
) -> DataFrame:
    """Minimum checks, quality gates and the overall verdict as (gate, observed, target, status).

    Every input here is a one-row aggregate, so the joins below are of single rows.
    """
    counts = eligibility(results, task_assets, assets)
    summary = workflow_summary(results)
    picked = summary.agg(
        F.max(F.when(F.col("workflow") == "manual", F.col("median_seconds"))).alias("manual_median"),
        *[
            F.max(F.when(F.col("workflow") == assisted, F.col(c))).alias(c)
            for c in ("median_seconds", "supported_rate", "accuracy_rate", "n_fabricated", "n_no_answer", "n_gaps")
        ],
    )
    firsts = first_completions(results).agg(
        F.count_if(F.col("task_type").isin("table", "chart")).alias("n_table_chart"),
        F.count_if(F.col("task_type") == "no_answer").alias("n_none"),
    )
    one = counts.join(picked).join(firsts)
    passes = [F.coalesce(F.col(c) >= t, F.lit(False)) for c, t in READINESS.values()]
    ready = passes[0]
    for p in passes[1:]:
        ready = ready & p
    one = one.withColumn("_ready", ready)

    def gated(ok: Column, when: Column | None = None) -> Column:
        usable = F.col("_ready") if when is None else F.col("_ready") & when
        return F.when(usable & F.coalesce(ok, F.lit(False)), "pass").when(usable, "fail").otherwise("not_evaluable")

    zero = F.lit(0)
    cut = reduction(F.col("manual_median"), F.col("median_seconds"))
    quality = [
        ("minimumTableOrChartTasks", F.col("n_table_chart"), 2, gated(F.col("n_table_chart") >= 2)),
        ("minimumNoAnswerTasks", F.col("n_none"), 2, gated(F.col("n_none") >= 2)),
        ("assistedSupportedConclusionRate", F.col("supported_rate"), 0.8, gated(F.col("supported_rate") >= 0.8)),
        ("assistedCitationLocatorAccuracyRate", F.col("accuracy_rate"), 0.9, gated(F.col("accuracy_rate") >= 0.9)),
        ("assistedNoAnswerFabrications", F.coalesce("n_fabricated", zero), 0,
         gated(F.coalesce("n_fabricated", zero) <= 0, F.coalesce("n_no_answer", zero) > 0)),
        ("medianDurationReductionRate", cut, 0.25, gated(cut >= 0.25)),
        ("minimumRegionGapTasks", F.coalesce("n_gaps", zero), 3, gated(F.coalesce("n_gaps", zero) >= 3)),
    ]
    rows = [
        (name, F.col(c), t, F.when(F.col(c) >= t, "pass").otherwise("not_evaluable"))
        for name, (c, t) in READINESS.items()
    ] + quality
    every = quality[0][3] == "pass"
    for q in quality[1:]:
        every = every & (q[3] == "pass")
    overall = F.when(~F.col("_ready"), "not_evaluable").when(every, "pass").otherwise("fail")
    rows.append(("overall", F.lit(None), 0, overall))
    return _gate_rows(one, rows)
