"""Golden suites: coverage, minimums, seed contracts, execution reports and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.integrity import error_codes

# Fixed values.
LAYERS = ["retrieval", "evidence", "answer"]
MODALITIES = ["pdf", "image", "mixed"]
TASK_TYPES = [
    "chart", "cross_document_compare", "exact_fact", "image", "method_constraints", "no_answer", "table",
]
MINIMUM_CASES = 20
MINIMUM_PER_LAYER = 6
MINIMUM_REFUSALS = 2
WANTED = (
    [("layer", v) for v in LAYERS] + [("modality", v) for v in MODALITIES]
    + [("task_type", v) for v in TASK_TYPES] + [("disposition", "refuse")]
)


def coverage(cases: DataFrame) -> DataFrame:
    """Zero-filled counts per wanted (dimension, value); one pass over the cases."""
    counters = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"), F.lit(v).alias("value"),
                F.count_if(F.col(d) == v).alias("n"),
            )
            for d, v in WANTED
        ]
    )
    return cases.agg(counters.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def checks(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """One-row frame of aggregates to (rule, passed) rows."""
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("passed")) for n, c in rules])
    return df.agg(rows.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def minimums(cases: DataFrame) -> DataFrame:
    def distinct(column: str, wanted: list[str], where: Column | None = None) -> Column:
        out = None
        for value in wanted:
            hit = F.col(column) == value
            found = F.bool_or(hit if where is None else hit & where)
            out = found if out is None else out & found
        return out

    per_layer = None
    modal = None
    for layer in LAYERS:
        here = F.col("layer") == layer
        enough = F.count_if(here) >= MINIMUM_PER_LAYER
        covers = distinct("modality", MODALITIES, here)
        per_layer = enough if per_layer is None else per_layer & enough
        modal = covers if modal is None else modal & covers
    return checks(
        cases,
        [
            ("minimumCases", F.count(F.lit(1)) >= MINIMUM_CASES),
            ("minimumPerLayer", per_layer),
            ("layersCoverModalities", modal),
            ("allModalities", distinct("modality", MODALITIES)),
            ("allTaskTypes", distinct("task_type", TASK_TYPES)),
            ("minimumRefusals", F.count_if(F.col("disposition") == "refuse") >= MINIMUM_REFUSALS),
        ],
    )


COHORTS = ["visible", "outside", "old_generation", "old_index", "wrong_provider"]


def seed_contract(rows: DataFrame, signatures: DataFrame, token: str) -> DataFrame:
    """Named checks a generated corpus must pass."""
    kinds = ["asset_kind", "unit_kind", "representation_kind", "locator_kind"]
    known = rows.join(
        F.broadcast(signatures.select(*kinds, F.lit(True).alias("_known"))), kinds, "left"
    )
    present = marked = None
    for c in COHORTS:
        here = F.bool_or(F.col("cohort") == c)
        with_token = F.bool_or((F.col("cohort") == c) & F.contains(F.col("text"), F.lit(token)))
        present = here if present is None else present & here
        marked = with_token if marked is None else marked & with_token
    chain_ok = (F.col("index_version") == F.col("current_index")) & (
        F.col("generation") == F.col("current_generation")
    )
    return checks(
        known,
        [
            ("everyCohortPresent", present),
            ("visibleIsLargest", F.count_if(F.col("cohort") == "visible") > F.count(F.lit(1)) / 2),
            ("currentMatchesChain", F.bool_and(~F.col("is_current") | chain_ok)),
            ("poisonCarriesToken", marked),
            ("everySignatureKnown", F.bool_and(F.col("_known").isNotNull())),
        ],
    )


def release_report(cases: DataFrame, executions: DataFrame, answers: DataFrame) -> DataFrame:
    """Status per case rolled up by layer: failed, passed, or waiting for a model answer."""
    ran = executions.groupBy("case_id").agg(F.bool_and("passed").alias("engineered"))
    joined = (
        cases.join(ran, "case_id", "left").join(answers, "case_id", "left")
        .fillna(False, ["engineered", "answered"])
    )
    settled = (F.col("layer") != "answer") | F.col("answered")
    status = (
        F.when(~F.col("engineered"), "failed").when(settled, "passed").otherwise("engineering_pass_model_pending")
    )
    return joined.groupBy(status.alias("status"), "layer").agg(
        F.count(F.lit(1)).alias("n_cases"), F.min("ratio").alias("min_coverage"),
        F.bool_and(F.col("engineered") & settled).alias("release_passed"),
    )


def suite_errors(cases: DataFrame, targets: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Cases whose targets or modality break the suite rules, with the codes."""
    f = fixtures.select(
        "fixture_id", F.col("modality").alias("f_modality"), F.col("page_number").alias("f_page"),
        F.col("page_label").alias("f_label"), "n_regions",
    )
    image = F.col("locator_kind") == "image_region"
    known = F.col("f_modality").isNotNull()
    pdf = known & (F.col("f_modality") == "pdf")
    checked = targets.join(f, "fixture_id", "left").groupBy("case_id").agg(
        F.bool_or(~known).alias("unknown_fixture"),
        F.bool_or(known & (F.col("f_modality") == "image") & ~image).alias("pdf_locator"),
        F.bool_or(pdf & image).alias("image_locator"),
        F.bool_or(pdf & ~image & (F.col("f_label") != F.col("page_label"))).alias("page_label"),
        F.bool_or(pdf & ~image & (F.col("f_page") != F.col("page_number"))).alias("page_number"),
        F.bool_or(
            known & F.col("locator_kind").isin("pdf_region", "image_region") & (F.col("region_index") >= F.col("n_regions"))
        ).alias("region_index"),
        F.bool_or(F.col("f_modality") == "pdf").alias("has_pdf"),
        F.bool_or(F.col("f_modality") == "image").alias("has_image"),
    )
    no = F.lit(False)
    joined = cases.join(checked, "case_id", "left")
    implied = (
        F.when(F.col("has_pdf") & F.col("has_image"), "mixed").when(F.col("has_pdf"), "pdf").when(F.col("has_image"), "image")
    )
    answer = F.col("disposition") == "answer"
    rules = [
        (answer & F.col("has_pdf").isNull() & F.col("unknown_fixture").isNull(), "no_targets"),
        *[(F.coalesce(c, no), c) for c in
          ("unknown_fixture", "pdf_locator", "image_locator", "page_label", "page_number", "region_index")],
        (answer & implied.isNotNull() & (implied != F.col("modality")), "modality"),
        (~answer & ((F.col("layer") != "answer") | (F.col("task_type") != "no_answer")), "refusal_layer"),
    ]
    return joined.withColumn("errors", error_codes(rules)).where(F.col("errors") != "")


def execution_gaps(cases: DataFrame, targets: DataFrame, executions: DataFrame) -> DataFrame:
    """Golden cases not executed exactly once, or executed with other properties."""
    n_targets = targets.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_targets"))
    ran = executions.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("runs"), F.min_by("layer", F.struct("layer", "modality")).alias("x_layer"),
        F.min_by("modality", F.struct("layer", "modality")).alias("x_modality"),
        F.max("target_count").alias("x_targets"), F.bool_and("passed").alias("x_passed"),
        F.bool_and("adapters_ran").alias("x_adapters"),
    )
    wanted = cases.join(n_targets, "case_id", "left").fillna(0, ["n_targets"]).withColumn("_wanted", F.lit(True))
    joined = wanted.join(ran, "case_id", "full_outer")
    there = F.col("runs").isNotNull() & F.col("_wanted").isNotNull()
    rules = [
        (F.col("runs").isNull(), "not_executed"),
        (F.col("_wanted").isNull(), "unknown_case"),
        (F.coalesce(F.col("runs") > 1, F.lit(False)), "duplicate"),
        (there & (F.col("x_layer") != F.col("layer")), "layer"),
        (there & (F.col("x_modality") != F.col("modality")), "modality"),
        (there & (F.col("x_targets") != F.col("n_targets")), "target_count"),
        (there & ~F.col("x_passed"), "failed"),
        (there & (F.col("n_targets") > 0) & ~F.col("x_adapters"), "adapters"),
    ]
    return joined.withColumn("errors", error_codes(rules)).where(F.col("errors") != "")
