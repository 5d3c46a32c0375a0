"""Readers of evaluation cases, study results, manifests, golden suites and binary assets.

Each reader only turns files into typed rows; the rules are separate functions from rows to rows
with an `errors` column, so they run on any table.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.functions import records as rc
from tracelode.functions import text as tx
from tracelode.operators.integrity import error_codes, first_code

# Formats.
STUDY_COLUMNS = [
    "participant_id", "asset_set", "task_id", "task_type", "question", "expected_answer_points",
    "expected_evidence_locations", "workflow", "started_at", "completed_at", "answer", "opened_citations",
    "saved_note", "supported_conclusion", "citation_locator_accuracy", "unsupported_claims", "region_gap",
    "observer_notes",
]
TASK_TYPES = ["exact_fact", "cross_document_compare", "method_constraints", "table", "chart", "image", "no_answer"]
REGION_GAPS = ["none", "table", "chart", "image", "scan", "other"]
PARTICIPANT_KINDS = ["target_user", "developer_self_test", "synthetic_user", "model_agent"]
ORIGINS = ["real_project", "synthetic", "demo"]
CASE_KEYS = {
    "id", "layer", "modality", "taskType", "question", "scope", "expectedDisposition", "expectedAnswerPoints",
    "evidenceTargets",
}
MAX_BYTES = 100 * 1024 * 1024
MIME_TYPES = ["application/pdf", "image/png", "image/jpeg", "image/webp"]

_LABELS = "array<struct<sourceFilename:string,pages:array<string>>>"


def read_eval_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSONL file; Spark splits large files, so lines carry a sortable id, not a counter."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def check_eval_lines(lines: DataFrame) -> DataFrame:
    """line_no, case_id, query, relevant, errors; blank lines are dropped."""
    rows = lines.where(tx.strip(F.col("line")) != "").withColumn("_v", F.expr("try_parse_json(line)"))
    rows = rows.withColumn("_json", F.col("_v").isNotNull() & F.rlike(tx.strip(F.col("line")), F.lit("^\\{[\\s\\S]*\\}$")))

    def text(field: str) -> Column:
        value = F.get_json_object("line", f"$.{field}")
        kind = F.expr(f"schema_of_variant(try_variant_get(_v, '$.{field}', 'variant'))")
        return F.when(F.coalesce(kind, F.lit("")) == "STRING", tx.strip(value))

    parsed = rows.select(
        "line_no", "line", "_v", "_json", text("id").alias("case_id"), text("query").alias("query"),
        F.from_json(F.get_json_object("line", "$.relevant"), _LABELS).alias("relevant"),
    )
    # By type, not by text: "1" is no page number and an object is no list.
    kind = F.coalesce(F.expr("schema_of_variant(try_variant_get(_v, '$.relevant', 'variant'))"), F.lit(""))
    pages_typed = ~F.rlike(kind, F.lit(r"(?i)pages: (?!ARRAY<(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))>)"))
    is_list = F.startswith(kind, F.lit("ARRAY<"))
    pages_ok = F.forall(
        F.col("relevant"),
        lambda r: (F.size(r["pages"]) > 0)
        & F.forall(r["pages"], lambda p: F.coalesce(F.rlike(p, F.lit("^[1-9][0-9]*$")), F.lit(False)))
        & (F.size(F.array_distinct(r["pages"])) == F.size(r["pages"])),
    )
    names = F.transform("relevant", lambda r: F.coalesce(tx.strip(r["sourceFilename"]), F.lit("")))
    firsts = parsed.where(F.coalesce("case_id", F.lit("")) != "").groupBy("case_id").agg(F.min("line_no").alias("_first"))
    known = parsed.join(firsts, "case_id", "left")
    labelled = F.coalesce(F.size("relevant") > 0, F.lit(False)) & is_list
    code = first_code(
        [
            (F.col("_v").isNull(), "invalid_json"),
            (~F.col("_json"), "not_an_object"),
            (F.coalesce("case_id", F.lit("")) == "", "missing_id"),
            (F.col("line_no") > F.col("_first"), "duplicate_id"),
            (F.coalesce("query", F.lit("")) == "", "missing_query"),
            (~labelled, "missing_labels"),
            (F.exists(names, lambda n: n == ""), "invalid_filename"),
            (F.size(F.array_distinct(names)) < F.size(names), "repeated_filename"),
            (~F.coalesce(pages_ok & pages_typed, F.lit(False)), "invalid_pages"),
        ],
        "",
    )
    return known.withColumn("errors", code).select("line_no", "case_id", "query", "relevant", "errors")


def read_study_results(spark: SparkSession, path: str) -> DataFrame:
    """Study CSV with quoted delimiters and line breaks; the header must be the 18 names in order."""
    header = spark.read.text(path).first()
    names = next(csv.reader([header[0].lstrip("﻿")]), []) if header else []
    if names != STUDY_COLUMNS:
        missing = sorted(set(STUDY_COLUMNS) - set(names))
        extra = sorted(set(names) - set(STUDY_COLUMNS))
        raise ValueError(f"study header must be the 18 columns in order (missing={missing}, extra={extra})")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*STUDY_COLUMNS, "_corrupt"]])
    rows = (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"')
        .option("escape", '"').option("enforceSchema", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    )
    return rows.withColumn("line_no", F.monotonically_increasing_id())


def check_study_results(rows: DataFrame, assisted: str = "assisted") -> DataFrame:
    """Study rows with trimmed values, duration and the first broken rule in `errors`."""
    trimmed = rows.select("line_no", *[tx.strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in STUDY_COLUMNS], *(
        ["_corrupt"] if "_corrupt" in rows.columns else []
    ))
    if "_corrupt" not in rows.columns:
        trimmed = trimmed.withColumn("_corrupt", F.lit(None).cast("string"))
    timed = rc.parse_times(trimmed, "started_at", "completed_at")
    key = ["participant_id", "task_id", "workflow"]
    firsts = timed.groupBy(*key).agg(F.min("line_no").alias("_first"))
    code = first_code(
        [
            (F.col("_corrupt").isNotNull(), "width"),
            *[(F.col(c) == "", f"{c}_required") for c in ("participant_id", "asset_set", "task_id")],
            (~F.col("task_type").isin(TASK_TYPES), "task_type"),
            (~F.col("workflow").isin("manual", assisted), "workflow"),
            (F.col("question") == "", "question_required"),
            (F.col("outcome") != "ok", "times"),
            (~F.col("saved_note").isin("yes", "no"), "saved_note"),
            (~F.col("supported_conclusion").isin("pass", "fail"), "supported_conclusion"),
            (~F.col("citation_locator_accuracy").isin("pass", "fail", "not_applicable"), "citation_locator_accuracy"),
            (~F.col("region_gap").isin(REGION_GAPS), "region_gap"),
            (F.col("line_no") > F.col("_first"), "duplicate"),
        ],
        "",
    )
    return timed.join(firsts, key, "left").withColumn("errors", code).drop("_first", "_corrupt", "outcome")


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Participants, assets and tasks of a study manifest as three tables of raw JSON objects."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("j"))
    return {
        part: whole.select(F.explode(F.from_json(F.get_json_object("j", f"$.{part}"), "array<string>")).alias("record"))
        for part in ("participants", "assets", "tasks")
    }


def _exact(keys: list[str]) -> Column:
    have = F.array_sort(F.json_object_keys("record"))
    return F.coalesce(have != F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(True))


def _field(name: str) -> Column:
    return F.get_json_object("record", f"$.{name}")


PARTICIPANT_KEYS = ["participantId", "kind", "targetProfileConfirmed", "qualificationEvidenceId"]
ASSET_KEYS = ["assetId", "modality", "origin", "complexityConfirmed", "qualificationEvidenceId", "sourceGroup", "layoutGroup"]
TASK_KEYS = ["taskId", "taskType", "origin", "scoreable", "assetIds", "qualificationEvidenceId"]


def _blank(name: str) -> Column:
    return tx.strip(F.coalesce(_field(name), F.lit(""))) == ""


def _flag(name: str) -> Column:
    return ~F.coalesce(_field(name), F.lit("")).isin("true", "false")


def check_manifest(records: DataFrame, part: str) -> DataFrame:
    """record_id and error codes of participant, asset or task records (column `record`: JSON text)."""
    if part == "participants":
        key, rules = "participantId", [
            (_exact(PARTICIPANT_KEYS), "fields"), (_blank("participantId") | _blank("qualificationEvidenceId"), "blank"),
            (~F.coalesce(_field("kind"), F.lit("")).isin(PARTICIPANT_KINDS), "kind"), (_flag("targetProfileConfirmed"), "flag"),
            ((_field("kind") != "target_user") & (_field("targetProfileConfirmed") == "true"), "confirmed_non_target"),
        ]
    elif part == "assets":
        key, rules = "assetId", [
            (_exact(ASSET_KEYS), "fields"),
            (_blank("assetId") | _blank("qualificationEvidenceId") | _blank("sourceGroup") | _blank("layoutGroup"), "blank"),
            (~F.coalesce(_field("modality"), F.lit("")).isin("pdf", "image"), "modality"),
            (~F.coalesce(_field("origin"), F.lit("")).isin(ORIGINS), "origin"), (_flag("complexityConfirmed"), "flag"),
            ((_field("origin") != "real_project") & (_field("complexityConfirmed") == "true"), "confirmed_unreal"),
        ]
    else:
        ids = F.from_json(_field("assetIds"), "array<string>")
        key, rules = "taskId", [
            (_exact(TASK_KEYS), "fields"), (_blank("taskId") | _blank("qualificationEvidenceId"), "blank"),
            (~F.coalesce(_field("taskType"), F.lit("")).isin(TASK_TYPES), "task_type"),
            (~F.coalesce(_field("origin"), F.lit("")).isin(ORIGINS), "origin"), (_flag("scoreable"), "flag"),
            (~F.coalesce(F.size(ids) > 0, F.lit(False)), "no_assets"),
            (F.size(F.array_distinct(ids)) < F.size(ids), "repeated_asset"),
            ((_field("origin") != "real_project") & (_field("scoreable") == "true"), "scoreable_unreal"),
        ]
    named = records.withColumn("record_id", tx.strip(_field(key)))
    counts = named.groupBy("record_id").agg(F.count(F.lit(1)).alias("_n"))
    return named.join(counts, "record_id", "left").withColumn(
        "errors", error_codes([*rules, (F.coalesce(F.col("_n") > 1, F.lit(False)), "duplicate_id")])
    ).drop("_n")


def unknown_assets(tasks: DataFrame, assets: DataFrame) -> DataFrame:
    """(record_id, asset_id) of tasks that name an asset the manifest does not hold."""
    named = tasks.select("record_id", F.explode(F.from_json(_field("assetIds"), "array<string>")).alias("asset_id"))
    known = assets.select(tx.strip(_field("assetId")).alias("asset_id")).distinct()
    return named.join(known, "asset_id", "left_anti")


def check_golden_cases(records: DataFrame) -> DataFrame:
    """record_id and error codes of golden cases (column `record`: JSON text); unknown fields are errors."""
    keys = F.json_object_keys("record")
    extra = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in sorted(CASE_KEYS)]))) > 0
    points = F.from_json(_field("expectedAnswerPoints"), "array<string>")
    targets = F.from_json(_field("evidenceTargets"), "array<string>")
    selected = F.from_json(F.get_json_object("record", "$.scope.selectedFixtureIds"), "array<string>")
    mode = F.get_json_object("record", "$.scope.mode")
    refuse = _field("expectedDisposition") == "refuse"

    def empty(c: Column) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) == 0

    rules = [
        (F.coalesce(extra, F.lit(True)), "unknown_field"),
        (_blank("id") | _blank("question"), "blank"),
        (~F.coalesce(_field("layer"), F.lit("")).isin("retrieval", "evidence", "answer"), "layer"),
        (~F.coalesce(_field("taskType"), F.lit("")).isin(TASK_TYPES), "task_type"),
        (~F.coalesce(mode, F.lit("")).isin("all_ready", "selected"), "scope_mode"),
        ((mode == "all_ready") & ~empty(selected), "scope_selection"),
        ((mode == "selected") & empty(selected), "scope_empty"),
        (refuse & ((_field("layer") != "answer") | (_field("taskType") != "no_answer")), "refusal_layer"),
        (refuse & (~empty(points) | ~empty(targets)), "refusal_evidence"),
        (~refuse & empty(targets), "targets_required"),
        (~refuse & (_field("layer") == "answer") & empty(points), "points_required"),
        (~refuse & (_field("layer") != "answer") & ~empty(points), "points_not_allowed"),
    ]
    return records.withColumn("record_id", _field("id")).withColumn("errors", error_codes(rules))


def read_binary_assets(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def detected_mime(content: Column) -> Column:
    """MIME type by leading bytes, null when unknown."""
    head = F.hex(F.substring(content, 1, 16))
    webp = F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250") & F.substring(head, 25, 8).isin(
        "56503820", "5650384C", "56503858"
    )
    return (
        F.when(F.startswith(head, F.lit("255044462D")), "application/pdf")
        .when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png")
        .when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg")
        .when(webp, "image/webp")
    )


def inspect_binary(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """files: content, declared_mime, declared_size -> detected type, size, sha-256, first broken rule."""
    size = F.length("content")
    seen = files.withColumn("detected", detected_mime(F.col("content"))).withColumn("size", size.cast("long")).withColumn(
        "sha256", F.sha2("content", 256)
    )
    code = first_code(
        [
            (~F.lower("declared_mime").isin(MIME_TYPES), "unsupported_type"),
            (F.col("size") == 0, "empty"),
            (F.col("size") > limit, "too_large"),
            (F.col("size") != F.col("declared_size"), "size_mismatch"),
            (~F.col("detected").eqNullSafe(F.lower("declared_mime")), "signature_mismatch"),
        ],
        "ok",
    )
    return seen.withColumn("outcome", code)


def merge_pages(native: DataFrame, ocr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with OCR text where the native text is blank, and one verdict per asset.

    native, ocr: asset_id, page_number, text. OCR only matters for assets with a blank native page;
    then its page set must equal the native one.
    """
    n = native.withColumn("_native", F.lit(True))
    o = ocr.select("asset_id", "page_number", F.col("text").alias("_ocr"), F.lit(True).alias("_has_ocr"))
    joined = n.join(o, ["asset_id", "page_number"], "full_outer")
    blank = tx.strip(F.coalesce("text", F.lit(""))) == ""
    both = joined.withColumn("_blank", F.col("_native") & blank).withColumn("_merged", F.when(blank, F.col("_ocr")).otherwise(F.col("text")))
    repeated = ocr.groupBy("asset_id", "page_number").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("asset_id").distinct()
    verdict = both.groupBy("asset_id").agg(
        F.count("_native").alias("n_pages"), F.min(F.when(F.col("_native"), F.col("page_number"))).alias("_lo"),
        F.max(F.when(F.col("_native"), F.col("page_number"))).alias("_hi"),
        F.count_distinct(F.when(F.col("_native"), F.col("page_number"))).alias("_distinct"),
        F.count_if("_blank").alias("n_blank"),
        F.bool_or(~F.col("_native").eqNullSafe(F.col("_has_ocr"))).alias("_differs"),
        F.bool_or(tx.strip(F.coalesce("_merged", F.lit(""))) != "").alias("_any_text"),
    ).join(repeated.withColumn("_repeated", F.lit(True)), "asset_id", "left")
    code = first_code(
        [
            (F.col("n_pages") == 0, "empty"),
            ((F.col("_lo") != 1) | (F.col("_hi") != F.col("n_pages")) | (F.col("_distinct") != F.col("n_pages")), "page_order"),
            ((F.col("n_blank") > 0) & (F.col("_differs") | F.col("_repeated").isNotNull()), "ocr_incomplete"),
            (~F.col("_any_text"), "no_text"),
        ],
        "ok",
    )
    verdict = verdict.withColumn("outcome", code).select("asset_id", "n_pages", "n_blank", "outcome")
    good = verdict.where("outcome = 'ok'").select("asset_id")
    pages = both.where("_native").join(good, "asset_id", "left_semi").select(
        "asset_id", "page_number", F.when(F.col("_blank"), "ocr").otherwise("layout").alias("source_kind"),
        F.coalesce("_merged", F.lit("")).alias("text"),
    )
    return pages, verdict
