"""Identifiers, times, JSON, markers, event text and prompt text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.functions import text as tx

# Fixed values.
RESERVED_KEYS = ["source", "embeddingProvider", "embeddingModel", "embeddingDimensions", "embeddingVersion", "chunkSize"]
OFFSET_PATTERN = "([+-]\\d{2}:?\\d{2}|Z)$"


def stable_uuid(namespace: str, value: Column) -> Column:
    """md5 of "namespace:value" written as a UUID."""
    digest = F.md5(F.concat(F.lit(f"{namespace}:"), value))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def iso_utc(ts: Column) -> Column:
    """UTC ISO-8601 with offset; fractional seconds only when there are any."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    micros = F.date_format(utc, "SSSSSS")
    base = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def has_offset(text: Column) -> Column:
    return F.rlike(text, F.lit(OFFSET_PATTERN))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def share(part: Column, whole: Column) -> Column:
    return F.bround(F.try_divide(part, whole), 6)


def canonical_json_sha(*fields: tuple[str, Column]) -> Column:
    """sha-256 of one JSON object with sorted keys and no blanks, in an array."""
    ordered = sorted(fields, key=lambda f: f[0])
    return F.sha2(F.concat(F.lit("["), F.to_json(F.struct(*[c.alias(n) for n, c in ordered])), F.lit("]")), 256)


def job_snapshot(base: Column, extension: Column) -> Column:
    """Config map of a job; null when the extension overrides a reserved key."""
    clash = F.arrays_overlap(F.map_keys(extension), F.array(*[F.lit(k) for k in RESERVED_KEYS]))
    return F.when(~clash, F.map_concat(base, extension))


def snapshot_mismatch(snapshot: Column, expected: dict[str, Column]) -> Column:
    """True when a key present in the snapshot disagrees with the running configuration."""
    out = F.lit(False)
    for key, value in expected.items():
        out = out | F.coalesce(F.try_element_at(snapshot, F.lit(key)) != value, F.lit(False))
    return out


def citation_marks(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """[n] marks of each answer with the citation they point at, null when there is none.

    answers: message_id, answer. citations: message_id, citation_index, citation_id.
    """
    marks = answers.select(
        "message_id", F.posexplode(F.regexp_extract_all("answer", F.lit("\\[(\\d+)\\]"), 1)).alias("mark_order", "n")
    ).withColumn("number", F.expr("try_cast(n AS BIGINT)"))
    known = citations.select("message_id", (F.col("citation_index") + 1).alias("number"), "citation_id")
    return marks.join(known, ["message_id", "number"], "left").drop("n")


_EVENT = T.StructType([T.StructField("name", T.StringType()), T.StructField("data", T.StringType())])


def stream_blocks(stream: Column) -> Column:
    """Complete blocks of an event stream; the part after the last blank line is the remainder."""
    return F.split(stream, "\r?\n\r?\n")


def stream_events(df: DataFrame, key: str, stream: str) -> DataFrame:
    """One row per complete event with data: key, event_order, name, data, valid JSON or not."""
    blocks = df.select(key, stream_blocks(F.col(stream)).alias("_b"))
    complete = blocks.select(
        key, F.posexplode(F.slice("_b", 1, F.size("_b") - 1)).alias("event_order", "_block")
    )
    lines = F.split("_block", "\r?\n")

    def values(field: str) -> Column:
        picked = F.filter(lines, lambda l: F.rlike(l, F.lit(f"^{field}(:|$)")))
        return F.transform(picked, lambda l: F.regexp_replace(l, f"^{field}:? ?", ""))

    names, data = values("event"), values("data")
    return (
        complete.where(F.size(data) > 0)
        .select(
            key, "event_order",
            F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit("message")).alias("name"),
            F.array_join(data, "\n").alias("data"),
        )
        .withColumn("is_json", single_json("data"))
    )


def single_json(column: str) -> Column:
    """True when the text is exactly one JSON value.

    The parser stops after a first value, so the text is read as the only item of an array.
    """
    items = F.expr(f"try_variant_get(try_parse_json(concat('[', {column}, ']')), '$', 'array<variant>')")
    return F.coalesce(F.size(items) == 1, F.lit(False))


def stream_remainder(stream: Column) -> Column:
    return F.element_at(stream_blocks(stream), -1)


BLOCK_HEADER = "^\\[(\\d+)\\] (.+), (pdf_page|pdf_region|image_region)$"


def prompt_evidence(df: DataFrame, key: str, context: str) -> DataFrame:
    """Numbered evidence blocks of a prompt: key, position, number, title, kind, excerpt, valid."""
    blocks = F.split(context, "\n\n(?=\\[\\d+\\] )")
    rows = df.select(key, F.posexplode(blocks).alias("_pos", "_block"))
    cut = F.locate("\n", F.col("_block"))
    header = F.when(cut > 0, F.expr("substring(_block, 1, locate('\n', _block) - 1)")).otherwise(F.col("_block"))
    excerpt = F.when(cut > 0, F.expr("substring(_block, locate('\n', _block) + 1)")).otherwise("")
    out = rows.select(
        key, (F.col("_pos") + 1).alias("position"), tx.strip(excerpt).alias("excerpt"),
        F.expr("try_cast(NULL AS BIGINT)").alias("_n"), header.alias("_h"),
    )
    return out.select(
        key, "position",
        F.regexp_extract("_h", BLOCK_HEADER, 1).cast("string").alias("number"),
        F.regexp_extract("_h", BLOCK_HEADER, 2).alias("title"),
        F.regexp_extract("_h", BLOCK_HEADER, 3).alias("kind"),
        "excerpt",
    ).withColumn("valid", (F.col("number") == F.col("position").cast("string")) & (F.col("excerpt") != ""))


def table_markdown(cells: Column) -> Column:
    """Cell matrix to markdown; null unless two rows have at least two filled cells."""
    trimmed = F.transform(cells, lambda row: F.transform(row, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    rows = F.filter(trimmed, lambda row: F.exists(row, lambda c: c != ""))
    full = F.filter(rows, lambda row: F.size(F.filter(row, lambda c: c != "")) >= 2)
    width = F.array_max(F.transform(rows, lambda row: F.size(row)))

    def line(row: Column) -> Column:
        padded = F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(
        F.array(line(F.element_at(rows, 1))), F.array(rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)
    )
    return F.when((F.size(rows) >= 2) & (F.size(full) >= 2), F.array_join(lines, "\n"))


def mask_ranges(text: Column, ranges: Column) -> Column:
    """Blank out half-open ranges (structs s, e), keeping line breaks."""
    return F.aggregate(
        ranges,
        text,
        lambda acc, r: F.concat(
            F.substring(acc, F.lit(1), r["s"]),
            F.regexp_replace(F.substring(acc, r["s"] + 1, r["e"] - r["s"]), "[^\n\r]", " "),
            F.substring(acc, r["e"] + 1, F.length(acc)),
        ),
    )


def parse_times(df: DataFrame, start: str, end: str) -> DataFrame:
    """Durations of ISO times with a code when an offset is missing or the order is wrong."""
    s, e = F.expr(f"try_to_timestamp({start})"), F.expr(f"try_to_timestamp({end})")
    code = (
        F.when(s.isNull() | e.isNull(), "invalid_time")
        .when(~has_offset(F.col(start)) | ~has_offset(F.col(end)), "offset_required")
        .when(e <= s, "not_after_start")
        .otherwise("ok")
    )
    return df.withColumn("outcome", code).withColumn(
        "seconds", F.when(F.col("outcome") == "ok", seconds_between(s, e))
    )
