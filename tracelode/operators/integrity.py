"""Integrity audits: drift, keys, references, geometry, eligibility, golden suites."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_codes(rules: Sequence[tuple[Column, str]]) -> Column:
    """Comma-joined codes of the rules that hold, in rule order."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules])), ",")


def first_code(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Code of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, code in rules[1:]:
        out = out.when(condition, code)
    return out.otherwise(otherwise)


def differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def region_targets(
    targets: DataFrame, assets: DataFrame, representations: DataFrame, geometry: DataFrame, units: DataFrame
) -> DataFrame:
    """Outcome per selected image region target; the first failed rule wins."""
    a = assets.where(
        (F.col("asset_kind") == "image") & (F.col("status") == "ready") & ~F.col("is_deleted")
    ).select("asset_id", "workspace_id", "current_generation")
    r = representations.where(F.col("representation_kind") == "image_oriented").select(
        "asset_id", "workspace_id", "generation", "representation_id", "object_key", "content_hash"
    )
    g = geometry.select(
        "representation_id", "workspace_id", "width_pixels", "height_pixels", "orientation_applied",
        F.lit(True).alias("_geometry"),
    )
    evidence = (
        units.select("asset_id", "workspace_id", "representation_id", "index_version")
        .join(
            representations.where(F.col("representation_kind").isin("image_ocr", "image_caption")).select(
                "representation_id", "representation_kind", "generation"
            ),
            "representation_id",
        )
        .join(assets.select("asset_id", F.col("current_index").alias("index_version")), ["asset_id", "index_version"])
        .groupBy("asset_id", "workspace_id", "generation")
        .agg(
            F.count_if(F.col("representation_kind") == "image_caption").alias("n_caption"),
            F.count_distinct(
                F.when(F.col("representation_kind") == "image_ocr", F.col("representation_id"))
            ).alias("n_ocr"),
        )
    )
    joined = (
        targets.join(a, ["asset_id", "workspace_id"], "left")
        .join(r, ["asset_id", "workspace_id", "generation"], "left")
        .join(g, ["representation_id", "workspace_id"], "left")
        .join(evidence, ["asset_id", "workspace_id", "generation"], "left")
    )
    invalid = (
        (F.col("width_pixels") < 1) | (F.col("height_pixels") < 1) | ~F.col("orientation_applied")
        | (F.coalesce(F.col("object_key"), F.lit("")) == "") | F.col("content_hash").isNull()
    )
    outcome = first_code(
        [
            (F.col("current_generation").isNull(), "asset_unavailable"),
            (F.col("current_generation") != F.col("generation"), "generation_changed"),
            (F.col("representation_id").isNull() | F.col("_geometry").isNull(), "display_missing"),
            (invalid, "geometry_invalid"),
            (F.coalesce("n_caption", F.lit(0)) != 1, "content_invalid"),
            (F.col("n_ocr") > 1, "representation_ambiguous"),
        ],
        "ok",
    )
    return joined.withColumn("outcome", outcome)


def embedding_drift(
    embeddings: DataFrame, units: DataFrame, representations: DataFrame, locators: DataFrame, assets: DataFrame
) -> DataFrame:
    """Current vectors whose copied scope disagrees with their unit, representation, locator or asset."""
    u = units.select(
        "unit_id", F.col("workspace_id").alias("u_ws"), F.col("asset_id").alias("u_asset"),
        F.col("index_version").alias("u_index"), F.col("representation_id").alias("u_rep"),
        F.col("locator_id").alias("u_loc"),
    )
    r = representations.select(
        F.col("representation_id").alias("u_rep"), F.col("representation_id").alias("r_id"),
        F.col("asset_id").alias("r_asset"), F.col("workspace_id").alias("r_ws"),
        F.col("generation").alias("r_gen"),
    )
    l = locators.select(
        F.col("locator_id").alias("u_loc"), F.col("asset_id").alias("l_asset"),
        F.col("workspace_id").alias("l_ws"), F.col("representation_id").alias("l_rep"),
        F.col("generation").alias("l_gen"),
    )
    a = assets.select(
        F.col("asset_id").alias("u_asset"), F.col("current_generation").alias("a_gen"),
        F.col("current_index").alias("a_index"),
    )
    joined = (
        embeddings.where("is_current").join(u, "unit_id", "left").join(r, "u_rep", "left")
        .join(l, "u_loc", "left").join(a, "u_asset", "left")
    )
    rules = [
        (F.col("u_ws").isNull(), "unit_missing"),
        (differs("workspace_id", "u_ws"), "workspace"),
        (differs("asset_id", "u_asset"), "asset"),
        (differs("index_version", "u_index"), "index"),
        (differs("r_asset", "u_asset"), "representation_asset"),
        (differs("r_ws", "u_ws"), "representation_workspace"),
        (differs("r_gen", "generation"), "representation_generation"),
        (differs("l_asset", "u_asset"), "locator_asset"),
        (differs("l_ws", "u_ws"), "locator_workspace"),
        (differs("l_rep", "r_id"), "locator_representation"),
        (differs("l_gen", "generation"), "locator_generation"),
        (differs("a_gen", "generation"), "asset_generation"),
        (differs("a_index", "index_version"), "asset_index"),
    ]
    return joined.withColumn("drift", error_codes(rules)).where(F.col("drift") != "")


def duplicate_keys(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """How many key values occur more than once, and how many rows they hold."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return groups.agg(
        F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows")
    ).select(F.lit(name).alias("rule"), "n_keys", "n_rows")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Child keys without a parent row, with the number of child rows that use them."""
    missing = child.where(F.col(key).isNotNull()).join(
        parent.select(F.col(parent_key).alias(key)), key, "left_anti"
    )
    return missing.groupBy(F.col(key).cast("string").alias("missing_key")).agg(
        F.count(F.lit(1)).alias("n_rows")
    ).select(F.lit(name).alias("rule"), "missing_key", "n_rows")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def region_errors(x: Column, y: Column, w: Column, h: Column) -> Column:
    return error_codes(
        [
            ((x < 0) | (x > 1), "x"),
            ((y < 0) | (y > 1), "y"),
            ((w <= 0) | (w > 1), "width"),
            ((h <= 0) | (h > 1), "height"),
            (x + w > 1, "x_width"),
            (y + h > 1, "y_height"),
        ]
    )


# Representation kinds a locator kind may point at.
LOCATOR_REPRESENTATIONS = {
    "pdf": ["pdf_text_legacy", "pdf_page_layout", "pdf_ocr", "pdf_table", "pdf_figure"],
    "image": ["image_ocr", "image_caption"],
}


def locator_snapshots(locators: DataFrame, representations: DataFrame) -> DataFrame:
    """Locators that fail version, representation snapshot or kind rules."""
    r = representations.select(
        "representation_id", F.col("workspace_id").alias("r_ws"), F.col("asset_id").alias("r_asset"),
        F.col("generation").alias("r_gen"), "representation_kind",
    )
    pdf = F.col("locator_kind").isin("pdf_page", "pdf_region")
    allowed = F.when(pdf, F.col("representation_kind").isin(LOCATOR_REPRESENTATIONS["pdf"])).otherwise(
        F.col("representation_kind").isin(LOCATOR_REPRESENTATIONS["image"])
    )
    rules = [
        (F.col("locator_version") != 1, "version"),
        (F.col("r_ws").isNull(), "representation_missing"),
        (F.col("r_ws").isNotNull() & differs("r_ws", "workspace_id"), "workspace"),
        (F.col("r_ws").isNotNull() & differs("r_asset", "asset_id"), "asset"),
        (F.col("r_ws").isNotNull() & differs("r_gen", "generation"), "generation"),
        (F.col("r_ws").isNotNull() & ~allowed, "representation_kind"),
    ]
    return locators.join(r, "representation_id", "left").withColumn("errors", error_codes(rules)).where(
        F.col("errors") != ""
    )


def job_eligibility(requests: DataFrame, assets: DataFrame, jobs: DataFrame, units: DataFrame) -> DataFrame:
    """Allowed, or the first reason against it, per (asset, action, role) request."""
    open_job = F.col("status").isin("queued", "running")
    state = jobs.groupBy("asset_id").agg(
        F.bool_or(open_job & (F.col("job_type") == "delete_cleanup")).alias("deleting_now"),
        F.bool_or(open_job & (F.col("job_type") == "ingest")).alias("ingesting"),
        F.bool_or(open_job & (F.col("job_type") == "embed_chunks")).alias("embedding"),
        F.max_by(F.struct("job_type", F.col("status").alias("job_status")), F.struct("queued_at", "job_id")).alias("latest"),
    )
    has_units = units.select("asset_id").distinct().withColumn("has_units", F.lit(True))
    joined = (
        requests.join(assets, "asset_id", "left").join(state, "asset_id", "left").join(has_units, "asset_id", "left")
    )
    no = F.lit(False)
    action = F.col("action")
    gone = F.col("status").isNull()
    deleting = F.col("status").isin("deleting", "deleted")
    failed_delete = (F.col("latest.job_type") == "delete_cleanup") & (F.col("latest.job_status") == "failed")
    rules = [
        (action.isin("delete", "delete_retry") & (F.col("role") != "owner"), "owner_only"),
        (gone, "asset_not_found"),
        ((action != "delete_retry") & deleting, "being_deleted"),
        ((action == "retry") & (F.col("status") != "failed"), "not_failed"),
        ((action == "reindex") & F.col("status").isin("pending_upload", "uploaded", "parsing", "chunking"), "not_ready"),
        ((action == "delete_retry") & (F.col("status") != "deleting"), "no_failed_deletion"),
        (F.coalesce("deleting_now", no), "deletion_running"),
        ((action == "retry") & F.coalesce("ingesting", no), "ingest_running"),
        ((action == "reindex") & F.coalesce("embedding", no), "reindex_running"),
        ((action == "reindex") & F.col("has_units").isNull(), "no_units"),
        ((action == "delete_retry") & ~F.coalesce(failed_delete, no), "no_failed_deletion"),
    ]
    return joined.withColumn("decision", first_code(rules, "allowed"))


# Coordinate spaces of region locators.
PDF_SPACE = "pdf_normalized_top_left_v1"
IMAGE_SPACE = "image_normalized_top_left_v1"


PDF_GEOMETRY = [
    "crop_x0_points", "crop_y0_points", "crop_x1_points", "crop_y1_points", "rotation_degrees", "display_width_points",
    "display_height_points",
]


def ordered_regions(rects: DataFrame, key: str) -> DataFrame:
    """(key, regions): the rectangles of each locator as an array in their order. A locator is one selection on one
    page or image, and its regions are part of its row in the data model."""
    region = F.struct("region_order", "x", "y", "width", "height")
    return rects.groupBy(key).agg(F.sort_array(F.collect_list(region)).alias("regions"))


def typed_locators(located: DataFrame) -> DataFrame:
    """Locators as exactly one filled struct (page, region or image), or none with the codes of broken rules.

    located: locator_kind, page_number, space, the seven columns `PDF_GEOMETRY`, width_pixels, height_pixels,
    orientation_applied, regions (null: none). A whole page has its number only, a region of a page also the space, the
    geometry the selection was made on and its regions in order, a region of an image the image's size.
    """
    kind, regions = F.col("locator_kind"), F.coalesce("regions", F.array().cast("array<struct<region_order:bigint,x:double,y:double,width:double,height:double>>"))
    page, region, image = (kind == k for k in ("pdf_page", "pdf_region", "image_region"))
    none = F.size(regions) == 0
    missing = F.lit(False)
    for name in PDF_GEOMETRY:
        missing = missing | F.col(name).isNull()
    rules = [
        (page & ~none, "page_has_regions"),
        (~page & none, "regions_missing"),
        (region & (F.col("space") != PDF_SPACE), "coordinate_space"),
        (image & (F.col("space") != IMAGE_SPACE), "coordinate_space"),
        (region & missing, "geometry_missing"),
        (image & ~((F.coalesce("width_pixels", F.lit(0)) > 0) & (F.coalesce("height_pixels", F.lit(0)) > 0)), "geometry_missing"),
        (image & ~F.coalesce("orientation_applied", F.lit(False)), "not_oriented"),
    ]
    checked = located.withColumn("errors", error_codes(rules))
    good = F.col("errors") == ""
    geometry = F.struct(
        F.array(*PDF_GEOMETRY[:4]).alias("crop_box_points"), F.col("rotation_degrees"), F.col("display_width_points"),
        F.col("display_height_points"),
    )
    return checked.withColumns({
        "page": F.when(good & page, F.struct(F.col("page_number"))),
        "region": F.when(good & region, F.struct("page_number", "space", geometry.alias("geometry"), regions.alias("regions"))),
        "image": F.when(good & image, F.struct("space", "width_pixels", "height_pixels", regions.alias("regions"))),
    })


def cloned_locators(citations: DataFrame, located: DataFrame, new_id: Column) -> DataFrame:
    """A copy of the locator of each citation (citation_id, locator_id) under a new id, with its details and regions;
    `located` has only locators that are sound."""
    sources = located.withColumnRenamed("locator_id", "source_id")
    return citations.select("citation_id", F.col("locator_id").alias("source_id")).join(sources, "source_id").withColumn("locator_id", new_id)
