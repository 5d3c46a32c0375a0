"""Relational operators over workspaces, notes, tags, citations and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as tx
from tracelode.scale import hot_ordinal


def source_available(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """`source_available`: the asset still exists and is not deleted."""
    known = assets.select("asset_id", F.lit(True).alias("_known"), "is_deleted")
    return rows.join(known, "asset_id", "left").withColumn(
        "source_available", F.col("_known").isNotNull() & ~F.coalesce(F.col("is_deleted"), F.lit(True))
    ).drop("_known", "is_deleted")


def note_title(title: Column) -> Column:
    trimmed = tx.strip(title)
    return F.coalesce(F.when(trimmed != "", trimmed), F.lit("Untitled note"))


def note_cards(notes: DataFrame, sources: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per note: shown title, first source, number of tags and first tag."""
    first = sources.groupBy("note_id").agg(F.min_by("asset_id", "source_order").alias("first_asset"))
    bound = tags.groupBy("note_id").agg(
        F.count(F.lit(1)).alias("n_tags"), F.min("tag").alias("first_tag")
    )
    return (
        notes.withColumn("title", note_title(F.col("title")))
        .join(first, "note_id", "left")
        .join(bound, "note_id", "left")
        .withColumn("n_tags", F.coalesce("n_tags", F.lit(0)))
    )


def note_search(notes: DataFrame, tags: DataFrame, needle: str, wanted: list[str]) -> DataFrame:
    """Case-insensitive substring on title or body, and any of the wanted tags (none = all)."""
    low = needle.lower()
    found = notes.where(
        F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(low))
        | F.contains(F.lower(F.coalesce("body", F.lit(""))), F.lit(low))
    )
    if not wanted:
        return found
    return found.join(tags.where(F.col("tag").isin(wanted)).select("note_id"), "note_id", "left_semi")


def locator_summary(kind: Column, page: Column, regions: Column) -> Column:
    count = F.when(regions > 1, F.concat(regions.cast("string"), F.lit(" regions"))).otherwise("region")
    label = F.concat(F.lit("PDF p."), page.cast("string"))
    return (
        F.when(kind == "pdf_page", label)
        .when(kind == "pdf_region", F.concat(label, F.lit(" · "), count))
        .otherwise(F.concat(F.lit("Image · "), count))
    )


def memberships(workspaces: DataFrame, members: DataFrame) -> DataFrame:
    """Active workspaces of every user with the role held there."""
    active = workspaces.where(~F.col("is_archived")).select("workspace_id", "name")
    return members.join(active, "workspace_id").select("user_id", "workspace_id", "name", "role")


def citation_lineage(wanted: DataFrame, citations: DataFrame, messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Wanted citations with their message and thread; `found` is false when any link is missing."""
    linked = (
        citations.join(messages.select("message_id", "thread_id", "workspace_id"),
                       ["message_id", "thread_id", "workspace_id"])
        .join(threads.select("thread_id", "workspace_id"), ["thread_id", "workspace_id"])
        .select("citation_id", "workspace_id", "message_id", "thread_id")
    )
    return wanted.join(linked, ["citation_id", "workspace_id"], "left").withColumn(
        "found", F.col("message_id").isNotNull()
    )


def note_sources_in_order(notes: DataFrame, sources: DataFrame, assets: DataFrame) -> DataFrame:
    """Sources of active notes with their 1-based position; a note may hold any number of them."""
    active = notes.where(~F.col("is_archived")).select("note_id")
    kept = sources.join(active, "note_id", "left_semi")
    placed = hot_ordinal(
        kept, ["note_id"], [F.col("source_order"), F.col("asset_id"), F.col("kind")],
        F.floor(F.col("source_order") / 1_000_000_000), "position",
    )
    return placed.join(assets, "asset_id", "left")


def tag_bindings(tags: DataFrame, note_tags: DataFrame, notes: DataFrame, asset_tags: DataFrame,
                 assets: DataFrame) -> DataFrame:
    """Per tag: how many live notes and assets carry it, with the first and last bound of each.

    The bound ids themselves are the rows of `bound_rows`; a tag may hold any share of them.
    """
    live = bound_rows(note_tags, notes, asset_tags, assets)
    counts = live.groupBy("tag").agg(
        F.count_if(F.col("kind") == "note").alias("n_notes"),
        F.count_if(F.col("kind") == "asset").alias("n_assets"),
        F.min(F.when(F.col("kind") == "note", F.col("bound_id"))).alias("first_note"),
        F.max(F.when(F.col("kind") == "asset", F.col("bound_id"))).alias("last_asset"),
    )
    return tags.join(counts, "tag", "left").fillna(0, ["n_notes", "n_assets"])


def bound_rows(note_tags: DataFrame, notes: DataFrame, asset_tags: DataFrame, assets: DataFrame) -> DataFrame:
    """(tag, kind, bound_id) for active notes and live assets."""
    n = note_tags.join(notes.where(~F.col("is_archived")).select("note_id"), "note_id", "left_semi")
    a = asset_tags.join(assets.where(~F.col("is_deleted")).select("asset_id"), "asset_id", "left_semi")
    return n.select("tag", F.lit("note").alias("kind"), F.col("note_id").alias("bound_id")).unionByName(
        a.select("tag", F.lit("asset").alias("kind"), F.col("asset_id").alias("bound_id"))
    )


def preferred_representation(assets: DataFrame, representations: DataFrame) -> DataFrame:
    """Best text representation of a PDF at its current generation: layout before legacy, then id."""
    rank = F.struct(
        F.when(F.col("representation_kind") == "pdf_page_layout", 0).otherwise(1), F.col("representation_id")
    )
    usable = representations.where(
        F.col("representation_kind").isin("pdf_page_layout", "pdf_text_legacy")
    ).select("asset_id", "workspace_id", F.col("generation").alias("current_generation"),
             "representation_id", "representation_kind")
    return (
        assets.where(F.col("asset_kind") == "pdf")
        .join(usable, ["asset_id", "workspace_id", "current_generation"])
        .groupBy("asset_id")
        .agg(F.min_by("representation_id", rank).alias("representation_id"))
    )


def oriented_representation(assets: DataFrame, representations: DataFrame, geometry: DataFrame) -> DataFrame:
    """Canonical picture of each image asset with the reason it cannot be used, if any."""
    r = representations.where(F.col("representation_kind") == "image_oriented").select(
        "asset_id", "workspace_id", F.col("generation").alias("current_generation"),
        "representation_id", "object_key", "content_hash",
    )
    g = geometry.select(
        "representation_id", F.col("asset_id").alias("g_asset"), F.col("workspace_id").alias("g_workspace"),
        "width_pixels", "height_pixels", "orientation_applied",
    )
    joined = (
        assets.where(F.col("asset_kind") == "image")
        .select("asset_id", "workspace_id", "current_generation")
        .join(r, ["asset_id", "workspace_id", "current_generation"], "left")
        .join(g, "representation_id", "left")
    )
    reason = (
        F.when(F.col("representation_id").isNull() | F.coalesce(F.col("object_key"), F.lit("")).eqNullSafe(""),
               "representation_missing")
        .when(F.col("g_asset").isNull(), "geometry_missing")
        .when(
            (F.col("g_workspace") != F.col("workspace_id")) | (F.col("g_asset") != F.col("asset_id"))
            | (F.col("width_pixels") <= 0) | (F.col("height_pixels") <= 0) | ~F.col("orientation_applied"),
            "geometry_invalid",
        )
        .otherwise("ok")
    )
    return joined.withColumn("reason", reason)


def manifest_references(results: DataFrame, participants: DataFrame, tasks: DataFrame) -> DataFrame:
    """Result rows that name an unknown participant or task, or disagree with the task's type."""
    p = participants.select("participant_id", F.lit(True).alias("_p"))
    k = tasks.select("task_id", F.col("task_type").alias("_type"))
    joined = results.join(p, "participant_id", "left").join(k, "task_id", "left")
    problem = (
        F.when(F.col("_p").isNull(), "unknown_participant")
        .when(F.col("_type").isNull(), "unknown_task")
        .when(F.col("_type") != F.col("task_type"), "task_type_mismatch")
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_p", "_type")


def case_assets(labels: DataFrame, assets: DataFrame) -> DataFrame:
    """Each labelled file name must belong to exactly one ready live PDF of the workspace."""
    pdfs = assets.where(
        (F.col("asset_kind") == "pdf") & (F.col("status") == "ready") & ~F.col("is_deleted")
    ).select("workspace_id", "source_filename", "asset_id")
    found = pdfs.groupBy("workspace_id", "source_filename").agg(
        F.count(F.lit(1)).alias("n_assets"), F.min("asset_id").alias("asset_id")
    )
    joined = labels.join(found, ["workspace_id", "source_filename"], "left").fillna(0, ["n_assets"])
    return joined.withColumn("resolved", F.when(F.col("n_assets") == 1, F.col("asset_id"))).drop("asset_id")


def snapshot_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that differ between two snapshots, with the side and the fields that differ."""
    a = left.select(key, F.lit(True).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    b = right.select(key, F.lit(True).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = a.join(b, key, "full_outer")
    fields = F.array_compact(
        F.array(*[F.when(~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in columns])
    )
    status = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").otherwise("changed")
    return joined.select(key, status.alias("status"), F.array_join(fields, ",").alias("fields")).where(
        (F.col("status") != "changed") | (F.col("fields") != "")
    )


def object_closure(expected: DataFrame, listed: DataFrame) -> DataFrame:
    """Expected against listed objects: missing, unexpected, still present after delete, mismatch."""
    e = expected.select("object_key", "expected_exists", F.col("hash").alias("e_hash"), F.col("size").alias("e_size"))
    l = listed.select("object_key", F.lit(True).alias("listed"), F.col("hash").alias("l_hash"), F.col("size").alias("l_size"))
    joined = e.join(l, "object_key", "full_outer")
    problem = (
        F.when(F.col("expected_exists").isNull(), "unexpected_object")
        .when(F.col("expected_exists") & F.col("listed").isNull(), "missing_object")
        .when(~F.col("expected_exists") & F.col("listed").isNotNull(), "deleted_object_present")
        .when(F.col("listed") & ((F.col("e_hash") != F.col("l_hash")) | (F.col("e_size") != F.col("l_size"))),
              "content_mismatch")
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull())
