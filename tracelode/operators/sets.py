"""Set operations: drift, missing ids, scopes, merges and replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.scale import hot_ordinal

SEQUENCE_BUCKET = 4096


def drift(registered: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows present on one side only, both frames of equal columns."""
    return registered.exceptAll(stored).withColumn("side", F.lit("registered_only")).unionByName(
        stored.exceptAll(registered).withColumn("side", F.lit("stored_only"))
    )


def first_requests(requests: DataFrame, owner: str, item: str, order: str) -> DataFrame:
    """Each requested item once per owner, at its first place."""
    return requests.groupBy(owner, item).agg(F.min(order).alias(order))


def missing(requests: DataFrame, found: DataFrame, owner: str, item: str, order: str, bucket: Column) -> DataFrame:
    """Requested items that do not exist, in request order with their position among the missing."""
    gone = first_requests(requests, owner, item, order).join(found.select(item).distinct(), item, "left_anti")
    return hot_ordinal(gone, [owner], [F.col(order), F.col(item)], bucket, "position")


def resolve_scopes(requests: DataFrame, selected: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets of each question scope in order, or one row with the reason it is invalid.

    requests: request_id, workspace_id, mode. selected: request_id, asset_id, asset_order.
    """
    ready = assets.where((F.col("status") == "ready") & ~F.col("is_deleted"))
    everything = requests.where(F.col("mode") == "all_ready").join(
        ready.select("workspace_id", "asset_id", "created_seq"), "workspace_id"
    ).select("request_id", "asset_id", F.col("created_seq").alias("_order"))
    chosen = requests.where(F.col("mode") == "selected").join(selected, "request_id").join(
        assets.select("workspace_id", "asset_id", "status", "is_deleted"), ["workspace_id", "asset_id"], "left"
    )
    bad = chosen.groupBy("request_id").agg(
        F.bool_or(~F.coalesce((F.col("status") == "ready") & ~F.col("is_deleted"), F.lit(False))).alias("_bad")
    ).where("_bad").select("request_id")
    good = chosen.join(bad, "request_id", "left_anti").select("request_id", "asset_id", F.col("asset_order").alias("_order"))
    rows = everything.unionByName(good)
    placed = hot_ordinal(
        rows, ["request_id"], [F.col("_order"), F.col("asset_id")], F.floor(F.col("_order") / SEQUENCE_BUCKET), "position"
    ).select("request_id", F.lit("ok").alias("outcome"), "position", "asset_id")
    failed = requests.select("request_id").join(rows.select("request_id").distinct(), "request_id", "left_anti")
    reasons = failed.join(bad.withColumn("_b", F.lit(True)), "request_id", "left").select(
        "request_id", F.when(F.col("_b"), "invalid_asset_scope").otherwise("empty_asset_scope").alias("outcome"),
        F.lit(None).cast("long").alias("position"), F.lit(None).cast(assets.schema["asset_id"].dataType).alias("asset_id"),
    )
    return placed.unionByName(reasons)


def build_scopes(requests: DataFrame, chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Ordered distinct union of chosen assets and target assets; mode all_ready when there are none.

    chosen, targets: request_id, asset_id, item_order.
    """
    rows = chosen.withColumn("_part", F.lit(0)).unionByName(targets.withColumn("_part", F.lit(1)))
    once = rows.groupBy("request_id", "asset_id").agg(F.min(F.struct("_part", "item_order")).alias("_at"))
    placed = hot_ordinal(
        once.select("request_id", "asset_id", "_at", F.col("_at.item_order").alias("_o"), F.col("_at._part").alias("_p")),
        ["request_id"], [F.col("_p"), F.col("_o"), F.col("asset_id")],
        F.struct("_p", F.floor(F.col("_o") / SEQUENCE_BUCKET).alias("b")), "position",
    ).select("request_id", F.lit("selected").alias("mode"), "position", "asset_id")
    empty = requests.select("request_id").join(rows.select("request_id").distinct(), "request_id", "left_anti").select(
        "request_id", F.lit("all_ready").alias("mode"), F.lit(None).cast("long").alias("position"),
        F.lit(None).cast("long").alias("asset_id"),
    )
    return placed.unionByName(empty)


def outside_scope(targets: DataFrame, scopes: DataFrame) -> DataFrame:
    """Targets whose asset is not in the resolved scope of their request."""
    return targets.join(scopes.select("request_id", "asset_id"), ["request_id", "asset_id"], "left_anti")


def upsert_threads(stored: DataFrame, incoming: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Merge incoming threads into stored ones.

    Threads of other workspaces stay, threads missing from the incoming list of a refreshed workspace
    go, and an incoming thread without history keeps the stored history.
    workspaces: the refreshed workspace ids. Columns: workspace_id, thread_id, title, n_messages.
    """
    key = ["workspace_id", "thread_id"]
    kept = stored.join(workspaces, "workspace_id", "left_anti")
    old = stored.select(*key, F.col("n_messages").alias("_old"))
    merged = incoming.join(old, key, "left").withColumn(
        "n_messages",
        F.when((F.col("n_messages") == 0) & F.col("_old").isNotNull(), F.col("_old")).otherwise(F.col("n_messages")),
    ).drop("_old")
    return kept.unionByName(merged)


def replace_bindings(bindings: DataFrame, requests: DataFrame, owners: DataFrame, owner: str, item: str) -> DataFrame:
    """Bindings after every owner in `owners` had its set replaced by its requested items, each once."""
    kept = bindings.join(owners.select(owner), owner, "left_anti").select(owner, item)
    return kept.unionByName(
        requests.join(owners.select(owner), owner, "left_semi").groupBy(owner, item).agg(F.lit(1).alias("_")).select(owner, item)
    )
