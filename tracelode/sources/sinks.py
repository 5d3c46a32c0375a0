"""Object keys, reports, generation replacement, purge and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.integrity import first_code


def object_key(workspace: Column, asset: Column, filename: Column) -> Column:
    """Place of an uploaded file; the suffix is lower-cased and defaults to .pdf."""
    suffix = F.lower(F.regexp_extract(filename, "[^/.](\\.[^./]+)$", 1))
    return F.concat(
        F.lit("workspaces/"), workspace, F.lit("/assets/"), asset, F.lit("/original"),
        F.when(suffix != "", suffix).otherwise(".pdf"),
    )


def derived_prefix(workspace: Column, asset: Column) -> Column:
    return F.concat(F.lit("workspaces/"), workspace, F.lit("/assets/"), asset, F.lit("/representations/"))


def check_derived(objects: DataFrame) -> DataFrame:
    """First broken rule per derived object.

    objects: workspace_id, asset_id, source_key, object_key, payload_size, content_type, payload_hash, declared_hash.
    """
    counts = objects.groupBy("object_key").agg(F.count(F.lit(1)).alias("_n"))
    bad_place = (F.col("object_key") == F.col("source_key")) | ~F.startswith(
        F.col("object_key"), derived_prefix(F.col("workspace_id"), F.col("asset_id"))
    )
    code = first_code(
        [
            (bad_place, "key_invalid"),
            (F.col("_n") > 1, "duplicate"),
            ((F.col("payload_size") == 0) | (F.coalesce("content_type", F.lit("")) == ""), "empty"),
            (F.col("payload_hash") != F.col("declared_hash"), "hash_mismatch"),
        ],
        "ok",
    )
    return objects.join(counts, "object_key").withColumn("outcome", code).drop("_n")


def write_report(df: DataFrame, path: str, sort_by: list[str]) -> None:
    """JSON report with sorted keys. It is written beside `path` and takes its place when complete, so a
    failed run leaves the old report as it was."""
    spark = df.sparkSession
    fresh, old = f"{path}-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    df.select(*sorted(df.columns)).sort(*sort_by).write.json(fresh)
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(place(path))
    if had and not files.rename(place(path), place(old)):
        files.delete(place(fresh), True)
        raise OSError(f"{path} cannot be moved aside; it is as it was")
    if not files.rename(place(fresh), place(path)):
        if had and not files.rename(place(old), place(path)):
            raise OSError(f"{path} cannot be replaced; the old report is {old}, the new one {fresh}")
        files.delete(place(fresh), True)
        raise OSError(f"{path} cannot be replaced; it is as it was")
    if had:
        files.delete(place(old), True)


def replace_generation(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows after the assets of `fresh` were replaced; running it twice changes nothing."""
    touched = fresh.select(*keys).distinct()
    return existing.join(touched, keys, "left_anti").unionByName(fresh)


def write_generation(df: DataFrame, path: str, partition: list[str]) -> None:
    """Overwrite only the partitions present in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def purge(tables: dict[str, DataFrame], deleted: DataFrame, key: str = "asset_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without rows of deleted assets, and how many rows of each asset went."""
    gone = deleted.select(key).distinct()
    kept = {name: df.join(gone, key, "left_anti") for name, df in tables.items()}
    removed = None
    for name, df in tables.items():
        one = df.join(gone, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
        removed = one if removed is None else removed.unionByName(one)
    return kept, removed


def snapshot(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Every table as (table_name, row_json); columns in the given order, nulls kept."""
    out = None
    for name, (df, columns) in tables.items():
        one = df.select(
            F.lit(name).alias("table_name"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row_json")
        )
        out = one if out is None else out.unionByName(one)
    return out
