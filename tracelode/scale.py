"""Building blocks that stay correct and parallel when one key is hot.

A plain window or `percentile` sends a whole group to one task. The helpers here
cut a group along its own ordering into buckets, work per (key, bucket), and
join small per-bucket summaries back, so a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hot_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str = "ordinal",
) -> DataFrame:
    """1-based position inside each key group.

    `bucket` must be a non-decreasing function of the first order expression.
    """
    keyed = df.withColumn("_bucket", bucket)
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    sizes = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [
        F.col("_bucket").eqNullSafe(F.col("_b"))
    ]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    joined = keyed.withColumn(name, local).join(offsets, condition, "inner")
    return joined.withColumn(name, F.col(name) + F.col("_offset")).drop(
        "_bucket", "_b", "_offset", *[f"_k_{k}" for k in keys]
    )


def hot_lag(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    bucket: Column,
    name: str,
) -> DataFrame:
    """LAG(value) per key, computed per (key, bucket) with the bucket edges joined in."""
    keyed = df.withColumn("_bucket", bucket)
    window = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ordering = F.struct(*[F.col(c) for c in order])
    edges = keyed.groupBy(*keys, "_bucket").agg(F.max_by(F.col(value), ordering).alias("_edge"))
    previous = Window.partitionBy(*keys).orderBy("_bucket")
    edges = edges.withColumn("_edge", F.lag("_edge").over(previous))
    local = keyed.withColumn("_first", F.row_number().over(window) == 1).withColumn(
        "_lag", F.lag(value).over(window)
    )
    return (
        local.join(edges, [*keys, "_bucket"], "left")
        .withColumn(name, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_lag")))
        .drop("_bucket", "_first", "_lag", "_edge")
    )


def hot_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float | str],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact order statistics per key without gathering a group, or most of it, in one task.

    `wanted` maps an output name to a fraction (nearest rank) or to "median" (mean of the two middle values).
    A mergeable sketch gives two bounds around each wanted rank, few of the group's rows apart whatever the values
    are. The rows below the bounds are only counted; those between them, about 6 / `accuracy` of the group, are
    counted by value, and the wanted rank is selected there. Should a rank lie outside its bounds, the group's least
    and greatest value take their place, so the result is exact in any case.
    """
    keys = list(keys)
    ranks: list[tuple[str, Column, float]] = []
    total = F.col("_total")
    for name, rule in wanted.items():
        if rule == "median":
            ranks += [(name, F.floor((total + 1) / 2), 0.5), (name, F.floor((total + 2) / 2), 0.5)]
        else:
            ranks.append((name, F.greatest(F.lit(1), F.least(total, F.ceil(F.lit(float(rule)) * total))), float(rule)))
    steps = range(len(ranks))
    near = [max(0.0, q - 3 / accuracy) for *_, q in ranks] + [min(1.0, q + 3 / accuracy) for *_, q in ranks]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.percentile_approx("_v", near, accuracy).alias("_near"),
    )

    def beside(other: DataFrame, columns: Sequence[str]) -> DataFrame:
        renamed = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *columns)
        condition = F.lit(True)
        for k in keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return rows.join(renamed, condition).drop(*[f"_k_{k}" for k in keys])

    low, high = [F.col("_near")[i] for i in steps], [F.col("_near")[len(ranks) + i] for i in steps]
    counted = beside(sketch, ["_total", "_least", "_most", "_near"]).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("_total", "_least", "_most", "_near")],
        *[F.count_if(F.col("_v") < low[i]).alias(f"_below{i}") for i in steps],
        *[F.count_if(F.col("_v") <= high[i]).alias(f"_upto{i}") for i in steps],
    )
    held = [(F.col(f"_below{i}") < r) & (r <= F.col(f"_upto{i}")) for i, (_, r, _) in enumerate(ranks)]
    bounds = counted.select(*keys, *[
        F.struct(
            r.cast("long").alias("rank"), F.when(held[i], low[i]).otherwise(F.col("_least")).alias("low"),
            F.when(held[i], high[i]).otherwise(F.col("_most")).alias("high"),
            F.when(held[i], F.col(f"_below{i}")).otherwise(0).alias("below"),
        ).alias(f"_b{i}")
        for i, (_, r, _) in enumerate(ranks)
    ])
    inside = [(F.col("_v") >= F.col(f"_b{i}.low")) & (F.col("_v") <= F.col(f"_b{i}.high")) for i in steps]
    between = beside(bounds, [f"_b{i}" for i in steps]).withColumn(
        "_i", F.filter(F.array(*[F.when(inside[i], i) for i in steps]), lambda x: x.isNotNull())
    ).where(F.size("_i") > 0)
    # one count per value and wanted rank; few rows are left here
    values = between.select(*keys, "_v", F.explode("_i").alias("_i"), F.array(*[F.col(f"_b{i}") for i in steps]).alias("_b")).select(
        *keys, "_v", "_i", F.col("_b")[F.col("_i")].alias("_b")
    ).groupBy(*keys, "_i", "_b.rank", "_b.below", "_v").agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*keys, "_i").orderBy("_v")) + F.col("below")
    hits = values.withColumn("_upto", running).where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n")))
    return hits.groupBy(*keys).agg(*[
        F.avg(F.when(F.col("_i").isin([i for i in steps if ranks[i][0] == n]), F.col("_v"))).alias(n) for n in wanted
    ])


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when `df` has at most `max_rows` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


SIFT_BITS = 1 << 27


def sift(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of `df` whose key may be one of `wanted`, to move fewer of them into a join that decides.

    A bitmap of hashed keys is broadcast, 16 MB however many keys there are; the more there are, the more others pass.
    """
    number = F.pmod(F.xxhash64(key), F.lit(SIFT_BITS)) + 1
    bucket = F.bitmap_bucket_number(number)
    bits = wanted.where(F.col(key).isNotNull()).groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))
    at = F.bitmap_bit_position(number).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1
    return df.withColumn("_bucket", bucket).join(F.broadcast(bits), "_bucket").where(marked).drop("_bucket", "_bits")


def top_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, name: str = "rank"
) -> DataFrame:
    """First k rows per key; the rank limit is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)
