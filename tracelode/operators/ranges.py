"""Interval and rectangle joins that emit only touching pairs.

Both sides are spread over fixed-width bins and joined by equality on (key, bin). A pair that
meets in several bins is kept in exactly one of them: the one holding the larger of the two starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text as tx

BIN = 2048
CELLS = 8


def _bins(start: Column, end: Column, width: int) -> Column:
    first = F.floor(start / width)
    last = F.greatest(first, F.floor((end - 1) / width))
    return F.explode(F.sequence(first.cast("long"), last.cast("long")))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str],
    left_span: tuple[str, str], right_span: tuple[str, str], width: int = BIN,
) -> DataFrame:
    """Pairs of half-open integer ranges with `right.start < left.end and right.end > left.start`."""
    ls, le = left_span
    rs, re = right_span
    l = left.select("*", _bins(F.col(ls), F.col(le), width).alias("_bin"))
    r = right.select("*", _bins(F.col(rs), F.col(re), width).alias("_bin"))
    owner = F.floor(F.greatest(F.col(ls), F.col(rs)) / width) == F.col("_bin")
    return (
        l.join(r, [*keys, "_bin"])
        .where((F.col(rs) < F.col(le)) & (F.col(re) > F.col(ls)) & owner)
        .drop("_bin")
    )


def islands(ranges: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Merge overlapping or touching ranges of one page into disjoint ones."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    grouped = opened.withColumn("_island", F.sum("_new").over(order))
    return grouped.groupBy(*keys, "_island").agg(
        F.min(start).alias(start), F.max(end).alias(end)
    ).drop("_island")


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "\\s", ""))


def char_coverage(chunks: DataFrame, regions: DataFrame, key: str, text: str) -> DataFrame:
    """`covered`: every visible character of the chunk lies inside some region of its page.

    `text` is the page text between char_start and char_end of the chunk.
    """
    merged = islands(regions, [key], "region_start", "region_end")
    spans = chunks.select(key, "char_start", "char_end", text)
    pairs = overlap_join(spans, merged, [key], ("char_start", "char_end"), ("region_start", "region_end"))
    low = F.greatest("char_start", "region_start") - F.col("char_start")
    size = F.least("char_end", "region_end") - F.greatest("char_start", "region_start")
    inside = pairs.groupBy(key, "char_start", "char_end").agg(
        F.sum(visible_chars(F.substring(F.col(text), low + 1, size))).alias("_inside")
    )
    return (
        chunks.join(inside, [key, "char_start", "char_end"], "left")
        .withColumn("covered", F.coalesce("_inside", F.lit(0)) == visible_chars(F.col(text)))
        .drop("_inside")
    )


def _cells(low: Column, size: Column) -> Column:
    first = F.floor(low * CELLS)
    return F.sequence(first.cast("long"), F.floor((low + size) * CELLS).cast("long"))


def rect_overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of rectangles (l_x.. / r_x..) with strictly positive overlap, through a grid."""

    def spread(df: DataFrame, p: str) -> DataFrame:
        return df.withColumn("_cx", F.explode(_cells(F.col(f"{p}x"), F.col(f"{p}width")))).withColumn(
            "_cy", F.explode(_cells(F.col(f"{p}y"), F.col(f"{p}height")))
        )

    owner = (F.floor(F.greatest("l_x", "r_x") * CELLS) == F.col("_cx")) & (
        F.floor(F.greatest("l_y", "r_y") * CELLS) == F.col("_cy")
    )
    touching = (
        F.least(F.col("l_x") + F.col("l_width"), F.col("r_x") + F.col("r_width")) > F.greatest("l_x", "r_x")
    ) & (
        F.least(F.col("l_y") + F.col("l_height"), F.col("r_y") + F.col("r_height")) > F.greatest("l_y", "r_y")
    )
    return (
        spread(left, "l_").join(spread(right, "r_"), [*keys, "_cx", "_cy"])
        .where(touching & owner)
        .drop("_cx", "_cy")
    )


def intersection_area(a: str = "l_", b: str = "r_") -> Column:
    def side(axis: str, extent: str) -> Column:
        low = F.greatest(f"{a}{axis}", f"{b}{axis}")
        high = F.least(F.col(f"{a}{axis}") + F.col(f"{a}{extent}"), F.col(f"{b}{axis}") + F.col(f"{b}{extent}"))
        return F.greatest(F.lit(0.0), high - low)

    return side("x", "width") * side("y", "height")


def prefixed(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") if c in columns else F.col(c) for c in df.columns])


def coverage_ratio(approved: DataFrame, rendered: DataFrame, key: str, region: str) -> DataFrame:
    """Per target: the worst best-overlap of its approved rectangles, as a share of their area."""
    box = ["x", "y", "width", "height"]
    a = prefixed(approved.select(key, region, *box), "l_", box)
    b = prefixed(rendered.select(key, *box), "r_", box)
    area = F.col("l_width") * F.col("l_height")
    ratio = F.when(area > 0, F.least(F.lit(1.0), intersection_area() / area)).otherwise(0.0)
    best = rect_overlap_join(a, b, [key]).groupBy(key, region).agg(F.max(ratio).alias("_best"))
    scored = approved.select(key, region).join(best, [key, region], "left").fillna(0.0, ["_best"])
    return scored.groupBy(key).agg(F.min("_best").alias("min_ratio"), F.count(F.lit(1)).alias("n_regions"))


#: Difference up to which a reported ratio agrees with the rectangles (fixed value).
RATIO_TOLERANCE = 1e-6


def against_reported(ratios: DataFrame, reported: DataFrame, key: str) -> DataFrame:
    """Ratios next to what a report claims (key, reported); `agrees` is false where nothing is claimed."""
    return ratios.join(reported.select(key, F.col("reported").cast("double").alias("reported")), key, "left").withColumn(
        "agrees", F.coalesce(F.abs(F.col("min_ratio") - F.col("reported")) <= RATIO_TOLERANCE, F.lit(False))
    )


def region_excerpt(
    selected: DataFrame, units: DataFrame, captions: DataFrame, key: str, limit: int = 4000
) -> DataFrame:
    """Text behind a multi-region selection.

    When every selected rectangle touches a unit, the touched units in region then unit order, each
    once; otherwise the caption. Units stay as long as they begin within the first `limit` characters of
    the joined text; a blank one adds its separator, so at most `limit` units are gathered.
    """
    box = ["x", "y", "width", "height"]
    l = prefixed(selected.select(key, "region_id", *box), "l_", box)
    r = prefixed(units.select(key, "unit_order", "unit_id", "unit_text", *box), "r_", box)
    pairs = rect_overlap_join(l, r, [key])
    hit_regions = pairs.groupBy(key).agg(F.count_distinct("region_id").alias("_hit"))
    wanted = selected.groupBy(key).agg(F.count_distinct("region_id").alias("_wanted"))
    firsts = pairs.groupBy(key, "unit_id", "unit_order", "unit_text").agg(F.min("region_id").alias("_region"))
    firsts = firsts.withColumn("_text", tx.strip(F.col("unit_text")))
    order = Window.partitionBy(key).orderBy("_region", "unit_order", "unit_id")
    before = F.sum(F.length("_text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = firsts.withColumn("_rank", F.row_number().over(order)).withColumn("_before", before)
    kept = kept.where(F.coalesce("_before", F.lit(0)) < limit)
    joined = kept.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_text"))), lambda s: s["_text"]), "\n"
        ).alias("_joined")
    )
    return (
        wanted.join(hit_regions, key, "left").join(joined, key, "left").join(captions, key, "left")
        .withColumn("from_units", F.coalesce(F.col("_hit") == F.col("_wanted"), F.lit(False)))
        .withColumn(
            "excerpt",
            F.substring(F.when(F.col("from_units"), F.col("_joined")).otherwise(tx.strip(F.col("caption"))), 1, limit),
        )
        .select(key, "from_units", "excerpt")
    )
