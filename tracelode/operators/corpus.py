"""A scaled test corpus: signatures x cohorts per seed row, duplicate profiles, hash vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SIGNATURES = [
    ("pdf-text-legacy", "pdf", "pdf_text_chunk", "pdf_text_legacy", "pdf_page"),
    ("pdf-page-layout", "pdf", "pdf_text_chunk", "pdf_page_layout", "pdf_page"),
    ("pdf-text-ocr", "pdf", "pdf_text_chunk", "pdf_ocr", "pdf_page"),
    ("pdf-ocr-region", "pdf", "pdf_ocr_region", "pdf_ocr", "pdf_region"),
    ("pdf-table", "pdf", "pdf_table", "pdf_table", "pdf_region"),
    ("pdf-figure", "pdf", "pdf_figure", "pdf_figure", "pdf_region"),
    ("image-ocr", "image", "image_ocr_region", "image_ocr", "image_region"),
    ("image-caption", "image", "image_caption", "image_caption", "image_region"),
]
COHORTS = [
    # cohort, generation, index version
    ("visible", 2, 2),
    ("outside", 2, 2),
    ("old_generation", 1, 2),
    ("old_index", 2, 1),
    ("wrong_provider", 2, 2),
]
DUPLICATES = {"D1": 1, "D8": 8, "D64": 64}
DIMENSIONS = 64
CENTROID_WEIGHT = 4.0
PERTURBATION = 0.1
NEAREST_STALE = 4  # so many stale rows per signature copy a visible vector


def _noise(*parts: Column) -> Column:
    """Deterministic number in [-1, 1] from a hash."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(65535)) / 32767.5 - 1.0


def scaled_corpus(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """Forty rows per seed (8 signatures x 5 cohorts) with locator and unit numbers and a vector.

    Visible rows cycle through the duplicate profiles; poison rows all use D8. Rows of one locator
    share their vector, whose own signature dimension carries the centroid weight.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(s[0]).alias("signature"), F.lit(s[1]).alias("asset_kind"),
                F.lit(s[2]).alias("unit_kind"), F.lit(s[3]).alias("representation_kind"), F.lit(s[4]).alias("locator_kind"),
                F.lit(c[0]).alias("cohort"), F.lit(c[1]).alias("generation"), F.lit(c[2]).alias("index_version"),
            )
            for i, s in enumerate(SIGNATURES)
            for c in COHORTS
        ]
    )
    rows = seeds.select(F.col(seed).alias("source_order"), F.explode(cells).alias("c")).select("source_order", "c.*")
    visible = F.col("cohort") == "visible"
    cycle = F.element_at(F.array(F.lit("D1"), F.lit("D8"), F.lit("D64")), (F.col("source_order") % 3 + 1).cast("int"))
    factor = F.element_at(F.create_map(*[F.lit(x) for p in DUPLICATES.items() for x in p]), F.col("profile"))
    placed = (
        rows.withColumn("profile", F.when(visible, cycle).otherwise("D8"))
        .withColumn("_order", F.when(visible, F.floor(F.col("source_order") / 3)).otherwise(F.col("source_order")))
        .withColumn("locator_order", F.floor(F.col("_order") / factor))
        .withColumn("unit_order", F.col("_order") % factor)
        .drop("_order")
    )
    stale = F.col("cohort").isin("old_generation", "old_index") & (F.col("source_order") < NEAREST_STALE)
    family = F.when(visible | stale, "target").otherwise(F.col("cohort"))
    vector = F.transform(
        F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)),
        lambda i: F.when(i == F.col("position"), F.lit(CENTROID_WEIGHT)).otherwise(
            PERTURBATION * _noise(F.col("signature"), F.col("profile"), F.col("locator_order"), F.col("_family"), i)
        ),
    )
    return placed.withColumn("_family", family).withColumn("embedding", vector).drop("_family")
