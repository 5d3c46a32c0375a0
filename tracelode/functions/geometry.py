"""Rectangles, pages and pixels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelode.operators.integrity import error_codes

TOLERANCE = 0.01
ROTATIONS = [0, 90, 180, 270]
EXACT = "decimal(38,18)"


def rotated_crop(crop: Column, media_top: Column) -> Column:
    """Top-left crop box (x0, y0, x1, y1) to user space, whose y axis points up."""
    return F.struct(
        crop["x0"].alias("x0"), (media_top - crop["y1"]).alias("y0"),
        crop["x1"].alias("x1"), (media_top - crop["y0"]).alias("y1"),
    )


def page_errors(
    media: Column, crop: Column, rotation: Column, width: Column, height: Column, page: Column,
    tolerance: float = TOLERANCE,
) -> Column:
    """Comma-joined codes of the page geometry rules that fail."""

    def flat(box: Column) -> Column:
        return (box["x1"] <= box["x0"]) | (box["y1"] <= box["y0"])

    sideways = rotation.isin(90, 270)
    crop_w, crop_h = crop["x1"] - crop["x0"], crop["y1"] - crop["y0"]
    want_w = F.when(sideways, crop_h).otherwise(crop_w)
    want_h = F.when(sideways, crop_w).otherwise(crop_h)
    inside = (
        (media["x0"] <= crop["x0"]) & (crop["x1"] <= media["x1"]) & (media["y0"] <= crop["y0"]) & (crop["y1"] <= media["y1"])
    )
    return error_codes(
        [
            (page < 1, "page_number"),
            (~rotation.isin(*ROTATIONS), "rotation"),
            (flat(media), "media_box"),
            (flat(crop), "crop_box"),
            (~inside, "crop_outside"),
            ((width <= 0) | (height <= 0), "display"),
            (F.abs(width - want_w) > tolerance, "display_width"),
            (F.abs(height - want_h) > tolerance, "display_height"),
        ]
    )


def normal_box(xs: Column, ys: Column, width: Column, height: Column) -> Column:
    """Bounding box of a polygon as shares of the picture, clamped to [0, 1]; null when degenerate."""

    def clamp(value: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))

    x0, x1 = clamp(F.array_min(xs) / width), clamp(F.array_max(xs) / width)
    y0, y1 = clamp(F.array_min(ys) / height), clamp(F.array_max(ys) / height)
    usable = (width > 0) & (height > 0) & (F.size(xs) >= 2) & (x1 > x0) & (y1 > y0)
    return F.when(usable, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def pixel_floor(value: Column, dimension: Column) -> Column:
    """floor(value * dimension) on the decimal text of the number."""
    return F.floor(value.cast("string").cast("decimal(28,18)") * dimension.cast("decimal(9,0)")).cast("long")


def pixel_ceil(origin: Column, extent: Column, dimension: Column) -> Column:
    edge = origin.cast("string").cast("decimal(27,18)") + extent.cast("string").cast("decimal(27,18)")
    return F.ceil(edge * dimension.cast("decimal(9,0)")).cast("long")


def axis_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def horizontal_ratio(ax: Column, aw: Column, bx: Column, bw: Column) -> Column:
    """Shared width as a share of the narrower rectangle."""
    return axis_overlap(ax, ax + aw, bx, bx + bw) / F.least(aw, bw)
