"""Boxes and intervals as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def center(lo: Column, hi: Column) -> Column:
    return (lo + hi) / F.lit(2.0)


def extent(lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(1), hi - lo)


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return extent(x0, x1) * extent(y0, y1)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of intervals over their union, which counts as 1 at least."""
    inter = overlap(a0, a1, b0, b1)
    return inter / F.greatest((a1 - a0) + (b1 - b0) - inter, F.lit(1))


def iou_of_ends(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The variant whose union is the sum of the right ends: it shrinks with the position."""
    inter = overlap(a0, a1, b0, b1)
    return inter / F.greatest(a1 + b1 - inter, F.lit(1))


def iou_2d(a: Column, b: Column) -> Column:
    """Of structs (x0, y0, x1, y1)."""
    inter = overlap(a["x0"], a["x1"], b["x0"], b["x1"]) * overlap(a["y0"], a["y1"], b["y0"], b["y1"])
    size = lambda s: (s["x1"] - s["x0"]) * (s["y1"] - s["y0"])
    return inter / F.greatest(size(a) + size(b) - inter, F.lit(1))


def scaled(c: Column, factor: float) -> Column:
    """Halves go to the even neighbour."""
    return F.rint(c * F.lit(float(factor))).cast("int")


def padded(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, share: float = 0.06, least: int = 4) -> Column:
    """The box grown by a share of its sides (halves go to the even neighbour), `least` at least, within the image."""
    px, py = (F.greatest(F.lit(least), F.rint(extent(a, b) * share)) for a, b in ((x0, x1), (y0, y1)))
    zero = F.lit(0)
    return F.struct(F.greatest(zero, x0 - px).cast("int").alias("x0"), F.greatest(zero, y0 - py).cast("int").alias("y0"), F.least(width, x1 + px).cast("int").alias("x1"), F.least(height, y1 + py).cast("int").alias("y1"))


def region_rule(w: Column, h: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether cropping to a box pays: struct(apply, ratio, reason), by ordered rules on the margins' shares."""
    ratio = (x1 - x0) * (y1 - y0) / F.greatest(w * h, F.lit(1)).cast("double")
    top, bottom, left, right = y0 / F.greatest(h, F.lit(1)), (h - y1) / F.greatest(h, F.lit(1)), x0 / F.greatest(w, F.lit(1)), (w - x1) / F.greatest(w, F.lit(1))
    vertical, horizontal = top + bottom, left + right
    one = lambda yes, why: F.struct(F.lit(yes).alias("apply"), ratio.alias("ratio"), F.lit(why).alias("reason"))
    trim = (
        (((vertical >= 0.10) | (horizontal >= 0.10)) & ((h >= 100) | (vertical >= 0.18) | (horizontal >= 0.18)))
        | (((bottom >= 0.08) | (top >= 0.08)) & ((h >= 120) | (bottom >= 0.20) | (top >= 0.20)))
        | ((vertical >= 0.06) & ((y1 - y0) / F.greatest(h, F.lit(1)) <= 0.88) & ((h >= 120) | (vertical >= 0.22)))
        | ((horizontal >= 0.06) & (ratio <= 0.82) & ((h >= 120) | (horizontal >= 0.10)))
    )
    return (
        F.when((ratio >= 0.92) & (vertical < 0.06) & (horizontal < 0.06), one(False, "inscription_fills_frame"))
        .when(F.greatest(top, bottom, left, right) < 0.035, one(False, "margins_too_small_to_help"))
        .when(ratio < 0.025, one(False, "no_clear_inscription_cluster"))
        .when(trim, one(True, "margin_trim"))
        .otherwise(one(False, "margins_too_small_to_help"))
    )


def single_line_crop(h: Column, w: Column) -> Column:
    return (h < 8) | (w < 8) | (w / h >= 4)


def union_box() -> list[Column]:
    """Aggregates of x0, y0, x1, y1 that hold all boxes of a group."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
