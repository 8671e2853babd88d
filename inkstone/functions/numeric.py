"""Numbers as Column expressions: roundings, medians, percentiles, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.signal import let


def js_round(c: Column) -> Column:
    """Halves go up."""
    return F.floor(c + F.lit(0.5))


def half_even(c: Column) -> Column:
    return F.rint(c)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def confidence_percent(mean: Column, default: int = 0) -> Column:
    """Mean of clamped confidences in percent; `default` where there are none."""
    return F.coalesce(js_round(mean * 100).cast("int"), F.lit(default))


def average_confidence(glyphs: Column, default: int = 0, drop_empty: bool = False) -> Column:
    """A1 and A2 over an array of glyphs (character, confidence, isSeparator): separators and unknown glyphs don't count."""
    used = F.filter(glyphs, lambda g: ~F.coalesce(g["isSeparator"], F.lit(False)) & (g["character"] != "?") & ((g["character"] != "") if drop_empty else F.lit(True)))
    total = F.aggregate(used, F.lit(0.0), lambda acc, g: acc + clamp(g["confidence"].cast("double")))
    return F.when(F.size(used) > 0, js_round(total / F.size(used) * 100).cast("int")).otherwise(F.lit(default))


def upper_median(values: Column) -> Column:
    """sorted[n // 2] of an array; null for an empty one."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def array_percentile(values: Column, share: float) -> Column:
    """Linear interpolation between the sorted values of an array, as numpy has it."""

    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(share)
        low = F.get(s, F.floor(at).cast("int"))
        return low + (F.get(s, F.ceil(at).cast("int")) - low) * (at - F.floor(at))

    return let(F.array_sort(values), between)


def weighted_ratio(part: Column, whole: Column) -> Column:
    """part / whole with a denominator of 1 at least, to four digits."""
    return F.round(part / F.greatest(whole, F.lit(1)), 4)


def index_of_max(values: Column) -> Column:
    """First index (from 0) of the largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def index_of_min(values: Column) -> Column:
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))
