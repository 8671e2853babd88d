"""Rules on segments of a line and on views of a glyph, as Column expressions over structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.signal import let
from inkstone.functions.text import is_numeral

# Fixed values: (score, limit) pairs that must all be undercut.
UNLIT = (("object_mean", 0.55), ("object_peak", 0.70))
SILENT = (("activity_mean", 0.06), ("activity_peak", 0.25), *UNLIT)
WEAK = (("activity_mean", 0.12), ("activity_peak", 0.40), ("edge_peak", 0.90), *UNLIT)
FLAT = (("edge_peak", 0.075), ("column_coherence", 2.2), ("row_coherence", 2.2), ("object_mean", 0.40), ("object_peak", 0.55))
MARGIN = (("activity_mean", 0.28), ("edge_peak", 1.15), ("column_coherence", 1.70), *UNLIT)


def _under(scores: Column, limits: tuple) -> Column:
    out = F.lit(True)
    for name, limit in limits:
        out = out & (scores[name] < F.lit(limit))
    return out


def thin_stem(scores: Column, height: Column) -> Column:
    """A narrow segment with ink enough to be a carved stem; it never counts as empty."""
    narrow = scores["width"].between(F.lit(2), F.greatest(F.lit(4), F.floor(height * F.lit(0.28)).cast("int")))
    return (height > 0) & narrow & (scores["activity_peak"] >= 0.40) & (scores["activity_mean"] >= 0.12)


def empty_segment(scores: Column, height: Column, at_margin: Column) -> Column:
    """Whether a segment is bare stone, from its scores and its line's height; at_margin: first or last of its line."""
    bare = _under(scores, SILENT) | _under(scores, WEAK) | _under(scores, FLAT) | (at_margin & _under(scores, MARGIN))
    return bare & ~thin_stem(scores, height)


def kept_segments(segments: Column, height: Column) -> Column:
    """Segments of an array of scores that aren't empty."""
    marked = F.transform(segments, lambda s, i: F.struct(s.alias("s"), empty_segment(s, height, (i == 0) | (i == F.size(segments) - 1)).alias("empty")))
    return F.transform(F.filter(marked, lambda m: ~m["empty"]), lambda m: m["s"])


def best_view(original: Column, other: Column) -> Column:
    """Of two views (label, confidence) of a glyph the better one.

    Where one sees a letter and the other a numeral, a letter of the original view stays from .08 on; a letter of the
    other view wins from .20 on if it isn't .05 weaker; else the original stays unless the other leads by .55.
    """
    a, b = original["confidence"], other["confidence"]
    differ = is_numeral(original["label"]) != is_numeral(other["label"])
    letter_stays = ~is_numeral(original["label"]) & (a >= 0.08)
    letter_wins = is_numeral(original["label"]) & (b >= 0.20) & (b >= a - 0.05)
    stays = letter_stays | (~letter_wins & (b < a + 0.55))
    keep = F.when(differ & letter_stays, True).when(differ & letter_wins, False).when(differ & stays, True).otherwise(a >= b)
    return F.when(other.isNull(), original).when(original.isNull(), other).otherwise(F.when(keep, original).otherwise(other))


def corridor_cuts(cuts: Column, width: Column, active: Column) -> Column:
    """Cuts of a line whose blank runs became one cut each, in the middle; blank ends fall out.

    active: a flag for each interval that the cuts make.
    """
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(width.cast("int")))
    on = F.filter(F.transform(active, lambda a, i: F.struct(a.alias("a"), i.alias("i"))), lambda x: x["a"])

    def between(hits: Column) -> Column:
        n = F.greatest(F.lit(0), F.size(hits) - 1)
        pairs = F.zip_with(F.slice(hits, 1, n), F.slice(hits, 2, n), lambda a, b: F.struct(a["i"].alias("a"), b["i"].alias("b")))
        return F.transform(pairs, lambda p: F.floor((F.get(edges, p["a"] + 1) + F.get(edges, p["b"])) / 2).cast("int"))

    return let(on, between)


def two_lobes(activity: Column, line_height: Column) -> Column:
    """Whether a profile has two peaks above half its largest, at least max(4, .10 of the line's height) apart."""
    gap = F.greatest(F.lit(4), F.floor(line_height * F.lit(0.10)).cast("int"))
    high = F.array_max(activity) * F.lit(0.5)
    last = F.size(activity) - 1
    peaks = F.filter(F.transform(activity, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda p: (p["i"] > 0) & (p["i"] < last) & (p["v"] > high) & (p["v"] >= F.get(activity, p["i"] - 1)) & (p["v"] > F.get(activity, p["i"] + 1)))
    return F.coalesce(F.exists(peaks, lambda a: F.exists(peaks, lambda b: b["i"] - a["i"] >= gap)), F.lit(False))


def dense_packing(widths: Column, line_height: Column) -> Column:
    """At least six intervals whose median width is at most .55 of a line under 100 high, or .32 of a higher one."""
    s = F.array_sort(widths)
    n = F.size(s)
    median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return (n >= 6) & (median <= line_height * F.when(line_height < 100, 0.55).otherwise(0.32))
