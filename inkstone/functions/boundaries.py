"""Cuts between letters from the boundary profile of a line, as Column expressions over array<double>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.profiles import deep_valley, internal_separator, pitch_of_edges
from inkstone.functions.signal import let, local_maxima, prominence, smooth

#: Lines under so many pixels are dense: peaks must stand out more there (fixed values).
DENSE = 72
LEVEL, SHARE, DENSE_SHARE = 0.5, 0.15, 0.26
PAIR_CLEAR, DENSE_PAIR_CLEAR = 0.10, 0.22
PairRule = Callable[[Column, Column], Column]


def _dense(height: Column) -> Column:
    return (height > 0) & (height < DENSE)


def peak_map(profile: Column, height: Column, threshold: float = 0.35, share: Column | float = SHARE) -> Column:
    """smooth: the profile smoothed by 2; peaks: (x, v, clear) of its local maxima, in order.

    A peak is at least `threshold` and half the highest (.62 of it on dense lines), and stands clear by `share` of that
    level. Profiles of fewer than three columns have none.
    """

    def found(s: Column) -> Column:
        level = F.greatest(F.lit(threshold), F.array_max(s) * F.when(_dense(height), 0.62).otherwise(LEVEL))

        def kept(level: Column) -> Column:
            tops = F.filter(local_maxima(s, 0.0), lambda x: F.get(s, x) >= level)
            return F.filter(F.transform(tops, lambda x: F.struct(x.alias("x"), F.get(s, x).alias("v"), prominence(s, x).alias("clear"))), lambda p: p["clear"] >= level * share)

        none = F.array().cast("array<struct<x:int,v:double,clear:double>>")
        return F.struct(s.alias("smooth"), F.when(F.size(s) >= 3, let(level, kept)).otherwise(none).alias("peaks"))

    return let(smooth(profile, 2.0), found)


def boundaries(profile: Column, height: Column, threshold: float = 0.35, pair_ok: PairRule | None = None, source_height: Column | None = None) -> Column:
    """Cut columns in order: peaks from the highest down (of equal ones the first), each dropped if it conflicts with a kept one.

    Two conflict within .30 of the height (8 columns at least), unless they are the sides of a separator: both stand clear, lie
    .08 apart (3 columns at least), and pair_ok(the weaker column, the stronger one) doesn't veto. source_height: the
    line's height before it was scaled, which says whether it is dense.
    """
    source = height if source_height is None else source_height
    apart = F.greatest(F.lit(8), F.floor(height * 0.30).cast("int"))
    sides = F.greatest(F.lit(3), F.floor(height * 0.08).cast("int"))
    clear = F.when(source < DENSE, DENSE_PAIR_CLEAR).otherwise(PAIR_CLEAR)

    def conflict(p: Column, q: Column) -> Column:
        gap = F.abs(p["x"] - q["x"])
        pair = (p["clear"] >= clear) & (q["clear"] >= clear) & (gap >= sides)
        if pair_ok is not None:  # q was kept before p, so p is no higher
            pair = pair & F.coalesce(pair_ok(p["x"], q["x"]), F.lit(False))
        return (gap < apart) & ~pair

    def picked(peaks: Column) -> Column:
        ranked = F.array_sort(F.transform(peaks, lambda p: F.struct((-p["v"]).alias("down"), p["x"].alias("x"), p["clear"].alias("clear"))))
        none = F.slice(ranked, 1, 0)
        kept = F.aggregate(ranked, none, lambda acc, p: F.when(F.exists(acc, lambda q: conflict(p, q)), acc).otherwise(F.concat(acc, F.array(p))))
        return F.array_sort(F.transform(kept, lambda p: p["x"]))

    share = F.when(source < DENSE, DENSE_SHARE).otherwise(SHARE)
    return let(peak_map(profile, source, threshold, share), lambda m: picked(m["peaks"]))


def coalesced_edges(edges: Column, activity: Column, height: Column) -> Column:
    """Edges of a line without those inside a letter, taken out one by one, the first each time, until none is left to take.

    An edge goes where the parts on its sides together are no wider than 1.22 pitches, the smaller is a fragment (.52), neither is
    a separator, and no deep valley runs through it. The pitch is that of the given edges. As every round takes one edge,
    as many rounds as there are edges settle it.
    """

    def settled(pitch: Column) -> Column:
        def goes(e: Column, i: Column) -> Column:
            left, right = F.get(e, i) - F.get(e, i - 1), F.get(e, i + 1) - F.get(e, i)
            separates = internal_separator(e, i - 1, pitch, height) | internal_separator(e, i, pitch, height)
            return ~separates & (left + right <= pitch * 1.22) & (F.least(left, right) <= pitch * 0.52) & ~F.coalesce(deep_valley(activity, F.get(e, i), height), F.lit(False))

        def once(e: Column, _: Column) -> Column:
            inner = F.when(F.size(e) >= 3, F.sequence(F.lit(1), F.size(e) - 2)).otherwise(F.array().cast("array<int>"))
            first = F.get(F.filter(inner, lambda i: goes(e, i)), 0)
            return F.when(first.isNull(), e).otherwise(F.concat(F.slice(e, F.lit(1), first), F.slice(e, first + 2, F.size(e))))

        return F.aggregate(F.sequence(F.lit(1), F.size(edges)), edges, once)

    return F.when((F.size(edges) < 3) | (height <= 0), edges).otherwise(let(pitch_of_edges(edges, height), settled))
