"""One-dimensional signals as array<double> expressions: smoothing, peaks, prominence, suppression, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def indices(n: Column) -> Column:
    """0 to n-1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def smooth(values: Column, sigma: float) -> Column:
    """Gaussian smoothing; beyond an end the signal is mirrored without its end sample."""
    radius = max(1, int(round(4 * sigma)))
    weight = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    total = sum(weight)
    n = F.size(values)

    def mirrored(i: Column) -> Column:
        span = F.greatest(F.lit(1), 2 * (n - 1))
        j = F.pmod(i, span)
        return F.when(j < n, j).otherwise(span - j)

    kernel = F.array(*[F.lit(w / total) for w in weight])
    return F.transform(values, lambda _, i: F.aggregate(F.transform(kernel, lambda w, k: w * F.get(values, mirrored(i + k - radius).cast("int"))), F.lit(0.0), lambda a, v: a + v))


def local_maxima(values: Column, threshold: float) -> Column:
    """Inner indices that are no lower than the left and higher than the right neighbour, and at least the threshold."""
    at = lambda i: F.get(values, i)
    return F.filter(indices(F.size(values)), lambda i: (i > 0) & (i < F.size(values) - 1) & (at(i) >= at(i - 1)) & (at(i) > at(i + 1)) & (at(i) >= F.lit(float(threshold))))


def prominence(values: Column, i: Column) -> Column:
    """How far the signal falls on both sides of index i before it rises above it; equal samples go on."""
    top = F.get(values, i)
    fall = F.struct(top.alias("low"), F.lit(True).alias("open"))

    def walk(side: Column) -> Column:
        step = lambda acc, v: F.struct(F.when(acc["open"] & (v <= top), F.least(acc["low"], v)).otherwise(acc["low"]).alias("low"), (acc["open"] & (v <= top)).alias("open"))
        return F.aggregate(side, fall, step)["low"]

    left = walk(F.reverse(F.slice(values, 1, i)))
    right = walk(F.slice(values, i + 2, F.greatest(F.lit(0), F.size(values) - i - 1)))
    return top - F.greatest(left, right)


def suppress(values: Column, peaks: Column, distance: int = 3) -> Column:
    """Peaks from the strongest down, each dropped if a kept one is nearer than `distance`; in order of position."""
    ranked = F.array_sort(F.transform(peaks, lambda i: F.struct((-F.get(values, i)).alias("v"), i.alias("i"))))
    none = F.array().cast("array<int>")
    kept = F.aggregate(ranked, none, lambda acc, p: F.when(F.exists(acc, lambda k: F.abs(k - p["i"]) < distance), acc).otherwise(F.concat(acc, F.array(p["i"]))))
    return F.array_sort(kept)


def peaks(values: Column, threshold: float = 0.35, distance: int = 3, sigma: float | None = None) -> Column:
    return let(smooth(values, sigma) if sigma else values, lambda v: suppress(v, local_maxima(v, threshold), distance))


def intervals(cuts: Column, width: Column, least: int = 2) -> Column:
    """Half-open intervals between 0, the sorted cuts and width, of at least `least`."""
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(width.cast("int")))
    pairs = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    return F.filter(pairs, lambda x: x["hi"] - x["lo"] >= least)


def span(values: Column, lo: Column, hi: Column) -> Column:
    return F.slice(values, lo + 1, F.greatest(F.lit(0), hi - lo))


def boxes(cuts: Column, objectness: Column, least: int = 2, empty: float = 0.12) -> Column:
    """Intervals whose mean objectness is at least `empty`, with their largest as confidence."""
    found = F.transform(intervals(cuts, F.size(objectness), least), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), F.array_max(span(objectness, x["lo"], x["hi"])).alias("confidence"), (F.aggregate(span(objectness, x["lo"], x["hi"]), F.lit(0.0), lambda a, v: a + v) / (x["hi"] - x["lo"])).alias("mean")))
    return F.filter(found, lambda x: x["mean"] >= F.lit(empty))


def collapse_close_peaks(values: Column, found: Column, pitch: Column) -> Column:
    """Folds peaks nearer than .85 pitch with only a shallow valley between them into the stronger one."""
    none = F.array().cast("array<int>")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        valley = F.array_min(span(values, last, p + 1))
        ratio = valley / (F.least(F.get(values, last), F.get(values, p)) + 1e-6)
        shallow = (p - last < F.floor(pitch * 0.85)) & (ratio > 0.65) & (valley > 0.45)
        stronger = F.when(F.get(values, p) > F.get(values, last), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(p))).otherwise(acc)
        return F.when(F.size(acc) == 0, F.array(p)).when(shallow, stronger).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(found, none, step)


def valley_cuts(values: Column, found: Column) -> Column:
    """The first lowest index between each two neighbouring peaks."""
    both = F.zip_with(F.slice(found, 1, F.greatest(F.lit(0), F.size(found) - 1)), F.slice(found, 2, F.greatest(F.lit(0), F.size(found) - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(both, lambda x: (x["a"] + F.array_position(span(values, x["a"], x["b"] + 1), F.array_min(span(values, x["a"], x["b"] + 1))) - 1).cast("int"))


def norm01(values: Column) -> Column:
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: (v - low) / (high - low + 1e-6))


def resample(values: Column, n: int) -> Column:
    """Linear interpolation at n even positions from the first to the last sample."""
    last = F.size(values) - 1

    def at(i: Column) -> Column:
        x = i * last / F.lit(max(1, n - 1))
        lo = F.floor(x).cast("int")
        return F.get(values, lo) + (F.get(values, F.least(lo + 1, last)) - F.get(values, lo)) * (x - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def soft_targets(bounds: Column, width: int, sigma: float = 2.5) -> Column:
    """For each position the largest of Gaussians around the bounds."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.array_max(F.transform(bounds, lambda b: F.exp(-0.5 * F.pow((x - b) / F.lit(sigma), 2)))), F.lit(0.0)))


def objectness_target(letters: Column, width: int, sigma: float = 1.5) -> Column:
    """1 within any interval (lo, hi), 0 outside, smoothed."""
    inside = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.when(F.exists(letters, lambda b: (x >= b["lo"]) & (x < b["hi"])), 1.0).otherwise(0.0))
    return smooth(inside, sigma)


def near_max(values: Column, x: Column, radius: int = 3) -> Column:
    """The largest sample within `radius` of x."""
    return F.array_max(span(values, F.greatest(F.lit(0), x - radius), F.least(F.size(values), x + radius + 1)))


def union_cuts(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))
