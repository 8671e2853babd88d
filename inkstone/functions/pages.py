"""Steps from a page's row signals to the bands of its lines, as Column expressions; `operators.pages` chains them.

A page is one row: `values` is the signal of its whole width and `centre` that of its middle third (array<double>, a value
for each row of the page). Lines that the peak search misses are looked for at the top, below the last line and at the
page's edge; peaks without a blank gutter between them fold together; bands that look like bare stone go.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.numeric import array_percentile, index_of_max
from inkstone.functions.peaks import line_pitch
from inkstone.functions.profiles import valley, widths
from inkstone.functions.signal import let, prominence, span

INTS = "array<int>"


def _whole(c: Column) -> Column:
    return F.floor(c).cast("int")


def part_of(value: Column, share: float, least: int) -> Column:
    """A share of a value in whole rows, at least `least`."""
    return F.greatest(F.lit(least), _whole(value * F.lit(share)))


def row_range(lo: Column, hi: Column) -> Column:
    """lo to hi - 1; empty where there are none."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast(INTS))


def _low(values: Column, lo: Column, hi: Column) -> Column:
    """The smallest value of rows lo to hi."""
    return F.array_min(span(values, lo, hi + 1))


def _tops(values: Column, y: Column) -> Column:
    """Whether a row is no lower than those two rows away."""
    return (F.get(values, y) >= F.get(values, y - 2)) & (F.get(values, y) >= F.get(values, y + 2))


def _gaps(found: Column) -> Column:
    return _whole(array_percentile(widths(found), 0.5))


def _best(*ranked: Column) -> Column:
    """The row of the largest score among arrays of (score, y); of equal ones the earliest array's, then the first. Null for none."""

    def keyed(k: int, r: Column) -> Column:  # a second parameter of the lambda, even one with a default, would be the place in the array
        return F.transform(r, lambda x: F.struct(x["score"].alias("score"), F.lit(-k).alias("k"), (-x["y"]).alias("y")))

    return -F.array_max(F.concat(*(keyed(k, r) for k, r in enumerate(ranked))))["y"]


def _with(found: Column, y: Column) -> Column:
    return F.when(y.isNotNull(), F.array_sort(F.concat(found, F.array(y.cast("int"))))).otherwise(found)


def _clearrow_range(values: Column, rows: Column, level: float, clear: float, also) -> Column:
    """(score, y) of rows that are tops of at least `level`, stand `clear` of their surroundings, and pass also(y, value); the score is both together."""
    at = lambda y: F.get(values, y)
    tops = F.filter(rows, lambda y: (at(y) >= level) & _tops(values, y) & F.coalesce(also(y, at(y)), F.lit(False)))
    scored = F.transform(tops, lambda y: F.struct((at(y) + prominence(values, y)).alias("score"), y.alias("y"), prominence(values, y).alias("clear")))
    return F.filter(scored, lambda x: x["clear"] >= clear)


def with_first_line(values: Column, centre: Column, found: Column) -> Column:
    """Peaks with a faint line about a pitch above the first one, if the page has room for it and blank stone lies between."""

    def add(pitch: Column) -> Column:
        first = F.get(found, F.lit(0))
        rows = row_range(F.lit(4), first - part_of(pitch, 0.30, 6) - 1)
        apart = lambda y: F.abs(first - y - pitch) <= pitch * 0.55
        blank = lambda v: lambda y, top: (_low(v, y, first) <= F.least(F.lit(0.20), top * 0.55)) & apart(y)
        # a bump of the middle third counts only where the whole width has one
        both = lambda y, top: blank(centre)(y, top) & (F.get(values, y) >= 0.18) & (prominence(values, y) >= 0.08)
        best = _best(_clearrow_range(values, rows, 0.18, 0.08, blank(values)), _clearrow_range(centre, rows, 0.18, 0.08, both))
        room = (first >= part_of(pitch, 0.55, 16)) & (first - part_of(pitch, 0.30, 6) > 5)
        return F.when(room, _with(found, best)).otherwise(found)

    return F.when(F.size(found) >= 2, let(_gaps(found), add)).otherwise(found)


def with_short_last_line(centre: Column, found: Column) -> Column:
    """Peaks with the highest clear bump of the middle third from .65 to 1.55 pitches below the last one."""

    def add(pitch: Column) -> Column:
        last = F.element_at(found, -1)
        lo, hi = last + part_of(pitch, 0.65, 10), F.least(F.size(centre) - 2, last + _whole(pitch * 1.55))
        tops = F.filter(row_range(lo + 2, hi - 2), lambda y: (F.get(centre, y) >= 0.48) & _tops(centre, y))
        clear = F.filter(tops, lambda y: prominence(centre, y) >= 0.06)
        best = _best(F.transform(clear, lambda y: F.struct(F.get(centre, y).alias("score"), y.alias("y"))))
        far = ~F.exists(found, lambda p: F.abs(best - p) < part_of(pitch, 0.55, 10))
        return F.when((hi > lo + 4) & F.coalesce(far, F.lit(False)), _with(found, best)).otherwise(found)

    return F.when(F.size(found) >= 2, let(_gaps(found), add)).otherwise(found)


def with_edge_line(values: Column, centre: Column, found: Column) -> Column:
    """Peaks with a last line that the page's edge cuts off: where the signal rises again behind the valley below the last peak."""
    h = F.size(values)

    def add(pitch: Column) -> Column:
        last = F.element_at(found, -1)
        target, end = last + pitch, F.least(h - 2, last + part_of(pitch, 0.70, 8))
        below = span(values, last, end + 1)
        dip = (last + F.array_position(below, F.array_min(below)) - 1).cast("int")
        fits = (target <= h - 4) & (h - last >= part_of(pitch, 0.55, 14)) & (end > last + 2) & (F.get(values, dip) <= F.get(values, last) * 0.55) & (h - 1 > dip + 5)

        def rises(v: Column) -> Column:
            edge = lambda y: y >= h - part_of(pitch, 0.35, 8)
            bump = lambda y: (y < h - 3) & (F.get(v, y) >= F.get(v, y - 2)) & (F.get(v, y) >= F.get(v, F.least(h - 1, y + 2)))
            rows = F.filter(row_range(dip + 3, h - 1), lambda y: (F.get(v, y) >= 0.20) & (edge(y) | (bump(y) & (F.abs(y - target) <= pitch * 0.60))))
            return F.transform(rows, lambda y: F.struct(F.get(v, y).alias("score"), y.alias("y")))

        ranked = F.array(rises(centre), rises(values))
        top = lambda r: F.greatest(F.array_max(F.transform(r[0], lambda x: x["score"])), F.array_max(F.transform(r[1], lambda x: x["score"])))

        def place(r: Column) -> Column:
            best = _best(r[0], r[1])
            rose = (top(r) >= F.get(values, dip) + 0.05) | (top(r) >= 0.28)
            far = ~F.exists(found, lambda p: F.abs(best - p) < part_of(pitch, 0.50, 10))
            return F.when(F.coalesce(rose & far, F.lit(False)), _with(found, best)).otherwise(found)

        return F.when(fits, let(ranked, place)).otherwise(found)

    return F.when(F.size(found) >= 2, let(_gaps(found), add)).otherwise(found)


def with_second_line(values: Column, centre: Column, found: Column) -> Column:
    """A lone peak of a page's upper part (.55), with the clearest bump well below it (.38 of the page, 18 rows at least) behind blank stone."""
    h = F.size(values)
    first = F.get(found, F.lit(0))
    lo = first + part_of(h, 0.38, 18)
    blank = lambda v: lambda y, top: _low(v, first, y) <= F.least(F.lit(0.18), top * 0.50)
    best = _best(*(_clearrow_range(v, row_range(lo + 2, h - 4), 0.20, 0.10, blank(v)) for v in (values, centre)))
    second = let(best, lambda y: F.when(h - y >= part_of(h, 0.10, 10), _with(found, y)).otherwise(found))
    return F.when((F.size(found) == 1) & (first <= _whole(h * 0.55)) & (h - 2 > lo + 4), second).otherwise(found)


def _ratio(values: Column, a: Column, b: Column) -> Column:
    """The lowest row between two peaks as a share of the lower peak."""
    return _low(values, F.least(a, b), F.greatest(a, b)) / (F.least(F.get(values, a), F.get(values, b)) + 1e-6)


def separate_peaks(values: Column, found: Column) -> Column:
    """Peaks with a blank gutter between them; of two without one the stronger stays.

    A page of four peaks or more at an even pitch over .45 of its height is packed: there only ripples within a pitch and nearly
    flat dips fold. Otherwise dips to more than .58 fold, and where one peak is 1.35 times the median and no other has
    a gutter of .55 to it, it stands alone.
    """
    h = F.size(values)

    def folded(packed: Column, pitch: Column) -> Column:
        def step(kept: Column, p: Column) -> Column:
            last = F.element_at(kept, -1)
            ratio = _ratio(values, last, p)
            ripple = ((p - last < _whole(pitch * 0.78)) & (ratio > 0.58)) | ((p - last <= _whole(pitch * 1.20)) & (ratio > 0.84))
            folds = F.when(packed, ripple).otherwise(ratio > 0.58)
            own = F.when(F.get(values, p) > F.get(values, last), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(p))).otherwise(kept)
            return F.when(F.size(kept) == 0, F.array(p)).when(folds, own).otherwise(F.concat(kept, F.array(p)))

        return F.aggregate(found, F.array().cast(INTS), step)

    def by(pitch: Column) -> Column:
        gaps = widths(found)
        near = F.size(F.filter(gaps, lambda g: (g >= pitch * 0.70) & (g <= pitch * 1.45)))
        packed = (F.size(found) >= 4) & (near >= F.greatest(F.lit(2), F.size(gaps) - 1)) & (F.element_at(found, -1) - F.get(found, F.lit(0)) >= _whole(h * 0.45))
        heights = F.transform(found, lambda p: F.get(values, p))
        best = F.get(found, index_of_max(heights))
        gutter = F.exists(found, lambda p: (p != best) & (_ratio(values, best, p) <= 0.55))
        alone = ~packed & (F.array_max(heights) >= array_percentile(heights, 0.5) * 1.35) & ~gutter
        return F.when(alone, F.array(best)).otherwise(folded(packed, pitch))

    return F.when(F.size(found) < 2, found).otherwise(let(F.greatest(F.lit(12), line_pitch(values, found)), by))


def slopes(values: Column) -> Column:
    """Half the difference of each row's neighbours; at the ends the difference to the only one."""
    at = lambda i: F.get(values, i)
    last = F.size(values) - 1
    return F.transform(values, lambda v, i: F.when(last < 1, 0.0).when(i == 0, at(F.lit(1)) - v).when(i == last, v - at(i - 1)).otherwise((at(i + 1) - at(i - 1)) / 2))


def around_peak(values: Column, peak: Column, lo: Column, hi: Column) -> Column:
    """lo, hi of the band around a peak: from the first steep rise above it to the last steep fall into low rows below, with margins.

    Steep is .85 of the steepest; low is under .55. Without a rise (or fall) the band reaches to lo (or hi).
    """

    def of(d: Column) -> Column:
        up, down = span(d, lo, peak), span(d, peak, hi)
        steepest = F.array_max(up)
        rising = F.filter(row_range(lo, peak), lambda y: F.get(d, y) >= steepest * 0.85)
        top = F.when(steepest > 1e-6, F.array_min(rising)).otherwise(lo)
        deepest = F.array_min(down)
        falling = F.filter(row_range(peak, hi), lambda y: (F.get(d, y) <= deepest * 0.85) & (F.get(values, y) < 0.55))
        first = (peak + F.array_position(down, deepest) - 1).cast("int")
        bottom = F.when(deepest < -1e-6, F.coalesce(F.array_max(falling), first) + 1).otherwise(hi)
        a, b = F.greatest(lo, F.coalesce(top, lo)), F.least(hi, F.coalesce(bottom, hi))
        margin = F.greatest(F.lit(2), F.rint(F.greatest(F.lit(1), b - a) * 0.045).cast("int")) + 3
        return F.struct(F.greatest(lo, a - margin).cast("int").alias("lo"), F.least(hi, b + margin).cast("int").alias("hi"))

    return let(slopes(values), of)


def letter_bands(bands: Column, scores: Column, values: Column) -> Column:
    """Bands (lo, hi) that look like letters: .45 of the best score or within .35 of it; only the best where it is 1.45 times the kept ones' median.

    Without any score the band of the highest middle row stays.
    """
    at = lambda i: F.get(scores, i)
    best = F.array_max(scores)
    middle = F.transform(bands, lambda b: F.get(values, F.greatest(F.lit(0), F.least(F.size(values) - 1, _whole((b["lo"] + b["hi"]) / 2)))))
    good = F.filter(F.sequence(F.lit(0), F.size(bands) - 1), lambda i: at(i) >= F.greatest(best * 0.45, best - 0.35))

    def kept(found: Column) -> Column:
        own = F.transform(found, at)
        one = (F.size(found) >= 2) & (F.array_max(own) >= array_percentile(own, 0.5) * 1.45)
        return F.transform(F.when(one, F.array(F.get(found, index_of_max(own)))).otherwise(found), lambda i: F.get(bands, i))

    return F.when(F.size(bands) <= 1, bands).when(best <= 1e-6, F.array(F.get(bands, index_of_max(middle)))).otherwise(let(good, kept))


def clusters(values: Column, rows: Column, gap: Column) -> Column:
    """Rows in order, where of those nearer than gap to the last kept one the higher stays."""

    def step(kept: Column, y: Column) -> Column:
        last = F.element_at(kept, -1)
        higher = F.when(F.get(values, y) > F.get(values, last), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(y))).otherwise(kept)
        return F.when(F.size(kept) == 0, F.array(y)).when(y - last < gap, higher).otherwise(F.concat(kept, F.array(y)))

    return F.aggregate(rows, F.array().cast(INTS), step)


def own_peaks(values: Column, centre: Column) -> Column:
    """Rows of a band's own signals, three from either end at least, that are clear tops of .18 or more in either of them."""
    n = F.size(values)
    seen = lambda v: F.filter(row_range(F.lit(3), n - 3), lambda y: (F.get(v, y) >= 0.18) & _tops(v, y) & (prominence(v, y) >= 0.08))
    return F.array_sort(F.array_union(seen(values), seen(centre)))


def highest_two(values: Column, found: Column) -> Column:
    """The two highest peaks in order of place; of equal ones the later."""
    ranked = F.array_sort(F.transform(found, lambda p: F.struct((-F.get(values, p)).alias("v"), (-p).alias("p"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, 2), lambda x: -x["p"]))


def cut_merit(ratio: Column, upper: Column, lower: Column) -> Column:
    """How good a cut between two peaks is: deep, with letters on both sides."""
    return (1.0 - ratio) + F.least(upper, lower) * 0.35 + (upper + lower) * 0.15


def usual_height(bands: Column, lone_pitch: Column) -> Column:
    """The median height of the bands of up to 1.4 median heights; for a lone band no more than .95 of lone_pitch (18 rows at least), if that is known."""
    heights = F.transform(bands, lambda b: (b["hi"] - b["lo"]).cast("double"))
    median = array_percentile(heights, 0.5)
    typical = F.filter(heights, lambda x: x <= median * 1.40)
    usual = array_percentile(F.when(F.size(typical) > 0, typical).otherwise(heights), 0.5)
    by_pitch = F.when(lone_pitch.isNotNull(), F.greatest(F.lit(18.0), lone_pitch * 0.95))
    return F.when(F.size(bands) == 1, F.least(usual, by_pitch)).otherwise(usual)


def strip_band(values: Column) -> Column:
    """The only band of a strip: around its highest row, .40 of the strip about it where that is under .35 (24 rows at least)."""
    h = F.size(values)
    peak = index_of_max(values)

    def wide(b: Column) -> Column:
        half = _whole(F.greatest(b["hi"] - b["lo"], _whole(h * 0.40)) / 2)
        thin = b["hi"] - b["lo"] < part_of(h, 0.35, 24)
        return F.array(F.struct(F.when(thin, F.greatest(F.lit(0), peak - half)).otherwise(b["lo"]).cast("int").alias("lo"), F.when(thin, F.least(h, peak + half)).otherwise(b["hi"]).cast("int").alias("hi")))

    return let(around_peak(values, peak, F.lit(0), h), wide)


def first_bands(values: Column, centre: Column, p: Column, whole: Column) -> Column:
    """Bands cut in the valleys between peaks p: those past the first `whole` ones are read from the middle third.

    Bands of under .05 of the page (6 rows at least) become .12 about their peak, and a last one of more than 1.25 median heights ends after 1.15.
    """
    h, n = F.size(values), F.size(p)
    pitch = _gaps(p)
    of = lambda i, a, b: F.when(i >= whole, valley(centre, a, b)).otherwise(valley(values, a, b))

    def edges() -> Column:
        first, last = F.get(p, F.lit(0)), F.get(p, n - 1)
        inner = F.transform(row_range(F.lit(1), n), lambda i: of(i, F.get(p, i - 1), F.get(p, i)))
        return F.concat(F.array(of(F.lit(0), first - pitch, first + 1)), inner, F.array(of(n - 1, last, last + pitch + 1)))

    def between(e: Column) -> Column:
        return F.transform(p, lambda y, i: F.struct(F.get(e, i).cast("int").alias("lo"), F.least(h, F.get(e, i + 1)).cast("int").alias("hi")))

    cut = F.when(n >= 2, let(edges(), between)).otherwise(F.array(around_peak(values, F.get(p, F.lit(0)), F.lit(0), h)))
    half = part_of(h, 0.12, 6)
    thin = lambda b: b["hi"] - b["lo"] < part_of(h, 0.05, 6)
    thick = lambda b, y: F.struct(F.when(thin(b), F.greatest(F.lit(0), y - half)).otherwise(b["lo"]).alias("lo"), F.when(thin(b), F.least(h, y + half)).otherwise(b["hi"]).alias("hi"))

    def capped(b: Column) -> Column:
        last, before = F.element_at(b, -1), F.slice(b, 1, F.size(b) - 1)
        median = array_percentile(F.transform(before, lambda x: (x["hi"] - x["lo"]).cast("double")), 0.5)
        end = F.least(h, last["lo"] + F.rint(median * 1.15).cast("int"))
        over = F.concat(before, F.array(F.struct(last["lo"].alias("lo"), end.alias("hi"))))
        return F.when((F.size(b) >= 2) & (last["hi"] - last["lo"] > median * 1.25), over).otherwise(b)

    return let(let(cut, lambda b: F.transform(b, lambda x, i: thick(x, F.get(p, i)))), capped)
