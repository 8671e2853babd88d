"""The peaks of a page's row signal, one for each line of text, as Column expressions over array<double>.

Candidates stand clear of their surroundings; the pitch between lines comes from their gaps and the autocorrelation; the
strongest suppress nearer ones; gaps of more than a pitch and a half, and the room after the last line, are searched for
weaker lines; double humps within a line fold into one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.numeric import array_mean, array_percentile
from inkstone.functions.profiles import widths
from inkstone.functions.signal import collapse_close_peaks, indices, let, prominence, span

#: Least height and prominence of a line, and of a weak one in a gap or after the last.
LEVEL, CLEAR, GAP_LEVEL, LAST_LEVEL, WEAK = 0.32, 0.15, 0.28, 0.22, 0.06
INTS = "array<int>"


def _whole(c: Column) -> Column:
    return F.floor(c).cast("int")


def _first_max(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def clear_maxima(values: Column) -> Column:
    """Indices, two from either end at least, that no sample within two columns exceeds, and that stand clear."""
    at = lambda i: F.get(values, i)
    top = lambda i: (at(i) >= at(i - 1)) & (at(i) >= at(i + 1)) & (at(i) >= at(i - 2)) & (at(i) >= at(i + 2))
    found = F.filter(indices(F.size(values)), lambda i: (i >= 2) & (i < F.size(values) - 2) & (at(i) >= LEVEL) & top(i))
    return F.filter(found, lambda i: prominence(values, i) >= CLEAR)


def line_pitch(values: Column, found: Column) -> Column:
    """The median gap between peaks (.12 of the signal, 24 at least, without gaps), or the lag at which the signal repeats itself.

    Lags from .85 of the gap (16 at least) up to the larger of 2.8 gaps and .45 of the signal, half of it at most, count.
    The best one wins if it is 1.4 gaps or more and repeats by .10, or within .35 of a gap and repeats by .20.
    """
    h = F.size(values)
    gap = F.when(F.size(found) >= 2, _whole(array_percentile(widths(found), 0.5))).otherwise(F.greatest(F.lit(24), _whole(h * 0.12)))

    def of(med: Column) -> Column:
        lo = F.greatest(F.lit(16), _whole(med * 0.85))
        hi = F.least(_whole(h / 2), F.greatest(lo + 1, _whole(med * 2.8), _whole(h * 0.45)))

        def repeats(x: Column) -> Column:
            at = lambda d: F.aggregate(F.zip_with(F.slice(x, 1, h - d), F.slice(x, d + 1, h - d), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            return let(F.transform(F.sequence(lo, hi - 1), at), lambda ac: F.struct((lo + _first_max(ac)).cast("int").alias("lag"), (F.array_max(ac) / (at(F.lit(0)) + 1e-6)).alias("score")))

        centred = let(array_mean(values), lambda m: F.transform(values, lambda v: v - m))
        longer = lambda b: ((b["score"] >= 0.10) & (b["lag"] >= _whole(med * 1.4))) | ((b["score"] >= 0.20) & (F.abs(b["lag"] - med) <= _whole(med * 0.35)))
        return F.when(hi <= lo + 1, med).otherwise(let(let(centred, repeats), lambda b: F.when(longer(b), b["lag"]).otherwise(med)))

    return let(gap, of)


def suppressed(values: Column, found: Column, distance: Column) -> Column:
    """Peaks from the strongest down (of equal ones the first), each dropped if a kept one is nearer than `distance`; in order of position."""
    ranked = F.array_sort(F.transform(found, lambda i: F.struct((-F.get(values, i)).alias("v"), i.alias("i"))))
    kept = F.aggregate(ranked, F.array().cast(INTS), lambda acc, p: F.when(F.exists(acc, lambda k: F.abs(k - p["i"]) < distance), acc).otherwise(F.concat(acc, F.array(p["i"]))))
    return F.array_sort(kept)


def _far(found: Column, i: Column, distance: Column) -> Column:
    return ~F.exists(found, lambda q: F.abs(i - q) < distance)


def with_gaps_filled(values: Column, kept: Column, pitch: Column) -> Column:
    """Peaks with a weaker one in each gap of 1.55 pitches or more, if its highest place stands clear enough."""
    edge, distance = F.greatest(F.lit(8), _whole(pitch * 0.35)), F.greatest(F.lit(12), _whole(pitch * 0.55))

    def step(out: Column, i: Column) -> Column:
        p, following = F.get(kept, i), F.get(kept, i + 1)
        lo, hi = p + edge, following - edge
        mid = lo + _first_max(span(values, lo, hi))
        own = F.concat(out, F.array(p))
        good = following.isNotNull() & (following - p >= _whole(pitch * 1.55)) & (hi > lo) & (F.get(values, mid) >= GAP_LEVEL)
        good = F.when(good, (prominence(values, mid) >= WEAK) & _far(own, mid, distance)).otherwise(False)
        return F.when(F.coalesce(good, F.lit(False)), F.concat(own, F.array(mid))).otherwise(own)

    return F.aggregate(indices(F.size(kept)), F.array().cast(INTS), step)


def with_last_line(values: Column, found: Column, pitch: Column) -> Column:
    """Peaks with a short line after the last one, .70 to 1.55 pitches on, if its highest place is a bump of its own."""
    last = F.element_at(found, -1)
    lo, hi = last + F.greatest(F.lit(8), _whole(pitch * 0.70)), F.least(F.size(values) - 2, last + _whole(pitch * 1.55))
    mid = lo + _first_max(span(values, lo, hi))
    good = F.when((hi > lo + 4) & (F.get(values, mid) >= LAST_LEVEL), (prominence(values, mid) >= WEAK) & _far(found, mid, F.greatest(F.lit(10), _whole(pitch * 0.55)))).otherwise(False)
    return F.when(F.coalesce(good, F.lit(False)), F.concat(found, F.array(mid))).otherwise(found)


def line_peaks(values: Column) -> Column:
    """Rows of the lines of a page from its row signal; where nothing stands clear, the highest row alone."""

    def searched(found: Column) -> Column:
        def by(pitch: Column) -> Column:
            kept = suppressed(values, found, F.greatest(F.lit(12), _whole(pitch * 0.55)))
            # the room after the last line is searched only where two lines give a pitch
            filled = let(kept, lambda k: let(with_gaps_filled(values, k, pitch), lambda f: F.when(F.size(k) >= 2, with_last_line(values, f, pitch)).otherwise(f)))
            return let(F.array_sort(filled), lambda f: let(line_pitch(values, f), lambda p: collapse_close_peaks(values, f, p)))

        return let(line_pitch(values, found), by)

    return let(clear_maxima(values), lambda c: F.when(F.size(c) > 0, searched(c)).otherwise(F.array(_first_max(values))))
