"""The region of a page that holds its inscription, as Column expressions; `operators.regions` chains them.

`rows` is the row signal of a page's whole width, `middle` that of its middle half (array<double>); `columns(lo, hi)` gives the
column signal of the rows lo to hi. Boxes are structs x0, y0, x1, y1, ends exclusive; null where there is none. What a step asks of
every sample (a maximum, a median, a limit) is bound by `let` first: within a lambda it would be computed anew for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.numeric import array_percentile
from inkstone.functions.pages import part_of, row_range
from inkstone.functions.profiles import density_box, expanded_peak
from inkstone.functions.signal import let, span

Columns = Callable[[Column, Column], Column]
INTS = "array<int>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(v.cast("int").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))))


def _ends(values: Column, least: Column) -> Column:
    """lo, hi around all samples of at least `least`."""
    at = lambda limit: F.filter(F.transform(values, lambda v, i: F.when(v >= limit, i)), lambda i: i.isNotNull())
    return let(let(least, at), lambda found: F.struct(F.array_min(found).alias("lo"), (F.array_max(found) + 1).alias("hi")))


def mask_box(row_counts: Column, column_counts: Column) -> Column:
    """The box of a stroke mask, from its pixels in each row and each column: where they are dense, else around all of them.

    The latter needs .0015 of the page's pixels (48 at least) and 12 rows and columns.
    """
    h, w = F.size(row_counts), F.size(column_counts)
    dense = density_box(F.transform(row_counts, lambda v: v / w), F.transform(column_counts, lambda v: v / h))
    pixels = F.aggregate(row_counts, F.lit(0.0), lambda a, v: a + v)
    ends = F.struct(_ends(column_counts, F.lit(1)).alias("x"), _ends(row_counts, F.lit(1)).alias("y"))

    def around(e: Column) -> Column:
        x, y = e["x"], e["y"]
        enough = (pixels >= F.greatest(F.lit(48), F.floor(h * w * 0.0015))) & (x["hi"] - x["lo"] >= 12) & (y["hi"] - y["lo"] >= 12)
        return F.when(enough, box(x["lo"], y["lo"], x["hi"], y["hi"]))

    of = lambda b: F.when(b.isNotNull(), box(b["x0"], b["y0"], b["x1"], b["y1"]))
    return F.coalesce(let(dense, of), let(ends, around))


def line_rows(rows: Column) -> Column:
    """y0, y1 around all lines: the peaks of .42 of the highest, .04 of the page apart (6 rows at least), each as far as rows hold .20 of it; null under 12 rows."""
    at = lambda i: F.get(rows, i)
    h = F.size(rows)
    tops = lambda highest: F.filter(row_range(F.lit(1), h - 1), lambda i: (at(i) >= at(i - 1)) & (at(i) >= at(i + 1)) & (at(i) >= highest * 0.42))
    kept = lambda found: F.aggregate(found, F.array().cast(INTS), lambda acc, i: F.when((F.size(acc) == 0) | (i - F.element_at(acc, -1) >= part_of(h, 0.04, 6)), F.concat(acc, F.array(i))).otherwise(acc))
    spans = lambda highest: F.transform(kept(tops(highest)), lambda i: expanded_peak(rows, i, 0.20))
    ends = lambda s: F.struct(F.array_min(F.transform(s, lambda x: x["lo"])).alias("y0"), F.array_max(F.transform(s, lambda x: x["hi"])).alias("y1"))
    tall = lambda y: F.when(y["y1"] - y["y0"] >= 12, y)
    return let(F.array_max(rows), lambda highest: F.when(highest > 1e-6, let(let(spans(highest), ends), tall)))


def line_columns(columns: Column) -> Column:
    """x0, x1 around the columns of .24 of the highest that also stand .12 above the median towards it; null under 12 columns or without any signal."""

    def of(own: Column) -> Column:
        top = F.array_max(own)
        limit = let(array_percentile(own, 0.5), lambda median: F.greatest(median + (top - median) * 0.12, top * 0.24))
        wide = lambda ends: F.when(ends["hi"] - ends["lo"] >= 12, F.struct(ends["lo"].alias("x0"), ends["hi"].alias("x1")))
        return F.when(top > 1e-6, let(_ends(own, limit), wide))

    return let(columns, of)


def lower_ridge(rows: Column, middle: Column, y0: Column, y1: Column) -> Column:
    """The row of a weak line below a block of lines (y0, y1), behind a blank gutter; null without one.

    Candidates are local tops of .12 of the block's highest row (.14 at least), .04 of the page below it (3 rows at least); the whole
    width's signal falls between to .22, to .55 of them and to .40 of the block. The highest wins, those of the middle count .15 more.
    """
    h = F.size(rows)
    lo = F.least(h - 4, y1 + part_of(h, 0.04, 3))

    def ranked(signal: Column, k: int, main: Column) -> Column:
        at = lambda y: F.get(signal, y)
        valley = lambda y: F.array_min(span(rows, F.greatest(F.lit(0), y1 - 1), y + 1))
        top = lambda y: (at(y) >= F.greatest(F.lit(0.14), main * 0.12)) & (at(y) >= at(y - 1)) & (at(y) >= at(y + 1))
        blank = lambda y: let(valley(y), lambda v: (v <= F.least(F.lit(0.22), at(y) * 0.55)) & (v <= main * 0.40))
        found = F.filter(row_range(lo + 1, h - 2), lambda y: top(y) & blank(y))
        return F.transform(found, lambda y: F.struct((at(y) + 0.15 * k).alias("score"), F.lit(k).alias("k"), (-y).alias("y")))

    def ridge(main: Column) -> Column:
        room = (y1 < h - 6) & (main > 1e-6) & (h - 2 > lo + 4)
        return F.when(room, -F.array_max(F.concat(ranked(middle, 1, main), ranked(rows, 0, main)))["y"])

    return let(F.coalesce(F.array_max(span(rows, y0, y1)), F.array_max(rows)), ridge)


def lower_end(rows: Column, middle: Column, ridge: Column, y1: Column) -> Column:
    """End row of a block with the weak line at `ridge`: as far as the middle holds .28 of it, or the whole width .22."""
    return F.least(F.size(rows), F.greatest(y1, expanded_peak(middle, ridge, 0.28)["hi"], expanded_peak(rows, ridge, 0.22)["hi"]))


def lower_columns(columns: Column) -> Column:
    """lo, hi of a weak line's columns: those of .18 of the highest and no less than the median."""
    return _ends(columns, F.greatest(F.array_max(columns) * 0.18, array_percentile(columns, 0.5)))


def union_box(a: Column, b: Column) -> Column:
    """The box around both, or the one there is."""
    return F.when(a.isNotNull() | b.isNotNull(), box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"])))
