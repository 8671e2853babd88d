"""Bands of pages whose lines are known beforehand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.functions import pages as G
from inkstone.functions.numeric import array_mean
from inkstone.functions.signal import span
from inkstone.operators import pages


def tents(size, tops, half=12):
    y = np.arange(size)
    return np.max([height * np.clip(1 - np.abs(y - at) / half, 0, None) for at, height in tops.items()], 0)


def one(spark, column, **arrays):
    row = {k: [float(x) for x in v] for k, v in arrays.items()}
    out = spark.createDataFrame([row], ", ".join(f"{k} array<double>" for k in row)).select(column.alias("x")).first().x
    return out


def ints(*values):
    return F.array(*[F.lit(v) for v in values])


def test_a_faint_first_line_a_pitch_above(spark):
    lines = {70: 1, 110: 1, 150: 1}
    for top, there in ((0.3, True), (0.15, False)):
        s = tents(190, lines | {30: top})
        assert one(spark, G.with_first_line(F.col("s"), F.col("s"), ints(70, 110, 150)), s=s) == [30] * there + [70, 110, 150]
    # no room above, or no blank stone between
    assert one(spark, G.with_first_line(F.col("s"), F.col("s"), ints(20, 60)), s=tents(190, {20: 1, 60: 1})) == [20, 60]
    full = np.maximum(tents(190, lines | {30: 0.4}), 0.3)
    assert one(spark, G.with_first_line(F.col("s"), F.col("s"), ints(70, 110, 150)), s=full) == [70, 110, 150]


def test_last_lines_in_the_middle_and_at_the_edge(spark):
    s, c = tents(200, {30: 1, 70: 1, 110: 1}), tents(200, {30: 1, 70: 1, 110: 1, 150: 0.5})
    assert one(spark, G.with_short_last_line(F.col("c"), ints(30, 70, 110)), c=c) == [30, 70, 110, 150]
    assert one(spark, G.with_short_last_line(F.col("c"), ints(30, 70, 110)), c=s) == [30, 70, 110]
    cut = tents(155, {30: 1, 70: 1, 110: 1, 158: 0.9})  # the page ends before the line's top
    assert one(spark, G.with_edge_line(F.col("s"), F.col("s"), ints(30, 70, 110)), s=cut) == [30, 70, 110, 153]
    assert one(spark, G.with_edge_line(F.col("s"), F.col("s"), ints(30, 70, 110)), s=s[:155]) == [30, 70, 110]
    assert one(spark, G.with_second_line(F.col("s"), F.col("s"), ints(40)), s=tents(200, {40: 1, 140: 0.4})) == [40, 140]
    assert one(spark, G.with_second_line(F.col("s"), F.col("s"), ints(40)), s=tents(200, {40: 1, 90: 0.4})) == [40]


def test_equal_bumps_go_to_the_middle_at_the_edge_and_to_the_whole_width_elsewhere(spark):
    # the middle's bump at 154 is the second of its own, as high as the whole width's first one
    s, c = tents(200, {30: 1, 70: 1, 110: 1}), tents(200, {30: 1, 70: 1, 110: 1})
    s[150], c[136], c[154] = 0.6, 0.5, 0.6
    assert one(spark, G.with_edge_line(F.col("s"), F.col("c"), ints(30, 70, 110)), s=s, c=c) == [30, 70, 110, 154]
    s, c = tents(200, {40: 1}), tents(200, {40: 1})
    s[125], s[150], c[140] = 0.3, 0.5, 0.5
    assert one(spark, G.with_second_line(F.col("s"), F.col("c"), ints(40)), s=s, c=c) == [40, 150]


def test_gutters_keep_peaks_apart(spark):
    s = tents(200, {30: 1, 70: 1, 110: 1, 150: 1})
    assert one(spark, G.separate_peaks(F.col("s"), ints(30, 70, 110, 150)), s=s) == [30, 70, 110, 150]
    # two peaks with a dip to .7 between them are one line, the higher of them
    s = np.interp(np.arange(100), [0, 30, 45, 60, 99], [0, 0.9, 0.7, 1, 0])
    assert one(spark, G.separate_peaks(F.col("s"), ints(30, 60)), s=s) == [60]
    # one that rises from ripples stands alone
    s = np.interp(np.arange(160), [0, 20, 40, 60, 90, 120, 140, 159], [0.4, 0.5, 0.4, 1, 0.4, 0.5, 0.4, 0.4])
    assert one(spark, G.separate_peaks(F.col("s"), ints(20, 60, 120)), s=s) == [60]


def test_the_band_about_a_peak(spark):
    s = np.zeros(100)
    s[40:60] = 1.0  # rises at 39 and 40, falls at 59 and 60; margins are 2 + 3
    assert tuple(one(spark, G.around_peak(F.col("s"), F.lit(50), F.lit(0), F.lit(100)), s=s)) == (34, 66)
    assert tuple(one(spark, G.around_peak(F.col("s"), F.lit(50), F.lit(36), F.lit(63)), s=s)) == (36, 63)
    assert tuple(one(spark, G.around_peak(F.col("s"), F.lit(5), F.lit(0), F.lit(20)), s=[0.5] * 20)) == (0, 20)


@pytest.mark.parametrize(("scores", "kept"), [([1.0, 0.9, 0.2], [0, 1]), ([2.0, 0.95, 0.95], [0]), ([2.0, 0.5, 1.7], [0, 2]), ([0.0, 0.0, 0.0], [2])])
def test_bands_like_bare_stone_go(spark, scores, kept):
    bands = [(0, 10), (10, 20), (20, 30)]
    column = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in bands])
    got = one(spark, G.letter_bands(column, F.array(*[F.lit(x) for x in scores]), F.col("s")), s=np.arange(30) / 30)
    assert [tuple(b) for b in got] == [bands[i] for i in kept]


def score(lo, hi):
    return F.coalesce(array_mean(span(F.col("row.c"), lo, hi)), F.lit(0.0))


def test_a_band_of_several_lines_is_cut_twice_at_most(spark):
    s = tents(200, {25: 1, 75: 1, 125: 1, 175: 1}, 20)
    df = spark.createDataFrame([(1, s.tolist(), s.tolist())], "k int, s array<double>, c array<double>")
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.lit(200).alias("hi")))
    cut = lambda n: [tuple(b) for b in pages.split_bands(df, F.col("s"), F.col("c"), whole, F.lit(50.0), score, n).first().bands]
    once, twice = cut(1), cut(2)
    assert len(once) == 2 and len(twice) >= 3 and twice[0][0] == 0 and twice[-1][1] == 200
    for bands in (once, twice):
        assert all(a[1] == b[0] for a, b in zip(bands, bands[1:])) and all(s[b[0]] == 0 or b[0] == 0 for b in bands)  # noqa: B905


def test_pages_of_known_lines(spark):
    four, two = tents(200, {30: 1, 75: 0.9, 120: 1, 165: 0.95}, 18), tents(160, {50: 1, 110: 1}, 22)
    strip = tents(60, {33: 1}, 10)
    rows = [(1, four, 300), (2, two, 200), (3, strip, 400), (1, four, 300), (4, None, 100), (5, np.zeros(0), 100)]
    rows = [(k, None if v is None else v.tolist(), w, "x", None) for k, v, w in rows]
    df = spark.createDataFrame(rows, "k int, c array<double>, w int, s string, bands string")
    out = pages.page_bands(df, F.col("c"), F.col("c"), F.col("w"), score)
    assert out.columns == ["k", "c", "w", "s", "bands"]
    got: dict = {}
    for r in out.collect():
        got.setdefault(r.k, []).append(None if r.bands is None else [tuple(b) for b in r.bands])
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and got[4] == [None] and got[5] == [None]
    for k, tops, v in ((1, [30, 75, 120, 165], four), (2, [50, 110], two), (3, [33], strip)):
        bands = got[k][0]
        assert len(bands) == len(tops) and all(lo <= t < hi for (lo, hi), t in zip(bands, tops, strict=True))
        assert all(0 <= lo < hi <= len(v) for lo, hi in bands)
