"""Cuts between letters on profiles whose peaks are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.functions import boundaries as B


def bells(size, tops, sigma=2.0):
    x = np.arange(size)
    return np.max([h * np.exp(-0.5 * ((x - at) / sigma) ** 2) for at, h in tops.items()], 0)


def cuts(spark, profile, height, **rules):
    df = spark.createDataFrame([([float(x) for x in profile],)], "v array<double>")
    return df.select(B.boundaries(F.col("v"), F.lit(height), **rules).alias("x")).first().x


def test_letters_keep_their_distance(spark):
    # 100 high: 30 columns apart; smoothing lowers bells to about .7
    assert cuts(spark, bells(200, {40: 1, 90: 1, 140: 1}), 100) == [40, 90, 140]
    assert cuts(spark, bells(200, {40: 1, 44: 0.9, 140: 1}, 1.5), 100) == [41, 140]  # smoothed into one
    assert cuts(spark, [0.1, 0.9], 100) == [] and cuts(spark, [0.0] * 50, 100) == []


def test_both_sides_of_a_separator_stay_unless_vetoed(spark):
    two = bells(200, {90: 1, 104: 0.9, 30: 0.8})
    assert cuts(spark, two, 100) == [30, 90, 104]
    assert cuts(spark, two, 100, pair_ok=lambda weaker, stronger: F.lit(False)) == [30, 90]
    # the weaker column comes first
    assert cuts(spark, two, 100, pair_ok=lambda weaker, stronger: weaker > stronger) == [30, 90, 104]
    assert cuts(spark, two, 100, pair_ok=lambda weaker, stronger: weaker < stronger) == [30, 90]


def test_dense_lines_want_higher_peaks(spark):
    low = bells(200, {40: 1, 140: 0.55})
    assert cuts(spark, low, 100) == [40, 140] and cuts(spark, low, 60) == [40]
    assert cuts(spark, low, 60, source_height=F.lit(100)) == [40, 140]


@pytest.mark.parametrize(("edges", "left"), [
    ([0, 20, 40, 60], [0, 20, 40, 60]),
    # the part before takes in two slivers of 2, the others become one part of 10: six rounds
    ([0, 20, 40, 60, 62, 64, 66, 68, 70, 72, 74, 94, 114], [0, 20, 40, 64, 74, 94, 114]),
    # slivers up to 6 wide between letters are a separator and stay
    ([0, 20, 40, 60, 62, 64, 66, 68, 70, 90, 110], [0, 20, 40, 64, 70, 90, 110]),
    ([0, 40], [0, 40]),
])
def test_edges_inside_letters_go_until_none_is_left(spark, edges, left):
    ink = [0.5] * 120
    df = spark.createDataFrame([(edges, ink)], "e array<int>, v array<double>")
    assert df.select(B.coalesced_edges(F.col("e"), F.col("v"), F.lit(20)).alias("x")).first().x == left


def test_a_deep_valley_keeps_its_edge(spark):
    ink = [0.5] * 45 + [0.0] * 5 + [0.5] * 50
    df = spark.createDataFrame([([0, 20, 40, 47, 60, 80, 100], ink)], "e array<int>, v array<double>")
    assert 47 in df.select(B.coalesced_edges(F.col("e"), F.col("v"), F.lit(20)).alias("x")).first().x
