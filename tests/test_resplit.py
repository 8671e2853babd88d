"""Boxes that are cut while their parts win."""

import itertools

from pyspark.sql import functions as F

from inkstone.functions import resplit as S


def cut(spark, boxes, cuts, score, strength=None, activity=None, height=20, size=60):
    row = ([dict(zip(("lo", "hi", "score"), b, strict=True)) for b in boxes], cuts, strength or [0.0] * size, activity or [0.5] * size)
    df = spark.createDataFrame([row], "b array<struct<lo:int,hi:int,score:double>>, c array<int>, s array<double>, a array<double>")
    found = df.select(S.split_boxes(F.col("b"), F.col("c"), F.col("s"), F.col("a"), F.lit(height), score).alias("x")).first().x
    return [tuple(b) for b in found]


def test_parts_that_win(spark):
    score = lambda lo, hi: F.when(hi - lo == 60, 0.1).when(hi - lo == 30, 0.5).otherwise(0.2)
    assert cut(spark, [(0, 60, 0.9)], [20, 30, 40], score) == [(0, 30, 0.5), (30, 60, 0.5)]
    # complete ones stay, unless parts gain .34 or a sure boundary runs through
    whole = lambda lo, hi: F.when(hi - lo == 60, 0.8).otherwise(0.35)
    assert cut(spark, [(0, 60, 0.9)], [30], whole) == [(0, 60, 0.9)]
    assert cut(spark, [(0, 60, 0.9)], [30], whole, [0.0] * 30 + [0.4] + [0.0] * 29) == [(0, 30, 0.35), (30, 60, 0.35)]
    # of equal gains the first; cuts at a box's ends don't count; narrow boxes aren't looked at
    same = lambda lo, hi: F.when(hi - lo == 60, 0.1).otherwise(0.5)
    assert cut(spark, [(0, 60, 0.9)], [2, 25, 35, 58], same) == [(0, 25, 0.5), (25, 60, 0.5)]
    assert cut(spark, [(0, 11, 0.1), (11, 60, 0.9)], [5, 30], lambda lo, hi: F.lit(0.1) + 0 * lo)[0] == (0, 11, 0.1)


def test_passes_are_bounded_and_keep_the_line_whole(spark):
    quiet = [0.5 - 0.001 * ((i * 37) % 60) for i in range(240)]
    found = cut(spark, [(0, 240, 0.2)], [], lambda lo, hi: F.lit(0.1) + 0 * lo, activity=quiet, size=240)
    assert found[0][0] == 0 and found[-1][1] == 240 and all(a[1] == b[0] for a, b in itertools.pairwise(found))
    assert 2 < len(found) <= 2**S.PASSES and min(hi - lo for lo, hi, _ in found) >= 4
    assert cut(spark, [], [5], lambda lo, hi: F.lit(0.1) + 0 * lo) == []
