"""Regions of pages whose inscription is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.functions import boxes
from inkstone.functions import profiles as P
from inkstone.functions import regions as R
from inkstone.functions.numeric import array_mean
from inkstone.functions.signal import span
from inkstone.operators import regions


def tents(size, tops, half=8):
    y = np.arange(size)
    return np.max([h * np.clip(1 - np.abs(y - at) / half, 0, None) for at, h in tops.items()], 0)


def one(spark, column, **arrays):
    row = {k: [float(x) for x in v] for k, v in arrays.items()}
    return spark.createDataFrame([row], ", ".join(f"{k} array<double>" for k in row)).select(column.alias("x")).first().x


def test_rows_and_columns_around_lines(spark):
    s = tents(200, {50: 1, 90: 0.9, 130: 0.3})  # the third line is under .42
    assert tuple(one(spark, R.line_rows(F.col("s")), s=s)) == (44, 97)
    assert one(spark, R.line_rows(F.col("s")), s=[0.0] * 50) is None
    x = np.concatenate([np.zeros(30), np.ones(40), np.zeros(30)])
    assert tuple(one(spark, R.line_columns(F.col("s")), s=x)) == (30, 70)
    assert one(spark, R.line_columns(F.col("s")), s=np.concatenate([np.zeros(50), np.ones(5), np.zeros(50)])) is None


def test_what_holds_for_a_whole_signal_is_computed_once_not_for_every_sample(spark):
    v = spark.createDataFrame([([0.0], [0.0])], "s array<double>, m array<double>")
    s, m = F.col("s"), F.col("m")

    def count(column, name):
        return v.select(column.alias("x"))._jdf.queryExecution().analyzed().toString().count(f"{name}(")

    assert count(R.line_columns(s), "array_sort") == 1
    assert count(R.lower_columns(s), "array_sort") == 1
    assert count(R.line_rows(s), "aggregate") == 1
    assert count(P.density_box(s, m), "array_sort") == 4  # two signals, two limits


def test_a_weak_line_below_a_block(spark):
    s, m = tents(200, {50: 1, 130: 0.2}), tents(200, {50: 1, 130: 0.4})
    ridge = lambda y1: R.lower_ridge(F.col("s"), F.col("m"), F.lit(42), F.lit(y1))
    assert one(spark, ridge(60), s=s, m=m) == 130
    assert one(spark, ridge(60), s=tents(200, {50: 1}), m=tents(200, {50: 1})) is None
    assert one(spark, ridge(60), s=np.maximum(s, 0.3), m=m) is None  # no blank gutter
    assert one(spark, R.lower_end(F.col("s"), F.col("m"), F.lit(130), F.lit(60)), s=s, m=m) == 136


def test_the_box_of_a_mask(spark):
    rows, cols = np.zeros(100), np.zeros(120)
    rows[20:60], cols[30:90] = 40, 30
    assert tuple(one(spark, R.mask_box(F.col("r"), F.col("c")), r=rows, c=cols)) == (30, 20, 90, 60)
    assert one(spark, R.mask_box(F.col("r"), F.col("c")), r=np.zeros(100), c=np.zeros(120)) is None


def test_margins_are_halves_to_even(spark):
    got = spark.range(1).select(boxes.padded(F.lit(100), F.lit(100), F.lit(275), F.lit(225), F.lit(400), F.lit(230)).alias("b")).first().b
    assert tuple(got) == (90, 92, 285, 230)  # 10.5 is 10, 7.5 is 8


@pytest.mark.parametrize(("top", "want"), [(50, ("margin_trim", (24, 38, 76, 130))), (None, ("no_bbox", (0, 0, 100, 200)))])
def test_a_page_is_cropped_to_its_lines(spark, top, want):
    s = tents(200, {50: 1, 90: 1, 120: 0.9}) if top else np.zeros(200)
    x = np.concatenate([np.zeros(28), np.ones(44), np.zeros(28)]) if top else np.zeros(100)
    df = spark.createDataFrame([(1, s.tolist(), x.tolist(), 9)], "k int, s array<double>, x array<double>, box int")
    score = lambda lo, hi: F.coalesce(array_mean(span(F.col("row.s"), lo, hi)), F.lit(0.0))
    found = regions.found_boxes(df, F.col("s"), F.col("s"), F.lit(100), lambda lo, hi: F.col("row.x"), score, F.lit(None).cast("struct<x0:int,y0:int,x1:int,y1:int>"))
    r = regions.regions(found, F.lit(100), F.lit(200)).first()
    if top:  # the box with its margins
        assert r.reason == want[0] and r.applied and r.y0 < 45 and r.y1 > 124 and r.x0 <= 28 and r.x1 >= 72
    else:
        assert (r.reason, (r.x0, r.y0, r.x1, r.y1)) == want and not r.applied
