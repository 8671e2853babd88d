"""Regions of pages: where a page's inscription lies, and whether cropping to it pays. One row for each page, nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import regions as R
from inkstone.functions.boxes import padded, region_rule
from inkstone.functions.pages import part_of

#: From rows lo and hi of a page to a column signal, or to a score; columns of the pages are under `row`.
Of = Callable[[Column, Column], Column]


def found_boxes(pages: DataFrame, rows: Column, middle: Column, width: Column, columns: Of, score: Of, mask: Column) -> DataFrame:
    """pages with `box` (x0, y0, x1, y1), the estimate around all of a page's lines; null where nothing looks like letters.

    The union of the mask's box (null: none) and that of the lines' rows and columns, with a weak line below it. It must
    be .05 of the page high and wide (16 at least) and score .18.
    """
    own = lambda f: lambda s: F.when(s.isNotNull(), f(s))
    out = pages.select(F.struct(*pages.columns).alias("row"), rows.alias("s"), middle.alias("m"), width.alias("w"), mask.alias("mask"))
    s, m, w, h = F.col("s"), F.col("m"), F.col("w"), F.size("s")
    out = out.withColumn("y", R.line_rows(s)).withColumn("x", own(lambda y: R.line_columns(columns(y["y0"], y["y1"])))(F.col("y")))
    lines = F.when(F.col("x").isNotNull(), R.box(F.col("x.x0"), F.col("y.y0"), F.col("x.x1"), F.col("y.y1")))
    out = out.withColumn("box", R.union_box(F.col("mask"), lines))
    out = out.withColumn("ridge", R.lower_ridge(s, m, F.col("box.y0"), F.col("box.y1")))
    out = out.withColumn("end", F.when(F.col("ridge").isNotNull(), R.lower_end(s, m, F.col("ridge"), F.col("box.y1"))))
    top = F.greatest(F.col("box.y1"), F.col("ridge") - part_of(h, 0.08, 6))
    out = out.withColumn("wide", F.when(F.col("end") > top + 4, R.lower_columns(columns(top, F.col("end")))))
    longer = R.box(F.least(F.col("box.x0"), F.col("wide.lo")), F.col("box.y0"), F.greatest(F.col("box.x1"), F.col("wide.hi")), F.greatest(F.col("box.y1"), F.col("end")))
    out = out.withColumn("box", F.when(F.col("box").isNotNull(), longer))
    b = F.col("box")
    good = (b["y1"] - b["y0"] >= part_of(h, 0.05, 16)) & (b["x1"] - b["x0"] >= part_of(w, 0.05, 16)) & (score(b["y0"], b["y1"]) >= 0.18)
    return out.select(*(F.col("row")[c].alias(c) for c in pages.columns if c.lower() != "box"), F.when(good, b).alias("box"))


def regions(pages: DataFrame, width: Column, height: Column) -> DataFrame:
    """pages (box) with x0, y0, x1, y1, applied, ratio and reason of the part of each page to work on.

    The whole page with ratio 1 where there is no box, and where cropping doesn't pay; else the box with its margins.
    """
    b = F.col("box")
    rule = region_rule(width, height, b["x0"], b["y0"], b["x1"], b["y1"])
    out = pages.withColumn("rule_", F.when(b.isNotNull(), rule)).withColumn("crop_", F.when(F.col("rule_.apply"), padded(b["x0"], b["y0"], b["x1"], b["y1"], width, height)))
    whole = {"x0": F.lit(0), "y0": F.lit(0), "x1": width, "y1": height}
    corners = [F.coalesce(F.col(f"crop_.{n}"), v).cast("int").alias(n) for n, v in whole.items()]
    return out.select(*(c for c in pages.columns), *corners, F.coalesce("rule_.apply", F.lit(False)).alias("applied"), F.coalesce("rule_.ratio", F.lit(1.0)).alias("ratio"), F.coalesce("rule_.reason", F.lit("no_bbox")).alias("reason"))
