"""Reading order, words, gaps, runs and lines, over rows of boxes or samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.numeric import upper_median
from inkstone.functions.signal import let
from inkstone.operators.ranks import percentiles


def reading_order(rows: DataFrame, line: str, center: str, position: str, rtl: bool = True) -> DataFrame:
    """Adds `reading` (from 1): right to left, rows at one place in input order."""
    w = Window.partitionBy(line).orderBy(F.desc(center) if rtl else F.asc(center), position)
    return rows.withColumn("reading", F.row_number().over(w))


def words(rows: DataFrame, line: str, order: list[str], separator: Column, character: Column) -> DataFrame:
    """line, word (from 1), text, letters: what stands between separators; words without letters vanish."""
    w = Window.partitionBy(line).orderBy(*order)
    marked = rows.withColumn("__sep", separator).withColumn("__island", F.sum(F.col("__sep").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__pos", F.row_number().over(w))
    letters = marked.where(~F.col("__sep")).withColumn("__c", character)
    found = letters.groupBy(line, "__island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__c"))), lambda x: x["__c"]), "").alias("text"), F.count("*").alias("letters"))
    numbered = Window.partitionBy(line).orderBy("__island")
    return found.where("text <> ''").select(line, F.row_number().over(numbered).alias("word"), "text", "letters")


def line_text(found: DataFrame, line: str, bar: str = "|") -> DataFrame:
    """line, text: its words joined by bars."""
    return found.groupBy(line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), bar).alias("text"))


def page_text(lines: DataFrame, page: str, line: str) -> DataFrame:
    """page, text: non-empty lines in order, by line ends."""
    return lines.where("text <> ''").groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, "text"))), lambda x: x["text"]), "\n").alias("text"))


def gaps(rows: DataFrame, line: str, x0: str, x1: str, position: str) -> DataFrame:
    """Adds `gap` to the next box to the left, null for the last one of a line."""
    w = Window.partitionBy(line).orderBy(F.desc((F.col(x0) + F.col(x1)) / 2), position)
    return rows.withColumn("gap", F.col(x0) - F.lead(x1).over(w))


def gap_threshold(gap_list: Column) -> Column:
    """From an array of a line's gaps: wide gaps begin at max(14, 3.2 median) if none is over 18, else at max(18, 2.05 median)."""
    m = upper_median(gap_list)
    return F.when(F.size(gap_list) < 1, F.lit(14.0)).when(F.array_max(gap_list) <= 18, F.greatest(F.lit(14.0), m * F.lit(3.2))).otherwise(F.greatest(F.lit(18.0), m * F.lit(2.05)))


def with_separators(rows: DataFrame, line: str, x0: str, x1: str, position: str) -> DataFrame:
    """Rows and, after each gap of at least its line's threshold, a separator two wide in the middle of the gap."""
    spaced = gaps(rows, line, x0, x1, position)
    limits = spaced.groupBy(line).agg(gap_threshold(F.collect_list("gap")).alias("__limit"))
    joined = spaced.join(limits, line)
    middle = (F.col(x0) - F.col("gap") / 2).cast("int")
    own = F.struct(F.col(x0).cast("int").alias("x0"), F.col(x1).cast("int").alias("x1"), F.lit(False).alias("is_separator"))
    bar = F.struct((middle - 1).alias("x0"), (middle + 1).alias("x1"), F.lit(True).alias("is_separator"))
    both = F.when(F.col("gap") >= F.col("__limit"), F.array(own, bar)).otherwise(F.array(own))
    return joined.select(line, F.explode(both).alias("b")).select(line, "b.x0", "b.x1", "b.is_separator")


def bars(rows: DataFrame, line: str, x0: str, x1: str, height: str, position: str) -> DataFrame:
    """Adds `is_bar`: at most 12 wide, aspect at most .42, and 14 from both neighbours (a line's end counts as far).

    Of boxes with one x0 and position the widest comes last, so it is the next one's neighbour.
    """
    w = Window.partitionBy(line).orderBy(x0, position, x1)
    width = F.col(x1) - F.col(x0)
    before, after = F.coalesce(F.col(x0) - F.lag(x1).over(w), F.lit(999)), F.coalesce(F.lead(x0).over(w) - F.col(x1), F.lit(999))
    return rows.withColumn("is_bar", (width <= 12) & (width / F.greatest(F.lit(1), F.col(height)) <= 0.42) & (before >= 14) & (after >= 14))


def clamped_crops(rows: DataFrame, line: str, x0: str, x1: str, pad: Column, width: Column, position: str) -> DataFrame:
    """Adds crop_lo, crop_hi: the padded box, no further than halfway to its neighbours and within the image."""
    w = Window.partitionBy(line).orderBy((F.col(x0) + F.col(x1)) / 2, position)
    left = F.coalesce((F.lag(x1).over(w) + F.col(x0)) / 2, F.lit(0))
    right = F.coalesce((F.lead(x0).over(w) + F.col(x1)) / 2, width)
    return rows.withColumns({"crop_lo": F.greatest(F.lit(0), F.least(F.col(x0), F.greatest(F.col(x0) - pad, left))).cast("int"), "crop_hi": F.least(width, F.greatest(F.col(x1), F.least(F.col(x1) + pad, right))).cast("int")})


def runs(rows: DataFrame, line: str, order: list[str], inside: Column, least: int = 1) -> DataFrame:
    """line, run (from 1), first, last, length: maximal runs of rows that are inside, by row number from 0."""
    w = Window.partitionBy(line).orderBy(*order)
    numbered = rows.withColumn("__n", F.row_number().over(w) - 1).withColumn("__in", F.coalesce(inside, F.lit(False)))
    kept = numbered.where("__in").withColumn("__g", F.col("__n") - F.row_number().over(w))
    found = kept.groupBy(line, "__g").agg(F.min("__n").alias("first"), F.max("__n").alias("last"), F.count("*").alias("length")).where(F.col("length") >= least)
    return found.select(line, F.row_number().over(Window.partitionBy(line).orderBy("first")).alias("run"), "first", "last", "length")


def cluster_lines(boxes: Column) -> Column:
    """Lines of an array of boxes (pos, cy, h): each box, by cy, joins the first line whose mean is near, else opens one.

    Near is within max(8, .55 of the upper median height); the result is array<struct<mean, members>> by mean.
    """
    ranked = F.sort_array(F.transform(boxes, lambda b: F.struct(b["cy"].cast("double").alias("cy"), b["pos"].cast("int").alias("pos"))))
    none = F.expr("cast(array() as array<struct<total:double,members:array<int>>>)")
    mean = lambda line: line["total"] / F.size(line["members"])

    def clustered(near: Column) -> Column:
        def join(acc: Column, b: Column) -> Column:
            first = F.array_position(F.transform(acc, lambda line: F.abs(b["cy"] - mean(line)) <= near), F.lit(True)) - 1
            own = F.array(F.struct(b["cy"].alias("total"), F.array(b["pos"]).alias("members")))
            grown = lambda line: F.struct((line["total"] + b["cy"]).alias("total"), F.concat(line["members"], F.array(b["pos"])).alias("members"))
            return let(first, lambda hit: F.when(hit < 0, F.concat(acc, own)).otherwise(F.transform(acc, lambda line, i: F.when(i == hit, grown(line)).otherwise(line))))

        return F.aggregate(ranked, none, join)

    # the limit is computed once, not for every pair of a box and a line
    found = let(F.greatest(F.lit(8.0), upper_median(F.transform(boxes, lambda b: b["h"].cast("double"))) * F.lit(0.55)), clustered)
    return F.sort_array(F.transform(found, lambda line: F.struct(mean(line).alias("mean"), line["members"].alias("members"))))


def bars_between(bars: DataFrame, letters: DataFrame, key: str, slack: int = 2, rise: int = 4) -> DataFrame:
    """Bars (key, id, x0, x1, cy) of a line that stand between a left and a right letter, at its height and inside no letter.

    letters: key, x0, x1, y0, y1. A line's letters are summed up to the three numbers that decide about height and
    neighbours; only the test for "inside a letter" joins them, with letters of the bar's own bins of 64 columns.
    """
    line = letters.groupBy(key).agg(F.min("x1").alias("first"), F.max("x0").alias("last"), (F.min("y0") - rise).alias("top"), (F.max("y1") + rise).alias("bottom"))
    near = bars.join(line, key).where("first <= x0 AND last >= x1 AND cy BETWEEN top AND bottom").select(*bars.columns)
    # a letter that holds a bar is met in the bin of the bar's left end
    held = letters.select(key, (F.col("x0") - slack).alias("lo"), (F.col("x1") + slack).alias("hi"))
    bins = F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))
    held = held.select(F.col(key).alias("__key"), "lo", "hi", F.explode(bins).alias("__bin"))
    on = (F.col(key) == F.col("__key")) & (F.floor(F.col("x0") / 64) == F.col("__bin")) & (F.col("x0") >= F.col("lo")) & (F.col("x1") <= F.col("hi"))
    return near.join(held, on, "left_anti")


def tagged_bars(boxes: DataFrame, bars: DataFrame, key: str, shift: float = 6, stretch: float = 10) -> DataFrame:
    """boxes (key, cx, width and others) with is_separator: a bar of the line has a centre and a width that are nearly the same.

    Both sides are dealt to bins of the tolerance, so that only bars of the same or the next bin meet a box.
    """
    cell = lambda c: F.floor(F.col(c) / shift)
    own = boxes.withColumn("__bin", cell("cx"))
    around = bars.select(F.col(key).alias("__key"), F.col("cx").alias("__cx"), F.col("width").alias("__width"), F.explode(F.array(*[cell("cx") + d for d in (-1, 0, 1)])).alias("__cell"))
    on = (F.col(key) == F.col("__key")) & (F.col("__bin") == F.col("__cell")) & (F.abs(F.col("cx") - F.col("__cx")) <= shift) & (F.abs(F.col("width") - F.col("__width")) <= stretch)
    tagged = own.join(around, on, "left_semi").withColumn("is_separator", F.lit(True)).unionByName(own.join(around, on, "left_anti").withColumn("is_separator", F.lit(False)))
    return tagged.drop("__bin")


def maxima(rows: DataFrame, key: str, order: list[str], value: str, threshold: float) -> DataFrame:
    """rows that are no lower than the one before, higher than the one after and at least `threshold`, with their place i.

    Places count from 0 in each key; first and last rows are no maxima. Two running windows: no task holds a series.
    """
    w = Window.partitionBy(key).orderBy(*order)
    v = F.col(value)
    marked = rows.withColumns({"i": F.row_number().over(w) - 1, "__a": F.lag(v).over(w), "__b": F.lead(v).over(w)})
    return marked.where((v >= F.col("__a")) & (v > F.col("__b")) & (v >= F.lit(threshold))).drop("__a", "__b")


def robust_pitch(rows: DataFrame, key: str, width: str, height: float) -> DataFrame:
    """key, pitch: the median width of those from .32 to 1.05 of the height, and then of those up to 1.35 of that median."""
    kept = rows.where(F.col(width).between(0.32 * height, 1.05 * height))
    first = percentiles(kept, key, width, {"__m": 0.5})
    return percentiles(kept.join(first, key).where(F.col(width) <= 1.35 * F.col("__m")), key, width, {"pitch": 0.5})


def separator_runs(boxes: DataFrame, key: str, x0: str, x1: str, separator: Column, gap: int = 3) -> DataFrame:
    """key, run, lo, hi, bars: separators that follow each other in a line, `gap` columns apart at most, as one run.

    Of boxes at one place separators come last, so that runs are a function of the boxes.
    """
    w = Window.partitionBy(key).orderBy(x0, x1, "__bar")
    marked = boxes.withColumn("__bar", F.coalesce(separator, F.lit(False)))
    joins = F.coalesce(F.col("__bar") & F.lag("__bar").over(w) & (F.col(x0) - F.lag(x1).over(w) <= gap), F.lit(False))
    numbered = marked.withColumn("__new", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("__bar").groupBy(key, "run").agg(F.min(x0).alias("lo"), F.max(x1).alias("hi"), F.count("*").alias("bars"))
