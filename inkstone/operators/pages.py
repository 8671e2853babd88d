"""Bands of all lines of pages: steps on one row for each page, without a shuffle.

A step's result is a column of its own, so that expressions stay shallow; what a page needs is bounded by its height.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import pages as G
from inkstone.functions.boxes import single_line_crop
from inkstone.functions.peaks import line_peaks, line_pitch
from inkstone.functions.profiles import joined_bands, valley, widened_bands
from inkstone.functions.signal import let, span

#: From the first and the end row of a band to how letter-like it is; columns of the pages are under `row`.
Score = Callable[[Column, Column], Column]
#: How often a band that holds several lines is cut at most.
CUTS = 2


def cut_once(pages: DataFrame, score: Score) -> DataFrame:
    """pages (s, c, bands: lo, hi, go; usual) with each band that may go cut in two where it holds two lines.

    Bands of 1.6 usual heights (28 rows at least) are looked at: a cut is the valley between two neighbouring peaks of the
    band's own, with parts of .35 usual heights (10 rows at least) that score .42 of the whole each; it falls to .52 of
    the lower peak, or to .70 where parts are alike in height and score .72 of the whole. The best by depth and scores wins.
    Without one, a band of 2.15 usual heights is cut between its two highest peaks, if parts of .30 score .35. Bands that
    were cut, or that are 2.2 usual heights tall, may go again.
    """
    usual = F.col("usual")
    looked = lambda b: b["go"] & (b["hi"] - b["lo"] >= G.part_of(usual, 1.60, 28))
    own = lambda b, v: F.when(looked(b), span(F.col(v), b["lo"], b["hi"])).alias(v)  # noqa: E731  signals of bands that are looked at
    fields = lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), (b["hi"] - b["lo"]).alias("tall"), own(b, "s"), own(b, "c"), F.greatest(score(b["lo"], b["hi"]), F.lit(1e-6)).alias("whole"))
    out = pages.withColumn("x", F.transform("bands", fields))

    def each(name: str, value: Callable[[Column], Column]) -> None:
        """Adds a field to every band; a step of its own keeps expressions shallow."""
        nonlocal out
        out = out.withColumn("x", F.transform("x", lambda x: x.withField(name, value(x))))

    none = F.array().cast(G.INTS)
    each("raw", lambda x: F.when(x["s"].isNotNull(), G.own_peaks(x["s"], x["c"])).otherwise(none))
    each("few", lambda x: F.when(x["s"].isNotNull() & (F.size(x["raw"]) < 2), line_peaks(x["s"])))
    each("raw", lambda x: F.when(x["few"].isNotNull(), G.separate_peaks(x["s"], x["few"])).otherwise(x["raw"]))
    each("peaks", lambda x: F.when(F.size(x["raw"]) >= 2, G.clusters(x["s"], x["raw"], G.part_of(usual, 0.45, 10))).otherwise(none))
    # candidates: neighbouring peaks, and last the two highest
    couple = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    neighbours = lambda p: F.transform(G.row_range(F.lit(0), F.size(p) - 1), lambda i: couple(F.get(p, i), F.get(p, i + 1)))
    highest = lambda x: let(G.highest_two(x["s"], x["peaks"]), lambda t: F.array(couple(F.get(t, F.lit(0)), F.get(t, F.lit(1)))))
    each("pairs", lambda x: F.when(F.size(x["peaks"]) >= 2, F.concat(neighbours(x["peaks"]), highest(x))))
    each("cuts", lambda x: F.transform(x["pairs"], lambda p, i: F.struct(p["a"].alias("a"), p["b"].alias("b"), i.alias("i"), valley(x["s"], p["a"], p["b"] + 1).alias("at"), F.least(F.get(x["s"], p["a"]), F.get(x["s"], p["b"])).alias("peak"))))
    each("cuts", lambda x: F.transform(x["cuts"], lambda p: p.withField("upper", score(x["lo"], x["lo"] + p["at"])).withField("lower", score(x["lo"] + p["at"], x["hi"])).withField("ratio", F.get(x["s"], p["at"]) / p["peak"])))

    def merit(x: Column, p: Column) -> Column:
        at, weaker = p["at"], F.least(p["upper"], p["lower"])
        smaller, larger = F.least(at, x["tall"] - at), F.greatest(at, x["tall"] - at)
        fits = (p["b"] - p["a"] >= G.part_of(usual, 0.45, 10)) & (p["peak"] > 1e-6) & (smaller >= G.part_of(usual, 0.35, 10)) & (weaker >= x["whole"] * 0.42)
        alike = (p["ratio"] <= 0.70) & (smaller >= x["tall"] * 0.32) & (larger <= x["tall"] * 0.68) & (weaker >= x["whole"] * 0.72)
        forced = (x["tall"] >= usual * 2.15) & (smaller >= G.part_of(usual, 0.30, 10)) & (weaker >= x["whole"] * 0.35)
        last = p["i"] == F.size(x["cuts"]) - 1
        rank = F.when(last, F.when(forced, 0)).when(fits & ((p["ratio"] <= 0.52) | alike), 1)
        return F.struct(rank.alias("rank"), G.cut_merit(p["ratio"], p["upper"], p["lower"]).alias("merit"), (-p["i"]).alias("i"), at.alias("at"))

    each("best", lambda x: F.array_max(F.filter(F.transform(x["cuts"], lambda p: merit(x, p)), lambda m: m["rank"].isNotNull()))["at"])
    band = lambda lo, hi, go: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), go.alias("go"))
    parts = lambda x: F.when(x["best"].isNotNull(), F.array(band(x["lo"], x["lo"] + x["best"], F.lit(True)), band(x["lo"] + x["best"], x["hi"], F.lit(True)))).otherwise(F.array(band(x["lo"], x["hi"], x["tall"] >= usual * 2.20)))
    return out.withColumn("bands", F.flatten(F.transform("x", parts))).drop("x")


def split_bands(pages: DataFrame, values: Column, centre: Column, bands: Column, usual: Column, score: Score, cuts: int = 1) -> DataFrame:
    """pages with bands (lo, hi): those given, cut where they hold several lines, at most `cuts` times each.

    score: sees the pages' own columns under `row`, as in F.col("row.c").
    """
    every = F.transform(bands, lambda b: F.struct(b["lo"].cast("int").alias("lo"), b["hi"].cast("int").alias("hi"), F.lit(True).alias("go")))
    out = pages.select(F.struct(*pages.columns).alias("row"), values.alias("s"), centre.alias("c"), every.alias("bands"), usual.alias("usual"))
    for _ in range(cuts):
        out = cut_once(out, score)
    plain = F.transform("bands", lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi")))
    return out.select(*(F.col("row")[c].alias(c) for c in pages.columns), plain.alias("bands"))


def page_bands(pages: DataFrame, values: Column, centre: Column, width: Column, score: Score) -> DataFrame:
    """pages with bands: first and end row (lo, hi) of every line of each page, in order.

    values, centre: row signals (array<double>) of the whole width and of the middle third; width: of the page, in the
    rows' unit; score: sees the pages' own columns under `row`. A page without a signal has no bands (null). Pages that
    repeat give repeated rows; a column of the name bands is replaced. Strips four times as wide as tall are one line.
    """
    h = F.size("s")
    old = [c for c in pages.columns if c.lower() != "bands"]
    out = pages.select(F.struct(*pages.columns).alias("row"), values.alias("s"), centre.alias("c"), width.alias("width"))
    s, c, p = F.col("s"), F.col("c"), F.col("p")
    out = out.withColumn("p", line_peaks(s)).withColumn("p", G.separate_peaks(s, p)).withColumn("whole", F.size("p"))
    for found in (G.with_second_line(s, c, p), G.with_first_line(s, c, p), G.with_short_last_line(c, p), G.with_edge_line(s, c, p), G.separate_peaks(s, p)):
        out = out.withColumn("p", found)
    out = out.withColumn("bands", G.first_bands(s, c, p, F.col("whole"))).withColumn("bands", joined_bands(F.col("bands"), h))
    # a lone band's own height says nothing: the pitch of its peaks does, if there are four
    out = out.withColumn("lone", F.when(F.size("bands") == 1, line_peaks(s)))
    out = out.withColumn("pitch", F.when(F.size("lone") >= 4, line_pitch(s, F.col("lone"))))
    out = out.withColumn("usual", G.usual_height(F.col("bands"), F.col("pitch")))
    out = out.withColumn("bands", F.transform("bands", lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), F.lit(True).alias("go"))))
    for _ in range(CUTS):
        out = cut_once(out, score)
    out = out.withColumn("bands", F.transform("bands", lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"))))
    out = out.withColumn("scores", F.transform("bands", lambda b: score(b["lo"], b["hi"])))
    out = out.withColumn("bands", G.letter_bands(F.col("bands"), F.col("scores"), s)).withColumn("bands", widened_bands(F.col("bands"), s, h))
    out = out.withColumn("strip", G.strip_band(s))
    bands = F.when(h > 0, F.when(single_line_crop(h, F.col("width")), F.col("strip")).otherwise(F.col("bands")))
    return out.select(*(F.col("row")[c].alias(c) for c in old), bands.alias("bands"))
