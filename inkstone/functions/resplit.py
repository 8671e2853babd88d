"""Wide boxes of a line cut again where their parts score better, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.numeric import index_of_min
from inkstone.functions.signal import let, near_max, span

#: How complete the letter between two columns is.
Score = Callable[[Column, Column], Column]
#: Passes over a line at most, and the score under which a box is incomplete (fixed values).
PASSES, INCOMPLETE = 6, 0.35


def _share(height: Column, share: float, least: int) -> Column:
    return F.greatest(F.lit(least), F.floor(height * share).cast("int"))


def _box(lo: Column, hi: Column, score: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), score.cast("double").alias("score"))


def split_box(box: Column, cuts: Column, strength: Column, activity: Column, height: Column, score: Score) -> Column:
    """A box (lo, hi, score) as an array of one or two: cut where its parts gain most, the first of equal gains.

    Boxes of half the height (12 columns at least) are looked at. A cut leaves .08 of the height (4 at least) on both sides. In an
    incomplete box any cut with a part of .08 counts, and sure boundaries (.40) count .25 more; without a cut the quietest
    column is taken. In others both parts need .22: a sure boundary of a box of .70 of the height always gains; else
    parts must score .34 more than the whole, or .40 each in such a wide box.
    """
    lo, hi = box["lo"], box["hi"]
    wide, part = hi - lo >= F.floor(height * 0.70), _share(height, 0.08, 4)

    def of(whole: Column) -> Column:
        broken = ((whole < INCOMPLETE) | (box["score"] < INCOMPLETE)) & (hi - lo >= F.floor(height * 0.50))

        def tried(c: Column) -> Column:
            left, right, sure = score(lo, c), score(c, hi), near_max(strength, c) >= 0.40
            rest = left + right - whole - 0.32
            fair = F.when(F.least(left, right) >= 0.22, F.when(wide & sure, left + right).when((rest > 0.02) | (wide & (F.least(left, right) >= 0.40)), rest))
            gain = F.when(broken, F.when(F.greatest(left, right) >= 0.08, left + right + F.when(sure, 0.25).otherwise(0.0))).otherwise(fair)
            return F.struct(gain.alias("gain"), (-c).alias("k"), c.alias("at"), left.alias("left"), right.alias("right"))

        inner = F.filter(cuts, lambda c: (c >= lo + part) & (c <= hi - part))
        margin = F.greatest(part, F.floor((hi - lo) * 0.12).cast("int"))
        quiet = span(activity, lo + margin, hi - margin)
        forced = F.when(broken & (F.size(quiet) > 0), (lo + margin + index_of_min(quiet)).cast("int"))

        def chosen(best: Column) -> Column:
            at = F.coalesce(best["at"], forced)
            parts = F.array(_box(lo, at, F.coalesce(best["left"], score(lo, at))), _box(at, hi, F.coalesce(best["right"], score(at, hi))))
            return F.when(at.isNotNull(), parts).otherwise(F.array(_box(lo, hi, box["score"])))

        return let(F.array_max(F.filter(F.transform(inner, tried), lambda x: x["gain"].isNotNull())), chosen)

    return F.when(hi - lo >= _share(height, 0.50, 12), let(score(lo, hi), of)).otherwise(F.array(_box(lo, hi, box["score"])))


def split_boxes(boxes: Column, cuts: Column, strength: Column, activity: Column, height: Column, score: Score) -> Column:
    """The boxes (lo, hi, score) of a line, cut while parts win: again over all boxes as long as one of half the height is incomplete, PASSES times at most.

    cuts: ascending, distinct columns; strength and activity: a value for each column.
    """
    typed = F.transform(boxes, lambda b: _box(b["lo"], b["hi"], b["score"]))

    def again(now: Column, k: Column) -> Column:
        left = F.exists(now, lambda b: (b["score"] < INCOMPLETE) & (b["hi"] - b["lo"] >= F.floor(height * 0.50)))
        return F.when((k == 1) | left, F.flatten(F.transform(now, lambda b: split_box(b, cuts, strength, activity, height, score)))).otherwise(now)

    return F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), typed, again)
