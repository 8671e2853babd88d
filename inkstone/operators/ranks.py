"""Exact order statistics of large groups, and their means in a given order, without an array or a map of all their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells that a group's range of values is cut into.
CELLS = 4096


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """group and, for each name, the value at a rank (from 0) among the group's sorted values; `n` in a rank is their number.

    Equal values are counted before anything else. Counts of cells of a group's range say which cells hold the ranks, and only
    values of these are sorted: a window runs over the cells of a group (CELLS at most) and over the distinct values of
    one cell, never over a group. Nulls don't count.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__c"))
    ends = counted.groupBy(group).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.sum("__c").alias("n"))
    low, high, v = (F.col(c).cast("double") for c in ("__low", "__high", value))
    share = (v - low) / (high - low) * CELLS
    # a range that isn't finite is one cell
    cell = F.when((high > low) & (high - low < float("inf")), F.least(F.lit(CELLS - 1), F.floor(share).cast("int"))).otherwise(0)
    placed = counted.join(ends, group).withColumn("__cell", cell)
    w = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = placed.groupBy(group, "__cell").agg(F.sum("__c").alias("__in"), F.first("n").alias("n")).withColumn("__before", F.sum("__in").over(w) - F.col("__in"))
    held = lambda r: (F.col("__before") <= r) & (r < F.col("__before") + F.col("__in"))
    wanted = cells.where(F.greatest(*[held(r).cast("int") for r in ranks.values()], F.lit(0)) == 1).select(group, "__cell", "__before")
    inner = Window.partitionBy(group, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.join(wanted, [group, "__cell"]).withColumn("__upto", F.col("__before") + F.sum("__c").over(inner))
    hit = lambda r: F.max(F.when((F.col("__upto") > r) & (F.col("__upto") - F.col("__c") <= r), F.col(value)))
    return upto.groupBy(group).agg(*[hit(r).alias(name) for name, r in ranks.items()])


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group and named percentiles, interpolated linearly between neighbouring values."""
    at = {name: (F.col("n") - 1) * F.lit(share) for name, share in shares.items()}
    both = {f"{name}__{side}": f(x) for name, x in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    both |= {f"{name}__part": x - F.floor(x) for name, x in at.items()}
    found = at_ranks(rows, group, value, {k: v for k, v in both.items() if not k.endswith("__part")})
    sizes = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    between = lambda name: F.col(f"{name}__lo") + (F.col(f"{name}__hi") - F.col(f"{name}__lo")) * both[f"{name}__part"]
    return found.join(sizes, group).select(group, *[between(name).alias(name) for name in shares])


def means_in_order(rows: DataFrame, group: str, value: Column, order: list[str], mean: str = "mean") -> DataFrame:
    """group and the mean of its values, added one after the other in the given order; nulls don't count.

    A sum of doubles depends on its order in the last place. F.avg adds parts of a group as they arrive, so a mean at a limit
    falls to either side; here it is a function of the rows if `order` is a total one. A running window: no task holds a group.
    """
    w = Window.partitionBy(group).orderBy(*order)
    so_far = rows.select(group, F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__mean"), F.row_number().over(w).alias("__i"))
    return so_far.groupBy(group).agg(F.max_by("__mean", "__i").alias(mean))
