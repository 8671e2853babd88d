"""Order-dependent matching: candidates by keys and ranges in Spark, then a greedy pass over small independent groups.

Greedy results depend on order, not on grouping, as long as no candidate crosses groups. Rows are therefore first split
where no candidate can exist (a gap of more than the tolerance), so a key that holds many rows still gives small groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.operators.groups import map_groups


def islands(rows: DataFrame, keys: list[str], at: str, gap: float, order: str) -> DataFrame:
    """Adds `island`: it rises where a row comes `gap` or more after the one before it within its keys."""
    w = Window.partitionBy(*keys).orderBy(at, order)
    new = F.when(F.col(at) - F.lag(at).over(w) < gap, 0).otherwise(1)
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def overlap_islands(rows: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Adds `island`: it rises where a row's interval begins at or after the end of all before it within its keys."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("__new", F.when(F.col(lo) < before, 0).otherwise(1))
    return out.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def link_nearby(local: DataFrame, remote: DataFrame, tolerance: float) -> DataFrame:
    """local_id, remote_id: each local row in order takes the first remote row of the same text nearer than `tolerance` that none has.

    local: id, text, at, pos; remote: id, text, at, pos; pos gives the order. Rows without text aren't linked.
    """
    side = lambda d, n: d.where("text IS NOT NULL AND text <> ''").select("id", "text", "at", "pos", F.lit(n).alias("side"))
    both = islands(side(local, 0).unionByName(side(remote, 1)), ["text"], "at", tolerance, "id")

    # islands of one side only link nothing
    w = Window.partitionBy("text", "island")
    both = both.withColumns({"__lo": F.min("side").over(w), "__hi": F.max("side").over(w)}).where("__lo < __hi").drop("__lo", "__hi")

    def greedy(c: dict[str, np.ndarray]) -> list[tuple]:
        other = c["side"] == 1
        ids, at = c["id"][other], c["at"][other]
        free = np.ones(len(ids), bool)
        out = []
        for i, t in zip(c["id"][~other], c["at"][~other], strict=True):
            near = np.flatnonzero(free & (np.abs(at - t) < tolerance))
            if len(near):
                free[near[0]] = False
                out.append((i, ids[near[0]]))
        return out

    kinds = [d.schema["id"].dataType.simpleString() for d in (local, remote)]
    return map_groups(both, ["text", "island"], ["pos", "id"], f"local_id {kinds[0]}, remote_id {kinds[1]}", greedy)


def nearby_pairs(local: DataFrame, remote: DataFrame, tolerance: float) -> DataFrame:
    """local_id, remote_id of all rows (id, text, at) of one text whose times differ by less than `tolerance`.

    Times are dealt to cells of the tolerance; a remote row is met in its own cell and both next to it, so a text with
    very many rows pairs no distant ones.
    """
    cell = lambda: F.floor(F.col("at") / tolerance)
    around = remote.select(F.col("id").alias("remote_id"), "text", F.col("at").alias("then"), F.explode(F.array(*[cell() + d for d in (-1, 0, 1)])).alias("cell"))
    met = local.withColumn("cell", cell()).join(around, ["text", "cell"]).where(F.abs(F.col("at") - F.col("then")) < tolerance)
    return met.select(F.col("id").alias("local_id"), "remote_id")


def overlap_pairs(truth: DataFrame, found: DataFrame, key: str, least: float = 0.5, cell: float = 64.0) -> DataFrame:
    """key, g, p, iou, lo, hi of intervals (key, id, lo, hi) of one line whose overlap over union is at least `least` (over 0).

    lo, hi: what the two cover. Intervals meet in cells of `cell` units, a few to an interval, and count in the cell where
    the later one begins; so a line with very many intervals gives no pairs of distant ones. Empty intervals overlap nothing.
    """
    cells = F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))
    side = lambda d, n: d.where("lo < hi").select(key, F.col("id").alias(n), F.col("lo").alias(f"{n}0"), F.col("hi").alias(f"{n}1"), F.explode(cells).alias("__cell"))
    inter = F.least("g1", "p1") - F.greatest("g0", "p0")
    score = inter / F.greatest((F.col("g1") - F.col("g0")) + (F.col("p1") - F.col("p0")) - inter, F.lit(1))
    met = side(truth, "g").join(side(found, "p"), [key, "__cell"]).where("g0 < p1 AND p0 < g1").where(F.col("__cell") == F.floor(F.greatest("g0", "p0") / cell))
    return met.withColumn("iou", score).where(F.col("iou") >= least).select(key, "g", "p", "iou", F.least("g0", "p0").alias("lo"), F.greatest("g1", "p1").alias("hi"))


def match_greedy(pairs: DataFrame, key: str) -> DataFrame:
    """One-to-one pairs of each line, from the best overlap down; of equal ones the larger g, then the larger p, goes first.

    Pairs with lo and hi (as `overlap_pairs` has them) are split where nothing reaches across, so a line with very many
    pairs still gives small groups; pairs without are one group for each line. Ids must be unique within a line.
    """

    def greedy(c: dict[str, np.ndarray]) -> list[tuple]:
        used_g, used_p, keep = set(), set(), []
        for row in zip(*(c[n] for n in names), strict=True):
            g, p = row[names.index("g")], row[names.index("p")]
            if g not in used_g and p not in used_p:
                used_g.add(g)
                used_p.add(p)
                keep.append(row)
        return keep

    split = {"lo", "hi"} <= set(pairs.columns)
    own = overlap_islands(pairs, [key], "lo", "hi").drop("lo", "hi") if split else pairs
    names = [c for c in own.columns if c != "island"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "island")
    return map_groups(own, [key, "island"] if split else [key], [F.desc("iou"), F.desc("g"), F.desc("p")], schema, greedy)


def boundary_hits(truth: DataFrame, cuts: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, at, cut: each true boundary in order takes the nearest unused cut within the tolerance (the first of equal ones).

    Lines are split where neither boundaries nor cuts stand within the tolerance of each other.
    """
    side = lambda d, n: d.select(key, "at", F.lit(n).alias("side"))
    both = islands(side(truth, 0).unionByName(side(cuts, 1)), [key], "at", tolerance + 1e-9, "side")

    def greedy(c: dict[str, np.ndarray]) -> list[tuple]:
        cut = np.unique(c["at"][c["side"] == 1])
        free, out = np.ones(len(cut), bool), []
        for t in c["at"][c["side"] == 0] if len(cut) else ():
            d = np.where(free, np.abs(cut - t), np.inf)
            i = int(d.argmin())
            if d[i] <= tolerance:
                free[i] = False
                out.append((c[key][0], t, cut[i]))
        return out

    kind = truth.schema["at"].dataType.simpleString()
    return map_groups(both, [key, "island"], ["at"], f"{key} {truth.schema[key].dataType.simpleString()}, at {kind}, cut {kind}", greedy)


def merge_boxes(boxes: DataFrame, key: str, least: float = 0.15) -> DataFrame:
    """Boxes (key, x0, y0, x1, y1) of one image, merged in one pass from the largest down.

    A box joins the first kept one that holds it or overlaps it by `least` (over 0); the two become the box around them.
    A box that holds a kept one takes its place. Of equal sizes the first by its corners goes first. Images are split
    where no box reaches across a column, so one with very many boxes still gives small groups.
    """

    def merge(c: dict[str, np.ndarray]) -> list[tuple]:
        kept: list[tuple] = []
        size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
        holds = lambda a, b: a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3]
        for b in sorted(zip(*(c[n].tolist() for n in ("x0", "y0", "x1", "y1")), strict=True), key=lambda b: (-size(b), b)):
            for i, k in enumerate(kept):
                inter = max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1]))
                if holds(k, b) or inter / max(size(b) + size(k) - inter, 1) >= least:
                    kept[i] = (min(b[0], k[0]), min(b[1], k[1]), max(b[2], k[2]), max(b[3], k[3]))
                    break
                if holds(b, k):
                    kept[i] = b
                    break
            else:
                kept.append(b)
        return [(c[key][0], *b) for b in kept]

    own = boxes.select(key, "x0", "y0", "x1", "y1")
    split = overlap_islands(own, [key], "x0", "x1")
    return map_groups(split, [key, "island"], ["x0", "y0"], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), merge)
