"""Frozen splits, balanced and reservoir samples, and evaluation totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("gt_letters", "pred_boxes", "boxes_matched", "merge_or_miss", "oversplit", "boundary_hit", "boundary_missed", "boundary_false")
SEED = 7
SHARES = (0.70, 0.85)
RESERVOIR = 80_000


def portable_order(key: Column, seed: int = SEED) -> Column:
    """A hash that orders keys alike in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def frozen_split(groups: DataFrame, key: str, known: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """key, part: about 70 train, 15 val and 15 test of a hundred groups by hash, so that no group ever moves.

    known: a split (key, part) written before; its groups keep their parts and new ones go to train.
    """
    share = F.conv(F.substring(portable_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    part = F.when(share < SHARES[0], "train").when(share < SHARES[1], "val").otherwise("test")
    fresh = groups.select(key).where(F.col(key).isNotNull()).distinct()
    if known is None:
        return fresh.withColumn("part", part)
    return known.select(key, "part").unionByName(fresh.join(known, key, "left_anti").withColumn("part", F.lit("train")))


def reservoir(rows: DataFrame, key: str, cap: int = RESERVOIR, seed: int = SEED) -> DataFrame:
    """A uniform sample of `cap` rows that is the same on every run: those of the smallest hashes."""
    return rows.orderBy(portable_order(F.col(key), seed), key).limit(cap)


def lowest(rows: DataFrame, key: str, room: int, seed: int = SEED, step: int = 4) -> DataFrame:
    """The `room` rows of the smallest hashes of their keys, by a threshold that counts of hash prefixes give; no rows are sorted.

    Rows of one key that can't all be taken go by a hash of the whole row; copies beyond that are alike.
    """
    short = F.coalesce(portable_order(F.col(key), seed), F.lit("!" * 32))  # null keys come first
    whole = F.concat(short, F.md5(F.to_json(F.struct(*rows.columns))))
    edge, rest = "", room
    while rest > 0 and len(edge) < 64:
        order = short if len(edge) + step <= 32 else whole
        within = rows.where(F.substring(order, 1, len(edge)) == edge) if edge else rows
        cells = within.groupBy(F.substring(order, 1, len(edge) + step).alias("cell")).count().collect()  # at most 16**step rows, and one for nulls
        for cell, n in sorted(map(tuple, cells)):
            if n > rest:
                edge = cell
                break
            rest -= n
        else:
            return rows
        if not rest:
            break
    order = short if len(edge) <= 32 else whole
    below = rows.where(order < edge) if edge else rows.limit(0)
    if not rest:
        return below
    alike = rows.where(order == edge).limit(1).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(rest)))).drop("__copy")
    return below.unionByName(alike)


def balance_cap(rows: DataFrame, key: str, positive: Column, hard: Column, ratio: float = 2.0, seed: int = SEED) -> DataFrame:
    """All positives and hard negatives, and easy negatives up to max(0, max(pos, round(ratio * pos)) - hard)."""
    marked = rows.withColumn("__kind", F.when(positive, 0).when(hard, 1).otherwise(2))
    counts = {r["__kind"]: r["count"] for r in marked.groupBy("__kind").count().collect()}  # three rows at most
    pos, n_hard = counts.get(0, 0), counts.get(1, 0)
    room = max(0, max(pos, round(ratio * pos)) - n_hard)
    easy = lowest(marked.where("__kind = 2"), key, room, seed)
    return marked.where("__kind < 2").unionByName(easy).drop("__kind")


def totals(lines: DataFrame, part: str) -> DataFrame:
    """Sums and ratios of a per-line score table for each part and for all of it (part: all)."""
    grouped = lines.groupingSets([[F.col(part)], []], F.col(part)).agg(F.count("*").alias("lines"), *[F.sum(c).alias(c) for c in COUNTERS if c in lines.columns])
    ratio = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 4)
    return grouped.select(F.coalesce(part, F.lit("all")).alias("part"), "lines", *[c for c in COUNTERS if c in lines.columns], ratio("boxes_matched", "gt_letters").alias("recall"), ratio("boxes_matched", "pred_boxes").alias("precision"))
