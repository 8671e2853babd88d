"""Long series: places, maxima and prominence of very many rows of one key, in many tasks.

A series is cut into blocks of `WIDE` samples, blocks into blocks of blocks, and so on: a tree whose nodes hold the largest
and smallest value of each child. The nearest higher sample of a peak is found by climbing until a sibling holds one and
descending to it; every step is a join with nodes of bounded size, so work is linear in the rows and a key of any number
of rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Children of a node.
WIDE = 64
FEW = 20  # levels are never more: 64**20 samples


def positions(rows: DataFrame, key: str, bucket: Column, order: list[str]) -> DataFrame:
    """rows with i, their place (from 0) within key in the given order.

    bucket: a coarser value that never falls as the order goes on (an hour of a time, say). Windows run over the rows of
    one bucket, and over a key's buckets, never over all rows of a key.
    """
    own = rows.withColumn("bucket_", bucket)
    sizes = own.groupBy(key, "bucket_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(key).alias("key_"), F.col("bucket_").alias("of_"), before.alias("before_"))
    placed = own.withColumn("row_", F.row_number().over(Window.partitionBy(key, "bucket_").orderBy(*order)))
    met = placed.join(starts, F.col(key).eqNullSafe(F.col("key_")) & F.col("bucket_").eqNullSafe(F.col("of_")))
    return met.select(*rows.columns, (F.col("before_") + F.col("row_") - 1).cast("bigint").alias("i"))


def _div(c: Column) -> Column:
    return F.floor(c / WIDE).cast("bigint")


def tree(rows: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (key, b, children: hi and lo of each in order) of each level, the lowest first; rows: key, i, v."""
    below = rows.select("key", F.col("i").alias("b"), F.col("v").alias("hi"), F.col("v").alias("lo"))
    out = []
    for _ in range(levels):
        nodes = below.groupBy("key", _div(F.col("b")).alias("b_")).agg(F.array_sort(F.collect_list(F.struct("b", "hi", "lo"))).alias("children"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
        below = nodes.select("key", F.col("b_").alias("b"), "hi", "lo")
        out.append(nodes.select("key", F.col("b_").alias("b"), "children"))
    return out


def local_maxima(rows: DataFrame, least: float) -> DataFrame:
    """Rows (key, i, v) that are no lower than the one before, higher than the one behind and at least `least`; never the first or last.

    Each row goes to its block and, at a block's edge, to the next one too, so that windows never run over a key.
    """
    block, place = _div(F.col("i")), F.col("i") % WIDE
    both = F.array_compact(F.array(block, F.when(place == 0, block - 1), F.when(place == WIDE - 1, block + 1)))
    w = Window.partitionBy("key", "block").orderBy("i")
    met = rows.select("key", "i", "v", F.explode(both).alias("block")).withColumns({"before": F.lag("v").over(w), "behind": F.lead("v").over(w)})
    return met.where((_div(F.col("i")) == F.col("block")) & (F.col("v") >= F.col("before")) & (F.col("v") > F.col("behind")) & (F.col("v") >= least)).select("key", "i", "v")


def prominences(rows: DataFrame, peaks: DataFrame) -> DataFrame:
    """peaks (key, i, v, prominence): how far the series falls on both sides of each before it rises above it; equal samples go on.

    rows: key, i (0 to n - 1 without gaps), v; peaks: some of them. Towards an end of the series without a higher sample
    the fall is down to the lowest sample on the way. The longest series' length is the only thing the driver learns.
    """
    longest = rows.agg(F.max("i")).first()[0]
    if longest is None:
        return peaks.withColumn("prominence", F.lit(None).cast("double"))
    levels = next(k for k in range(1, FEW) if WIDE**k > longest)
    nodes = tree(rows, levels)
    at, side, v, low, children = (F.col(c) for c in ("at", "side", "v", "low", "children"))

    def searched(walk: DataFrame, level: DataFrame, node: Column, seen: Column, child) -> DataFrame:
        """The nodes' children in order of distance (seen) up to the first that holds a higher sample: the lowest on the way, and that child."""
        of = level.select(F.col("key").alias("key_"), F.col("b").alias("b_"), "children")
        met = walk.withColumn("node", node).join(of, F.col("key").eqNullSafe(F.col("key_")) & (F.col("node") == F.col("b_"))).withColumn("seen", seen)
        met = met.withColumn("hit", F.array_position(F.transform("seen", lambda x: x["hi"] > v), True).cast("int"))
        passed = F.when(F.col("hit") > 0, F.slice("seen", F.lit(1), F.greatest(F.lit(0), F.col("hit") - 1))).otherwise(F.col("seen"))
        lowest = F.least(low, F.array_min(F.transform(passed, lambda x: x["lo"])))
        return met.select("key", "i", "v", "side", lowest.alias("low"), F.col("node").alias("node"), "hit", F.when(F.col("hit") > 0, child(F.col("hit"))).alias("child"))

    walk = peaks.select("key", "i", "v", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), v.alias("low"), F.col("i").alias("at"))
    state = ["key", "i", "v", "side", "low"]
    hits = []
    for level in nodes:  # climb
        c = (at % WIDE).cast("int")
        aside = F.when(side < 0, F.reverse(F.slice(children, F.lit(1), c))).otherwise(F.slice(children, c + 2, F.lit(WIDE)))
        found = searched(walk.withColumn("c", c), level, _div(at), aside, lambda hit: at + side * hit)
        hits.append(found.where("hit > 0").select(*state, F.col("child").alias("at")))
        walk = found.where("hit = 0").select(*state, F.col("node").alias("at"))
    done = walk.select(*state)
    down = hits[-1]
    for k in range(levels - 1, 0, -1):  # descend
        whole = F.when(side < 0, F.reverse(children)).otherwise(children)
        found = searched(down, nodes[k - 1], at, whole, lambda hit: at * WIDE + F.when(side < 0, F.size(children) - hit).otherwise(hit - 1))
        down = found.select(*state, F.col("child").alias("at")).unionByName(hits[k - 1])
    every = done.unionByName(down.select(*state))
    return every.groupBy("key", "i", "v").agg((F.max("v") - F.max("low")).alias("prominence"))
