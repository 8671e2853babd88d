"""Connected components over edges in DataFrames.

Alternating large-star and small-star rounds: every node's larger neighbours move to its smallest neighbour, until the
edges are stars. A round is a few aggregates and joins on the node; nothing but a row count and a checksum reaches the
driver. Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import Kept


def _smallest(pairs: DataFrame, with_self: bool) -> DataFrame:
    """(u, m): each u's smallest v.

    The key passes through an expression that keeps its value: Spark then deals both sides of the join that follows
    anew and can split a node with very many neighbours; rows of one key are summed up before they are dealt.
    """
    least = F.min("v")
    out = pairs.groupBy("u").agg(least.alias("m"))
    return out.select(F.col("u").bitwiseXOR(F.lit(0)).alias("u"), (F.least("m", "u") if with_self else F.col("m")).alias("m"))


def components(edges: DataFrame, kept: Kept, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges (a, b: bigint); component is the smallest node reachable.

    Loops and repeated edges do no harm; nulls are left out. No edges: no rows. Rounds grow with the logarithm of the
    longest path; if `rounds` aren't enough, that is an error.
    """
    now = kept.keep(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    was = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was or not state[0]:
            break
        was = state
        # large-star: u's larger neighbours to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both, True), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = kept.keep(large)
        # small-star: u and its smaller neighbours to the smallest of them
        least = _smallest(large, False)
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = kept.keep(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        kept.drop(now)
        kept.drop(large)
        now = then
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    out = kept.keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    kept.drop(now)
    return out
