"""Best paths over a lattice of spans, and intervals split by a fixed pitch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.operators.groups import map_groups


def arcs(lines: DataFrame, line: str, edges: str, atoms: int = 3) -> DataFrame:
    """line, i, j, lo, hi: every span of up to `atoms` neighbouring intervals between a line's sorted edges (array<int>)."""
    last = F.size(edges) - 1
    starts = lines.where(last > 0).select(line, edges, F.explode(F.sequence(F.lit(0), last - 1)).alias("i"))
    spans = starts.select(line, edges, "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("i") + atoms, last))).alias("j"))
    return spans.select(line, "i", "j", F.get(edges, F.col("i")).alias("lo"), F.get(edges, F.col("j")).alias("hi"))


def reward(score: Column, floor: float = 0.0, cost: float = 0.55) -> Column:
    """What an arc brings: its score, at least `floor`, less the cost of one more segment."""
    return F.greatest(score, F.lit(floor)) - F.lit(cost)


def best_path(scored: DataFrame, line: str, fallback: float = -0.70) -> DataFrame:
    """line, i, j, lo, hi, reward of the arcs (line, i, j, lo, hi, reward) on the path of the largest sum from 0 to the last node.

    Of equal sums the path whose last arc starts first wins. A line whose nodes no arcs connect is crossed by single
    intervals at the fallback reward. A task holds one line's arcs.
    """

    def run(c: dict[str, np.ndarray]) -> list[tuple]:
        end = int(c["j"].max())
        best, back = [0.0] + [-np.inf] * end, [None] * (end + 1)
        at = 0
        for node in range(1, end + 1):
            while at < len(c["j"]) and c["j"][at] == node:
                i = int(c["i"][at])
                if best[i] + c["reward"][at] > best[node]:
                    best[node], back[node] = best[i] + c["reward"][at], (i, int(c["lo"][at]), int(c["hi"][at]), float(c["reward"][at]))
                at += 1
            if back[node] is None:
                best[node], back[node] = best[node - 1] + fallback, (node - 1, -1, -1, fallback)
        out, node = [], end
        while node:
            i, lo, hi, r = back[node]
            out.append((c[line][0], i, node, lo, hi, r))
            node = i
        return out[::-1]

    own = scored.select(line, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), F.col("reward").cast("double").alias("reward"))
    return map_groups(own, [line], ["j", "i"], f"`{line}` {own.schema[line].dataType.simpleString()}, i int, j int, lo int, hi int, reward double", run)


def fixed_pitch(lines: DataFrame, line: str, signal: str, count: str, weight: float = 2.2) -> DataFrame:
    """line, cuts: `count` intervals of a signal (array<double>), cut where it is low and widths are near the mean."""

    def run(c: dict[str, np.ndarray]) -> list[tuple]:
        v, n = np.asarray(c[signal][0], float), int(c[count][0])
        w = len(v)
        if n < 2 or w < n:
            return [(c[line][0], [])]
        target = w / n
        x = np.arange(w + 1)
        cost = np.concatenate([weight * v, [0.0]])
        best, back = np.where(x == 0, 0.0, np.inf), []
        for layer in range(n):
            step = best[:, None] + ((x[None, :] - x[:, None] - target) / (0.35 * target)) ** 2
            step[x[None, :] <= x[:, None]] = np.inf
            back.append(step.argmin(0))
            best = step.min(0) + (cost if layer < n - 1 else 0)
        cuts, at = [], w
        for layer in range(n - 1, 0, -1):
            at = int(back[layer][at])
            cuts.append(at)
        return [(c[line][0], cuts[::-1])]

    own = lines.select(line, signal, count)
    return map_groups(own, [line], [], f"`{line}` {own.schema[line].dataType.simpleString()}, cuts array<int>", run)
