"""Queries of cuts between letters. A line is a block of forty parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import boundaries as B
from inkstone.functions import resplit as S
from inkstone.functions.numeric import array_mean
from inkstone.functions.signal import span
from inkstone.plans.profiles import _BLOCKS, _blocks
from inkstone.plans.registry import query
from inkstone.plans.registry import rounded as _rounded

#: Of each block: height, smoothed profile, and the peaks that stand clear by the share of the level.
_MAPS = f"""
    {_BLOCKS}, v AS (SELECT block, list(r ORDER BY i) AS v FROM p GROUP BY block), j AS (SELECT block, v, unnest(range(40)) AS j FROM v), d AS (SELECT block, v, j, unnest(range(-8, 9)) AS d FROM j),
    w AS (SELECT block, j, d, exp(-0.5 * (d / 2.0) ** 2) AS w, (j + d + 78) % 78 AS k, v FROM d), s AS MATERIALIZED (SELECT block, j, list_sum(list(w * v[CASE WHEN k < 40 THEN k ELSE 78 - k END + 1] ORDER BY d)) / list_sum(list(w ORDER BY d)) AS s FROM w GROUP BY block, j),
    h AS (SELECT block, 27 + block % 3 * 30 AS h, greatest(0.35, max(s) * CASE WHEN 27 + block % 3 * 30 < 72 THEN 0.62 ELSE 0.5 END) AS level FROM s GROUP BY block),
    l AS (SELECT *, lag(s) OVER x AS a, lead(s) OVER x AS b FROM s WINDOW x AS (PARTITION BY block ORDER BY j)), c AS (SELECT l.block, j, s, h, level FROM l JOIN h USING (block) WHERE s >= a AND s > b AND s >= level),
    e AS (SELECT c.block, c.j, c.s, h, level, coalesce(max(o.j) FILTER (o.j < c.j AND o.s > c.s), -1) AS lo, coalesce(min(o.j) FILTER (o.j > c.j AND o.s > c.s), 1000) AS hi FROM c JOIN s o ON o.block = c.block GROUP BY c.block, c.j, c.s, h, level),
    m AS (SELECT e.block, e.j, e.s, h, level, e.s - greatest(min(o.s) FILTER (o.j <= e.j), min(o.s) FILTER (o.j >= e.j)) AS clear FROM e JOIN s o ON o.block = e.block AND o.j > e.lo AND o.j < e.hi GROUP BY e.block, e.j, e.s, h, level),
    k AS (SELECT * FROM m WHERE clear >= level * CASE WHEN h < 72 THEN 0.26 ELSE 0.15 END)"""


@query(f"WITH {_MAPS} SELECT block, CAST(j AS INT) AS x, round(s, 6) AS v, round(clear, 6) AS clear FROM k")
def boundary_maps(spark, sf_dir):
    """Peaks of each line's smoothed boundary profile."""
    height = (27 + F.col("block") % 3 * 30).cast("int")
    share = F.when(height < B.DENSE, B.DENSE_SHARE).otherwise(B.SHARE)
    found = _blocks(spark, sf_dir).select("block", F.explode(B.peak_map(F.col("r"), height, share=share)["peaks"]).alias("p"))
    return found.select("block", "p.x", _rounded("p.v").alias("v"), _rounded("p.clear").alias("clear"))


@query(f"""
    WITH RECURSIVE {_MAPS}, n AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY s DESC, j) AS n FROM k),
    f AS (SELECT block, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(j BIGINT, clear DOUBLE)[]) AS kept FROM h
      UNION ALL SELECT f.block, n.n, CASE WHEN len(list_filter(kept, lambda q: abs(n.j - q.j) < greatest(8, floor(0.30 * h)) AND NOT (n.clear >= CASE WHEN h < 72 THEN 0.22 ELSE 0.10 END AND q.clear >= CASE WHEN h < 72 THEN 0.22 ELSE 0.10 END AND abs(n.j - q.j) >= greatest(3, floor(0.08 * h)) AND (n.j + 2 * q.j) % 3 <> 0))) = 0
        THEN list_append(kept, struct_pack(j := n.j, clear := n.clear)) ELSE kept END FROM f JOIN n ON n.block = f.block AND n.n = f.n + 1)
    SELECT block, coalesce(list_aggregate(list_sort(list_transform(arg_max(kept, n), lambda q: q.j)), 'string_agg', ','), '') AS cuts FROM f GROUP BY block
""")
def boundary_cuts(spark, sf_dir):
    """Cuts of each line; pairs of which the weaker column and twice the stronger add up to a multiple of three are vetoed."""
    height = (27 + F.col("block") % 3 * 30).cast("int")
    cuts = B.boundaries(F.col("r"), height, pair_ok=lambda weaker, stronger: (weaker + 2 * stronger) % 3 != 0)
    return _blocks(spark, sf_dir).select("block", F.array_join(cuts.cast("array<string>"), ",").alias("cuts"))


_SEPARATES = "{k} > 0 AND {k} < len(e) - 2 AND {l} >= 0.42 * p AND {r} >= 0.42 * p AND ({w} <= 0.32 * p OR {w} / 20.0 <= 0.22 OR ({w} <= 0.55 * least({l}, {r}) AND {w} / 20.0 <= 0.30))"
_PART = "(e[i + {b}] - e[i + {a}])"
_LEFT = _SEPARATES.format(k="i - 1", l=_PART.format(a=-1, b=0), w=_PART.format(a=0, b=1), r=_PART.format(a=1, b=2))
_RIGHT = _SEPARATES.format(k="i", l=_PART.format(a=0, b=1), w=_PART.format(a=1, b=2), r=_PART.format(a=2, b=3))


@query(f"""
    WITH RECURSIVE {_BLOCKS}, a AS (SELECT block, list(CASE WHEN r < 0.5 THEN 0.02 ELSE r END ORDER BY i) AS v, list_sort(list_distinct(list_concat([0, 40], list_transform(range(8), lambda k: (block * 7 + k * (5 + block % 6)) % 39 + 1)))) AS e FROM p GROUP BY block),
    w AS (SELECT block, v, e, list_transform(range(1, len(e)), lambda i: e[i + 1] - e[i]) AS w FROM a), t AS (SELECT *, list_filter(w, lambda x: x BETWEEN 0.35 * 20 AND 1.15 * 20) AS letters, list_filter(w, lambda x: x >= 0.25 * 20) AS strong FROM w),
    s AS (SELECT block, v, e, CAST(CASE WHEN len(letters) >= 2 THEN list_aggregate(letters, 'median') WHEN len(strong) >= 2 THEN list_aggregate(strong, 'median') ELSE 18 END AS DOUBLE) AS p FROM t),
    f AS (SELECT block, v, p, e, 0 AS k FROM s UNION ALL SELECT block, v, p, list_concat(e[1 : x], e[x + 2 :]), k + 1 FROM (SELECT *, list_filter(range(1, len(e) - 1), lambda i: NOT coalesce({_LEFT}, false) AND NOT coalesce({_RIGHT}, false) AND e[i + 2] - e[i] <= 1.22 * p AND least(e[i + 1] - e[i], e[i + 2] - e[i + 1]) <= 0.52 * p
        AND NOT coalesce(e[i + 1] > 0 AND e[i + 1] < 40 AND list_avg(v[greatest(0, e[i + 1] - 2) + 1 : least(40, e[i + 1] + 3)]) < 0.08 AND least(list_avg(v[greatest(0, e[i + 1] - 6) + 1 : e[i + 1]]), list_avg(v[e[i + 1] + 1 : least(40, e[i + 1] + 6)])) >= 0.16, false))[1] AS x FROM f WHERE len(e) >= 3) y WHERE x IS NOT NULL)
    SELECT block, array_to_string(arg_max(e, k), ',') AS edges, CAST(max(k) AS INT) AS taken FROM f GROUP BY block
""")
def coalesced_edges(spark, sf_dir):
    """Edges of each line without those inside a letter, and how many were taken out."""
    low = _blocks(spark, sf_dir).withColumn("v", F.transform("r", lambda x: F.when(x < 0.5, 0.02).otherwise(x)))
    block = F.col("block")
    edges = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((block * 7 + k * (5 + block % 6)) % 39 + 1).cast("int"))
    lines = low.withColumn("e", F.array_sort(F.array_union(F.array(F.lit(0), F.lit(40)), edges)))
    found = lines.withColumn("c", B.coalesced_edges(F.col("e"), F.col("v"), F.lit(20)))
    return found.select("block", F.array_join(F.col("c").cast("array<string>"), ",").alias("edges"), (F.size("e") - F.size("c")).alias("taken"))


_SCORE = "(0.7 * list_avg(list_transform(v[{a} + 1 : {b}], lambda x: x * x)))"
_L, _R, _WHOLE = _SCORE.format(a="b.lo", b="c"), _SCORE.format(a="c", b="b.hi"), _SCORE.format(a="b.lo", b="b.hi")
_SURE = "list_max(g[greatest(0, c - 3) + 1 : least(40, c + 4)]) >= 0.40"
#: What a cut c of box b gains, null where it doesn't count; lines are 14 high.
_GAIN = f"""CASE WHEN ({_WHOLE} < 0.35 OR b.s < 0.35) AND b.hi - b.lo >= 7 THEN CASE WHEN greatest({_L}, {_R}) >= 0.08 THEN {_L} + {_R} + CASE WHEN {_SURE} THEN 0.25 ELSE 0.0 END END
    WHEN least({_L}, {_R}) >= 0.22 THEN CASE WHEN b.hi - b.lo >= 9 AND {_SURE} THEN {_L} + {_R} WHEN {_L} + {_R} - {_WHOLE} - 0.32 > 0.02 OR (b.hi - b.lo >= 9 AND least({_L}, {_R}) >= 0.40) THEN {_L} + {_R} - {_WHOLE} - 0.32 END END"""
_MARGIN = "greatest(4, CAST(floor((b.hi - b.lo) * 0.12) AS INT))"
_QUIET = f"v[b.lo + {_MARGIN} + 1 : b.hi - {_MARGIN}]"
_CUT = f"""CASE WHEN b.hi - b.lo >= 12 THEN coalesce(-(list_sort(list_filter(list_transform(list_filter(cuts, lambda c: c >= b.lo + 4 AND c <= b.hi - 4), lambda c: struct_pack(gain := {_GAIN}, k := -c)), lambda x: x.gain IS NOT NULL))[-1]).k,
    CASE WHEN ({_WHOLE} < 0.35 OR b.s < 0.35) AND len({_QUIET}) > 0 THEN b.lo + {_MARGIN} + list_position({_QUIET}, list_min({_QUIET})) - 1 END) END"""


@query(f"""
    WITH RECURSIVE {_BLOCKS}, s AS (SELECT block, list(r ORDER BY i) AS v, list(c ORDER BY i) AS g, list_sort(list_distinct(list_transform(range(4), lambda k: CAST((block * 3 + k * 11) % 38 + 1 AS INT)))) AS cuts FROM p GROUP BY block),
    f AS (SELECT block, 0 AS k, [struct_pack(lo := 0, hi := 26, s := 0.3::DOUBLE), struct_pack(lo := 26, hi := 40, s := 0.6::DOUBLE)] AS boxes FROM s
      UNION ALL SELECT f.block, k + 1, flatten(list_transform(list_transform(boxes, lambda b: struct_pack(lo := b.lo, hi := b.hi, s := b.s, at := CAST({_CUT} AS INT))), lambda b: CASE WHEN b.at IS NULL THEN [struct_pack(lo := b.lo, hi := b.hi, s := b.s)]
        ELSE [struct_pack(lo := b.lo, hi := b.at, s := {_SCORE.format(a="b.lo", b="b.at")}), struct_pack(lo := b.at, hi := b.hi, s := {_SCORE.format(a="b.at", b="b.hi")})] END))
        FROM f JOIN s USING (block) WHERE k < 6 AND (k = 0 OR len(list_filter(boxes, lambda b: b.s < 0.35 AND b.hi - b.lo >= 7)) > 0)),
    e AS (SELECT block, unnest(arg_max(boxes, k)) AS b FROM f GROUP BY block)
    SELECT block, b.lo AS lo, b.hi AS hi, round(b.s, 6) AS score FROM e
""")
def split_boxes(spark, sf_dir):
    """Two boxes of each line, cut while parts win; the mean square of the profile stands for completeness."""
    block, v = F.col("block"), F.col("r")
    score = lambda lo, hi: F.coalesce(array_mean(F.transform(span(v, lo, hi), lambda x: x * x)) * 0.7, F.lit(0.0))
    cuts = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ((block * 3 + k * 11) % 38 + 1).cast("int"))))
    boxes = F.expr("array(struct(0 AS lo, 26 AS hi, 0.3D AS score), struct(26 AS lo, 40 AS hi, 0.6D AS score))")
    found = _blocks(spark, sf_dir).select("block", F.explode(S.split_boxes(boxes, cuts, F.col("c"), v, F.lit(14), score)).alias("b"))
    return found.select("block", "b.lo", "b.hi", _rounded("b.score").alias("score"))
