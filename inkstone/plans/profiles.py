"""Queries of rules on profiles, widths, bars and labels. Arrays hold an order's lines or blocks of forty parts, so none grows with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import profiles as P
from inkstone.operators import layout
from inkstone.plans.registry import query
from inkstone.plans.registry import rounded as _rounded
from inkstone.sources.tables import read


def _of_orders(spark, sf_dir, value, *columns):
    """l_orderkey, v: a value of each order's lines, in order."""
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", *columns)
    return lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", value.alias("v")))), lambda x: x["v"]).alias("v"))


@query("""
    WITH e AS (SELECT l_orderkey, (l_orderkey % 90)::DOUBLE AS h, lead(l_partkey % 300) OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 300) - l_partkey % 300 AS w FROM lineitem),
    s AS (SELECT l_orderkey, h, count(*) AS n, count(*) FILTER (w BETWEEN 0.35 * h AND 1.15 * h) AS a, median(w) FILTER (w BETWEEN 0.35 * h AND 1.15 * h) AS ma, count(*) FILTER (w >= 0.25 * h) AS b, median(w) FILTER (w >= 0.25 * h) AS mb FROM e GROUP BY l_orderkey, h)
    SELECT l_orderkey, round(CASE WHEN n < 2 OR h <= 0 THEN greatest(18, 0.55 * h) WHEN a >= 2 THEN ma WHEN b >= 2 THEN mb ELSE greatest(18, 0.55 * h) END, 6) AS pitch FROM s
""")
def pitch_of_edges(spark, sf_dir):
    edges = _of_orders(spark, sf_dir, (F.col("l_partkey") % 300).cast("int"), "l_partkey")
    return edges.select("l_orderkey", _rounded(P.pitch_of_edges(F.array_sort("v"), F.col("l_orderkey") % 90)).alias("pitch"))


_ACTIVITY = "a AS (SELECT l_orderkey, list(CAST(l_discount * 6.1 AS DOUBLE) ORDER BY l_linenumber, l_discount) AS v FROM lineitem GROUP BY l_orderkey)"


def _activity(spark, sf_dir):
    return _of_orders(spark, sf_dir, F.col("l_discount").cast("double") * 6.1, "l_discount")


@query(f"""
    WITH {_ACTIVITY}, s AS (SELECT l_orderkey, v[2:len(v) - 1] AS s FROM a), m AS (SELECT l_orderkey, coalesce(list_avg(s), 0) AS mean, coalesce(list_max(s), 0) AS peak FROM s)
    SELECT l_orderkey, round(mean, 6) AS mean, round(peak, 6) AS peak, round(mean, 9) >= 0.10 OR round(peak, 9) >= 0.35 AS carved FROM m
""")
def span_ink(spark, sf_dir):
    found = _activity(spark, sf_dir).select("l_orderkey", P.span_ink(F.transform("v", lambda x: F.round(x, 9)), F.lit(1), F.size("v") - 1).alias("s"))
    return found.select("l_orderkey", _rounded("s.mean").alias("mean"), _rounded("s.peak").alias("peak"), "s.carved")


@query("""
    WITH a AS (SELECT l_orderkey, list(CAST(l_tax * 2 AS DOUBLE) ORDER BY l_linenumber) AS v FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, round(list_aggregate(v, 'quantile_cont', 0.92), 6) AS edge_peak, round(list_avg(v), 6) AS edge_mean, round(len(list_filter(v, lambda x: x > 0.10)) / len(v), 6) AS edge_ratio FROM a
""")
def content_statistics(spark, sf_dir):
    found = _of_orders(spark, sf_dir, F.col("l_tax").cast("double") * 2, "l_tax").select("l_orderkey", P.content(F.col("v")).alias("c"))
    return found.select("l_orderkey", *[_rounded(f"c.{n}").alias(n) for n in ("edge_peak", "edge_mean", "edge_ratio")])


@query("""
    WITH r AS (SELECT l_orderkey, CAST(l_tax AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CAST(l_quantity / 50 AS DOUBLE) AS c FROM lineitem),
    m AS (SELECT l_orderkey, max((a + b + c) / 3) / (avg((a + b + c) / 3) + 1e-6) AS rows, greatest(avg(a), avg(b), avg(c)) / ((avg(a) + avg(b) + avg(c)) / 3 + 1e-6) AS cols, avg(b) AS am, max(b) AS ap FROM r GROUP BY l_orderkey),
    f AS (SELECT l_orderkey, quantile_cont(x, 0.92) AS p FROM (SELECT l_orderkey, unnest([a, b, c]) AS x FROM r) GROUP BY l_orderkey)
    SELECT m.l_orderkey, round(p, 6) AS edge_peak, round(cols, 6) AS column_coherence, round(rows, 6) AS row_coherence, round(am, 6) AS activity_mean, round(ap, 6) AS activity_peak, 1.0::DOUBLE AS object_mean, 3.0::DOUBLE AS width FROM m JOIN f USING (l_orderkey)
""")
def segment_scores(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    rows = _of_orders(spark, sf_dir, F.array(d("l_tax"), d("l_discount"), d("l_quantity") / 50), "l_tax", "l_discount", "l_quantity")
    found = rows.select("l_orderkey", P.segment_scores(F.col("v"), F.transform("v", lambda r: F.get(r, 1))).alias("s"))
    return found.select("l_orderkey", *[_rounded(f"s.{n}").alias(n) for n in ("edge_peak", "column_coherence", "row_coherence", "activity_mean", "activity_peak")], "s.object_mean", "s.width")


#: Signals of forty columns, one for each block of forty part keys; a key that is missing is a column of zero.
_BLOCKS = """
    p AS (SELECT block, i, coalesce(CAST(p_size / 50 AS DOUBLE), 0) AS r, coalesce(CAST((p_partkey * 7 % 50) / 50 AS DOUBLE), 0) AS c
      FROM (SELECT DISTINCT p_partkey // 40 AS block FROM part) CROSS JOIN (SELECT unnest(range(40)) AS i) LEFT JOIN part ON p_partkey = block * 40 + i)"""


def _blocks(spark, sf_dir):
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part", "p_partkey", "p_size").select(F.floor(key / 40).alias("block"), (key % 40).alias("i"), (F.col("p_size") / 50).alias("r"), ((key * 7 % 50) / 50).alias("c"))
    both = rows.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("r", "c").alias("v")))).alias("x"))
    column = lambda n: F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.coalesce(F.try_element_at("x", i.cast("bigint"))[n], F.lit(0.0))).alias(n)
    return both.select("block", column("r"), column("c"))


@query(f"""
    WITH {_BLOCKS}, o AS (SELECT block, r, c, row_number() OVER (PARTITION BY block ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY block) AS n FROM p),
    t AS (SELECT block, greatest(0.08, quantile_cont(r, 0.88) * 0.55) AS tr, greatest(0.06, quantile_cont(c, 0.88) * 0.55) AS tc FROM p GROUP BY block),
    e AS (SELECT block, min(n) AS n, min(i) FILTER (r >= tr) AS y0, max(i) FILTER (r >= tr) + 1 AS y1, min(i) FILTER (c >= tc) AS x0, max(i) FILTER (c >= tc) + 1 AS x1,
      min(i) FILTER (r >= greatest(0.04, tr * 0.65)) AS b0, max(i) FILTER (r >= greatest(0.04, tr * 0.65)) + 1 AS b1, min(i) FILTER (c >= greatest(0.03, tc * 0.65)) AS a0, max(i) FILTER (c >= greatest(0.03, tc * 0.65)) + 1 AS a1 FROM o JOIN t USING (block) GROUP BY block)
    SELECT block, CASE WHEN n < 4 THEN 'none' WHEN x0 IS NULL OR y0 IS NULL THEN concat_ws(',', a0, b0, a1, b1) WHEN x1 - x0 > 8 AND y1 - y0 > 8 THEN concat_ws(',', x0, y0, x1, y1) ELSE 'none' END AS box FROM e
""")
def density_box(spark, sf_dir):
    box = P.density_box(F.col("r"), F.col("c"))
    return _blocks(spark, sf_dir).select("block", box.alias("b")).select("block", F.coalesce(F.when(F.col("b").isNotNull(), F.concat_ws(",", *[F.col(f"b.{n}").cast("string") for n in ("x0", "y0", "x1", "y1")])), F.lit("none")).alias("box"))


@query(f"""
    WITH {_BLOCKS}, o AS (SELECT block, r, c, row_number() OVER (PARTITION BY block ORDER BY i) - 1 AS i FROM p),
    w AS (SELECT block, i, 1 + 14 * r + 12 * c * (1 - r) + 10 * exp(-0.5 * ((i - 9.5) / 2.5) ** 2) + 6 * exp(-0.5 * ((i - 19.5) / 2.5) ** 2) AS w FROM o)
    SELECT block, CAST(i AS INT) AS i, round(greatest(1, least(40, w)), 6) AS w FROM w
""")
def column_weights(spark, sf_dir):
    letters = F.expr("array(struct(2 AS lo, 9 AS hi), struct(10 AS lo, 18 AS hi), struct(21 AS lo, 27 AS hi), struct(34 AS lo, 38 AS hi))")
    found = _blocks(spark, sf_dir).select("block", F.posexplode(P.column_weights(F.col("r"), F.col("c"), letters, real=True)).alias("i", "w"))
    return found.select("block", "i", _rounded("w").alias("w"))


@query("""
    SELECT p_partkey, round(0.35 * least(1.5, v / (h + 1e-6)) + 0.30 * least(1, p / (m + 1e-6) / 4) + 0.20 * c + 0.15 * least(1, s * 3), 6) AS score
    FROM (SELECT p_partkey, (p_size + 3)::DOUBLE AS v, (p_partkey % 31 + 1)::DOUBLE AS h, (p_partkey % 9)::DOUBLE AS p, (p_partkey % 4 + 1)::DOUBLE AS m, p_partkey % 10 / 10.0::DOUBLE AS c, p_partkey % 7 / 14.0::DOUBLE AS s FROM part)
""")
def band_score(spark, sf_dir):
    key = F.col("p_partkey")
    score = P.band_score(F.col("p_size") + 3.0, key % 31 + 1.0, key % 9 + 0.0, key % 4 + 1.0, key % 10 / 10.0, key % 7 / 14.0)
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", _rounded(score).alias("score"))


@query("""
    WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS w FROM lineitem), n AS (SELECT *, lag(w) OVER o AS a, lead(w) OVER o AS z FROM b WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, w))
    SELECT l_orderkey, l_linenumber, coalesce(a >= 0.42 * 40 AND z >= 0.42 * 40, false) AND (w <= 0.32 * 40 OR w / 60 <= 0.24 OR (w <= 0.55 * least(a, z) AND w / 60 <= 0.30)) AS separates FROM n
""")
def separator_boxes(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity")
    w = F.col("l_quantity").cast("double")
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return lines.select("l_orderkey", "l_linenumber", P.word_separator_box(w, F.lit(60), F.lit(40), F.lag(w).over(order), F.lead(w).over(order)).alias("separates"))


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS w, (l_discount * 8)::DOUBLE AS ap, (l_tax * 2)::DOUBLE AS am, (l_suppkey % 10 / 10.0)::DOUBLE AS om, (l_partkey % 20 / 20.0)::DOUBLE AS op, (l_suppkey % 7 / 10.0)::DOUBLE AS ep, (l_partkey % 11 / 10.0)::DOUBLE AS conf FROM lineitem)
    SELECT l_orderkey, l_linenumber, (w BETWEEN 2 AND 16 AND round(ap, 9) >= 0.40 AND round(am, 9) >= 0.12) OR (conf >= 0.85 AND (om >= 0.70 OR op >= 0.85 OR (ep >= 0.20 AND round(ap, 9) >= 0.35))) AS stays FROM s
""")
def rescued_segments(spark, sf_dir):
    d = lambda c: F.round(c.cast("double"), 9)
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    scores = F.struct(F.col("l_quantity").cast("double").alias("width"), d(F.col("l_discount") * 8).alias("activity_peak"), d(F.col("l_tax") * 2).alias("activity_mean"), (supp % 10 / 10.0).alias("object_mean"), (part % 20 / 20.0).alias("object_peak"), (supp % 7 / 10.0).alias("edge_peak"))
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_suppkey", "l_partkey")
    return lines.select("l_orderkey", "l_linenumber", P.rescued_segment(scores, F.lit(60), part % 11 / 10.0).alias("stays"))


@query(f"""
    WITH {_BLOCKS}, a AS (SELECT block, list(r ORDER BY i) AS v FROM p GROUP BY block), c AS (SELECT block, v, unnest([0, 3, 11, 20, 28, 36, 40]) AS c FROM a),
    k AS (SELECT block, c, len(v) AS n, coalesce(list_max(v[greatest(0, c - 6) + 1 : c]), 0) AS l, coalesce(list_max(v[c + 1 : least(len(v), c + 6)]), 0) AS r FROM c)
    SELECT block, coalesce(string_agg(c, ',' ORDER BY c) FILTER (c > 0 AND c < n AND (least(l, r) >= 0.92 OR (c <= 8 AND r >= 0.92) OR (n - c <= 8 AND l >= 0.92))), '') AS cuts FROM k GROUP BY block
""")
def active_cuts(spark, sf_dir):
    cuts = F.array(*[F.lit(c) for c in (0, 3, 11, 20, 28, 36, 40)])
    found = _blocks(spark, sf_dir).select("block", P.active_cuts(cuts, F.col("r"), F.lit(25), 0.92).alias("cuts"))
    return found.select("block", F.array_join(F.col("cuts").cast("array<string>"), ",").alias("cuts"))


@query(f"""
    WITH {_BLOCKS}, a AS (SELECT block, list(CASE WHEN r < 0.5 THEN 0.02 ELSE r END ORDER BY i) AS v FROM p GROUP BY block), c AS (SELECT block, v, unnest(range(0, 41)) AS c FROM a)
    SELECT block, count(*) AS valleys, CAST(sum(c) AS BIGINT) AS places FROM c
    WHERE c > 0 AND c < len(v) AND list_avg(v[greatest(0, c - 2) + 1 : least(len(v), c + 3)]) < 0.08 AND least(list_avg(v[greatest(0, c - 6) + 1 : c]), list_avg(v[c + 1 : least(len(v), c + 6)])) >= 0.16 GROUP BY block
""")
def deep_valleys(spark, sf_dir):
    low = _blocks(spark, sf_dir).select("block", F.transform("r", lambda x: F.when(x < 0.5, 0.02).otherwise(x)).alias("v"))
    found = low.select("block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda c: F.coalesce(P.deep_valley(F.col("v"), c, F.lit(60)), F.lit(False)))).alias("c"))
    return found.groupBy("block").agg(F.count("*").alias("valleys"), F.sum("c").alias("places"))


@query(f"""
    WITH {_BLOCKS}, a AS (SELECT block, list(r ORDER BY i) AS v FROM p GROUP BY block), s AS (SELECT block, v, block % 12 + 18 AS n, v[block % 12 + 20 : 40] AS junk FROM a),
    t AS (SELECT block, n, greatest(2, CAST(floor(0.15 * n) AS INT)) AS m, v[1 : n] AS col FROM s), u AS (SELECT *, col[m + 1 : n - m] AS mid FROM t), x AS (SELECT *, list_position(mid, list_min(mid)) - 1 + m AS c FROM u)
    SELECT block, CASE WHEN n > 10 * 1.55 AND list_max(col) > 0 AND len(mid) >= 4 AND c >= 6 AND n - c >= 6 THEN '0-' || c || ',' || c || '-' || n ELSE '0-' || n END AS parts FROM x WHERE len(col) = n
""")
def wide_split(spark, sf_dir):
    n = (F.col("block") % 12 + 18).cast("int")
    found = _blocks(spark, sf_dir).select("block", P.wide_split(F.lit(0), n, F.slice("r", F.lit(1), n), F.lit(10)).alias("p"))
    return found.select("block", F.array_join(F.transform("p", lambda x: F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string"))), ",").alias("parts"))


@query()
def absorbed_slivers(spark, sf_dir):
    """Boxes of a block's runs, where slivers join the body they touch."""
    boxes = F.expr("array(struct(0 AS lo, 2 AS hi, 0.5D AS score), struct(3 AS lo, 12 AS hi, 0.7D AS score), struct(13 AS lo, 15 AS hi, 0.9D AS score), struct(16 AS lo, 30 AS hi, 0.4D AS score), struct(30 AS lo, 33 AS hi, 0.2D AS score))")
    found = _blocks(spark, sf_dir).select("block", P.absorbed_slivers(boxes, F.col("r"), F.lit(30)).alias("b"))
    return found.select("block", F.array_join(F.transform("b", lambda x: F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string"), F.lit(":"), x["score"].cast("string"))), ",").alias("boxes"))


@query(f"""
    WITH {_BLOCKS}, a AS (SELECT block, list(r ORDER BY i) AS v FROM p GROUP BY block), t AS (SELECT block, v, (block % 9 + 28)::DOUBLE AS h, [0.5 + block % 5 / 20.0, 0.6, 0.7]::DOUBLE[] AS s, (block % 10 / 10.0)::DOUBLE AS m FROM a)
    SELECT block, round(CASE WHEN 8 / h BETWEEN 0.14 AND 0.34 AND 9 / h BETWEEN 0.14 AND 0.34 AND 26 / h BETWEEN 0.48 AND 0.95 AND m < list_max(s) + 0.05 AND list_avg(v[5 : 30]) >= 0.18 THEN list_avg(s) END, 6) AS score FROM t
""")
def stem_triples(spark, sf_dir):
    block = F.col("block")
    edges = F.array(*[F.lit(e) for e in (4, 12, 21, 30)])
    singles = F.array(0.5 + block % 5 / 20.0, F.lit(0.6), F.lit(0.7))
    return _blocks(spark, sf_dir).select("block", _rounded(P.stem_triple(edges, F.lit(0), (block % 9 + 28).cast("double"), F.col("r"), singles, block % 10 / 10.0)).alias("score"))


@query("""
    WITH l AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN ' 𐩣 ' WHEN 1 THEN 'mem' WHEN 2 THEN 'HA' WHEN 3 THEN '𐩨' WHEN 4 THEN 'num_5' WHEN 5 THEN '|' WHEN 6 THEN '𐩥' WHEN 7 THEN '𐩲' END AS s, doc_id % 9 AS k FROM documents)
    SELECT doc_id, k IN (0, 1) AS mem, k = 2 AS heth, k = 3 AS beth, k IN (0, 1, 2) AS stem_body, k IN (6, 7) AS round, k IN (4, 5) AS numeral FROM l
""")
def label_sets(spark, sf_dir):
    names = [" 𐩣 ", "mem", "HA", "𐩨", "num_5", "|", "𐩥", "𐩲"]
    k = F.col("doc_id") % 9
    label = F.coalesce(*[F.when(k == i, n) for i, n in enumerate(names)])
    tests = {"mem": P.is_letter(label, "mem"), "heth": P.is_letter(label, "heth"), "beth": P.is_letter(label, "beth"), "stem_body": P.is_stem_body(label), "round": P.is_round(label), "numeral": P.is_numeral_or_separator(label)}
    return read(spark, sf_dir, "documents", "doc_id").select("doc_id", *[t.alias(n) for n, t in tests.items()])


@query("SELECT l_orderkey, CAST(min(l_partkey % 900) AS INT) AS x0, CAST(min(l_suppkey % 70) AS INT) AS y0, CAST(max(l_partkey % 900 + 20) AS INT) AS x1, CAST(max(l_suppkey % 70 + 30) AS INT) AS y1 FROM lineitem GROUP BY l_orderkey")
def union_box(spark, sf_dir):
    from inkstone.functions import boxes

    x, y = (F.col("l_partkey") % 900).cast("int"), (F.col("l_suppkey") % 70).cast("int")
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey").select("l_orderkey", x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 30).alias("y1"))
    return lines.groupBy("l_orderkey").agg(*boxes.union_box())


_LETTERS = """
    l AS (SELECT l_orderkey, l_linenumber AS id, l_partkey % 400 AS x0, l_partkey % 400 + 10 + CAST(floor(l_quantity) AS INT) AS x1, l_suppkey % 40 AS y0, l_suppkey % 40 + 30 AS y1 FROM lineitem WHERE l_linenumber > 1),
    b AS (SELECT l_orderkey, l_linenumber AS id, l_partkey % 400 AS x0, l_partkey % 400 + 4 AS x1, l_suppkey % 90 AS cy FROM lineitem WHERE l_linenumber = 1)
"""


def _letters(spark, sf_dir):
    x = (F.col("l_partkey") % 400).cast("int")
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").withColumns({"x0": x, "id": F.col("l_linenumber")})
    letters = lines.where("id > 1").select("l_orderkey", "id", "x0", (F.col("x0") + 10 + F.floor("l_quantity").cast("int")).alias("x1"), (F.col("l_suppkey") % 40).alias("y0"), (F.col("l_suppkey") % 40 + 30).alias("y1"))
    return letters, lines.where("id = 1").select("l_orderkey", "id", "x0", (F.col("x0") + 4).alias("x1"), (F.col("l_suppkey") % 90).alias("cy"))


@query(f"""
    WITH {_LETTERS} SELECT b.l_orderkey, b.id, CAST(b.x0 AS INT) AS x0 FROM b WHERE EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = b.l_orderkey AND l.x1 <= b.x0) AND EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = b.l_orderkey AND l.x0 >= b.x1)
    AND NOT EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = b.l_orderkey AND b.x0 >= l.x0 - 2 AND b.x1 <= l.x1 + 2) AND cy BETWEEN (SELECT min(y0) - 4 FROM l WHERE l.l_orderkey = b.l_orderkey) AND (SELECT max(y1) + 4 FROM l WHERE l.l_orderkey = b.l_orderkey)
""")
def bars_between_letters(spark, sf_dir):
    letters, bars = _letters(spark, sf_dir)
    return layout.bars_between(bars, letters, "l_orderkey").select("l_orderkey", "id", "x0")


@query(f"""
    WITH {_LETTERS} SELECT l_orderkey, id, EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = l.l_orderkey AND abs((l.x0 + l.x1) / 2.0 - (b.x0 + b.x1) / 2.0) <= 6 AND abs((l.x1 - l.x0) - 4 * (b.x1 - b.x0)) <= 10) AS is_separator FROM l
""")
def tagged_bars(spark, sf_dir):
    letters, bars = _letters(spark, sf_dir)
    own = letters.select("l_orderkey", "id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), (F.col("x1") - F.col("x0")).alias("width"))
    return layout.tagged_bars(own, bars.select("l_orderkey", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), (4 * (F.col("x1") - F.col("x0"))).alias("width")), "l_orderkey").select("l_orderkey", "id", "is_separator")


@query(f"""
    WITH {_BLOCKS}, o AS (SELECT block, r, row_number() OVER (PARTITION BY block ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY block) AS n FROM p),
    k AS (SELECT block, arg_max(i, (r, -i)) AS k, max(r) AS top, min(n) AS n FROM o GROUP BY block), f AS (SELECT k.*, greatest(0.12, 0.6 * top) AS floor FROM k)
    SELECT f.block, CAST(coalesce(max(i) FILTER (i < k AND r < floor) + 1, 0) AS INT) AS lo, CAST(coalesce(min(i) FILTER (i > k AND r < floor), min(n)) AS INT) AS hi FROM f JOIN o USING (block) GROUP BY f.block
""".replace("min(n)) AS INT", "min(f.n)) AS INT"))
def expanded_peaks(spark, sf_dir):
    from inkstone.functions.numeric import index_of_max

    return _blocks(spark, sf_dir).select("block", P.expanded_peak(F.col("r"), index_of_max(F.col("r")), 0.6).alias("x")).select("block", "x.lo", "x.hi")


@query(f"""
    WITH {_BLOCKS}, a AS (SELECT block, list(r ORDER BY i) AS v FROM p GROUP BY block), e AS (SELECT block, v, list_concat([0], [7, 15, 24, 35]) AS k FROM a),
    s AS (SELECT block, v, [[0, 8], [7, 15], [15, 24], [24, 35], [35, 40]] AS spans FROM a), x AS (SELECT block, list_transform(spans, lambda t: t[1] + list_position(v[t[1] + 1 : t[2]], list_min(v[t[1] + 1 : t[2]])) - 1) AS edges FROM s)
    SELECT block, edges[1] || '-' || edges[2] || ',' || edges[2] || '-' || edges[3] || ',' || edges[3] || '-' || edges[4] || ',' || edges[4] || '-' || edges[5] AS bands FROM x
""")
def valley_bands(spark, sf_dir):
    peaks = F.array(*[F.lit(p) for p in (7, 15, 24, 35)])  # a median distance of 9
    found = _blocks(spark, sf_dir).select("block", P.valley_bands(F.col("r"), peaks).alias("b"))
    return found.select("block", F.array_join(F.transform("b", lambda x: F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string"))), ",").alias("bands"))


@query(f"""
    WITH {_BLOCKS}, m AS (SELECT block, i, r - avg(r) OVER (PARTITION BY block) AS x FROM p), l AS (SELECT unnest(range(8, 13)) AS lag),
    s AS (SELECT a.block, lag, round(sum(a.x * b.x), 9) AS s FROM l, m a JOIN m b ON a.block = b.block AND b.i = a.i + lag GROUP BY a.block, lag)
    SELECT block, CAST(arg_max(lag, (s, -lag)) AS INT) AS pitch FROM s GROUP BY block
""")
def autocorrelation_pitch(spark, sf_dir):
    return _blocks(spark, sf_dir).select("block", P.autocorrelation_pitch(F.col("r"), F.lit(30)).alias("pitch"))


@query(f"""
    WITH {_BLOCKS}, a AS (SELECT block, list(r ORDER BY i) AS v FROM p GROUP BY block), c AS (SELECT block, v, unnest(range(4, 36)) AS s FROM a),
    w AS (SELECT *, v[s + 1] AS here, least(list_max(v[3 : s]), list_max(v[s + 1 : 38])) AS weaker FROM c)
    SELECT block, CAST(s AS INT) AS seam FROM w WHERE weaker >= 0.16 AND (here <= 0.55 * weaker OR (here <= v[s - 1] AND here <= v[s + 3] AND here <= 0.70 * weaker))
""")
def seams_between_bodies(spark, sf_dir):
    whole = _blocks(spark, sf_dir)
    return whole.select("block", F.explode(F.filter(F.sequence(F.lit(4), F.lit(35)), lambda s: P.seam_between_bodies(F.col("r"), F.lit(2), s, F.lit(38)))).alias("seam"))


_SHAPE = "p_partkey, p_size % 50 / 50.0::DOUBLE AS vert, p_partkey % 21 / 20.0::DOUBLE AS horiz, (p_partkey * 3) % 16 / 15.0::DOUBLE AS top, (p_partkey * 5) % 14 / 13.0::DOUBLE AS bot, (p_partkey * 7) % 41 / 40.0::DOUBLE AS hole, p_partkey % 4 AS runs, p_partkey % 6 AS k, p_partkey % 10 / 10.0::DOUBLE AS conf, p_partkey % 8 = 0 AS gimel"


@query(f"""
    WITH s AS (SELECT {_SHAPE} FROM part), b AS (SELECT *, CASE k WHEN 0 THEN 'WAW' WHEN 1 THEN 'AYN' WHEN 2 THEN 'TETH' WHEN 3 THEN 'DHADHE' WHEN 4 THEN 'BETH' ELSE 'other' END AS label,
      CASE WHEN (hole >= 0.80 AND vert <= 0.55) OR (bot <= 0.60 AND top >= 0.70 AND hole >= 0.70 AND vert <= 0.55) OR (runs = 2 AND vert <= 0.55 AND hole >= 0.70) THEN 'BETH' WHEN top >= 0.75 AND bot >= 0.75 THEN CASE WHEN vert >= 0.78 AND hole <= 0.70 AND vert >= horiz + 0.08 THEN 'TETH' WHEN horiz >= 0.72 AND horiz >= vert + 0.12 THEN 'DHADHE' WHEN vert >= 0.88 AND hole <= 0.65 THEN 'TETH' WHEN horiz >= 0.80 AND vert <= 0.60 THEN 'DHADHE' WHEN hole >= 0.75 AND vert <= 0.55 THEN 'BETH' END END AS box,
      CASE WHEN vert >= 0.82 THEN 'WAW' WHEN hole >= 0.58 AND vert <= 0.72 THEN 'AYN' WHEN vert >= 0.78 AND hole <= 0.65 THEN 'WAW' WHEN hole >= 0.55 AND vert + 0.05 < hole THEN 'AYN' END AS ring FROM s)
    SELECT p_partkey, CASE WHEN label IN ('TETH', 'DHADHE', 'BETH') AND box <> label THEN box WHEN label = 'BETH' AND gimel THEN 'GIMEL' WHEN label IN ('WAW', 'AYN') AND ring <> label THEN ring END AS fixed,
      coalesce(CASE WHEN label IN ('TETH', 'DHADHE', 'BETH') AND box <> label THEN conf >= 0.45 WHEN label = 'BETH' AND gimel THEN conf >= 0.45 WHEN label IN ('WAW', 'AYN') AND ring <> label THEN conf >= 0.45 END, false) AS trusted FROM b
""")
def printed_shapes(spark, sf_dir):
    from inkstone.functions import constants as K

    key = F.col("p_partkey")
    signs = {"WAW": K.WAW, "AYN": K.AYN, "TETH": K.TETH, "DHADHE": K.DHADHE, "BETH": K.BETH, "GIMEL": K.GIMEL}
    label = F.coalesce(*[F.when(key % 6 == i, F.lit(signs[n])) for i, n in enumerate(("WAW", "AYN", "TETH", "DHADHE", "BETH"))], F.lit("x"))
    m = F.struct((F.col("p_size") % 50 / 50.0).alias("vert"), (key % 21 / 20.0).alias("horiz"), (key * 3 % 16 / 15.0).alias("top"), (key * 5 % 14 / 13.0).alias("bot"), (key * 7 % 41 / 40.0).alias("hole"), (key % 4).alias("lower_runs"))
    name = F.create_map(*[F.lit(x) for n, s in signs.items() for x in (s, n)])
    found = read(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("x", P.shape_fixed(label, key % 10 / 10.0, m, key % 8 == 0))
    return found.select("p_partkey", F.try_element_at(name, F.col("x.label")).alias("fixed"), F.coalesce(F.col("x.trusted"), F.lit(False)).alias("trusted"))


@query(f"""
    WITH {_BLOCKS}, a AS (SELECT block, list(r ORDER BY i) AS v FROM p GROUP BY block), e AS (SELECT block, v, [0, 3 + block % 4, 15, 18 + block % 5, 32, 40] AS e FROM a), x AS (SELECT block, v, e, unnest([0, 1, 2, 3, 4]) AS i FROM e),
    w AS (SELECT *, e[i + 2] - e[i + 1] AS w, CASE WHEN i > 0 THEN e[i + 1] - e[i] END AS l, CASE WHEN i < 4 THEN e[i + 3] - e[i + 2] END AS r FROM x)
    SELECT block, CAST(i AS INT) AS i, w >= 2 AND w / 30.0 <= 0.24 AS thin, coalesce(i > 0 AND i < 4 AND l >= 0.42 * 12 AND r >= 0.42 * 12 AND (w <= 0.32 * 12 OR w / 30.0 <= 0.22 OR (w <= 0.55 * least(l, r) AND w / 30.0 <= 0.30)), false) AS separates,
      i <= 3 AND list_max(v[greatest(0, e[i + 2] - 3) + 1 : e[i + 2] + 4]) >= 0.9123 AS crosses FROM w
""")
def edge_rules(spark, sf_dir):
    """Of each part of a line: whether it is thin, separates words, and whether joining it with the next crosses a boundary."""
    block = F.col("block")
    edges = F.array(F.lit(0), (3 + block % 4).cast("int"), F.lit(15), (18 + block % 5).cast("int"), F.lit(32), F.lit(40))
    parts = _blocks(spark, sf_dir).select("block", "r", edges.alias("e"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    e, i = F.col("e"), F.col("i")
    width = F.get(e, i + 1) - F.get(e, i)
    crosses = P.crosses_strong(e, i, i + 2, F.col("r"), 0.9123) & (i <= 3)
    return parts.select("block", "i", P.thin_bar(width, F.lit(30)).alias("thin"), P.internal_separator(e, i, F.lit(12), F.lit(30)).alias("separates"), crosses.alias("crosses"))


@query("""
    WITH b AS (SELECT l_orderkey, CAST(l_partkey % 60 AS INT) AS x0, CAST(l_partkey % 60 + 2 + l_suppkey % 9 AS INT) AS x1, l_suppkey % 3 <> 0 AS bar FROM lineitem),
    m AS (SELECT *, coalesce(bar AND lag(bar) OVER w AND x0 - lag(x1) OVER w <= 3, false) AS j FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY x0, x1)),
    r AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT l_orderkey, CAST(run AS BIGINT) AS run, min(x0) AS lo, max(x1) AS hi, count(*) AS bars FROM r WHERE bar GROUP BY l_orderkey, run
""")
def separator_runs(spark, sf_dir):
    x = (F.col("l_partkey") % 60).cast("int")
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey").select("l_orderkey", x.alias("x0"), (x + 2 + F.col("l_suppkey") % 9).cast("int").alias("x1"), (F.col("l_suppkey") % 3 != 0).alias("bar"))
    return layout.separator_runs(lines, "l_orderkey", "x0", "x1", F.col("bar")).withColumn("run", F.col("run").cast("bigint"))
