"""Queries of rules on single glyphs, segments, intervals and short profiles, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import boxes, fusion, segments, signal, text
from inkstone.functions import constants as K
from inkstone.operators import classify, jobs
from inkstone.plans.profiles import _BLOCKS, _blocks
from inkstone.plans.registry import query
from inkstone.plans.registry import rounded as _rounded
from inkstone.sources import files
from inkstone.sources.tables import read


def _lines(spark, sf_dir, *columns):
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *columns)


_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_IDS = ", ".join(_ID)
#: Labels by l_suppkey % 6: two letters, a numeral, a separator, an unknown one and none.
_LABEL = "CASE l_suppkey % 6 WHEN 0 THEN '𐩣' WHEN 1 THEN '𐩨' WHEN 2 THEN 'NUM_5' WHEN 3 THEN '|' WHEN 4 THEN '?' END"


def _label():
    k = F.col("l_suppkey") % 6
    return F.coalesce(*[F.when(k == i, F.lit(v)) for i, v in enumerate(("𐩣", "𐩨", "NUM_5", "|", "?"))])


@query(f"""
    WITH g AS (SELECT {_IDS}, {_LABEL} AS label, (l_partkey % 21) / 20.0::DOUBLE AS conf, (l_partkey % 30)::DOUBLE AS w, (l_partkey % 17) / 16.0::DOUBLE AS detect, l_partkey % 3 = 0 AS low FROM lineitem)
    SELECT {_IDS}, label IN ('|', 'NUM_5') AND w / 40 <= 0.55 AS narrow, (low AND conf < 0.55) OR (detect < 0.70 AND conf < 0.45 AND low) OR (label = '?' AND low AND detect < 0.80 AND conf < 0.55) AS ignored,
      conf >= 0.40 AND label IS NOT NULL AND label <> '?' AS stone, conf >= 0.45 AND label IN ('𐩣', '𐩨') AS paper, CASE WHEN label = 'NUM_5' THEN CASE WHEN w / 40 <= 0.45 THEN '|' ELSE '𐩨' END ELSE coalesce(label, '?') END AS paper_label FROM (SELECT {_IDS}, coalesce(label, '') AS label0, label, conf, w, detect, low FROM g)
""".replace("label IN ('|', 'NUM_5') AND w", "label0 IN ('|', 'NUM_5') AND w").replace("(label = '?' AND low", "(label0 = '?' AND low").replace("label IN ('𐩣', '𐩨') AS paper,", "label0 IN ('𐩣', '𐩨') AS paper,"))
def glyph_rules(spark, sf_dir):
    part, label = F.col("l_partkey"), _label()
    conf, w, detect, low = part % 21 / 20.0, (part % 30).cast("double"), part % 17 / 16.0, part % 3 == 0
    return _lines(spark, sf_dir).select(
        *_ID, fusion.narrow_separator(w, F.lit(40), label).alias("narrow"), fusion.ignored_candidate(low, detect, conf, F.coalesce(label == "?", F.lit(False))).alias("ignored"), fusion.stone_trusted(F.lit(True), conf, label).alias("stone"),
        fusion.paper_trusted(conf, label).alias("paper"), fusion.paper_label(label, w / 40, F.array(F.lit("NUM_2"), F.lit("𐩨"))).alias("paper_label"),
    )


@query(f"""
    WITH s AS (SELECT {_IDS}, l_quantity::DOUBLE AS width, (l_partkey % 51) / 50.0::DOUBLE AS am, (l_partkey % 37) / 36.0::DOUBLE AS ap, (l_suppkey % 41) / 30.0::DOUBLE AS ep, (l_suppkey % 29) / 28.0::DOUBLE AS om, (l_partkey % 23) / 22.0::DOUBLE AS op, 1 + (l_partkey % 19) / 9.0::DOUBLE AS cc, 1 + (l_suppkey % 13) / 6.0::DOUBLE AS rc, l_linenumber = 1 AS margin FROM lineitem),
    r AS (SELECT *, om < 0.55 AND op < 0.70 AS unlit, width BETWEEN 2 AND 14 AND ap >= 0.40 AND am >= 0.12 AS stem FROM s)
    SELECT {_IDS}, ((am < 0.06 AND ap < 0.25 AND unlit) OR (am < 0.12 AND ap < 0.40 AND ep < 0.90 AND unlit) OR (ep < 0.075 AND cc < 2.2 AND rc < 2.2 AND om < 0.40 AND op < 0.55) OR (margin AND am < 0.28 AND ep < 1.15 AND cc < 1.70 AND unlit)) AND NOT stem AS empty, stem FROM r
""")
def empty_segments(spark, sf_dir):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    scores = F.struct(
        F.col("l_quantity").cast("double").alias("width"), (part % 51 / 50.0).alias("activity_mean"), (part % 37 / 36.0).alias("activity_peak"), (supp % 41 / 30.0).alias("edge_peak"), (supp % 29 / 28.0).alias("object_mean"),
        (part % 23 / 22.0).alias("object_peak"), (1 + part % 19 / 9.0).alias("column_coherence"), (1 + supp % 13 / 6.0).alias("row_coherence"),
    )
    rows = _lines(spark, sf_dir, "l_quantity")
    return rows.select(*_ID, segments.empty_segment(scores, F.lit(50), F.col("l_linenumber") == 1).alias("empty"), segments.thin_stem(scores, F.lit(50)).alias("stem"))


@query("""
    WITH w AS (SELECT l_orderkey, l_linenumber AS n, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS k FROM lineitem)
    SELECT l_orderkey, count(*) FILTER (NOT (0.1 < 0.12 AND CASE WHEN i IN (1, k) THEN q < 46 ELSE q < 20 END)) AS kept FROM w GROUP BY l_orderkey
""")
def kept_segments(spark, sf_dir):
    """Segments left of each order: inner ones need edges of .9, outer ones of 1.15 with the same activity."""
    q = F.col("l_quantity").cast("double")
    # an edge of q / 40 with a limit of 1.15 at the margins, and activity that only the other rules let pass
    edge = F.when(q < 20, 0.5).when(q < 46, 1.0).otherwise(1.2)
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", F.struct("l_linenumber", q.alias("q"), F.lit(0.1).alias("activity_mean"), F.lit(0.3).alias("activity_peak"), edge.alias("edge_peak"), F.lit(0.1).alias("object_mean"), F.lit(0.1).alias("object_peak"), F.lit(1.5).alias("column_coherence"), F.lit(1.5).alias("row_coherence"), F.lit(30.0).alias("width")).alias("s"))
    lists = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lists.select("l_orderkey", F.size(segments.kept_segments(F.col("s"), F.lit(50))).cast("bigint").alias("kept"))


@query("""
    SELECT event_id, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN event_type = 'purchase' THEN 'text' END AS text, CASE WHEN event_type = 'error' THEN 'broken' END AS error,
      event_type = 'purchase' AND user_id % 2 = 0 AS has_overlay, CASE WHEN user_id % 2 = 0 THEN '[omitted]' END AS stored FROM events
""")
def job_views(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id")
    status = F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").when(kind == "click", "queued").otherwise("running")
    rows = read(spark, sf_dir, "events", "event_id", "event_type", "user_id").select(F.col("event_id").alias("id"), status.alias("status"), F.lit("broken").alias("error"), F.lit("text").alias("text"), F.when(user % 2 == 0, "bytes").alias("overlay"))
    stored = rows.select(F.col("id").alias("key"), files.without_overlay(F.struct(F.col("overlay").alias("overlayBase64"), "text"))["overlayBase64"].alias("stored"))
    views = jobs.job_view(rows)
    views = views.withColumn("has_overlay", F.coalesce("has_overlay", F.lit(False)))
    return views.join(stored, views["id"] == stored["key"]).select(F.col("id").alias("event_id"), "status", "text", "error", "has_overlay", "stored")


_NAMES = ", ".join(f"({i}, '{c}', '{n}', '{a}', '{t}')" for i, (c, n, a, t) in enumerate(zip(K.LETTERS, K.LETTER_NAMES, K.ARABIC_NAMES, K.TRANSLITERATION, strict=True)))


@query(f"""
    WITH n(i, character, name, arabic, latin) AS (VALUES {_NAMES}), p AS (SELECT doc_id, CASE WHEN doc_id % 31 < 29 THEN doc_id % 31 END AS i FROM documents)
    SELECT doc_id, character, name, arabic, latin, CASE WHEN character IS NOT NULL THEN 'U+' || upper(to_hex({K.FIRST_LETTER} + n.i)) END AS codepoint FROM p LEFT JOIN n USING (i)
""")
def enriched_labels(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id").withColumn("key", F.when(F.col("doc_id") % 31 < 29, F.col("doc_id") % 31))
    known = F.broadcast(classify.label_dictionary(spark).where("type = 'letter'"))  # a fixed table of 39 rows
    return docs.join(known, F.col("key") == F.col("index"), "left").select("doc_id", "character", "name", F.col("arabic_name").alias("arabic"), F.col("latin_translit").alias("latin"), "codepoint")


@query(f"""
    WITH b AS (SELECT {_IDS}, (l_partkey % 40)::DOUBLE AS a0, (l_partkey % 40 + 25)::DOUBLE AS a1, (l_suppkey % 50)::DOUBLE AS b0, (l_suppkey % 50 + 30)::DOUBLE AS b1 FROM lineitem), o AS (SELECT *, greatest(0, least(a1, b1) - greatest(a0, b0)) AS x FROM b)
    SELECT {_IDS}, round(x / greatest(25 + 30 - x, 1), 6) AS iou, round(x / greatest(a1 + b1 - x, 1), 6) AS of_ends, round(x * 10 / greatest(25 * 20 + 30 * 10 - x * 10, 1), 6) AS boxes, round((a0 + a1) / 2, 6) AS center, CAST(round_even(a0 * 1.5, 0) AS INT) AS scaled FROM o
""")
def interval_geometry(spark, sf_dir):
    a0, b0 = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    box = lambda x0, x1, y0, y1: F.struct(x0.alias("x0"), F.lit(y0).alias("y0"), x1.alias("x1"), F.lit(y1).alias("y1"))
    return _lines(spark, sf_dir).select(
        *_ID, _rounded(boxes.iou(a0, a0 + 25, b0, b0 + 30)).alias("iou"), _rounded(boxes.iou_of_ends(a0, a0 + 25, b0, b0 + 30)).alias("of_ends"), _rounded(boxes.iou_2d(box(a0, a0 + 25, 0, 20), box(b0, b0 + 30, 10, 20))).alias("boxes"),
        _rounded(boxes.center(a0, a0 + 25)).alias("center"), boxes.scaled(a0, 1.5).alias("scaled"),
    )


@query(f"""
    WITH {_BLOCKS}, o AS (SELECT block, r, row_number() OVER (PARTITION BY block ORDER BY i) - 1 AS i FROM p), m AS (SELECT block, list(r ORDER BY i) AS v, min(r) AS lo, max(r) AS hi FROM o GROUP BY block),
    j AS (SELECT block, v, lo, hi, unnest(range(0, 14)) AS j FROM m), k AS (SELECT *, j * 39 / 13.0::DOUBLE AS x FROM j)
    SELECT block, CAST(j AS INT) AS j, round((v[j + 1] - lo) / (hi - lo + 1e-6), 6) AS norm, round(v[CAST(floor(x) AS INT) + 1] + (v[least(CAST(floor(x) AS INT) + 1, 39) + 1] - v[CAST(floor(x) AS INT) + 1]) * (x - floor(x)), 6) AS resampled,
      round(greatest(exp(-0.5 * ((j - 3) / 2.5) ** 2), exp(-0.5 * ((j - 11) / 2.5) ** 2)), 6) AS target, list_max(v[greatest(0, j - 3) + 1 : j + 4]) AS near FROM k
""")
def profile_steps(spark, sf_dir):
    whole = _blocks(spark, sf_dir)
    v = F.col("r")
    steps = F.arrays_zip(F.slice(signal.norm01(v), 1, 14).alias("norm"), signal.resample(v, 14).alias("resampled"), signal.soft_targets(F.array(F.lit(3), F.lit(11)), 14).alias("target"), F.transform(F.sequence(F.lit(0), F.lit(13)), lambda x: signal.near_max(v, x)).alias("near"))
    found = whole.select("block", F.posexplode(steps).alias("j", "x"))
    return found.select("block", "j", *[_rounded(f"x.{n}").alias(n) for n in ("norm", "resampled", "target")], "x.near")


@query(f"""
    WITH {_BLOCKS}, m AS (SELECT block, list(r ORDER BY i) AS v FROM p GROUP BY block), j AS (SELECT block, v, unnest(range(0, 40)) AS j FROM m), d AS (SELECT block, v, j, unnest(range(-4, 5)) AS d FROM j),
    w AS (SELECT block, j, exp(-0.5 * d * d) AS w, v[CASE WHEN abs(j + d) < 40 THEN abs(j + d) ELSE 78 - abs(j + d) END + 1] AS x FROM d)
    SELECT block, CAST(j AS INT) AS j, round(sum(w * x) / sum(w), 6) AS smooth FROM w GROUP BY block, j
""")
def smoothed_profile(spark, sf_dir):
    found = _blocks(spark, sf_dir).select("block", F.posexplode(signal.smooth(F.col("r"), 1.0)).alias("j", "s"))
    return found.select("block", "j", _rounded("s").alias("smooth"))


@query(f"""
    WITH {_BLOCKS}, m AS (SELECT block, list(r ORDER BY i) AS v FROM p GROUP BY block), e AS (SELECT block, v, unnest([[0, 6], [6, 7], [7, 15], [15, 29], [29, 40]]) AS e FROM m), s AS (SELECT block, e[1] AS lo, e[2] AS hi, v[e[1] + 1 : e[2]] AS s FROM e WHERE e[2] - e[1] >= 2)
    SELECT block, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, round(list_max(s), 6) AS confidence, round(list_avg(s), 6) AS mean FROM s WHERE list_avg(s) >= 0.5123
""")
def object_boxes(spark, sf_dir):
    cuts = F.array(*[F.lit(c) for c in (6, 7, 15, 29)])
    found = _blocks(spark, sf_dir).select("block", F.explode(signal.boxes(cuts, F.col("r"), empty=0.5123)).alias("b"))
    return found.select("block", "b.lo", "b.hi", _rounded("b.confidence").alias("confidence"), _rounded("b.mean").alias("mean"))


@query(f"""
    WITH {_BLOCKS}, m AS (SELECT block, list(r ORDER BY i) AS v FROM p GROUP BY block), f AS (SELECT block, v, [list_avg(v[e * 8 + 1 : e * 8 + 8]) >= 0.5123 for e in [0, 1, 2, 3, 4]] AS f FROM m), k AS (SELECT block, list_filter([0, 1, 2, 3, 4], lambda e: f[e + 1]) AS k FROM f)
    SELECT block, coalesce(list_aggregate([(((k[i] + 1) * 8 + k[i + 1] * 8) // 2) for i in range(1, len(k))], 'string_agg', ','), '') AS cuts FROM k
""")
def corridor_cuts(spark, sf_dir):
    v = F.col("r")
    active = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda e: F.aggregate(signal.span(v, e * 8, e * 8 + 8), F.lit(0.0), lambda a, x: a + x) / 8 >= 0.5123)
    cuts = segments.corridor_cuts(F.array(*[F.lit(c) for c in (8, 16, 24, 32)]), F.lit(40), active)
    return _blocks(spark, sf_dir).select("block", F.array_join(cuts.cast("array<string>"), ",").alias("cuts"))


@query("""
    WITH w AS (SELECT l_orderkey, list(l_quantity::DOUBLE) AS w FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, len(w) >= 6 AND list_median(w) <= 50 * 0.55 AS dense FROM w
""".replace("list_median(w)", "list_aggregate(w, 'median')"))
def dense_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("w"))
    return lines.select("l_orderkey", F.coalesce(segments.dense_packing(F.col("w"), F.lit(50)), F.lit(False)).alias("dense"))


@query(f"""
    WITH {_BLOCKS}, o AS (SELECT block, r, row_number() OVER (PARTITION BY block ORDER BY i) - 1 AS i, max(r) OVER (PARTITION BY block) / 2 AS half FROM p), l AS (SELECT *, lag(r) OVER w AS a, lead(r) OVER w AS b FROM o WINDOW w AS (PARTITION BY block ORDER BY i)),
    k AS (SELECT block, min(i) FILTER (r > half AND r >= a AND r > b) AS lo, max(i) FILTER (r > half AND r >= a AND r > b) AS hi FROM l GROUP BY block)
    SELECT block, coalesce(hi - lo >= 4, false) AS lobes FROM k
""")
def two_lobes(spark, sf_dir):
    return _blocks(spark, sf_dir).select("block", segments.two_lobes(F.col("r"), F.lit(40)).alias("lobes"))


@query(f"""
    WITH e AS (SELECT {_IDS}, (l_partkey % 21) / 20.0::DOUBLE AS c, (l_suppkey % 17) / 30.0::DOUBLE AS m, [(l_partkey % 9 + 1)::DOUBLE, (l_suppkey % 5 + 1)::DOUBLE, 2.0] AS raw, {_LABEL} AS label FROM lineitem), p AS (SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM e),
    h AS (SELECT *, list_sum(list_transform(p, lambda x: -x * ln(x))) / ln(3) AS h FROM p)
    SELECT {_IDS}, round(h, 6) AS entropy, round(0.50 * c + 0.30 * least(1, greatest(0, m / 0.35)) + 0.20 * (1 - h), 6) AS evidence, round(CAST(least(1, greatest(0, 0.40 * c + 0.55 * m + 0.05 * (l_partkey % 2))) AS DOUBLE), 6) AS joint, round(c * CASE WHEN label IS NULL OR label = '?' THEN 0.15 ELSE 1 END, 6) AS paper FROM h
""")
def evidence_scores(spark, sf_dir):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    raw = F.array((part % 9 + 1).cast("double"), (supp % 5 + 1).cast("double"), F.lit(2.0))
    total = part % 9 + supp % 5 + 4.0
    h = fusion.entropy(F.transform(raw, lambda x: x / total))
    c, m = part % 21 / 20.0, supp % 17 / 30.0
    return _lines(spark, sf_dir).select(*_ID, _rounded(h).alias("entropy"), _rounded(fusion.evidence(c, m, h)).alias("evidence"), _rounded(fusion.joint_score(c, m, part % 2)).alias("joint"), _rounded(fusion.paper_score(_label(), c)).alias("paper"))


@query("""
    WITH c AS (SELECT o_custkey AS id, o_orderkey % 9 AS k, (o_orderkey % 37) / 36.0::DOUBLE AS p, (o_orderkey % 23) / 22.0::DOUBLE AS s FROM orders), r AS (SELECT id, 'l' || k AS label, 0.55 * p + 0.45 * s + CASE WHEN k % 2 = 0 AND p >= 0.62 THEN 0.04 ELSE 0 END AS combined FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY combined DESC, label) AS n FROM r)
    SELECT id, label, round(combined, 6) AS combined FROM n WHERE n = 1
""")
def reranked_lookalikes(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("id"), F.concat(F.lit("l"), (key % 9).cast("string")).alias("label"), (key % 37 / 36.0).alias("proto"), (key % 23 / 22.0).alias("shape"), (key % 9 % 2 == 0).alias("is_hard"))
    return classify.rerank(rows).withColumn("combined", _rounded("combined"))


@query("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS at FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def single_row(spark, sf_dir):
    from inkstone.sources.tables import one_row

    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    first = orders.agg(F.min("o_orderkey").alias("o_orderkey"))
    return one_row(orders.join(F.broadcast(first), "o_orderkey")).select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))


@query("""
    WITH l AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '# comment' WHEN 1 THEN 'KEY_' || page_id % 7 || '="v' || page_id || '"' WHEN 2 THEN ' KEY_' || page_id % 7 || ' = w' || page_id ELSE '' END AS line FROM pages WHERE page_id % 4 IN (1, 2))
    SELECT 'KEY_' || page_id % 7 AS name, CASE WHEN min(page_id) % 4 = 1 THEN 'v' ELSE 'w' END || min(page_id) AS setting FROM l GROUP BY page_id % 7
""")
def settings_lines(spark, sf_dir):
    key = F.col("page_id")
    n, v = (key % 7).cast("string"), key.cast("string")
    line = F.when(key % 4 == 0, "# comment").when(key % 4 == 1, F.concat(F.lit("KEY_"), n, F.lit('="v'), v, F.lit('"'))).when(key % 4 == 2, F.concat(F.lit(" KEY_"), n, F.lit(" = w"), v)).otherwise("")
    return files.settings(read(spark, sf_dir, "pages", "page_id").withColumn("value", line), position="page_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stop' WHEN doc_id % 3 = 1 THEN 'd' || doc_id || '.' END AS echo, doc_id % 3 <> 2 AS ok FROM documents")
def json_requests(spark, sf_dir):
    key = F.col("doc_id")
    request = F.when(key % 3 == 2, F.lit("not json")).otherwise(F.to_json(F.struct(key.alias("id"), F.when(key % 3 == 0, "stop").otherwise(F.concat(F.lit("d"), key.cast("string"), F.lit("."))).alias("text"))))
    rows = read(spark, sf_dir, "documents", "doc_id").select(F.to_json(F.struct(key.alias("key"), request.alias("body"))).alias("line"))

    def work(r: dict) -> dict:
        import json

        try:
            return {"id": r["key"], "echo": json.loads(r["body"])["text"], "good": True, "overlay": b"never sent"}
        except ValueError:
            return {"id": r["key"], "echo": None, "good": False}

    found = files.json_lines(rows, "line", "id bigint, echo string, good boolean", work)
    return found.select(F.col("parsed.id").alias("doc_id"), F.col("parsed.echo").alias("echo"), F.col("parsed.good").alias("ok"))


@query("SELECT p_partkey, 'anonymous/' || p_partkey || '/source.' || CASE WHEN p_size % 2 = 0 THEN 'png' ELSE 'jpg' END AS source, 'anonymous/' || p_partkey || '/overlay.png' AS overlay FROM part")
def storage_paths(spark, sf_dir):
    paths = files.storage_paths(F.col("p_partkey").cast("string"), text.image_extension(F.when(F.col("p_size") % 2 == 0, "a.PNG").otherwise("a.jpeg")))
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", paths.alias("p")).select("p_partkey", "p.*")


@query("SELECT count(DISTINCT p_brand) = (SELECT count(DISTINCT p_brand) FROM part WHERE p_size <= 25) AS ready FROM part")
def required_files(spark, sf_dir):
    parts = read(spark, sf_dir, "part", "p_brand", "p_size")
    return files.ready(parts.select(F.col("p_brand").alias("file")).distinct(), parts.where("p_size <= 25").select(F.col("p_brand").alias("file")))


@query("""
    WITH v AS (SELECT user_id AS id, event_id, ts, event_type FROM events) SELECT id, max_by(event_type, (ts, event_id)) AS status, min(ts) AS created_at FROM v GROUP BY id
""")
def stored_jobs(spark, sf_dir):
    from inkstone.operators import archive

    events = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    last = archive.latest(events, "user_id", [F.desc("ts"), F.desc("event_id")]).select(F.col("user_id").alias("id"), F.col("event_type").alias("status"))
    first = events.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("created_at"))
    return last.join(first, "id")
