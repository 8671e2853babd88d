"""Queries of the bands of pages. A page is a block of 150 events; its row signals are waves of lines with noise from the events' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import pages as G
from inkstone.functions import regions as R
from inkstone.functions.numeric import array_mean, index_of_max
from inkstone.functions.peaks import line_peaks as find_line_peaks
from inkstone.functions.signal import let, span
from inkstone.operators import pages, regions
from inkstone.plans.registry import query
from inkstone.plans.registry import rounded as _rounded
from inkstone.sources.tables import read

#: Of each row of a page (k: its place) the two signals, the same in both languages; lines are 23 to 33 rows apart.
_WAVE = "(1 - abs(2 * ((k + page * 7) % lap) - lap) / CAST(lap AS DOUBLE))"
_LINE = "floor((k + page * 7) / CAST(lap AS DOUBLE))"
_S = f"round(0.85 * {_WAVE} * (0.35 + 0.65 * (({_LINE} * 37 + page * 11) % 10) / 9) + 0.15 * (value - floor(value)), 4)"
_C = f"round(0.70 * {_WAVE} * (0.35 + 0.65 * (({_LINE} * 53 + page * 7) % 10) / 9) + 0.30 * (value * 7 - floor(value * 7)), 4)"
_PAGES = f"""
    e AS (SELECT event_id // 150 AS page, event_id % 150 AS k, value, 23 + 2 * ((event_id // 150) % 6) AS lap FROM events),
    r AS MATERIALIZED (SELECT page, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS y, {_S} AS s, {_C} AS c, count(*) OVER (PARTITION BY page) AS h FROM e),
    g AS MATERIALIZED (SELECT page, y, h, 's' AS sig, s AS v FROM r UNION ALL SELECT page, y, h, 'c', c FROM r)"""
#: How clear each row stands in each signal, and whether it is no lower than two rows away.
_CLEAR = """
    higher AS (SELECT a.page, a.sig, a.y, a.v, a.h, coalesce(max(b.y) FILTER (b.y < a.y AND b.v > a.v), -1) AS l, coalesce(min(b.y) FILTER (b.y > a.y AND b.v > a.v), 100000) AS r FROM g a JOIN g b USING (page, sig) GROUP BY ALL),
    p AS (SELECT a.page, a.sig, a.y, a.v, a.h, a.v - greatest(min(b.v) FILTER (b.y <= a.y AND b.y > a.l), min(b.v) FILTER (b.y >= a.y AND b.y < a.r)) AS clear FROM higher a JOIN g b ON b.page = a.page AND b.sig = a.sig GROUP BY a.page, a.sig, a.y, a.v, a.h),
    t AS MATERIALIZED (SELECT *, v >= lag(v, 2) OVER w AND v >= lead(v, 2) OVER w AS top FROM p WINDOW w AS (PARTITION BY page, sig ORDER BY y))"""


def _pages(spark, sf_dir):
    """page, s, c: the signals of each page as arrays of 150 rows at most."""
    own = read(spark, sf_dir, "events", "event_id", "value").selectExpr("event_id DIV 150 AS page", "event_id % 150 AS k", "value", "23 + 2 * ((event_id DIV 150) % 6) AS lap")
    rows = own.selectExpr("page", "k", f"{_S} AS s", f"{_C} AS c").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("k", "s", "c"))).alias("x"))
    return rows.select("page", F.transform("x", lambda x: x["s"]).alias("s"), F.transform("x", lambda x: x["c"]).alias("c"))


def _highest(values, lo, hi):
    """The first highest row of lo to hi - 1."""
    return let(span(values, F.lit(lo), F.lit(hi)), lambda v: F.lit(lo) + index_of_max(v))


def _score(values):
    """Stands for how letter-like a band is: the mean of a signal."""
    return lambda lo, hi: F.coalesce(array_mean(span(values, lo, hi)), F.lit(0.0))


def _text(bands):
    return F.array_join(F.transform(bands, lambda b: F.concat(b["lo"].cast("string"), F.lit("-"), b["hi"].cast("string"))), ",")


def _pitch(peaks: str, name: str) -> str:
    """CTEs that end in `name` (page, pitch): the pitch of the peaks in a table (page, y), from their gaps and the lag at which the page repeats itself."""
    return f"""
    {name}_gap AS (SELECT page, lead(y) OVER (PARTITION BY page ORDER BY y) - y AS gap FROM {peaks}),
    {name}_med AS (SELECT page, h, CAST(coalesce(floor(median(gap)), greatest(24, floor(0.12 * h))) AS INT) AS med FROM {name}_gap JOIN (SELECT DISTINCT page, h FROM r) USING (page) GROUP BY page, h),
    {name}_lo AS (SELECT *, greatest(16, CAST(floor(0.85 * med) AS INT)) AS lo FROM {name}_med),
    {name}_hi AS (SELECT *, least(h // 2, greatest(lo + 1, CAST(floor(2.8 * med) AS INT), CAST(floor(0.45 * h) AS INT))) AS hi FROM {name}_lo),
    {name}_lag AS (SELECT page, med, unnest(range(lo, hi)) AS lag FROM {name}_hi WHERE hi > lo + 1),
    {name}_ac AS (SELECT l.page, med, lag, sum(a.x * b.x) AS ac FROM {name}_lag l JOIN centred a ON a.page = l.page JOIN centred b ON b.page = l.page AND b.y = a.y + lag GROUP BY l.page, med, lag),
    {name}_best AS (SELECT page, any_value(med) AS med, arg_max(lag, (round(ac, 9), -lag)) AS lag, max(ac) AS ac FROM {name}_ac GROUP BY page),
    {name} AS MATERIALIZED (SELECT m.page, CASE WHEN (b.ac / (w + 1e-6) >= 0.10 AND b.lag >= floor(1.4 * b.med)) OR (b.ac / (w + 1e-6) >= 0.20 AND abs(b.lag - b.med) <= floor(0.35 * b.med)) THEN b.lag ELSE m.med END AS pitch FROM {name}_med m LEFT JOIN {name}_best b USING (page) LEFT JOIN power USING (page))"""


@query(f"""
    WITH RECURSIVE {_PAGES}, {_CLEAR},
    centred AS MATERIALIZED (SELECT page, y, s - avg(s) OVER (PARTITION BY page) AS x FROM r), power AS (SELECT page, sum(x * x) AS w FROM centred GROUP BY page),
    near AS (SELECT page, y, s, h, s >= lag(s) OVER w AND s >= lead(s) OVER w AND s >= lag(s, 2) OVER w AND s >= lead(s, 2) OVER w AS top FROM r WINDOW w AS (PARTITION BY page ORDER BY y)),
    found AS MATERIALIZED (SELECT near.page, near.y, s FROM near JOIN t ON t.page = near.page AND t.sig = 's' AND t.y = near.y WHERE near.top AND near.y BETWEEN 2 AND near.h - 3 AND s >= 0.32 AND clear >= 0.15),
    {_pitch("found", "one")},
    ranked AS (SELECT page, y, row_number() OVER (PARTITION BY page ORDER BY s DESC, y) AS n FROM found),
    nms AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept FROM one UNION ALL SELECT m.page, k.n, CASE WHEN len(list_filter(kept, lambda q: abs(q - k.y) < greatest(12, floor(0.55 * pitch)))) = 0 THEN list_append(kept, k.y) ELSE kept END FROM nms m JOIN ranked k ON k.page = m.page AND k.n = m.n + 1 JOIN one ON one.page = m.page),
    kept AS MATERIALIZED (SELECT page, unnest(list_sort(arg_max(kept, n))) AS y FROM nms GROUP BY page),
    next AS (SELECT page, y, lead(y) OVER (PARTITION BY page ORDER BY y) AS z, count(*) OVER (PARTITION BY page) AS n, pitch FROM kept JOIN one USING (page)),
    rooms AS (SELECT page, y, pitch, y + greatest(8, floor(0.35 * pitch)) AS lo, z - greatest(8, floor(0.35 * pitch)) AS hi, 0.28 AS level, greatest(12, floor(0.55 * pitch)) AS apart FROM next WHERE z - y >= floor(1.55 * pitch)
      UNION ALL SELECT x.page, y, pitch, y + greatest(8, floor(0.70 * pitch)), least(h - 2, y + floor(1.55 * pitch)), 0.22, greatest(10, floor(0.55 * pitch)) FROM next x JOIN (SELECT DISTINCT page, h FROM r) USING (page) WHERE z IS NULL AND n >= 2 AND least(h - 2, y + floor(1.55 * pitch)) > y + greatest(8, floor(0.70 * pitch)) + 4),
    mids AS (SELECT q.page, q.y AS before, level, apart, arg_max(r.y, (r.s, -r.y)) AS y, max(r.s) AS s FROM rooms q JOIN r ON r.page = q.page AND r.y >= q.lo AND r.y < q.hi GROUP BY q.page, q.y, level, apart),
    more AS MATERIALIZED (SELECT page, y FROM kept UNION ALL SELECT m.page, m.y FROM mids m JOIN t ON t.page = m.page AND t.sig = 's' AND t.y = m.y WHERE m.s >= level AND clear >= 0.06 AND m.y - before >= apart),
    {_pitch("more", "two")},
    line AS (SELECT page, y, row_number() OVER (PARTITION BY page ORDER BY y) AS n FROM more),
    fold AS (SELECT page, n, [y] AS kept FROM line WHERE n = 1 UNION ALL SELECT o.page, o.n, CASE WHEN o.y - o.last < floor(0.85 * pitch) AND low / (least(a.s, b.s) + 1e-6) > 0.65 AND low > 0.45 THEN CASE WHEN b.s > a.s THEN list_append(o.kept[1 : len(o.kept) - 1], o.y) ELSE o.kept END ELSE list_append(o.kept, o.y) END
      FROM (SELECT f.page, l.n, l.y, f.kept, f.kept[-1] AS last, (SELECT min(r.s) FROM r WHERE r.page = f.page AND r.y BETWEEN f.kept[-1] AND l.y) AS low FROM fold f JOIN line l ON l.page = f.page AND l.n = f.n + 1) o JOIN r a ON a.page = o.page AND a.y = o.last JOIN r b ON b.page = o.page AND b.y = o.y JOIN two ON two.page = o.page),
    ends AS (SELECT page, array_to_string(arg_max(kept, n), ',') AS peaks FROM fold GROUP BY page)
    SELECT d.page, coalesce(peaks, (SELECT arg_max(r.y, (r.s, -r.y))::VARCHAR FROM r WHERE r.page = d.page)) AS peaks FROM (SELECT DISTINCT page FROM r) d LEFT JOIN ends USING (page)
""")
def line_peaks(spark, sf_dir):
    """Rows of the lines of each page."""
    return _pages(spark, sf_dir).select("page", F.array_join(find_line_peaks(F.col("s")).cast("array<string>"), ",").alias("peaks"))


@query(f"""
    WITH {_PAGES}, {_CLEAR},
    f AS (SELECT page, min(h) AS h, arg_max(y, (s, -y)) FILTER (y BETWEEN 40 AND 79) AS a, arg_max(y, (s, -y)) FILTER (y BETWEEN 80 AND 109) AS b, arg_max(y, (s, -y)) FILTER (y < 60) AS one FROM r GROUP BY page HAVING count(*) = 150),
    q AS (SELECT *, b - a AS pitch FROM f),
    first AS (SELECT t.page, arg_max(t.y, (t.v + t.clear, t.sig = 's', -t.y)) AS y FROM t JOIN q USING (page) JOIN t z ON z.page = t.page AND z.sig = 's' AND z.y = t.y
      WHERE t.top AND t.v >= 0.18 AND t.clear >= 0.08 AND z.v >= 0.18 AND z.clear >= 0.08 AND t.y BETWEEN 4 AND a - greatest(6, floor(0.30 * pitch)) - 2 AND abs(a - t.y - pitch) <= 0.55 * pitch
        AND a >= greatest(16, floor(0.55 * pitch)) AND a - greatest(6, floor(0.30 * pitch)) > 5 AND (SELECT min(g.v) FROM g WHERE g.page = t.page AND g.sig = t.sig AND g.y BETWEEN t.y AND a) <= least(0.20, 0.55 * t.v) GROUP BY t.page),
    short AS (SELECT t.page, arg_max(t.y, (t.v, -t.y)) AS y FROM t JOIN q USING (page) WHERE t.sig = 'c' AND t.top AND t.v >= 0.48 AND t.clear >= 0.06
        AND t.y BETWEEN b + greatest(10, floor(0.65 * pitch)) + 2 AND least(q.h - 2, b + floor(1.55 * pitch)) - 3 AND least(q.h - 2, b + floor(1.55 * pitch)) > b + greatest(10, floor(0.65 * pitch)) + 4 GROUP BY t.page),
    dips AS (SELECT q.page, arg_min(y, (s, y)) AS dip, min(s) AS low FROM q JOIN r USING (page) WHERE y BETWEEN b AND least(q.h - 2, b + greatest(8, floor(0.70 * pitch))) GROUP BY q.page),
    ups AS (SELECT t.*, q.b, q.pitch, dip, low, t.y >= t.h - greatest(8, floor(0.35 * pitch)) AS edge, t.v >= (SELECT g.v FROM g WHERE g.page = t.page AND g.sig = t.sig AND g.y = t.y - 2) AND t.v >= (SELECT g.v FROM g WHERE g.page = t.page AND g.sig = t.sig AND g.y = least(t.h - 1, t.y + 2)) AND t.y < t.h - 3 AS bump
      FROM t JOIN q USING (page) JOIN dips USING (page) JOIN r ON r.page = q.page AND r.y = q.b WHERE t.y BETWEEN dip + 3 AND t.h - 2 AND b + pitch <= t.h - 4 AND t.h - b >= greatest(14, floor(0.55 * pitch)) AND low <= 0.55 * s AND t.h - 1 > dip + 5),
    edge AS (SELECT page, arg_max(y, (v, sig = 'c', -y)) AS y FROM ups WHERE v >= 0.20 AND (edge OR (bump AND abs(y - b - pitch) <= 0.60 * pitch)) GROUP BY page HAVING max(v) >= any_value(low) + 0.05 OR max(v) >= 0.28),
    second AS (SELECT t.page, arg_max(t.y, (t.v + t.clear, t.sig = 's', -t.y)) AS y FROM t JOIN q USING (page) WHERE t.top AND t.v >= 0.20 AND t.clear >= 0.10 AND t.y BETWEEN one + 57 + 2 AND t.h - 5 AND t.h - 2 > one + 57 + 4
        AND (SELECT min(g.v) FROM g WHERE g.page = t.page AND g.sig = t.sig AND g.y BETWEEN one AND t.y) <= least(0.18, 0.50 * t.v) GROUP BY t.page)
    SELECT q.page, concat_ws(',', first.y, a, b) AS with_first, concat_ws(',', a, b, CASE WHEN short.y - b >= greatest(10, floor(0.55 * pitch)) THEN short.y END) AS with_short,
      concat_ws(',', a, b, CASE WHEN edge.y - b >= greatest(10, floor(0.50 * pitch)) THEN edge.y END) AS with_edge, concat_ws(',', one, CASE WHEN q.h - second.y >= 15 THEN second.y END) AS with_second
    FROM q LEFT JOIN first USING (page) LEFT JOIN short USING (page) LEFT JOIN edge USING (page) LEFT JOIN second USING (page)
""")
def weak_lines(spark, sf_dir):
    """Lines that the peak search misses, looked for about two given peaks of whole pages (and below a lone one)."""
    s, c = F.col("s"), F.col("c")
    two, one = F.array(_highest(s, 40, 80), _highest(s, 80, 110)), F.array(_highest(s, 0, 60))
    found = _pages(spark, sf_dir).where(F.size("s") == 150).withColumns({"two": two, "one": one})
    join = lambda x: F.array_join(x.cast("array<string>"), ",")
    return found.select(
        "page", join(G.with_first_line(s, c, F.col("two"))).alias("with_first"), join(G.with_short_last_line(c, F.col("two"))).alias("with_short"), join(G.with_edge_line(s, c, F.col("two"))).alias("with_edge"), join(G.with_second_line(s, c, F.col("one"))).alias("with_second")
    )


@query(f"""
    WITH RECURSIVE {_PAGES},
    f AS (SELECT page, y // 30 AS i, arg_max(y, (s, -y)) AS y, max(s) AS v FROM r WHERE h = 150 GROUP BY page, y // 30),
    gaps AS (SELECT page, lead(y) OVER (PARTITION BY page ORDER BY i) - y AS gap FROM f), med AS (SELECT page, CAST(floor(median(gap)) AS INT) AS med FROM gaps GROUP BY page),
    lags AS (SELECT page, med, unnest(range(greatest(16, CAST(floor(0.85 * med) AS INT)), least(75, greatest(greatest(16, CAST(floor(0.85 * med) AS INT)) + 1, CAST(floor(2.8 * med) AS INT), 67)))) AS lag FROM med),
    m AS (SELECT page, y, s - avg(s) OVER (PARTITION BY page) AS x FROM r WHERE h = 150), power AS (SELECT page, sum(x * x) AS w FROM m GROUP BY page),
    ac AS (SELECT l.page, med, lag, sum(a.x * b.x) AS ac FROM lags l JOIN m a ON a.page = l.page JOIN m b ON b.page = l.page AND b.y = a.y + lag GROUP BY l.page, med, lag),
    best AS (SELECT page, any_value(med) AS med, arg_max(lag, (round(ac, 9), -lag)) AS lag, max(ac) AS ac FROM ac GROUP BY page),
    pitch AS (SELECT page, greatest(12, CASE WHEN (ac / (w + 1e-6) >= 0.10 AND lag >= floor(1.4 * med)) OR (ac / (w + 1e-6) >= 0.20 AND abs(lag - med) <= floor(0.35 * med)) THEN lag ELSE med END) AS pitch FROM best JOIN power USING (page)),
    near AS (SELECT page, pitch, count(*) FILTER (gap BETWEEN 0.70 * pitch AND 1.45 * pitch) AS near, sum(gap) AS spread FROM gaps JOIN pitch USING (page) WHERE gap IS NOT NULL GROUP BY page, pitch),
    top AS (SELECT page, arg_max(y, (v, -y)) AS y, max(v) AS v, median(v) AS usual FROM f GROUP BY page),
    gutters AS (SELECT top.page, bool_or((SELECT min(s) FROM r WHERE r.page = top.page AND r.y BETWEEN least(f.y, top.y) AND greatest(f.y, top.y)) / (least(f.v, top.v) + 1e-6) <= 0.55) AS gutter FROM top JOIN f USING (page) WHERE f.y <> top.y GROUP BY top.page),
    kind AS (SELECT page, pitch, near >= 3 AND spread >= 67 AS packed, NOT (near >= 3 AND spread >= 67) AND v >= 1.35 * usual AND NOT gutter AS alone, y AS best FROM near JOIN top USING (page) JOIN gutters USING (page)),
    fold AS (SELECT page, 0 AS i, [y] AS kept FROM f WHERE i = 0
      UNION ALL SELECT n.page, n.i, CASE WHEN n.folds THEN CASE WHEN n.v > n.last THEN list_append(n.kept[1 : len(n.kept) - 1], n.y) ELSE n.kept END ELSE list_append(n.kept, n.y) END FROM (
        SELECT o.page, f.i, f.y, f.v, o.kept, z.s AS last, CASE WHEN k.packed THEN (f.y - o.kept[-1] < floor(0.78 * k.pitch) AND low.m / (least(f.v, z.s) + 1e-6) > 0.58) OR (f.y - o.kept[-1] <= floor(1.20 * k.pitch) AND low.m / (least(f.v, z.s) + 1e-6) > 0.84) ELSE low.m / (least(f.v, z.s) + 1e-6) > 0.58 END AS folds
        FROM fold o JOIN f ON f.page = o.page AND f.i = o.i + 1 JOIN kind k ON k.page = o.page JOIN r z ON z.page = o.page AND z.y = o.kept[-1]
          JOIN (SELECT a.page, a.y AS lo, b.y AS hi, min(c.s) AS m FROM f a JOIN f b ON b.page = a.page AND b.y > a.y JOIN r c ON c.page = a.page AND c.y BETWEEN a.y AND b.y GROUP BY a.page, a.y, b.y) low ON low.page = o.page AND low.lo = o.kept[-1] AND low.hi = f.y) n)
    SELECT page, CASE WHEN alone THEN best::VARCHAR ELSE array_to_string(kept, ',') END AS kept FROM fold JOIN kind USING (page) WHERE i = 4
""")
def separate_peaks(spark, sf_dir):
    """The highest row of each fifth of a page, where those without a blank gutter between them fold together."""
    found = F.array(*[_highest(F.col("s"), lo, lo + 30) for lo in range(0, 150, 30)])
    return _pages(spark, sf_dir).where(F.size("s") == 150).withColumn("p", found).select("page", F.array_join(G.separate_peaks(F.col("s"), F.col("p")).cast("array<string>"), ",").alias("kept"))


@query(f"""
    WITH {_PAGES}, d AS (SELECT page, y, s, h, CASE WHEN y = 0 THEN lead(s) OVER w - s WHEN y = h - 1 THEN s - lag(s) OVER w ELSE (lead(s) OVER w - lag(s) OVER w) / 2 END AS d FROM r WINDOW w AS (PARTITION BY page ORDER BY y)),
    k AS (SELECT page, arg_max(y, (s, -y)) AS peak, min(h) AS h FROM r GROUP BY page),
    m AS (SELECT k.page, peak, k.h, max(d) FILTER (y < peak) AS rise, min(d) FILTER (y >= peak) AS fall, arg_min(y, (d, y)) FILTER (y >= peak) AS deepest FROM k JOIN d USING (page) GROUP BY ALL),
    b AS (SELECT m.page, m.h, CASE WHEN rise > 1e-6 THEN min(y) FILTER (y < peak AND d >= 0.85 * rise) ELSE 0 END AS lo, CASE WHEN fall < -1e-6 THEN coalesce(max(y) FILTER (y >= peak AND d <= 0.85 * fall AND s < 0.55), deepest) + 1 ELSE m.h END AS hi FROM m JOIN d USING (page) GROUP BY m.page, m.h, rise, fall, deepest),
    w AS (SELECT page, h, coalesce(lo, 0) AS lo, hi, greatest(2, round_even(0.045 * greatest(1, hi - coalesce(lo, 0)), 0)) + 3 AS margin FROM b)
    SELECT page, CAST(greatest(0, lo - margin) AS INT) AS lo, CAST(least(h, hi + margin) AS INT) AS hi FROM w
""")
def peak_bands(spark, sf_dir):
    """The band about the highest row of each page."""
    band = G.around_peak(F.col("s"), index_of_max(F.col("s")), F.lit(0), F.size("s"))
    return _pages(spark, sf_dir).select("page", band.alias("b")).select("page", "b.lo", "b.hi")


@query(f"""
    WITH {_PAGES}, b AS (SELECT page, y // 30 AS i, min(y) AS lo, max(y) + 1 AS hi, avg(c * c * c) AS score FROM r GROUP BY page, y // 30),
    k AS (SELECT *, max(score) OVER (PARTITION BY page) AS best FROM b), a AS (SELECT * FROM k WHERE score >= greatest(0.45 * best, best - 0.35)),
    o AS (SELECT *, count(*) OVER w >= 2 AND best >= 1.45 * median(score) OVER w AS one, row_number() OVER (PARTITION BY page ORDER BY score DESC, i) AS place FROM a WINDOW w AS (PARTITION BY page))
    SELECT page, string_agg(lo || '-' || hi, ',' ORDER BY i) AS bands FROM o WHERE NOT one OR place = 1 GROUP BY page
""")
def letter_bands(spark, sf_dir):
    """Those fifths of a page that look like letters, scored by the cubes of a signal."""
    starts = F.filter(F.array(*[F.lit(i) for i in range(0, 150, 30)]), lambda lo: lo < F.size("s"))
    bands = F.transform(starts, lambda lo: F.struct(lo.alias("lo"), F.least(lo + 30, F.size("s")).alias("hi")))
    cubes = F.transform("c", lambda x: x * x * x)
    found = _pages(spark, sf_dir).withColumns({"b": bands, "cubes": cubes})
    scores = F.transform("b", lambda b: array_mean(span(F.col("cubes"), b["lo"], b["hi"])))
    return found.withColumn("scores", scores).select("page", _text(G.letter_bands(F.col("b"), F.col("scores"), F.col("s"))).alias("bands"))


@query(f"""
    WITH RECURSIVE {_PAGES}, bands AS (SELECT page, y // 75 AS half, min(y) AS lo, max(y) + 1 AS hi, 18 + page % 14 AS usual, greatest(avg(c), 1e-6) AS whole FROM r GROUP BY page, y // 75),
    l AS (SELECT b.page, b.half, g.sig, g.y - b.lo AS y, g.v, b.hi - b.lo AS n FROM bands b JOIN g ON g.page = b.page AND g.y >= b.lo AND g.y < b.hi),
    w AS (SELECT a.page, a.half, a.sig, a.y, a.v, a.n, coalesce(max(b.y) FILTER (b.y < a.y AND b.v > a.v), -1) AS l, coalesce(min(b.y) FILTER (b.y > a.y AND b.v > a.v), 100000) AS r, max(b.v) FILTER (b.y IN (a.y - 2, a.y + 2)) AS beside FROM l a JOIN l b USING (page, half, sig) GROUP BY ALL),
    p AS (SELECT a.page, a.half, a.sig, a.y, a.v, a.n, a.beside, a.v - greatest(min(b.v) FILTER (b.y <= a.y AND b.y > a.l), min(b.v) FILTER (b.y >= a.y AND b.y < a.r)) AS clear FROM w a JOIN l b ON b.page = a.page AND b.half = a.half AND b.sig = a.sig GROUP BY a.page, a.half, a.sig, a.y, a.v, a.n, a.beside),
    raw AS MATERIALIZED (SELECT page, half, y, row_number() OVER (PARTITION BY page, half ORDER BY y) AS i FROM (SELECT DISTINCT page, half, y FROM p WHERE y BETWEEN 3 AND n - 4 AND v >= 0.18 AND v >= beside AND clear >= 0.08)),
    s AS MATERIALIZED (SELECT page, half, y, v FROM l WHERE sig = 's'),
    fold AS (SELECT raw.page, raw.half, i, [raw.y] AS kept FROM raw WHERE i = 1
      UNION ALL SELECT f.page, f.half, n.i, CASE WHEN n.y - f.kept[-1] >= greatest(10, floor(0.45 * b.usual)) THEN list_append(f.kept, n.y) WHEN x.v > z.v THEN list_append(f.kept[1 : len(f.kept) - 1], n.y) ELSE f.kept END
        FROM fold f JOIN raw n ON n.page = f.page AND n.half = f.half AND n.i = f.i + 1 JOIN bands b ON b.page = f.page AND b.half = f.half JOIN s x ON x.page = f.page AND x.half = f.half AND x.y = n.y JOIN s z ON z.page = f.page AND z.half = f.half AND z.y = f.kept[-1]),
    ends AS (SELECT page, half, arg_max(kept, i) AS kept FROM fold GROUP BY page, half),
    pairs AS (SELECT page, half, i, kept[i] AS a, kept[i + 1] AS b, false AS forced FROM (SELECT page, half, kept, unnest(range(1, len(kept))) AS i FROM ends)
      UNION ALL SELECT page, half, 0, least(t[1], t[2]), greatest(t[1], t[2]), true FROM (SELECT e.page, e.half, list(s.y ORDER BY s.v DESC, s.y DESC) AS t FROM ends e JOIN s ON s.page = e.page AND s.half = e.half AND list_contains(e.kept, s.y) GROUP BY e.page, e.half) WHERE len(t) >= 2),
    cuts AS (SELECT q.*, arg_min(s.y, (s.v, s.y)) AS spot, min(s.v) AS low, least(max(s.v) FILTER (s.y = a), max(s.v) FILTER (s.y = b)) AS least_peak FROM pairs q JOIN s ON s.page = q.page AND s.half = q.half AND s.y BETWEEN a AND b GROUP BY q.page, q.half, i, a, b, forced),
    judged AS (SELECT c.*, d.lo, d.hi, d.hi - d.lo AS n, usual, whole, low / least_peak AS ratio, (SELECT avg(x.v) FROM l x WHERE x.page = c.page AND x.half = c.half AND x.sig = 'c' AND x.y < c.spot) AS u, (SELECT avg(x.v) FROM l x WHERE x.page = c.page AND x.half = c.half AND x.sig = 'c' AND x.y >= c.spot) AS d FROM cuts c JOIN bands d USING (page, half)),
    found AS (SELECT page, half, arg_max(spot, ((1.0 - ratio) + 0.35 * least(u, d) + 0.15 * (u + d), -i)) AS spot FROM judged WHERE NOT forced AND b - a >= greatest(10, floor(0.45 * usual)) AND least_peak > 1e-6 AND least(spot, n - spot) >= greatest(10, floor(0.35 * usual)) AND least(u, d) >= 0.42 * whole
        AND (ratio <= 0.52 OR (ratio <= 0.70 AND least(spot, n - spot) >= 0.32 * n AND greatest(spot, n - spot) <= 0.68 * n AND least(u, d) >= 0.72 * whole)) GROUP BY page, half),
    forced AS (SELECT page, half, spot FROM judged WHERE forced AND n >= 2.15 * usual AND least(spot, n - spot) >= greatest(10, floor(0.30 * usual)) AND least(u, d) >= 0.35 * whole)
    SELECT b.page, b.lo::INT AS lo, CASE WHEN b.hi - b.lo >= greatest(28, floor(1.60 * usual)) AND coalesce(f.spot, o.spot) IS NOT NULL THEN lo || '-' || (lo + coalesce(f.spot, o.spot)) || ',' || (lo + coalesce(f.spot, o.spot)) || '-' || hi ELSE lo || '-' || hi END AS parts
    FROM bands b LEFT JOIN found f USING (page, half) LEFT JOIN forced o USING (page, half)
""")
def split_bands(spark, sf_dir):
    """Both halves of a page, cut where they hold two lines."""
    halves = F.filter(F.array(F.lit(0), F.lit(75)), lambda lo: lo < F.size("s"))
    found = _pages(spark, sf_dir).withColumn("b", F.explode(F.transform(halves, lambda lo: F.struct(lo.alias("lo"), F.least(lo + 75, F.size("s")).alias("hi")))))
    usual = (18 + F.col("page") % 14).cast("double")
    parts = pages.split_bands(found, F.col("s"), F.col("c"), F.array("b"), usual, _score(F.col("row.c")))
    return parts.select("page", "b.lo", _text(F.col("bands")).alias("parts"))


@query()
def page_bands(spark, sf_dir):
    """The bands of all lines of every page."""
    found = pages.page_bands(_pages(spark, sf_dir), F.col("s"), F.col("c"), F.lit(200), _score(F.col("row.c")))
    return found.select("page", F.size("bands").alias("lines"), _text(F.col("bands")).alias("bands"))


def _mask(page):
    """A box of a page's strokes for two pages of three."""
    x0, y0 = 20 + page % 10, 30 + page % 40
    return F.when(page % 3 > 0, R.box(x0, y0, F.lit(90), y0 + 40))


@query(f"""
    WITH RECURSIVE {_PAGES}, x AS MATERIALIZED (SELECT page, y AS i, CASE WHEN y BETWEEN 10 + page % 30 AND 139 - page % 50 THEN 0.3 + 0.7 * c ELSE 0.02 * c END AS v FROM r),
    q AS MATERIALIZED (SELECT page, y, h, CASE WHEN y < 60 + page % 25 OR y > 128 - page % 20 THEN s ELSE s * 0.1 END AS s, CASE WHEN y < 60 + page % 25 OR y > 128 - page % 20 THEN c ELSE c * 0.1 END AS m FROM r),
    l AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b, max(s) OVER (PARTITION BY page) AS top FROM q WINDOW w AS (PARTITION BY page ORDER BY y)), t AS (SELECT page, y, h, row_number() OVER (PARTITION BY page ORDER BY y) AS n FROM l WHERE s >= a AND s >= b AND s >= 0.42 * top),
    f AS (SELECT page, n, [y] AS kept FROM t WHERE n = 1 UNION ALL SELECT f.page, t.n, CASE WHEN t.y - f.kept[-1] >= greatest(6, floor(0.04 * t.h)) THEN list_append(f.kept, t.y) ELSE f.kept END FROM f JOIN t ON t.page = f.page AND t.n = f.n + 1),
    k AS (SELECT page, unnest(arg_max(kept, n)) AS y FROM f GROUP BY page), p AS (SELECT k.page, k.y, q.h, greatest(0.12, 0.20 * q.s) AS floor FROM k JOIN q USING (page, y)),
    sp AS (SELECT p.page, p.y, coalesce(max(q.y) FILTER (q.y < p.y AND q.s < floor) + 1, 0) AS lo, coalesce(min(q.y) FILTER (q.y > p.y AND q.s < floor), min(p.h)) AS hi FROM p JOIN q ON q.page = p.page GROUP BY p.page, p.y),
    y AS (SELECT page, min(lo) AS y0, max(hi) AS y1 FROM sp GROUP BY page HAVING max(hi) - min(lo) >= 12),
    z AS (SELECT page, greatest(median(v) + 0.12 * (max(v) - median(v)), 0.24 * max(v)) AS thr FROM x GROUP BY page), xs AS (SELECT x.page, min(i) AS x0, max(i) + 1 AS x1 FROM x JOIN z USING (page) WHERE v >= thr GROUP BY x.page HAVING max(i) + 1 - min(i) >= 12),
    b AS (SELECT d.page, d.h, least(x0, CASE WHEN d.page % 3 > 0 THEN 20 + d.page % 10 END) AS x0, least(CASE WHEN x0 IS NOT NULL THEN y0 END, CASE WHEN d.page % 3 > 0 THEN 30 + d.page % 40 END) AS y0, greatest(x1, CASE WHEN d.page % 3 > 0 THEN 90 END) AS x1, greatest(CASE WHEN x0 IS NOT NULL THEN y1 END, CASE WHEN d.page % 3 > 0 THEN 70 + d.page % 40 END) AS y1
      FROM (SELECT DISTINCT page, h FROM q) d LEFT JOIN (SELECT * FROM y JOIN xs USING (page)) USING (page)),
    m AS (SELECT b.*, max(q.s) AS main, least(b.h - 4, b.y1 + greatest(3, floor(0.04 * b.h))) AS lo FROM b JOIN q ON q.page = b.page AND q.y >= b.y0 AND q.y < b.y1 GROUP BY ALL),
    g2 AS (SELECT page, y, 1 AS k, m AS v, lag(m) OVER w AS a, lead(m) OVER w AS b FROM q WINDOW w AS (PARTITION BY page ORDER BY y) UNION ALL SELECT page, y, 0, s, lag(s) OVER w, lead(s) OVER w FROM q WINDOW w AS (PARTITION BY page ORDER BY y)),
    c AS (SELECT m.page, g2.y, g2.v + 0.15 * k AS score, k, g2.v, m.main, (SELECT min(q.s) FROM q WHERE q.page = m.page AND q.y BETWEEN greatest(0, m.y1 - 1) AND g2.y) AS low FROM m JOIN g2 ON g2.page = m.page AND g2.y >= m.lo + 1 AND g2.y < m.h - 2 WHERE m.y1 < m.h - 6 AND main > 1e-6 AND m.h - 2 > m.lo + 4 AND g2.v >= greatest(0.14, 0.12 * main) AND g2.v >= g2.a AND g2.v >= g2.b),
    d AS (SELECT page, arg_max(y, (score, k, -y)) AS ridge FROM c WHERE low <= least(0.22, 0.55 * v) AND low <= 0.40 * main GROUP BY page),
    o AS (SELECT d.page, ridge, greatest(0.12, 0.28 * q.m) AS fm, greatest(0.12, 0.22 * q.s) AS fs FROM d JOIN q ON q.page = d.page AND q.y = d.ridge),
    n AS (SELECT o.page, ridge, greatest(coalesce(min(q.y) FILTER (q.y > ridge AND q.m < fm), min(q.h)), coalesce(min(q.y) FILTER (q.y > ridge AND q.s < fs), min(q.h))) AS hi FROM o JOIN q ON q.page = o.page GROUP BY o.page, ridge),
    w AS (SELECT x.page, min(i) AS lo, max(i) + 1 AS hi FROM x JOIN (SELECT page, greatest(0.18 * max(v), median(v)) AS thr FROM x GROUP BY page) u USING (page) WHERE v >= thr GROUP BY x.page),
    a AS (SELECT m.page, m.h, CASE WHEN least(m.h, greatest(m.y1, n.hi)) > greatest(m.y1, ridge - greatest(6, floor(0.08 * m.h))) + 4 THEN least(m.x0, w.lo) ELSE m.x0 END AS x0, m.y0, CASE WHEN least(m.h, greatest(m.y1, n.hi)) > greatest(m.y1, ridge - greatest(6, floor(0.08 * m.h))) + 4 THEN greatest(m.x1, w.hi) ELSE m.x1 END AS x1, CASE WHEN n.hi IS NULL THEN m.y1 ELSE greatest(m.y1, least(m.h, n.hi)) END AS y1 FROM m LEFT JOIN n USING (page) LEFT JOIN w USING (page)),
    ok AS (SELECT a.* FROM a JOIN q ON q.page = a.page AND q.y >= a.y0 AND q.y < a.y1 GROUP BY ALL HAVING avg(q.m) >= 0.18 AND a.y1 - a.y0 >= greatest(16, floor(0.05 * a.h)) AND a.x1 - a.x0 >= 16),
    s AS (SELECT *, (x1 - x0) * (y1 - y0) / CAST(150 * h AS DOUBLE) AS ratio, y0 / CAST(h AS DOUBLE) AS t, (h - y1) / CAST(h AS DOUBLE) AS bo, x0 / 150.0::DOUBLE AS l, (150 - x1) / 150.0::DOUBLE AS rr FROM ok),
    j AS (SELECT *, CASE WHEN ratio >= 0.92 AND t + bo < 0.06 AND l + rr < 0.06 THEN 'inscription_fills_frame' WHEN greatest(t, bo, l, rr) < 0.035 THEN 'margins_too_small_to_help' WHEN ratio < 0.025 THEN 'no_clear_inscription_cluster'
      WHEN ((t + bo >= 0.10 OR l + rr >= 0.10) AND (h >= 100 OR t + bo >= 0.18 OR l + rr >= 0.18)) OR ((bo >= 0.08 OR t >= 0.08) AND (h >= 120 OR bo >= 0.20 OR t >= 0.20)) OR (t + bo >= 0.06 AND (y1 - y0) / h <= 0.88 AND (h >= 120 OR t + bo >= 0.22)) OR (l + rr >= 0.06 AND ratio <= 0.82 AND (h >= 120 OR l + rr >= 0.10)) THEN 'margin_trim' ELSE 'margins_too_small_to_help' END AS reason FROM s),
    pad AS (SELECT *, greatest(4, round_even(0.06 * (x1 - x0), 0)) AS px, greatest(4, round_even(0.06 * (y1 - y0), 0)) AS py FROM j)
    SELECT v.page, coalesce(reason, 'no_bbox') AS reason, round(coalesce(ratio, 1), 6) AS ratio, CASE WHEN reason = 'margin_trim' THEN concat_ws(',', CAST(greatest(0, x0 - px) AS INT), CAST(greatest(0, y0 - py) AS INT), CAST(least(150, x1 + px) AS INT), CAST(least(v.h, y1 + py) AS INT)) ELSE concat_ws(',', 0, 0, 150, v.h) END AS region
    FROM (SELECT DISTINCT page, h FROM q) v LEFT JOIN pad USING (page)
""")
def page_regions(spark, sf_dir):
    """The part of each page that holds its lines, from signals that are faint in a gap above the last one."""
    page, s, c = F.col("page"), F.col("s"), F.col("c")
    faint = lambda v: F.transform(v, lambda x, y: F.when((y < 60 + page % 25) | (y > 128 - page % 20), x).otherwise(x * 0.1))
    sides = F.transform(c, lambda x, i: F.when((i >= 10 + page % 30) & (i <= 139 - page % 50), 0.7 * x + 0.3).otherwise(x * 0.02))
    own = _pages(spark, sf_dir).select("page", faint(s).alias("s"), faint(c).alias("m"), sides.alias("x"))
    boxed = regions.found_boxes(own, s, F.col("m"), F.lit(150), lambda lo, hi: F.col("row.x"), _score(F.col("row.m")), _mask(page))
    out = regions.regions(boxed.withColumn("h", F.size("s")), F.lit(150), F.col("h"))
    corners = F.concat_ws(",", *[F.col(n).cast("string") for n in ("x0", "y0", "x1", "y1")])
    return out.select("page", "reason", _rounded("ratio").alias("ratio"), corners.alias("region"))
