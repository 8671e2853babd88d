"""Writes with conditions, split matching, order statistics and profile rules against plain recomputations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.functions import profiles
from inkstone.operators import groups, jobs, matching, ranks, records
from inkstone.streaming import jobs as streams


@pytest.mark.parametrize("active", [0, 1, 2])
def test_exactly_one_policy_is_active(spark, active):
    columns = "is_active boolean, ios_minimum_supported_version string, android_minimum_supported_version string"
    df = spark.createDataFrame([(i < active, "1", "2") for i in range(3)], columns)
    if active == 1:
        assert [tuple(r)[1:] for r in records.set_minimums(df, "9.0.0").collect()] == [("9.0.0", "9.0.0")]
    else:
        with pytest.raises(Exception, match="active policies"):
            records.set_minimums(df, "9.0.0").collect()


def test_images_take_numbers_only_where_there_is_content(spark):
    docs = spark.createDataFrame([(1, "s"), (2, None), (3, "")], "id int, source_path string")
    extras = spark.createDataFrame([(1, 0, b"", None, "a.pdf"), (1, 1, b"x", None, "a.pdf"), (1, 2, None, None, "b.pdf"), (1, 3, b"y", "image/webp", "b"), (9, 0, b"x", None, "c.pdf")], "id int, pos int, content binary, mime string, filename string")
    out = sorted(map(tuple, records.documentation_images(docs, extras).collect()))
    assert out == [(1, "anonymous/1/extra-01.pdf", False, 1), (1, "anonymous/1/extra-02.b", False, 2), (1, "s", True, 0)]


def test_repeats_reach_their_share(spark):
    a, b = spark.range(90), spark.range(1000, 1010)
    assert records.repeated_to_share(a, b, 0.5).where("id >= 1000").count() == 90
    assert records.repeated_to_share(a, b.limit(0), 0.5).count() == 90 and records.repeated_to_share(a.limit(0), b, 0.5).count() == 10
    assert records.repeated(b, 4).count() == 40


def intervals(rng, n, key):
    lo = rng.integers(0, 400, n)
    return [(key, i, int(x), int(x + w)) for i, (x, w) in enumerate(zip(lo, rng.integers(0, 90, n)))]


@pytest.mark.parametrize("cell", [5.0, 64.0, 1000.0])
def test_pairs_and_greedy_matching_are_those_of_all_pairs(spark, cell):
    rng = np.random.default_rng(1)
    g, p = intervals(rng, 60, 1) + intervals(rng, 5, 2), intervals(rng, 50, 1) + intervals(rng, 9, 3)
    want = []
    for k, i, a, b in g:
        for q, j, c, d in p:
            if k == q and a < d and c < b and a < b and c < d:
                x = min(b, d) - max(a, c)
                iou = x / max(b - a + d - c - x, 1)
                if iou >= 0.3:
                    want.append((k, i, j, iou))
    kind = "k int, id int, lo int, hi int"
    pairs = matching.overlap_pairs(spark.createDataFrame(g, kind), spark.createDataFrame(p, kind), "k", 0.3, cell)
    assert sorted((r.k, r.g, r.p, round(r.iou, 9)) for r in pairs.collect()) == sorted((*w[:3], round(w[3], 9)) for w in want)
    used_g, used_p, best = set(), set(), []
    for k, i, j, iou in sorted(want, key=lambda w: (w[0], -w[3], -w[1], -w[2])):
        if (k, i) not in used_g and (k, j) not in used_p:
            used_g.add((k, i))
            used_p.add((k, j))
            best.append((k, i, j))
    assert sorted((r.k, r.g, r.p) for r in matching.match_greedy(pairs, "k").collect()) == sorted(best)


def test_boxes_merge_in_one_pass(spark):
    rng = np.random.default_rng(2)
    boxes = [(1, int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in zip(rng.integers(0, 500, 80), rng.integers(0, 60, 80), rng.integers(1, 60, 80), rng.integers(1, 60, 80))]
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    kept = []
    for b in sorted((b[1:] for b in boxes), key=lambda b: (-size(b), b)):
        for i, k in enumerate(kept):
            inside = k[0] <= b[0] and k[1] <= b[1] and k[2] >= b[2] and k[3] >= b[3]
            inter = max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1]))
            if inside or inter / (size(b) + size(k) - inter) >= 0.15:
                kept[i] = (min(b[0], k[0]), min(b[1], k[1]), max(b[2], k[2]), max(b[3], k[3]))
                break
        else:
            kept.append(b)
    df = spark.createDataFrame(boxes, "k int, x0 int, y0 int, x1 int, y1 int")
    assert sorted(tuple(r)[1:] for r in matching.merge_boxes(df, "k").collect()) == sorted(kept)


def test_queue_by_windows_is_the_queue(spark):
    rng = np.random.default_rng(3)
    rows = [(int(q), i, int(t), int(s)) for i, (q, t, s) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 500, 200), rng.integers(0, 9, 200)))]
    want, free = {}, {}
    for q, i, t, s in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        begin = max(t, free.get(q, -(10**9)))
        free[q] = begin + s
        want[i] = (begin, begin + s)
    df = spark.createDataFrame(rows, "q int, id int, t bigint, s bigint")
    assert {r.id: (r.start, r.end) for r in jobs.fifo(df, "q", "t", "s", "id").collect()} == want


def test_groups_that_span_batches_stay_whole(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).selectExpr("CASE WHEN id < 300 THEN 0 ELSE id % 11 END AS k", "id")
        out = {r.k: (r.n, r.s) for r in groups.map_groups(df, ["k"], ["id"], "k bigint, n bigint, s bigint", lambda c: [(c["k"][0], len(c["id"]), int(c["id"].sum()))]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert out == {r.k: (r.n, r.s) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()}


def test_percentiles_of_repeated_values(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, 301)
    df = spark.createDataFrame([("a", int(v)) for v in x] + [("b", 5), ("c", None)], "g string, v int")
    out = {r.g: r for r in ranks.percentiles(df, "g", "v", {"p10": 0.1, "p92": 0.92}).collect()}
    assert set(out) == {"a", "b"} and out["b"].p10 == 5
    assert [out["a"].p10, out["a"].p92] == pytest.approx(np.percentile(x, [10, 92]).tolist())


def test_a_missing_version_is_an_error(spark, tmp_path):
    batch = spark.createDataFrame([(1, "queued")], "id int, status string").withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    with pytest.raises(FileNotFoundError):
        streams.upsert(f"{tmp_path}/none")(batch, 3)
    for n in range(3):
        streams.upsert(f"{tmp_path}/some")(batch, n)
    assert sorted(p.name for p in (tmp_path / "some").iterdir()) == ["v1", "v2"]


def test_slivers_join_what_they_touch(spark):
    one = spark.range(1)
    run = lambda boxes, activity: [(r["lo"], r["hi"]) for r in one.select(profiles.absorbed_slivers(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(0.5).alias("score")) for a, b in boxes]), F.array(*[F.lit(float(v)) for v in activity]), F.lit(30)).alias("x")).first().x]
    assert run([(0, 2), (3, 12), (13, 15)], [1] * 20) == [(0, 12), (13, 15)]
    assert run([(0, 2), (3, 12)], [1, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1]) == [(0, 2), (3, 12)]
    assert run([(0, 10), (14, 16)], [1] * 20) == [(0, 10), (14, 16)]


def test_thin_boxes_and_weak_ends_join(spark):
    one = spark.range(1)
    boxes = lambda rows: F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(float(s)).alias("score")) for a, b, s in rows])
    run = lambda c: [tuple(r) for r in one.select(c.alias("x")).first().x]
    rows = [(0, 8, 0.5), (9, 17, 0.7), (18, 25, 0.6), (40, 70, 0.9), (70, 75, 0.2)]
    # two make a box of .57 of the height, which takes in no third; smaller ones do
    assert run(profiles.packed_thin(boxes(rows), F.lit(30))) == [(0, 17, 0.6), (18, 25, 0.6), (40, 70, 0.9), (70, 75, 0.2)]
    assert run(profiles.packed_thin(boxes(rows), F.lit(60))) == [(0, 25, 0.6), (40, 70, 0.9), (70, 75, 0.2)]
    no = F.array(*[F.lit(False)] * 5)
    assert run(profiles.edge_slivers(boxes(rows), F.lit(30), no)) == [(0, 8, 0.5), (9, 17, 0.7), (18, 25, 0.6), (40, 75, 0.9)]
    stem = F.array(*[F.lit(i == 4) for i in range(5)])
    assert len(run(profiles.edge_slivers(boxes(rows), F.lit(30), stem))) == 5
    assert run(profiles.edge_slivers(boxes([(0, 3, 0.1), (4, 30, 0.8)]), F.lit(30), F.array(F.lit(False)))) == [(0, 30, 0.8)]


def test_bands_of_a_page(spark):
    struct = lambda rows: F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in rows])
    run = lambda c: [tuple(r) for r in spark.range(1).select(c.alias("x")).first().x]
    join = lambda rows, h: run(profiles.joined_bands(struct(rows), F.lit(h)))
    # up to .16 of a page of 100 is tiny: 16 rows
    assert join([(0, 10), (12, 52), (60, 72), (75, 115)], 100) == [(0, 52), (60, 115)]
    assert join([(0, 17), (20, 60), (60, 77), (80, 120)], 100) == [(0, 17), (20, 60), (60, 77), (80, 120)]
    assert join([(0, 12), (14, 34), (40, 60)], 100) == [(0, 12), (14, 34), (40, 60)]  # .6 of its neighbour: no scrap
    assert join([(0, 40), (42, 50), (52, 60)], 100) == [(0, 40), (42, 50), (52, 60)]  # the last neighbour is as low
    assert join([(0, 40), (42, 50)], 100) == [(0, 40), (42, 50)] and join([(0, 5)], 100) == [(0, 5)]

    widen = lambda rows, v, h: run(profiles.widened_bands(struct(rows), F.array(*[F.lit(float(x)) for x in v]), F.lit(h)))
    # bands of 20 rows: 6 rows outwards, and inner edges 4 rows past the middle of a gap
    assert widen([(20, 40), (60, 80)], [0.0] * 100, 100) == [(14, 54), (46, 86)]
    # ink above the first band, .4 of its largest or more, belongs to it
    inked = [0.0] * 10 + [0.5] * 10 + [1.0] * 20 + [0.0] * 60
    assert widen([(20, 40), (60, 80)], inked, 100) == [(4, 54), (46, 86)]
    faint = [0.0] * 10 + [0.3] * 10 + [1.0] * 20 + [0.0] * 60
    assert widen([(20, 40), (60, 80)], faint, 100) == [(14, 54), (46, 86)]
    # never past the page
    assert widen([(2, 22), (60, 98)], [0.0] * 100, 100) == [(0, 45), (37, 100)]


@pytest.mark.parametrize("cells", [1, 7, 4096])
def test_ranks_through_cells(spark, monkeypatch, cells):
    monkeypatch.setattr(ranks, "CELLS", cells)
    rng = np.random.default_rng(cells)
    own = {"even": rng.random(400), "skewed": rng.random(300) ** 20 * 1e9, "ties": np.round(rng.random(200), 1), "one": np.array([3.0]), "same": np.full(50, 2.5), "wide": np.array([-1e308, 0.0, 1.0, 2.0, 1e308])}
    df = spark.createDataFrame([(k, float(v)) for k, x in own.items() for v in x], "g string, v double").repartition(5)
    n = F.col("n")
    got = {r.g: (r.least, r.lower, r.upper, r.most) for r in ranks.at_ranks(df, "g", "v", {"least": F.lit(0), "lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2), "most": n - 1}).collect()}
    assert got == {k: (s[0], s[(len(s) - 1) // 2], s[len(s) // 2], s[-1]) for k, s in ((k, np.sort(x)) for k, x in own.items())}
