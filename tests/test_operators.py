import itertools

import pytest
from pyspark.sql import functions as F

from inkstone.operators import archive, classify, evaluate, jobs, layout, matching


def test_words_and_lines(spark):
    rows = [(1, i, c) for i, c in enumerate("AB||C|")]
    df = spark.createDataFrame(rows, "line int, pos int, c string")
    found = layout.words(df, "line", ["pos"], F.col("c") == "|", F.col("c"))
    assert [(r.word, r.text, r.letters) for r in found.orderBy("word").collect()] == [(1, "AB", 2), (2, "C", 1)]
    assert layout.line_text(found, "line").first().text == "AB|C"


def test_gap_threshold(spark):
    at = lambda g: spark.createDataFrame([(g,)], "g array<int>").select(layout.gap_threshold(F.col("g"))).first()[0]
    assert at([10, 12, 24]) == pytest.approx(24.6)
    assert at([]) == 14.0 and at([2, 3, 4]) == 14.0 and at([5, 6, 7]) == pytest.approx(19.2)


def test_lines_of_boxes(spark):
    df = spark.createDataFrame([([(0, 10, 20), (1, 40, 20), (2, 14, 20), (3, 44, 20)],)], "b array<struct<pos:int,cy:int,h:int>>")
    lines = df.select(layout.cluster_lines(F.col("b")).alias("x")).first().x
    assert [(r["mean"], r["members"]) for r in lines] == [(12.0, [0, 2]), (42.0, [1, 3])]


def test_bars_by_boxes_at_one_place_in_any_order(spark):
    rows = [(1, 10, 12, 40, 1), (1, 10, 30, 40, 1), (1, 40, 45, 40, 2)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "k int, x0 int, x1 int, h int, pos int").coalesce(1)
        out = layout.bars(df, "k", "x0", "x1", "h", "pos").collect()
        assert sorted((r.x0, r.x1, r.is_bar) for r in out) == [(10, 12, False), (10, 30, False), (40, 45, False)]


def test_runs_of_separators_at_one_place_in_any_order(spark):
    boxes = [("p", 0, 5, True), ("p", 6, 9, False), ("p", 6, 9, True), ("p", 11, 14, True), ("q", 0, 5, True), ("q", 0, 5, True), ("q", 0, 5, True), ("q", 30, 31, True)]
    for rows in (boxes, boxes[::-1]):
        df = spark.createDataFrame(rows, "k string, x0 int, x1 int, bar boolean").coalesce(1)
        runs = layout.separator_runs(df, "k", "x0", "x1", F.col("bar"))
        # equal separators are one run, and a line's first run is 1
        assert sorted(map(tuple, runs.collect())) == [("p", 1, 0, 5, 1), ("p", 3, 6, 14, 2), ("q", 1, 0, 5, 3), ("q", 2, 30, 31, 1)]


def test_the_limit_between_lines_is_computed_once(spark):
    df = spark.createDataFrame([([(0, 10, 20), (1, 40, 20)],)], "b array<struct<pos:int,cy:int,h:int>>")
    plan = df.select(layout.cluster_lines(F.col("b")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_sort(") == 1  # of the heights; not again for every box and every line
    # boxes in any order give the same lines, and equal places go by number
    shuffled = [(3, 44, 20), (2, 10, 20), (1, 40, 20), (0, 10, 20)]
    lines = spark.createDataFrame([(shuffled,)], df.schema).select(layout.cluster_lines(F.col("b")).alias("x")).first().x
    assert [(r["mean"], r["members"]) for r in lines] == [(10.0, [0, 2]), (42.0, [1, 3])]


def test_linking_is_greedy_and_exact(spark):
    local = spark.createDataFrame([(1, "a", 0.0, 1), (2, "a", 50.0, 2), (3, "b", 0.0, 3), (4, None, 0.0, 4)], "id long, text string, at double, pos long")
    remote = spark.createDataFrame([(11, "a", 60.0, 1), (12, "a", 40.0, 2), (13, "b", 500.0, 3)], "id long, text string, at double, pos long")
    assert sorted(map(tuple, matching.link_nearby(local, remote, 100.0).collect())) == [(1, 11), (2, 12)]
    assert sorted(map(tuple, matching.link_nearby(local, remote, 55.0).collect())) == [(1, 12), (2, 11)]


def test_interval_matching_is_one_to_one(spark):
    g = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 8, 20)], "k int, id int, lo int, hi int")
    p = spark.createDataFrame([(1, 7, 0, 9), (1, 8, 9, 20), (1, 9, 0, 10)], "k int, id int, lo int, hi int")
    pairs = matching.overlap_pairs(g, p, "k")
    assert sorted((r.g, r.p) for r in matching.match_greedy(pairs, "k").collect()) == [(1, 9), (2, 8)]


def test_boundaries_and_boxes(spark):
    t = spark.createDataFrame([(1, 10), (1, 13), (1, 90)], "k int, at int")
    c = spark.createDataFrame([(1, 12), (1, 50)], "k int, at int")
    assert [tuple(r) for r in matching.boundary_hits(t, c, "k", 3).collect()] == [(1, 10, 12)]
    b = spark.createDataFrame([(1, 0, 0, 10, 10), (1, 2, 2, 5, 5), (1, 1, 0, 11, 10), (1, 50, 50, 60, 60)], "k int, x0 int, y0 int, x1 int, y1 int")
    assert sorted(tuple(r)[1:] for r in matching.merge_boxes(b, "k").collect()) == [(0, 0, 11, 10), (50, 50, 60, 60)]


def test_purge_and_pages(spark):
    p = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None)], "id int, at int")
    c = spark.createDataFrame([(1, "x"), (3, "y")], "pid int, v string")
    left, (rest,) = archive.survivors(p, [(c, "pid")], F.col("at") < 6, "id")
    assert sorted(r.id for r in left.collect()) == [3, 4] and [r.v for r in rest.collect()] == ["y"]
    assert [r.id for r in archive.keyset_page(p, "at", 5).collect()] == [3]
    assert [r.id for r in archive.keyset_page(p, "at", (5, 1), tiebreak="id").collect()] == [2, 3]


def test_history_has_every_remote_row_once(spark):
    linked = spark.createDataFrame([(1, 10, 5), (2, None, 6)], "local_id long, remote_id long, sort_ts long")
    remote = spark.createDataFrame([(10, 1), (11, 2)], "rid long, sort_ts long")
    out = archive.merged_history(linked, remote, "rid").collect()
    assert sorted((r.local_id or 0, r.remote_id or 0) for r in out) == [(0, 11), (1, 10), (2, 0)]


def test_banks(spark):
    bank = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label string, v array<double>")
    x = spark.createDataFrame([(1, [2.0, 1.0])], "id int, v array<double>")
    r = classify.prototype_match(x, bank).first()
    assert r.label == "a" and r.margin == pytest.approx((2 - 1) / 5**0.5, rel=1e-4)
    stats = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "mean array<double>, std array<double>")
    s = classify.shape_match(x, bank, stats).first()
    assert s.label == "a" and s.similarity == pytest.approx(1 / (1 + 1.25**0.5))
    pairs = {(r.a, r.b) for r in classify.confusable(classify.group_members(spark)).collect()}
    assert all((b, a) in pairs for a, b in pairs) and ("𐩠", "𐩡") in pairs
    assert classify.label_dictionary(spark).count() == 39


def test_splits_and_samples(spark):
    keys = spark.range(400).selectExpr("cast(id as string) AS k")
    split = evaluate.frozen_split(keys, "k")
    parts = {r.part: r["count"] for r in split.groupBy("part").count().collect()}
    assert sum(parts.values()) == 400 and 240 < parts["train"] < 320
    more = evaluate.frozen_split(keys.union(spark.createDataFrame([("new",)], "k string")), "k", split)
    assert more.where("k = 'new'").first().part == "train" and more.join(split, ["k", "part"]).count() == 400
    assert {r.k for r in evaluate.reservoir(keys, "k", 30).collect()} == {r.k for r in evaluate.reservoir(keys.repartition(7), "k", 30).collect()}


def test_queue(spark):
    df = spark.createDataFrame([("q", 1, 0.0, 10.0), ("q", 2, 1.0, 5.0), ("q", 3, 2.0, 1.0)], "q string, id int, at double, s double")
    assert [tuple(r)[1:] for r in jobs.fifo(df, "q", "at", "s", "id").orderBy("id").collect()] == [(1, 0.0, 10.0), (2, 10.0, 15.0), (3, 15.0, 16.0)]


def test_every_oracle_has_a_query():
    from inkstone.plans import suite

    assert set(suite.oracle_sql()) <= set(suite.queries()) and len(list(itertools.islice(suite.queries(), 100))) > 50
