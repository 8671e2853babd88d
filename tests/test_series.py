"""Series that span many blocks, against a walk over the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.operators import series


def walked(v, p):
    """How far v falls on both sides of p, by looking at every sample."""
    higher = np.flatnonzero(v > v[p])
    left, right = higher[higher < p], higher[higher > p]
    lo, hi = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(v))
    return v[p] - max(v[lo : p + 1].min(), v[p:hi].min())


def maxima(v, least):
    return [i for i in range(1, len(v) - 1) if v[i] >= v[i - 1] and v[i] > v[i + 1] and v[i] >= least]


@pytest.mark.parametrize("wide", [2, 3, 64])
def test_prominence_over_trees_of_blocks(spark, monkeypatch, wide):
    monkeypatch.setattr(series, "WIDE", wide)
    rng = np.random.default_rng(wide)
    n = np.arange(130)
    own = {"noise": np.round(rng.random(150), 2), "steps": np.repeat(rng.integers(0, 4, 40), 3) / 4, "rising": n / 150 + (n % 2) * 0.02, "falling": 1 - n / 150 + (n % 2) * 0.02, "one": np.array([0.5]), "flat": np.full(70, 0.5), None: np.array([0.0, 1.0, 0.2, 0.9, 0.1])}
    rows = spark.createDataFrame([(k, i, float(x)) for k, v in own.items() for i, x in enumerate(v)], "key string, i bigint, v double")
    peaks = series.local_maxima(rows, 0.1)
    assert sorted((str(r.key), r.i) for r in peaks.collect()) == sorted((str(k), i) for k, v in own.items() for i in maxima(v, 0.1))
    got = {(r.key, r.i): r.prominence for r in series.prominences(rows, peaks).collect()}
    want = {(k, i): walked(v, i) for k, v in own.items() for i in maxima(v, 0.1)}
    assert got == pytest.approx(want)


def test_places_run_over_buckets(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), float(t), int(e)) for e, (k, t) in enumerate(zip(rng.integers(0, 3, 400), np.round(rng.random(400) * 20, 1), strict=True))]
    df = spark.createDataFrame(rows, "k int, t double, e int").repartition(7)
    got = {r.e: r.i for r in series.positions(df, "k", F.floor("t"), ["t", "e"]).collect()}
    want = {}
    for key in range(3):
        want |= {e: i for i, (_, _, e) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]))}
    assert got == want
    assert series.prominences(df.limit(0).selectExpr("k AS key", "0L AS i", "t AS v"), df.limit(0).selectExpr("k AS key", "0L AS i", "t AS v")).count() == 0


def test_a_hot_key_is_many_tasks_work(spark):
    rows = spark.range(40_000).selectExpr("1 AS key", "id AS i", "sin(id * 0.7) + sin(id * 0.013) AS v")
    nodes = series.tree(rows, 3)
    assert [t.agg(F.max(F.size("children")), F.count("*")).first()[:] for t in nodes] == [(64, 625), (64, 10), (10, 1)]
