import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from inkstone.operators import lattice
from inkstone.sources import files
from inkstone.streaming import jobs as streams


def test_best_path_is_the_best(spark):
    edges = [0, 3, 7, 12, 20]
    lines = spark.createDataFrame([(1, edges)], "line int, edges array<int>")
    spans = lattice.arcs(lines, "line", "edges")
    assert spans.count() == 4 + 3 + 2
    scored = spans.withColumn("reward", lattice.reward(((F.col("i") * 7 + F.col("j") * 5) % 11) / 10.0))
    value = {(r.i, r.j): r.reward for r in scored.collect()}
    paths = [[0, *inner, 4] for n in range(4) for inner in itertools.combinations((1, 2, 3), n)]
    best = max(sum(value[a, b] for a, b in itertools.pairwise(p)) for p in paths if all(b - a <= 3 for a, b in itertools.pairwise(p)))
    got = lattice.best_path(scored, "line").orderBy("i").collect()
    assert sum(r.reward for r in got) == pytest.approx(best)
    assert [(r.i, r.lo) for r in got][0] == (0, 0) and got[-1].hi == 20 and all(a.j == b.i for a, b in itertools.pairwise(got))


def test_fixed_pitch(spark):
    v = [1.0] * 30
    v[10], v[20] = 0.0, 0.0
    df = spark.createDataFrame([(1, v, 3), (2, v, 1)], "line int, v array<double>, n int")
    assert sorted((r.line, r.cuts) for r in lattice.fixed_pitch(df, "line", "v", "n").collect()) == [(1, [10, 20]), (2, [])]


def test_files(spark, tmp_path):
    lines = spark.createDataFrame([(0, "# c"), (1, "A='x=1'"), (2, "A=2"), (3, " B = y "), (4, "junk")], "n int, value string")
    assert sorted(map(tuple, files.settings(lines, position="n").collect())) == [("A", "x=1"), ("B", "y")]
    up = spark.createDataFrame([("data:image/png;base64,QUJD",), ("",), (None,), ("QUJD",)], "imageBase64 string")
    assert [(bytes(r.content) if r.content is not None else None, r.problem) for r in files.uploads(up).collect()] == [(b"ABC", None), (b"", "empty"), (None, "missing"), (b"ABC", None)]
    rows = spark.createDataFrame([('{"id": "1", "n": 2}',), ("broken",)], "line string")
    out = files.json_lines(rows, "line", "id string, ok boolean, twice int, error string", lambda r: {"twice": r["n"] * 2, "overlay": b"x"}).collect()
    assert (out[0].parsed.ok, out[0].parsed.twice, out[1].parsed.ok) == (True, 4, False) and out[1].parsed.error
    for name in ("a.PNG", "b.txt", "c.jpeg"):
        (tmp_path / name).write_bytes(b"12")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.images(spark, str(tmp_path)).collect()) == ["a.PNG", "c.jpeg"]


def test_job_stream(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 1, 1, 10, m)
    rows = [("a", "queued", at(0)), ("a", "running", at(1)), ("a", "succeeded", at(2)), ("a", "failed", at(3)), ("b", "queued", at(1)), ("b", "odd", at(2))]
    spark.createDataFrame(rows, "id string, status string, at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, status string, at timestamp").parquet(f"{tmp_path}/in")
    states = streams.transitions(stream)
    q = states.writeStream.outputMode("update").foreachBatch(streams.upsert(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out/v0").collect()
    assert sorted((r.id, r.status) for r in got) == [("a", "succeeded"), ("b", "queued")]
