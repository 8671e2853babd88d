"""Feature tables: what is computed again, what readers see, and runs that are lost half-way."""

import pytest
from pyspark.sql import functions as F

from inkstone.sources import features

SCHEMA = "source string, id int, v double"
ROWS = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 3, 3.0), ("c", 4, 4.0), (None, 5, 5.0)]


def doubled(rows):
    return rows.select("source", "id", (F.col("v") * 2).alias("f"))


def data(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def seen(spark, path, version=None):
    return sorted((r.id, r.f) for r in features.read(spark, path, "source", version).collect())


def test_one_changed_source_is_computed_again(spark, tmp_path):
    path = str(tmp_path / "t")
    assert features.refresh(data(spark, ROWS), path, "source", doubled, "r1") == 0
    assert seen(spark, path) == [(1, 2.0), (2, 4.0), (3, 6.0), (4, 8.0), (5, 10.0)]
    # the same rows in another order and in other partitions: no new version
    assert features.refresh(data(spark, ROWS[::-1]).repartition(3), path, "source", doubled, "r1") == 0
    changed = [r for r in ROWS if r[1] != 3] + [("b", 3, 30.0)]
    assert features.refresh(data(spark, changed), path, "source", doubled, "r1") == 1
    assert {r.source for r in spark.read.parquet(f"{path}/data/v1").collect()} == {"b"}
    assert (3, 60.0) in seen(spark, path) and (3, 6.0) in seen(spark, path, 0)
    # a source goes, another comes, a row repeats
    assert features.refresh(data(spark, [r for r in changed if r[0] != "c"] + [("d", 6, 6.0), ("a", 1, 1.0)]), path, "source", doubled, "r1") == 2
    assert seen(spark, path) == [(1, 2.0), (1, 2.0), (2, 4.0), (3, 60.0), (5, 10.0), (6, 12.0)]
    assert {r.source for r in spark.read.parquet(f"{path}/data/v2").collect()} == {"a", "d"}
    # another rule computes all again; then only what the last version reads is left
    assert features.refresh(data(spark, ROWS), path, "source", doubled, "r2") == 3
    assert features.forget(spark, path, 1) == [0, 1, 2] and seen(spark, path) == [(1, 2.0), (2, 4.0), (3, 6.0), (4, 8.0), (5, 10.0)]
    with pytest.raises(FileNotFoundError):
        features.read(spark, path, "source", 0)


def test_a_lost_run_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    features.refresh(data(spark, ROWS), path, "source", doubled, "r1")
    changed = [("a", 1, 100.0), *ROWS[1:]]

    def lost(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        features.refresh(data(spark, changed), path, "source", lost, "r1")
    # lost between write and commit
    store = features._store
    monkeypatch.setattr(features, "_store", lambda s, p: store(s, p) if "manifest/v" not in p else lost(None))
    with pytest.raises(RuntimeError):
        features.refresh(data(spark, changed), path, "source", doubled, "r1")
    monkeypatch.setattr(features, "_store", store)
    assert features.versions(spark, path) == [0] and (1, 2.0) in seen(spark, path)
    assert features.refresh(data(spark, changed), path, "source", doubled, "r1") == 1 and (1, 200.0) in seen(spark, path)


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert features.versions(spark, path) == []
    assert features.refresh(data(spark, []), path, "source", doubled, "r1") == 0 and seen(spark, path) == []
    assert features.refresh(data(spark, ROWS[:1]), path, "source", doubled, "r1") == 1 and seen(spark, path) == [(1, 2.0)]
