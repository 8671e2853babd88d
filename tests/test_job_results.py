"""Job results in batch and as a stream: one rule, whatever the batches and the order of arrival."""

import datetime

import pytest
from pyspark.sql import functions as F

from inkstone.operators import jobs
from inkstone.streaming import jobs as streams

SCHEMA = "id string, kind string, result string, at timestamp, seq bigint"
AT = lambda m: datetime.datetime(2026, 1, 1, 10, m)
EVENTS = [
    ("once", "queued", None, AT(0), 1), ("once", "running", None, AT(1), 2), ("once", "succeeded", "raw", AT(2), 3), ("once", "finalized", "better", AT(3), 4), ("once", "finalized", "later", AT(4), 5),
    ("early", "queued", None, AT(0), 6), ("early", "finalized", "too soon", AT(1), 7), ("early", "succeeded", "raw", AT(2), 8),
    ("failed", "running", None, AT(1), 9), ("failed", "failed", "why", AT(2), 10), ("failed", "succeeded", "raw", AT(3), 11), ("failed", "finalized", "better", AT(4), 12),
    ("waits", "queued", None, AT(5), 13), ("runs", "running", None, AT(5), 14), ("runs", "queued", None, AT(6), 15),
    ("unknown", "finalized", "better", AT(3), 16), ("same", "succeeded", "a", AT(2), 18), ("same", "failed", None, AT(2), 17), ("odd", "other", None, AT(2), 19), ("null", "succeeded", "raw", AT(1), 20), ("null", "finalized", None, AT(2), 21),
]
WANT = {"once": ("succeeded", "better"), "early": ("succeeded", "raw"), "failed": ("failed", None), "waits": ("queued", None), "runs": ("running", None), "same": ("failed", None), "null": ("succeeded", None)}


def test_batch(spark):
    df = spark.createDataFrame(EVENTS + EVENTS[:6], SCHEMA).repartition(3)
    got = jobs.results(df, "id", "kind", "result", "at", "seq").collect()
    assert {r.id: (r.status, r.result) for r in got} == WANT and len(got) == len(WANT)
    assert {r.id: r.updated_at for r in got}["once"] == AT(4)
    assert jobs.results(df.limit(0), "id", "kind", "result", "at", "seq").count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_with_late_repeated_and_unordered_events_and_a_restart(spark, tmp_path, rocks):
    pytest.importorskip("google.protobuf")

    def add(n, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = streams.results(stream, "10 minutes", 60).writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{tmp_path}/out")).outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    backwards = EVENTS[::-1]
    add(0, backwards[:11])
    add(1, backwards[11:] + backwards[:5])  # the other half, and some again
    run()
    add(2, [("tick", "queued", None, AT(30), 90)])  # the watermark passes all others
    run()  # from the checkpoint
    add(3, [("once", "finalized", "much too late", AT(3), 91), ("waits", "succeeded", "late", AT(6), 92), ("tick", "running", None, AT(31), 93)])
    add(4, [("tick", "running", None, AT(59), 94)])
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r.batch, r.updated_at)):
        last[r.id] = (r.status, r.result)
    assert {k: v for k, v in last.items() if k != "tick"} == WANT
