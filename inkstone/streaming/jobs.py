"""Job records as streams: latest state per job, expiry, and upserts of micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.operators.jobs import pruned

try:  # the state server's messages need protobuf
    from pyspark.sql.streaming import StatefulProcessor
except ImportError:  # pragma: no cover
    StatefulProcessor = object

RANK = {"queued": 0, "running": 1, "succeeded": 2, "failed": 2}


def transitions(events: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Streaming aggregate: each job's furthest state and times; late events beyond the watermark are left out.

    events: id, status, at (timestamp). A job never goes back: queued, running, then succeeded or failed, whichever came first.
    """
    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(r)) for s, r in RANK.items()])
    known = events.withWatermark("at", delay).where(F.col("status").isin(*RANK))
    furthest = F.max_by("status", F.struct(rank.alias("rank"), (-F.unix_micros("at")).alias("first")))
    return known.groupBy("id").agg(furthest.alias("status"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def windowed_counts(events: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events of each status in tumbling windows."""
    return events.withWatermark("at", delay).groupBy(F.window("at", width), "status").agg(F.count("*").alias("n")).select("window.start", "window.end", "status", "n")


class Results(StatefulProcessor):
    """Job states whose result is replaced once: see `results`.

    Events wait in a list until the watermark has passed them, and are then applied in order of (at, seq); so batches and the
    order of arrival don't matter. A job is forgotten `minutes` after its last event.
    """

    JOB = "status string, result string, replaced boolean, at bigint"
    EVENT = "at bigint, seq bigint, kind string, result string"

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", self.JOB)
        self.waiting = handle.getListState("waiting", self.EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times = set()
        for r in rows:
            at = int(r.at.timestamp() * 1000)
            self.waiting.appendValue((at, r.seq, r.kind, r.result))
            times.add(at)
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        events = sorted(self.waiting.get() if self.waiting.exists() else [], key=lambda e: (e[0], e[1]))
        due, later = [e for e in events if e[0] <= now], [e for e in events if e[0] > now]
        if not due:
            if not later and self.job.exists() and self.job.get()[3] + self.minutes * 60_000 <= now:
                self.job.clear()
            return
        if later:
            self.waiting.put([tuple(e) for e in later])
        else:
            self.waiting.clear()
        status, result, replaced, _ = self.job.get() if self.job.exists() else (None, None, False, 0)
        for _, _, kind, value in due:
            if kind == "finalized":
                if status == "succeeded" and not replaced:
                    result, replaced = value, True
            elif status not in ("succeeded", "failed"):
                if kind in ("succeeded", "failed"):
                    status, result = kind, value if kind == "succeeded" else None
                elif kind == "running" or status is None:
                    status = kind
        last = due[-1][0]
        if status is None:
            return
        self.job.update((status, result, replaced, last))
        self.handle.registerTimer(last + self.minutes * 60_000)
        yield Row(id=key[0], status=status, result=result, updated_at=last)

    def close(self) -> None:
        pass


def results(events: DataFrame, delay: str = "10 minutes", minutes: int = K.JOB_TTL_MINUTES) -> DataFrame:
    """Streaming id, status, result, updated_at (milliseconds): a row whenever the watermark has passed events of a job; the last one stands.

    events: id (string), kind, result (string), at (timestamp), seq (bigint). The rule is that of `operators.jobs.results`,
    but for jobs that have been silent for `minutes`, which are forgotten, and events older than the watermark, which
    are left out. Needs a state store with column families (RocksDB).
    """
    known = events.where(F.col("kind").isin("queued", "running", "succeeded", "failed", "finalized")).withWatermark("at", delay)
    return known.groupBy("id").transformWithState(statefulProcessor=Results(minutes), outputStructType="id string, status string, result string, updated_at bigint", outputMode="Update", timeMode="EventTime")


def upsert(path: str, key: str = "id", order: str = "updated_at", minutes: int = K.JOB_TTL_MINUTES, cap: int = K.JOB_CAP) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: the last row of each key, pruned by age and number, as a new version of a Parquet table.

    Versions are folders named by batch; a batch that is run again writes the same folder again, so results are exact.
    A batch whose version before is missing is an error, not an empty table; versions before that one are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = _version(spark, path, number - 1).unionByName(batch)
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")
        now = latest.agg(F.max(order).alias("__now"))
        kept = pruned(latest.crossJoin(F.broadcast(now)), F.col("__now"), "created_at", order, key, cap, minutes).drop("__now")
        kept.write.mode("overwrite").parquet(f"{path}/v{number}")
        if number > 1:
            _files(spark, f"{path}/v{number - 2}", lambda fs, at: fs.delete(at, True))

    return write


def _files(spark, path: str, do):
    """do(file system, path) in the store of the path; needs a classic session."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return do(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def _version(spark, path: str, number: int) -> DataFrame:
    if not _files(spark, f"{path}/v{number}/_SUCCESS", lambda fs, at: fs.exists(at)):
        raise FileNotFoundError(f"version {number} of {path} is missing or unfinished")
    return spark.read.parquet(f"{path}/v{number}")
