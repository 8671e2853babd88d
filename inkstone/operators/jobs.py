"""Job records in batch: latest states, pruning by age and number, and the single-slot queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import constants as K


def latest_state(events: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """key, state, updated_at: the last event of each job."""
    last = F.max(F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("state"))).alias("last")
    return events.groupBy(key).agg(last).select(key, F.col("last.state").alias("state"), F.col("last.at").alias("updated_at"))


def pruned(jobs: DataFrame, now: Column, created: str, updated: str, key: str, cap: int = K.JOB_CAP, minutes: int = K.JOB_TTL_MINUTES) -> DataFrame:
    """Jobs updated within the last `minutes`; if more than `cap` are left, the newest by creation."""
    alive = jobs.where(F.col(updated) >= now - F.make_interval(mins=F.lit(minutes)))
    return alive.orderBy(F.desc(created), F.desc(key)).limit(cap)


def job_view(jobs: DataFrame) -> DataFrame:
    """What a poll sees of jobs (id, status, error, text, overlay): results of those that succeeded, errors of those that failed."""
    done, failed = F.col("status") == "succeeded", F.col("status") == "failed"
    return jobs.select("id", F.when(done, "succeeded").when(failed, "failed").otherwise("pending").alias("status"), F.when(done, F.col("text")).alias("text"), F.when(failed, F.col("error")).alias("error"), F.when(done, F.coalesce(F.col("overlay") != "", F.lit(False))).alias("has_overlay"))


def fifo(arrivals: DataFrame, queue: str, at: str, service: str, key: str) -> DataFrame:
    """queue, key, start, end of each job where a queue does one at a time in order of arrival.

    A job starts when it has arrived and all work before it is done: the largest, over jobs up to it, of an arrival less
    the work before that job, plus the work before it. Two running windows say so.
    """
    w = Window.partitionBy(queue).orderBy(at, key).rowsBetween(Window.unboundedPreceding, 0)
    before = arrivals.select(queue, key, at, service, (F.sum(service).over(w) - F.col(service)).alias("__before"))
    start = F.max(F.col(at) - F.col("__before")).over(w) + F.col("__before")
    return before.select(queue, key, start.alias("start"), (start + F.col(service)).alias("end"))


def results(events: DataFrame, key: str, kind: str, result: str, at: str, seq: str) -> DataFrame:
    """key, status, result, updated_at: where each job ends, by its events in order of (at, seq).

    Kinds: queued, running, succeeded, failed, and finalized, which gives a better result. The first of succeeded and failed
    stands. A job's result is replaced once, and only if it has succeeded: the first finalized behind that counts, others
    don't. finalized alone makes no job. Repeated events change nothing; other kinds are left out.
    """
    order = F.struct(F.col(at).alias("at"), F.col(seq).alias("seq"))
    own = events.where(F.col(kind).isin("queued", "running", "succeeded", "failed", "finalized")).select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(result).alias("result"), order.alias("at"))
    is_end, runs = F.col("kind").isin("succeeded", "failed"), F.max(F.when(F.col("kind") == "running", 1))
    ends = own.groupBy("key").agg(F.min_by(F.struct("kind", "result", "at"), F.when(is_end, F.col("at"))).alias("end"), runs.alias("runs"), F.max(F.when(F.col("kind") != "finalized", 1)).alias("known"), F.max("at.at").alias("updated_at")).where("known = 1")
    done = F.col("end.kind") == "succeeded"
    better = own.where("kind = 'finalized'").select(F.col("key").alias("key_"), F.col("at").alias("then"), F.col("result").alias("better"))
    met = ends.join(better, F.col("key").eqNullSafe(F.col("key_")) & (F.col("then") > F.col("end.at")) & done, "left")
    out = met.groupBy("key", "end", "runs", "updated_at").agg(F.min_by(F.struct("better"), "then").alias("b"))
    status = F.coalesce(F.col("end.kind"), F.when(F.col("runs") == 1, "running"), F.lit("queued"))
    return out.select(F.col("key").alias(key), status.alias("status"), F.when(F.col("b").isNotNull(), F.col("b.better")).when(done, F.col("end.result")).alias("result"), "updated_at")
