"""Versioned feature tables: only sources whose rows have changed are computed again, and a version counts once it is committed.

    <path>/data/v<n>/...        rows that version n has computed
    <path>/manifest/v<n>/...    source, fingerprint, built: which version computed a source's rows

A version is committed by one rename of its manifest. What a run wrote before it was lost is overwritten by the next; readers
never see it. Rows of older versions stay where manifests name them, so old versions remain readable until `forget`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Compute = Callable[[DataFrame], DataFrame]


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, ascending."""
    store, at = _store(spark, f"{path}/manifest")
    if not store.exists(at):
        return []
    names = [s.getPath().getName() for s in store.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """source, fingerprint, built of a version, by default the last."""
    known = versions(spark, path)
    chosen = known[-1] if version is None and known else version
    if chosen not in known:
        raise FileNotFoundError(f"{path} has no version {version}")
    return spark.read.parquet(f"{path}/manifest/v{chosen}")


def fingerprints(rows: DataFrame, source: str, rule: str) -> DataFrame:
    """source, fingerprint: the same whatever the order of rows, another if a row, a column or the rule changes.

    Two sums of 64-bit hashes and the number of rows; repeated rows count each.
    """
    names = sorted(rows.columns)
    cols = [F.col(c) for c in names]
    one, two = F.xxhash64(*cols, F.lit(1)), F.xxhash64(F.lit(2), *reversed(cols))
    wide = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    text = F.concat_ws(":", F.lit(rule), F.lit(",".join(names)), F.count("*").cast("string"), wide(one), wide(two))
    return rows.groupBy(F.col(source).cast("string").alias("source")).agg(F.sha2(text, 256).alias("fingerprint"))


def refresh(rows: DataFrame, path: str, source: str, compute: Compute, rule: str) -> int:
    """Brings the table at path up to date with rows and commits it; the number of the version that holds.

    compute: from rows of some sources to features, which must keep the column `source`; rule: names what it computes, so that a
    new rule computes all sources again. Null sources are a source of their own. Sources that are gone leave the
    manifest. Where nothing has changed no version is written.
    """
    spark = rows.sparkSession
    known = versions(spark, path)
    number = known[-1] + 1 if known else 0
    now = fingerprints(rows, source, rule)
    before = manifest(spark, path) if known else spark.createDataFrame([], "source string, fingerprint string, built int")
    old = before.select(F.col("source").alias("source_"), F.col("fingerprint").alias("fingerprint_"), "built")
    merged = now.join(old, F.col("source").eqNullSafe(F.col("source_")) & (F.col("fingerprint") == F.col("fingerprint_")), "left")
    merged = merged.select("source", "fingerprint", F.coalesce("built", F.lit(number)).cast("int").alias("built"))
    # written down first: what counts as changed is decided once
    draft = f"{path}/draft/v{number}"
    merged.write.mode("overwrite").parquet(draft)
    merged = spark.read.parquet(draft)
    if known and merged.where(F.col("built") == number).isEmpty() and merged.count() == before.count():
        return known[-1]
    changed = merged.where(F.col("built") == number).select(F.col("source").alias("source_"))
    some = rows.join(changed, F.col(source).cast("string").eqNullSafe(F.col("source_")), "left_semi")
    compute(some).write.mode("overwrite").parquet(f"{path}/data/v{number}")
    store, at = _store(spark, draft)
    _, final = _store(spark, f"{path}/manifest/v{number}")
    store.mkdirs(final.getParent())
    if not store.rename(at, final):
        raise RuntimeError(f"version {number} of {path} was committed by another run")
    return number


def read(spark: SparkSession, path: str, source: str, version: int | None = None) -> DataFrame:
    """Features of all sources as a version has them, by default the last."""
    named = manifest(spark, path, version)
    built = [r["built"] for r in named.select("built").distinct().collect()]  # versions that still hold rows
    found = None
    for b in sorted(built):
        own = named.where(F.col("built") == b).select(F.col("source").alias("source_"))
        rows = spark.read.parquet(f"{path}/data/v{b}")
        rows = rows.join(own, F.col(source).cast("string").eqNullSafe(F.col("source_")), "left_semi")
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        found = spark.read.parquet(f"{path}/data/v{versions(spark, path)[-1] if version is None else version}").limit(0)
    return found


def forget(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes manifests but for the last `keep`, and data that no manifest names any more; the deleted versions of data."""
    known = versions(spark, path)
    for v in known[:-keep]:
        store, at = _store(spark, f"{path}/manifest/v{v}")
        store.delete(at, True)
    used = {r["built"] for v in known[-keep:] for r in manifest(spark, path, v).select("built").distinct().collect()} | set(known[-1:])
    store, at = _store(spark, f"{path}/data")
    gone = [int(s.getPath().getName()[1:]) for s in store.listStatus(at) if int(s.getPath().getName()[1:]) not in used]
    for v in gone:
        store.delete(_store(spark, f"{path}/data/v{v}")[1], True)
    return sorted(gone)
