"""Helpers shared by the operators: reading tables, Arrow maps, shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z and nothing else.
LOWER = {i: i + 32 for i in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table, read by Spark only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def widen(df: DataFrame) -> DataFrame:
    """Deals a scan of fewer splits than cores over all cores; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def map_arrow(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """mapInArrow with a function from columns to columns (plain lists or arrays), batch by batch.

    fn may be a generator factory marked ``whole = True``; it then gets an iterator of column dicts and yields column dicts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = StructType.fromDDL(schema)
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches)
        for out in fn(columns) if getattr(fn, "whole", False) else map(fn, columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, types)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local mode a temporary one where none is set.

    Needs a classic session: Spark Connect has no context to ask.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


class Kept:
    """Tables written to the shared folder, so that what follows doesn't depend on lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: set[str] = set()

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Writes df as Parquet, in folders by a column's values if one is given, and reads it again: cuts the lineage."""
        schema = df.schema
        (df.write.partitionBy(by) if by else df.write).parquet(path := f"{self.top}/{self.n}")
        self.n += 1
        self.paths.add(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a kept table that nothing reads any more."""
        self.paths.discard(df._kept_at)
        drop_path(self.spark, df._kept_at)

    def only(self, *wanted: DataFrame) -> None:
        """Deletes all kept tables but those that the result still reads."""
        for path in self.paths - {df._kept_at for df in wanted}:
            self.paths.discard(path)
            drop_path(self.spark, path)


    def read_by(self, df: DataFrame, *under: DataFrame) -> DataFrame:
        """df, marked as the reader of these tables and of those that `under` read: see `release`."""
        df._reads = [self, *(k for u in under for k in getattr(u, "_reads", []))]
        return df


def release(df: DataFrame) -> None:
    """Deletes the tables that only df reads, once df has been written elsewhere."""
    for kept in getattr(df, "_reads", []):
        kept.only()


def free_name(name: str, columns: list[str]) -> str:
    """name, or a longer one that no column has (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parts_for(rows: int, each: int) -> int:
    """How many groups of about `each` rows."""
    return max(1, -(-rows // each))


def crc_mod(col: str, n: int) -> F.Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n




def among_lowest(hashed: F.Column, wanted: int, rows: int) -> F.Column:
    """Whether a row's 64-bit hash is among the lowest so many: about a quarter more than `wanted` of `rows` rows pass.

    A sample by a limit would send `wanted` rows of every task to the driver; this sends about `wanted` in all.
    """
    share = (1.25 * wanted + 50) / max(rows, 1)
    return F.lit(True) if share >= 1 else hashed < F.lit(int(share * 2.0**64) - 2**63).cast("bigint")
