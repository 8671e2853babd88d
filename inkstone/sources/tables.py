"""Table scans: columns are chosen at the scan, so that Parquet reads no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Where a row stands in its table: a total order of its rows, the same in every run and for every cut into tasks.
PLACE = ("_metadata.file_path", "_metadata.row_index")


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def one_row(df: DataFrame) -> DataFrame:
    """At most one row; a second one is an error."""
    from pyspark.sql import functions as F

    found = df.limit(2)
    return found.withColumn("__n", F.expr("count(*) over ()")).withColumn("__ok", F.assert_true(F.col("__n") <= 1)).where("__ok IS NULL").drop("__n", "__ok")
