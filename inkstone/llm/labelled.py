"""Labelled rows for training: a bounded sample of each class, and which rows are held out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import Kept, among_lowest, crc_mod

#: Rows of a class in a training sample, at most: those of the smallest hashes; and bytes of their texts.
PER_CLASS, CLASS_BYTES = 4000, 64 << 20
FOLDS = 5


def held_out(key: str = "doc_id", folds: int = FOLDS) -> Column:
    return crc_mod(key, folds) == 0


def sample(labels: DataFrame, label: str, per_class: int = PER_CLASS, folds: int = FOLDS, key: str = "doc_id") -> tuple[dict, float]:
    """({key: label} of at most 2 * per_class training keys, log-odds of label 1 over all training keys).

    Held-out rows never come in, nor do rows without a key or with a label other than 0 and 1. A key that has several
    labels has the largest.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key, folds)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}  # two rows at most
    picked: dict = {}
    for value in counts:
        hashed = F.xxhash64("key")
        rows = own.where((F.col("label") == value) & among_lowest(hashed, per_class, counts[value])).select("key", hashed.alias("h")).collect()
        picked |= {r["key"]: value for r in sorted(rows, key=lambda r: (r["h"], r["key"]))[:per_class]}
    return picked, math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))


def rows_of(docs: DataFrame, picked: dict, kept: Kept, text: str = "text", key: str = "doc_id", limit: int = CLASS_BYTES) -> DataFrame:
    """A kept table (picked, label, text, h): one row for each picked key that docs has, at most `limit` bytes of text a class.

    A key of several rows gives the text of the smallest hash. Rows of a class are taken in the order of their keys' hashes
    until one would pass `limit`; the first one always stays. The list of keys is bounded by the sample's size, so it goes
    to every task; tasks sum up before rows of a key meet.
    """
    keys = docs.sparkSession.createDataFrame([(k, v) for k, v in sorted(picked.items())], f"picked {docs.schema[key].dataType.simpleString()}, label int")
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(keys), F.col("key") == F.col("picked"))
    drawn = kept.keep(own.groupBy("picked", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("h", F.xxhash64("picked")))
    return drawn.where(within(drawn.select("label", "h", F.octet_length("text").alias("n")).collect(), limit))  # a row for each key


def within(sizes: list, limit: int) -> Column:
    """Which rows stay, given (label, h, n) of all: those whose class has at most `limit` bytes up to them, in order of h."""
    keep = F.lit(False)
    for value in sorted({r["label"] for r in sizes}):
        own = sorted((r["h"], r["n"] or 0) for r in sizes if r["label"] == value)
        total, last = 0, own[0][0]
        for h, n in own:
            total += n
            if total > limit and h != own[0][0]:
                break
            last = h
        keep = keep | ((F.col("label") == value) & (F.col("h") <= last))
    return keep
