"""A corpus pipeline over `documents`: filter, deduplicate, redact and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Stages work
on all that their predecessors kept. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import packing, pii, quality, simhash, toxicity
from inkstone.llm.common import Kept, free_name, release, table, widen

#: SQL can't express the classifiers.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Without labels of both kinds every document stays.

    Null and empty texts score as one passage of zeros; repeated rows stay or go together. Columns of other names pass
    through untouched; an empty table stays one.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return widen(docs).where(quality.scorer(model) >= quality.THRESHOLD)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. Without labels every document stays.

    Null and empty texts score what the bias says; repeated rows stay or go together. Columns of other names pass
    through untouched; an empty table stays one.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    if not len(model.slots):
        return docs
    return widen(docs).where(toxicity.scorer(model) < toxicity.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, of repeated or missing ids any one row.

    Rows get numbers that are written down first: the groups are found from numbers and texts alone, and only numbers
    and ids are joined with them, never texts.
    """
    kept = Kept(spark)
    row = free_name("row", docs.columns)
    rows = kept.keep(docs.withColumn(row, F.monotonically_increasing_id()))
    found = simhash.near_duplicates(rows.select(F.col(row).alias("id"), "text"), key="id")
    groups = found.select("id", "component_id")
    ids = rows.select(F.col(row).alias("id"), "doc_id")
    best = groups.join(ids, "id").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("best"))
    out = rows.join(best.select(F.col("best.id").alias(row)), row, "left_semi").select(*docs.columns)
    return kept.read_by(out, found)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind; n_chars follows the new text.

    Null texts stay null and empty ones empty; repeated rows are redacted alike. Other columns pass through untouched;
    an empty table stays one.
    """
    field = pii.fit(docs)
    new = {"text": pii.redacted(field)}
    out = widen(docs).withColumns(new)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row for each piece of a document.

    Null and empty texts are one piece of one token; repeated rows and null ids are pieces of their own. Only doc_id and
    text are read, so other columns' names don't matter; an empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("pii", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again.

    A stage's table, and what the stage itself wrote, is deleted once the next one's is written.
    """
    kept = Kept(spark)
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = kept.keep(out) if name != STAGES[-1][0] else out  # packing has written its pieces when it returns
        if name != STAGES[-1][0]:
            release(out)
        if last is not None:
            kept.drop(last)
        last = docs
    return docs
