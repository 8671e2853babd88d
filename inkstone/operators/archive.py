"""Archive reads and writes: nested listings, visibility, linking of local and stored records, pages, purges, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.functions.text import or_else, preview


def history_list(scans: DataFrame, ocr: DataFrame, docs: DataFrame, limit: int | None = K.LIST_DEFAULT) -> DataFrame:
    """scans (id, public_id, status, avg_confidence, created_at) with their text's preview and title, newest first.

    ocr: scan_id, raw_text; docs: scan_id, title; at most one row each per scan. Equal times go by id. limit None: all rows.
    """
    joined = scans.join(ocr, scans["id"] == ocr["scan_id"], "left").join(docs, scans["id"] == docs["scan_id"], "left")
    rows = joined.select(scans["id"], "public_id", "status", "avg_confidence", "created_at", preview(F.col("raw_text")).alias("preview"), or_else(F.trim("title"), F.lit(None)).alias("documentation_title"))
    return rows.orderBy(F.desc("created_at"), "id").limit(min(limit, K.LIST_CAP)) if limit is not None else rows


def scan_detail(scans: DataFrame, ocr: DataFrame, docs: DataFrame) -> DataFrame:
    """Scans that have a text, with it and with their documentation if there is one."""
    return scans.join(ocr, "scan_id").join(docs, "scan_id", "left")


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str, order: list[str]) -> DataFrame:
    """parents with an array of their children's fields, in the order of `order`; none: an empty array."""
    ordered = [*order, *(f for f in fields if f not in order)]
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias(name))
    return parents.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))


def visible(rows: DataFrame, owners: DataFrame, key: str, owner: Column) -> DataFrame:
    """Rows whose parent belongs to the owner."""
    return rows.join(owners.where(owner), key, "left_semi")


def append_missing(rows: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """Rows of which `present` has none: what a guarded insert would add."""
    return rows.join(present, on, "left_anti")


def survivors(parents: DataFrame, children: list[tuple[DataFrame, str]], doomed: Column, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """What a purge leaves: parents that aren't doomed, and children of parents that aren't."""
    gone = parents.where(doomed).select(F.col(key).alias("__gone"))
    return parents.where(~F.coalesce(doomed, F.lit(False))), [c.join(gone, c[k] == gone["__gone"], "left_anti") for c, k in children]


def keyset_page(rows: DataFrame, order: str, after, size: int = 50, tiebreak: str | None = None, before=None) -> DataFrame:
    """The next page by `order`; after: the last value, or (value, id) with a tiebreak. Without one, ties at a page's edge are skipped."""
    at = after if tiebreak is None else after[0]
    later = F.col(order) > F.lit(at)
    if tiebreak is not None:
        later = later | ((F.col(order) == F.lit(at)) & (F.col(tiebreak) > F.lit(after[1])))
    page = rows.where(later)
    if before is not None:
        page = page.where(F.col(order) < F.lit(before))
    return page.orderBy(order, *([tiebreak] if tiebreak else [])).limit(size)


def link(local: DataFrame, remote: DataFrame, first: tuple[str, str], second: tuple[str, str], remote_columns: list[str]) -> DataFrame:
    """local with its remote row: by the first pair of keys, else by the second; repeated second keys take the last by the first key.

    Null and empty keys link nothing.
    """
    by_id = remote.select(F.col(first[1]).alias("__k1"), F.struct(*remote_columns).alias("__r1"))
    named = remote.where(F.coalesce(F.col(second[1]).cast("string"), F.lit("")) != "")
    by_name = named.groupBy(F.col(second[1]).alias("__k2")).agg(F.max_by(F.struct(*remote_columns), F.col(first[1])).alias("__r2"))
    joined = local.join(by_id, local[first[0]] == F.col("__k1"), "left").join(by_name, local[second[0]] == F.col("__k2"), "left")
    return joined.withColumn("remote", F.coalesce("__r1", "__r2")).drop("__k1", "__k2", "__r1", "__r2")


def merged_history(linked: DataFrame, remote: DataFrame, remote_id: str) -> DataFrame:
    """linked rows (local id, remote id or null, time) and, after them, remote rows that none is linked to."""
    rest = remote.join(linked.where("remote_id IS NOT NULL").select(F.col("remote_id").alias(remote_id)), remote_id, "left_anti")
    return linked.unionByName(rest.select(F.lit(None).cast(linked.schema["local_id"].dataType).alias("local_id"), F.col(remote_id).alias("remote_id"), "sort_ts"))


def changed(local: DataFrame, remote: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Local rows that take over other values from their remote row; a remote null changes nothing."""
    other = remote.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = local.join(other, local[key] == other["__key"])
    new = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~new[c].eqNullSafe(F.col(c))
    return joined.where(differs).select(*[new[c].alias(c) if c in new else F.col(c) for c in local.columns])


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key (last write wins)."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def range_violations(rows: DataFrame, key: str, column: str, low: float, high: float) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).between(low, high)).select(F.col(key).cast("string").alias("key"), F.lit(f"{column}_range").alias("rule"))


def uniqueness_violations(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).cast("string").alias("key")).count().where("count > 1").select("key", F.lit(f"{column}_unique").alias("rule"))
