"""Rows that the archive writes, updates with conditions, and look-ups of local records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.functions.text import attachment_extension, attachment_path, clean, or_else


def scan_rows(results: DataFrame, confidence: Column) -> DataFrame:
    """Rows to append to scans, from results (id, public_id, source_path, overlay_path, device)."""
    return results.select("id", "public_id", F.col("source_path").alias("source_image_path"), F.col("overlay_path").alias("overlay_image_path"), F.lit(K.SCAN_STATUS).alias("status"), confidence.alias("avg_confidence"), F.col("device").alias("api_device"))


def text_rows(results: DataFrame) -> DataFrame:
    """Rows to append to the texts of scans; the payload's overlay, if there is one, becomes a mark that it is stored apart."""
    payload = F.col("payload")
    stored = F.when(F.coalesce(payload["overlayBase64"], F.lit("")) != "", F.lit(K.STORED_MARK))
    return results.select(F.col("id").alias("scan_id"), payload["text"].alias("raw_text"), "mode", "device", payload.withField("overlayBase64", stored).alias("raw_payload"))


def documentation_rows(inputs: DataFrame, fields: list[str]) -> DataFrame:
    """Rows to append to documentations: texts trimmed, a blank title becomes the default one, all wait for review."""
    title = or_else(clean(F.col("title")), F.lit(K.UNTITLED))
    return inputs.select("id", "scan_id", title.alias("title"), *[clean(F.col(f)).alias(f) for f in fields], "confidence", F.lit(K.DOCUMENTATION_STATUS).alias("status"))


def documentation_images(documentations: DataFrame, extras: DataFrame) -> DataFrame:
    """documentation_id, storage_path, is_primary, sort_order of the images to append.

    documentations: id, source_path (a missing one gives no primary row); extras: id, pos, content (binary), mime,
    filename. Extras are numbered from 1 in order of pos; empty ones take no number. Numbers are given within a
    documentation, whose attachments are few.
    """
    primary = documentations.where(F.coalesce(F.col("source_path"), F.lit("")) != "")
    primary = primary.select(F.col("id").alias("documentation_id"), F.col("source_path").alias("storage_path"), F.lit(True).alias("is_primary"), F.lit(0).alias("sort_order"))
    sent = extras.where(F.length("content") > 0).join(documentations.select("id"), "id", "left_semi")
    order = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    numbered = sent.select("id", order.alias("n"), attachment_extension(or_else(F.col("mime"), F.lit("image/jpeg")), F.col("filename")).alias("extension"))
    path = F.concat(F.lit("anonymous/"), attachment_path(F.col("id").cast("string"), F.col("n"), F.col("extension")))
    return primary.unionByName(numbered.select(F.col("id").alias("documentation_id"), path.alias("storage_path"), F.lit(False).alias("is_primary"), F.col("n").alias("sort_order")))


def newest_local(records: DataFrame, cap: int = K.LOCAL_CAP) -> DataFrame:
    """What a device stores: its newest records (id, created_at, result), at most `cap`, without overlays. Equal times go by id."""
    return records.orderBy(F.desc("created_at"), "id").limit(cap).withColumn("result", F.col("result").dropFields("overlayBase64"))


def by_server_id(local: DataFrame, wanted: DataFrame) -> DataFrame:
    """server_id, id: the newest local record (id, created_at, server_scan_id, result_scan_id) that has a wanted id in either place.

    Two equality joins instead of one with an "or"; each side is cut down to one row a key before it is joined.
    """
    newest = F.max_by("id", F.struct("created_at", "id"))
    either = local.select("id", "created_at", F.col("server_scan_id").alias("server_id")).unionByName(local.select("id", "created_at", F.col("result_scan_id").alias("server_id")))
    best = either.where(F.coalesce(F.col("server_id"), F.lit("")) != "").groupBy("server_id").agg(newest.alias("id"))
    return wanted.select("server_id").distinct().join(best, "server_id")


def policy(rows: DataFrame) -> DataFrame:
    """Active version policies as nested structs; a missing store address is the empty text."""
    platform = lambda p: F.struct(F.col(f"{p}_minimum_supported_version").alias("minimumSupportedVersion"), F.col(f"{p}_latest_version").alias("latestVersion"), clean(F.col(f"{p}_store_url")).alias("storeUrl")).alias(p)
    message = F.struct(F.col("update_message_ar").alias("ar"), F.col("update_message_en").alias("en")).alias("updateMessage")
    return rows.where("is_active").select(platform("ios"), platform("android"), message)


def own_path(bucket: Column, name: Column, user: Column, of: str) -> Column:
    """Whether a stored object belongs to a user: it lies in the bucket and in a folder of the user's name."""
    return F.coalesce((bucket == of) & name.contains("/") & (F.get(F.split(name, "/"), 0) == user), F.lit(False))


def touched(rows: DataFrame, where: Column, changes: dict[str, Column], now: Column) -> DataFrame:
    """rows with changes where the condition holds; every changed row has `now` as its updated_at, whatever was to be set."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in {**changes, "updated_at": now}.items()})


def set_minimums(policies: DataFrame, version: str) -> DataFrame:
    """The active policy with both minimums set; anything but exactly one active row is an error."""
    active = policies.where("is_active").agg(F.count("*").alias("n"), F.first(F.struct(*policies.columns)).alias("row"))
    wrong = F.raise_error(F.concat(F.lit("active policies: "), F.col("n").cast("string")))
    one = active.select(F.when(F.col("n") == 1, F.col("row")).otherwise(wrong).alias("row")).select("row.*")
    return one.withColumns({f"{p}_minimum_supported_version": F.lit(version) for p in ("ios", "android")})


def deletion_counts(deletions: DataFrame, error: str = "error") -> DataFrame:
    """found, deleted, failed of deletions; a failed one has an error."""
    return deletions.agg(F.count("*").alias("found"), F.count_if(F.col(error).isNull()).alias("deleted"), F.count_if(F.col(error).isNotNull()).alias("failed"))


def members(entries: DataFrame, key: Column, split: DataFrame, part: str) -> DataFrame:
    """Entries whose group key is in a part of a frozen split (name, part), whatever the case of letters."""
    wanted = split.where(F.col("part") == part).select(F.lower("name").alias("__name")).distinct()
    return entries.join(wanted, F.lower(key) == F.col("__name"), "left_semi")


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """Every row so many times."""
    return rows.withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__n")


def repeated_to_share(others: DataFrame, real: DataFrame, share: float) -> DataFrame:
    """others with real repeated until they make about `share` of all, once at least; only two counts are worked out before."""
    n = others.agg(F.count("*").alias("a")).crossJoin(real.agg(F.count("*").alias("b")))
    target = F.floor(F.col("a") * F.lit(share) / F.greatest(F.lit(1e-6), F.lit(1 - share)))
    times = F.broadcast(n.select(F.greatest(F.lit(1), F.rint(target / F.greatest("b", F.lit(1)))).cast("int").alias("__times")))  # one row
    more = real.crossJoin(times).withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__n")
    return others.unionByName(more)
