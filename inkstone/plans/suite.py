"""The query suite: every operator over whole driver tables, with the oracle SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import boxes, fusion, numeric, segments, signal, text
from inkstone.functions import constants as K
from inkstone.operators import archive, classify, evaluate, jobs, lattice, layout, matching, ranks, series
from inkstone.plans.registry import QUERIES, SQL, Query, query
from inkstone.plans.registry import rounded as _rounded
from inkstone.sources.tables import PLACE, read

# ---- archive ----------------------------------------------------------------------------------------------------------


@query("""
    SELECT CAST(d.doc_id AS VARCHAR) AS id, 'p' || d.doc_id AS public_id, CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'analyzed' END AS status,
           d.n_chars AS avg_confidence, d.doc_id AS created_at,
           coalesce(nullif(substr(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g'), 1, 80), ''), '—') AS preview,
           nullif(trim(b.text), '') AS documentation_title
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id
    ORDER BY d.doc_id DESC, id LIMIT 50
""")
def history_list(spark, sf_dir):
    docs, labels, bench = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), read(spark, sf_dir, "benchmark")
    scans = docs.join(labels, "doc_id", "left").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("p"), "doc_id").alias("public_id"), F.when(F.col("toxic") == 1, "failed").otherwise("analyzed").alias("status"), F.col("n_chars").alias("avg_confidence"), F.col("doc_id").alias("created_at"))
    # the newest scans are known before any text is read
    newest = scans.orderBy(F.desc("created_at"), "id").limit(K.LIST_DEFAULT)
    ocr = docs.select(F.col("doc_id").cast("string").alias("scan_id"), F.col("text").alias("raw_text"))
    titles = bench.select(F.col("item_id").cast("string").alias("scan_id"), F.col("text").alias("title"))
    return archive.history_list(newest, ocr, titles)


@query("""
    SELECT l.l_orderkey AS scan_id, l.l_linenumber AS line, coalesce(nullif(o.o_orderstatus, 'P'), 'unknown') AS device,
           CASE WHEN lower(trim(o.o_orderpriority)) = '1-urgent' THEN 'paper' ELSE 'stone' END AS mode, c.c_name AS title
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey
""")
def scan_detail(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("line"))
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").withColumnRenamed("o_orderkey", "scan_id")
    people = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    titled = orders.join(people, orders["o_custkey"] == people["c_custkey"], "left").select("scan_id", F.col("c_name").alias("title"))
    device = F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("unknown"))
    mode = F.when(F.lower(F.trim("o_orderpriority")) == "1-urgent", "paper").otherwise("stone")
    return archive.scan_detail(lines, orders.select("scan_id", device.alias("device"), mode.alias("mode")), titled).select("scan_id", "line", "device", "mode", "title")


@query("""
    SELECT c.c_custkey, count(DISTINCT o.o_orderkey) AS n_orders, count(l.l_orderkey) AS n_lines, coalesce(max(o.n), 0) AS most_lines
    FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) o ON o.o_custkey = c.c_custkey
    LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_custkey
""")
def nested_embed(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    orders = archive.nested(read(spark, sf_dir, "orders", "o_custkey", "o_orderkey").withColumn("l_orderkey", F.col("o_orderkey")), lines, "l_orderkey", ["l_linenumber", "l_quantity"], "images", ["l_linenumber"])
    people = archive.nested(read(spark, sf_dir, "customer", "c_custkey").withColumn("o_custkey", F.col("c_custkey")), orders.select("o_custkey", "o_orderkey", "images"), "o_custkey", ["o_orderkey", "images"], "documentations", ["o_orderkey"])
    sizes = F.transform("documentations", lambda d: F.size(d["images"]))
    return people.select("c_custkey", F.size("documentations").cast("bigint").alias("n_orders"), F.aggregate(sizes, F.lit(0), lambda a, v: a + v).cast("bigint").alias("n_lines"), F.coalesce(F.array_max(sizes), F.lit(0)).cast("bigint").alias("most_lines"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')")
def visible_semi(spark, sf_dir):
    owners = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderkey", "l_orderkey")
    return archive.visible(read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), owners, "l_orderkey", F.col("o_orderpriority") == "1-URGENT")


@query("SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 10 = 3)")
def guarded_seed(spark, sf_dir):
    present = read(spark, sf_dir, "supplier", "s_nationkey", "s_suppkey").where("s_suppkey % 10 = 3").select(F.col("s_nationkey").alias("n_nationkey"))
    return archive.append_missing(read(spark, sf_dir, "nation", "n_nationkey", "n_name"), present, "n_nationkey")


@query("""
    SELECT 'orders' AS name, count(*) AS rows_left FROM orders WHERE NOT coalesce(o_orderdate < TIMESTAMP '1995-01-01', false)
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderdate < TIMESTAMP '1995-01-01')
""")
def purge_survivors(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), read(spark, sf_dir, "lineitem", "l_orderkey")
    kept, (rest,) = archive.survivors(orders, [(lines, "l_orderkey")], F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"), "o_orderkey")
    count = lambda d, n: d.agg(F.lit(n).alias("name"), F.count("*").alias("rows_left"))
    return count(kept, "orders").unionByName(count(rest, "lineitem"))


_PAGE_START = "1995-06-01"


@query("SELECT o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01' ORDER BY o_orderdate LIMIT 50")
def keyset_page_strict(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return archive.keyset_page(orders, "o_orderdate", F.lit(_PAGE_START).cast("timestamp_ntz")).select("o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01' OR (o_orderdate = TIMESTAMP '1995-06-01' AND o_orderkey > 100) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def keyset_page_tiebreak(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return archive.keyset_page(orders, "o_orderdate", (F.lit(_PAGE_START).cast("timestamp_ntz"), 100), tiebreak="o_orderkey")


@query("""
    WITH named AS (SELECT c_mktsegment, max(c_custkey) AS c_custkey FROM customer GROUP BY c_mktsegment)
    SELECT e.event_id, coalesce(a.c_custkey, b.c_custkey) AS remote_id FROM events e LEFT JOIN customer a ON a.c_custkey = e.user_id
    LEFT JOIN named b ON b.c_mktsegment = upper(CASE e.event_type WHEN 'click' THEN 'building' WHEN 'view' THEN 'machinery' ELSE e.event_type END)
""")
def fallback_key_join(spark, sf_dir):
    segment = F.upper(F.when(F.col("event_type") == "click", "building").when(F.col("event_type") == "view", "machinery").otherwise(F.col("event_type")))
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type").withColumn("segment", segment)
    linked = archive.link(events, read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), ("user_id", "c_custkey"), ("segment", "c_mktsegment"), ["c_custkey"])
    return linked.select("event_id", F.col("remote.c_custkey").alias("remote_id"))


def _sides(spark, sf_dir):
    events = read(spark, sf_dir, "events", "event_id", "ts", "event_type", "user_id").select(F.col("event_id").alias("id"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("text"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_id").alias("pos"))
    return events.where("id % 2 = 0"), events.where("id % 2 = 1")


@query("""
    SELECT a.event_id AS local_id, b.event_id AS remote_id FROM events a JOIN events b ON a.event_type = b.event_type AND a.user_id = b.user_id
    WHERE a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND abs(epoch_us(a.ts) // 1000 - epoch_us(b.ts) // 1000) < 86400000
""")
def fuzzy_interval_candidates(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return matching.nearby_pairs(a, b, 86_400_000.0)


@query("""
    WITH RECURSIVE e AS (SELECT event_id AS id, event_type || ':' || user_id AS text, epoch_us(ts) // 1000 AS t FROM events),
    a AS (SELECT a.id, a.text, coalesce(list(b.id ORDER BY b.id) FILTER (b.id IS NOT NULL), CAST([] AS BIGINT[])) AS near FROM e a LEFT JOIN e b ON b.text = a.text AND b.id % 2 = 1 AND abs(a.t - b.t) < 86400000 WHERE a.id % 2 = 0 GROUP BY a.id, a.text),
    o AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS n FROM a),
    m AS (SELECT DISTINCT text, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS local_id, CAST(NULL AS BIGINT) AS remote_id FROM o
      UNION ALL SELECT text, n, CASE WHEN first IS NULL THEN used ELSE list_append(used, first) END, id, first FROM (SELECT m.text, o.n, used, o.id, list_filter(near, lambda k: NOT list_contains(used, k))[1] AS first FROM m JOIN o ON o.text = m.text AND o.n = m.n + 1) y)
    SELECT local_id, remote_id FROM m WHERE remote_id IS NOT NULL
""")
def fuzzy_interval_greedy(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return matching.link_nearby(a, b, 86_400_000.0)


@query("""
    WITH linked AS (SELECT e.event_id AS local_id, c.c_custkey AS remote_id, epoch_us(e.ts) // 1000 AS sort_ts FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id)
    SELECT local_id, remote_id, sort_ts FROM linked UNION ALL
    SELECT NULL, c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT remote_id FROM linked WHERE remote_id IS NOT NULL)
""")
def history_merge(spark, sf_dir):
    events, people = read(spark, sf_dir, "events", "event_id", "user_id", "ts"), read(spark, sf_dir, "customer", "c_custkey")
    linked = events.join(people, events["user_id"] == people["c_custkey"], "left").select(F.col("event_id").alias("local_id"), F.col("c_custkey").alias("remote_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("sort_ts"))
    return archive.merged_history(linked, people.withColumn("sort_ts", F.lit(0).cast("bigint")), "c_custkey")


@query("""
    SELECT s_suppkey, n_name AS s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name IS DISTINCT FROM s_name
""")
def state_merge(spark, sf_dir):
    local = read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    remote = read(spark, sf_dir, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_name"))
    return archive.changed(local, remote, "s_nationkey", ["s_name"]).select("s_suppkey", "s_name")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark, sf_dir):
    events = read(spark, sf_dir, "events", "user_id", "event_id", "ts")
    return archive.latest(events, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("""
    SELECT CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber AS key, 'l_quantity_range' AS rule FROM lineitem WHERE l_quantity NOT BETWEEN 0 AND 45
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'o_custkey_unique' FROM orders GROUP BY o_custkey HAVING count(*) > 1
""")
def dq_violations(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return archive.range_violations(lines, "id", "l_quantity", 0, 45).unionByName(archive.uniqueness_violations(read(spark, sf_dir, "orders", "o_custkey"), "o_custkey"))


# ---- scalar functions -------------------------------------------------------------------------------------------------


@query("""
    SELECT event_id, CASE WHEN lower(trim(event_type)) = 'view' THEN 'paper' ELSE 'stone' END AS mode,
           CASE event_type WHEN 'purchase' THEN 'documented' WHEN 'error' THEN 'local' ELSE 'analyzed' END AS status,
           CASE event_type WHEN 'purchase' THEN 'موثّق' WHEN 'error' THEN 'على الجهاز' ELSE 'المحفوظات' END AS label
    FROM events
""")
def status_rules(spark, sf_dir):
    kind = F.col("event_type")
    title, server = F.when(kind == "purchase", "t"), F.when(kind != "error", F.col("event_id").cast("string"))
    status = text.history_status(title, F.lit(None).cast("string"), server)
    mode = text.ocr_mode(F.when(F.lower(F.trim(kind)) == "view", " Paper ").otherwise(kind))
    return read(spark, sf_dir, "events", "event_id", "event_type").select("event_id", mode.alias("mode"), status.alias("status"), text.sync_label(status, server).alias("label"))


@query("SELECT doc_id, coalesce(nullif(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 80), ''), '—') AS preview FROM documents")
def preview_text(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)
    SELECT doc_id, CASE WHEN t = '' THEN 'نص محلَّل' WHEN length(t) <= 56 THEN t ELSE substr(t, 1, 56) || '…' END AS title FROM t
""")
def display_title(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.display_title(F.col("text")).alias("title"))


_LATIN = "hlxmqwjrbtskncvuf1e2gdo3zpyi4"


@query(f"SELECT doc_id, md5(translate(text, '{_LATIN}|', '{K.ARABIC_LETTERS} ')) AS arabic_md5 FROM documents")
def transliterate(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(text.to_arabic(F.col("text"), _LATIN)).alias("arabic_md5"))


@query("""
    WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g')) AS t FROM conversations)
    SELECT conv_id, string_agg(t, chr(10) ORDER BY turn, t) AS text FROM t WHERE t <> '' GROUP BY conv_id
""")
def collapse_spaces_lines(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    lines = turns.select("conv_id", "turn", text.collapse_blanks(F.coalesce("text", F.lit(""))).alias("text"))
    return layout.page_text(lines, "conv_id", "turn")


@query("""
    WITH v AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN '' ELSE (p_size % 3) || '.' || p_size || '.' || (p_partkey % 5) || CASE WHEN p_size % 2 = 0 THEN '-beta' ELSE '' END END AS v FROM part),
    n AS (SELECT p_partkey, v, [coalesce(TRY_CAST(split_part(split_part(v, '-', 1), '.', i) AS INT), 0) for i in [1, 2, 3]] AS n FROM v)
    SELECT p_partkey, CASE WHEN n < [1, 0, 0] THEN 'force-update' WHEN n < [1, 25, 3] THEN 'optional-update' ELSE 'supported' END AS status FROM n
""")
def semver_gate(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    version = F.when(size % 9 == 0, "").otherwise(F.concat((size % 3).cast("string"), F.lit("."), size.cast("string"), F.lit("."), (key % 5).cast("string"), F.when(size % 2 == 0, "-beta").otherwise("")))
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", text.version_status(version, F.lit("1.0.0"), F.lit("1.25.3")).alias("status"))


@query("""
    WITH e AS (SELECT page_id, lower(split_part(url, '.', -1)) AS own, lower(url) AS u FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(own, '^[a-z0-9]{1,8}$') THEN own WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'jpg' ELSE 'bin' END AS extension FROM e
""")
def attachment_ext(spark, sf_dir):
    mime = F.when(F.col("page_id") % 3 == 0, "application/PDF").when(F.col("page_id") % 3 == 1, "image/jpeg").otherwise("application/octet-stream")
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", text.attachment_extension(mime, F.col("url")).alias("extension"))


@query("""
    WITH f AS (SELECT p_partkey, p_name || CASE p_size % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.webp' ELSE '.jpeg' END AS f FROM part)
    SELECT p_partkey, CASE WHEN lower(f) LIKE '%.png' THEN 'image/png' WHEN lower(f) LIKE '%.webp' THEN 'image/webp' ELSE 'image/jpeg' END AS mime,
           CASE WHEN lower(f) LIKE '%.png' THEN 'png' WHEN lower(f) LIKE '%.webp' THEN 'webp' ELSE 'jpg' END AS extension FROM f
""")
def mime_type(spark, sf_dir):
    f = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, ".PNG").when(F.col("p_size") % 3 == 1, ".webp").otherwise(".jpeg"))
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select("p_partkey", text.mime_type(f).alias("mime"), text.image_extension(f).alias("extension"))


_ORG = ["BUILDING", "MACHINERY"]


@query("""
    WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE c_name || '@x' || c_nationkey || '.org' END AS email, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END AS kind, CASE WHEN c_acctbal > 0 THEN c_name END AS org FROM customer)
    SELECT c_custkey, CASE WHEN NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'email' WHEN trim(kind) = '' THEN 'user_type' WHEN kind IN ('BUILDING', 'MACHINERY') AND org IS NULL THEN 'organization' END AS problem FROM s
""")
def email_validation(spark, sf_dir):
    key = F.col("c_custkey")
    email = F.when(key % 7 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@x"), "c_nationkey", F.lit(".org")))
    kind = F.when(key % 5 == 0, " ").otherwise(F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.email_problem(email, kind, F.when(F.col("c_acctbal") > 0, F.col("c_name")), _ORG).alias("problem"))


@query("""
    SELECT doc_id, CASE WHEN octet_length(encode(text)) = 0 THEN 'empty' WHEN text IS NULL THEN 'missing' WHEN octet_length(encode(text)) > 12582912 THEN 'too_large' END AS problem,
           lower(regexp_replace(source, '\\.[^.]*$', '')) AS group_key, lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS slot FROM (SELECT doc_id, text, source || '.PNG' AS source FROM documents)
""")
def upload_checks(spark, sf_dir):
    image = F.concat(F.lit("/in/"), "source", F.lit(".PNG"))
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return docs.select("doc_id", text.upload_problem(F.col("text").cast("binary")).alias("problem"), text.group_key(image, F.lit("x")).alias("group_key"), F.substring(F.regexp_extract(text.attachment_path(F.lit("s"), F.col("doc_id") % 100, F.lit("png")), "extra-([0-9]+)", 1), 1, 2).alias("slot"))


@query("""
    SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 4 + 0.5) AS BIGINT) AS js, CAST(round_even(l_quantity / 4, 0) AS DOUBLE) AS even,
           l_quantity % 7 <= 3 AND l_discount >= 0.05 AS dropped FROM lineitem
""")
def rounding_rules(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    quarter = F.col("l_quantity") / 4
    return lines.select("l_orderkey", "l_linenumber", numeric.js_round(quarter).cast("bigint").alias("js"), numeric.half_even(quarter).alias("even"), ((F.col("l_quantity") % 7 <= 3) & (F.col("l_discount") >= 0.05)).alias("dropped"))


# ---- aggregates -------------------------------------------------------------------------------------------------------


@query("""
    SELECT l_orderkey, CAST(floor(avg(greatest(0, least(1, l_discount * 12))) FILTER (l_returnflag <> 'R') * 100 + 0.5) AS INT) AS confidence
    FROM lineitem GROUP BY l_orderkey
""")
def avg_confidence_grouped(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_discount", "l_returnflag", *PLACE)
    kept = F.when(F.col("l_returnflag") != "R", numeric.clamp(F.col("l_discount") * 12))
    # in the table's order, as the SQL adds with one thread
    means = ranks.means_in_order(lines, "l_orderkey", kept, ["file_path", "row_index"])
    return means.select("l_orderkey", numeric.js_round(F.col("mean") * 100).cast("int").alias("confidence"))


@query("""
    SELECT l_orderkey, coalesce(CAST(floor(list_sum(list(greatest(0, least(1, l_quantity / 37.3)) ORDER BY l_linenumber) FILTER (l_returnflag NOT IN ('R', 'A'))) / count(*) FILTER (l_returnflag NOT IN ('R', 'A')) * 100 + 0.5) AS INT), 0) AS confidence
    FROM lineitem GROUP BY l_orderkey
""")
def avg_confidence(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    glyph = F.struct("l_linenumber", F.when(F.col("l_returnflag") == "A", "?").otherwise("x").alias("character"), (F.col("l_quantity") / 37.3).alias("confidence"), (F.col("l_returnflag") == "R").alias("isSeparator"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(glyph)).alias("g")).select("l_orderkey", numeric.average_confidence(F.col("g")).alias("confidence"))


@query("""
    SELECT l_returnflag, round(list_sort(list(l_extendedprice))[CAST(count(*) // 2 AS INT) + 1], 6) AS upper_median, round(median(l_extendedprice), 6) AS true_median FROM lineitem GROUP BY l_returnflag
""")
def median_pair(spark, sf_dir):
    prices = read(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice")
    n = F.col("n")
    middle = ranks.at_ranks(prices, "l_returnflag", "l_extendedprice", {"upper": F.floor(n / 2), "lower": F.floor((n - 1) / 2)})
    return middle.select("l_returnflag", _rounded("upper").alias("upper_median"), _rounded((F.col("lower") + F.col("upper")) / 2).alias("true_median"))


@query("""
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.85), 6) AS p85, round(quantile_cont(l_extendedprice, 0.92), 6) AS p92, round(quantile_cont(l_extendedprice, 0.98), 6) AS p98
    FROM lineitem GROUP BY l_returnflag
""")
def percentile_exact(spark, sf_dir):
    prices = read(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice")
    names = {"p10": 0.1, "p85": 0.85, "p92": 0.92, "p98": 0.98}
    return ranks.percentiles(prices, "l_returnflag", "l_extendedprice", names).select("l_returnflag", *[_rounded(n).alias(n) for n in names])


@query("""
    WITH w AS (SELECT l_suppkey, l_quantity AS q FROM lineitem WHERE l_quantity BETWEEN 0.32 * 40 AND 1.05 * 40), m AS (SELECT l_suppkey, median(q) AS m FROM w GROUP BY l_suppkey)
    SELECT l_suppkey, round(median(q), 6) AS pitch FROM w JOIN m USING (l_suppkey) WHERE q <= 1.35 * m GROUP BY l_suppkey
""")
def robust_pitch(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity")
    return layout.robust_pitch(lines, "l_suppkey", "l_quantity", 40.0).withColumn("pitch", _rounded("pitch"))


@query("""
    WITH v AS (SELECT o_orderkey, o_orderstatus AS a, substr(o_orderpriority, 1, 1) AS p, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE substr(o_orderpriority, 1, 1) END AS s, (o_custkey % 100) / 100.0 AS x FROM orders),
    w AS (SELECT o_orderkey, a AS label, CAST(0.45 * x AS DOUBLE) AS w, 0 AS r FROM v UNION ALL SELECT o_orderkey, p, CAST(0.40 * (1 - x) AS DOUBLE), 1 FROM v UNION ALL SELECT o_orderkey, s, CAST(0.45 * 0.5 * CASE WHEN x < 0.05 THEN 0.25 ELSE 1 END AS DOUBLE), 2 FROM v),
    t AS (SELECT o_orderkey, label, sum(w) AS w, min(r) AS r FROM w GROUP BY ALL)
    SELECT o_orderkey, max_by(label, (round(w, 9), -r)) AS label, round(max(w), 6) AS trust FROM t GROUP BY o_orderkey
""")
def vote_fusion(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    x = (F.col("o_custkey") % 100) / 100.0
    first = F.substring("o_orderpriority", 1, 1)
    vote = lambda label, score, margin: F.struct(label.alias("label"), score.alias("score"), margin.alias("margin"))
    votes = fusion.vote_weights(vote(F.col("o_orderstatus"), x, F.lit(1.0)), vote(first, 1 - x, F.lit(1.0)), vote(F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).otherwise(first), F.lit(0.5), x))
    # weights to nine digits, so that equal sums tie whatever the order of adding
    best = fusion.fused(F.transform(votes, lambda v: F.struct(v["label"].alias("label"), F.round(v["weight"], 9).alias("weight"), v["rank"].alias("rank"))))
    return orders.select("o_orderkey", best.alias("b")).select("o_orderkey", "b.label", _rounded("b.trust").alias("trust"))


@query("""
    WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
    SELECT o_custkey, round(max(o_totalprice) FILTER (n = 1), 6) AS best, round(max(o_totalprice) FILTER (n = 1) - coalesce(max(o_totalprice) FILTER (n = 2), -1), 6) AS margin, count(*) AS k FROM r WHERE n <= 3 GROUP BY o_custkey
""")
def topk_margin(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice").withColumn("n", F.row_number().over(w)).where("n <= 3")
    nth = lambda i: F.max(F.when(F.col("n") == i, F.col("o_totalprice")))
    return top.groupBy("o_custkey").agg(_rounded(nth(1)).alias("best"), _rounded(nth(1) - F.coalesce(nth(2), F.lit(-1.0))).alias("margin"), F.count("*").alias("k"))


@query("""
    WITH v AS (SELECT o_orderkey, o_custkey % 3 = 0 AS na, o_orderkey % 2 = 0 AS nb, (o_custkey % 100) / 100.0::DOUBLE AS a, (o_orderkey % 90) / 90.0::DOUBLE AS b FROM orders)
    SELECT o_orderkey, CASE WHEN na <> nb AND NOT na AND a >= 0.08 THEN 'original' WHEN na <> nb AND na AND b >= 0.20 AND b >= a - 0.05 THEN 'other' WHEN na <> nb AND b < a + 0.55 THEN 'original' WHEN a >= b THEN 'original' ELSE 'other' END AS view FROM v
""")
def view_selection(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    view = lambda numeral, confidence, name: F.struct(F.when(numeral, "NUM_5").otherwise("x").alias("label"), confidence.alias("confidence"), F.lit(name).alias("view"))
    a = view(F.col("o_custkey") % 3 == 0, (F.col("o_custkey") % 100) / 100.0, "original")
    b = view(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 90) / 90.0, "other")
    return orders.select("o_orderkey", segments.best_view(a, b)["view"].alias("view"))


# ---- layout and signals -----------------------------------------------------------------------------------------------


@query("""
    WITH o AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
    w AS (SELECT user_id, island, string_agg(upper(substr(event_type, 1, 1)), '' ORDER BY pos) AS text, count(*) AS letters FROM o WHERE event_type <> 'error' GROUP BY ALL)
    SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY island) AS INT) AS word, text, letters FROM w
""")
def word_islands(spark, sf_dir):
    events = read(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type")
    return layout.words(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.upper(F.substring("event_type", 1, 1)))


@query("""
    WITH o AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
    w AS (SELECT user_id, island, string_agg(upper(substr(event_type, 1, 1)), '' ORDER BY pos) AS text FROM o WHERE event_type <> 'error' GROUP BY ALL)
    SELECT user_id, string_agg(text, '|' ORDER BY island) AS text FROM w GROUP BY user_id
""")
def line_texts(spark, sf_dir):
    return layout.line_text(word_islands(spark, sf_dir), "user_id")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS reading FROM lineitem")
def reading_order(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return layout.reading_order(lines, "l_orderkey", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("reading").cast("bigint").alias("reading"))


_BOXES = """
    b AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 900 AS INT) AS x0, CAST(floor(l_partkey % 900 + 3 + l_quantity) AS INT) AS x1 FROM lineitem),
    g AS (SELECT *, x0 - lead(x1) OVER (PARTITION BY l_orderkey ORDER BY (x0 + x1) / 2 DESC, l_linenumber * 10000 + x0) AS gap FROM b),
    t AS (SELECT l_orderkey, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gs FROM g GROUP BY l_orderkey),
    lim AS (SELECT l_orderkey, CASE WHEN gs IS NULL OR len(gs) < 1 THEN 14.0 WHEN gs[-1] <= 18 THEN greatest(14.0, 3.2 * gs[CAST(len(gs) // 2 AS INT) + 1]) ELSE greatest(18.0, 2.05 * gs[CAST(len(gs) // 2 AS INT) + 1]) END AS threshold FROM t)
"""


def _boxes(spark, sf_dir):
    x0 = (F.col("l_partkey") % 900).cast("int")
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").select("l_orderkey", "l_linenumber", x0.alias("x0"), (x0 + 3 + F.col("l_quantity")).cast("int").alias("x1"), (F.col("l_linenumber") * 10_000 + x0).alias("pos"))


@query(f"WITH {_BOXES} SELECT l_orderkey, round(CAST(threshold AS DOUBLE), 6) AS threshold FROM lim")
def gap_threshold(spark, sf_dir):
    spaced = layout.gaps(_boxes(spark, sf_dir), "l_orderkey", "x0", "x1", "pos")
    return spaced.groupBy("l_orderkey").agg(_rounded(layout.gap_threshold(F.collect_list("gap"))).alias("threshold"))


@query(f"""
    WITH {_BOXES} SELECT l_orderkey, x0, x1, false AS is_separator FROM b UNION ALL
    SELECT l_orderkey, CAST(trunc(x0 - gap / 2) AS INT) - 1, CAST(trunc(x0 - gap / 2) AS INT) + 1, true FROM g JOIN lim USING (l_orderkey) WHERE gap >= threshold
""")
def gap_separators(spark, sf_dir):
    return layout.with_separators(_boxes(spark, sf_dir), "l_orderkey", "x0", "x1", "pos")


@query(f"""
    WITH {_BOXES} SELECT l_orderkey, l_linenumber, x1 - x0 <= 12 AND (x1 - x0) / 40.0 <= 0.42 AND coalesce(x0 - lag(x1) OVER w, 999) >= 14 AND coalesce(lead(x0) OVER w - x1, 999) >= 14 AS is_bar
    FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY x0, l_linenumber * 10000 + x0)
""")
def word_bars(spark, sf_dir):
    return layout.bars(_boxes(spark, sf_dir).withColumn("h", F.lit(40)), "l_orderkey", "x0", "x1", "h", "pos").select("l_orderkey", "l_linenumber", "is_bar")


@query(f"""
    WITH {_BOXES}, n AS (SELECT *, coalesce((lag(x1) OVER w + x0) / 2, 0) AS l, coalesce((lead(x0) OVER w + x1) / 2, 1000) AS r FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY (x0 + x1) / 2, l_linenumber * 10000 + x0))
    SELECT l_orderkey, l_linenumber, CAST(trunc(greatest(0, least(x0, greatest(x0 - 6, l)))) AS INT) AS crop_lo, CAST(trunc(least(1000, greatest(x1, least(x1 + 6, r)))) AS INT) AS crop_hi FROM n
""")
def crop_clamp(spark, sf_dir):
    return layout.clamped_crops(_boxes(spark, sf_dir), "l_orderkey", "x0", "x1", F.lit(6), F.lit(1000), "pos").select("l_orderkey", "l_linenumber", "crop_lo", "crop_hi")


@query("""
    WITH o AS (SELECT user_id, value >= 50 AS inside, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
    k AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM o WHERE inside), r AS (SELECT user_id, min(n) AS first, max(n) AS last, count(*) AS length FROM k GROUP BY user_id, g HAVING count(*) >= 2)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS run, first, last, length FROM r
""")
def run_bands(spark, sf_dir):
    events = read(spark, sf_dir, "events", "user_id", "event_id", "ts", "value")
    found = layout.runs(events, "user_id", ["ts", "event_id"], F.col("value") >= 50, 2)
    return found.select("user_id", *[F.col(c).cast("bigint").alias(c) for c in ("run", "first", "last", "length")])


_SERIES = "o AS (SELECT user_id, least(1.0, value / 100) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"""
    WITH {_SERIES}, l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i))
    SELECT user_id, CAST(i AS INT) AS i, round(v, 6) AS v FROM l WHERE v >= a AND v > b AND v >= 0.35
""")
def local_maxima(spark, sf_dir):
    events = read(spark, sf_dir, "events", "user_id", "event_id", "ts", "value").withColumn("v", F.least(F.lit(1.0), F.col("value") / 100))
    return layout.maxima(events, "user_id", ["ts", "event_id"], "v", 0.35).select("user_id", "i", _rounded("v").alias("v"))


@query(f"""
    WITH {_SERIES}, l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i)), p AS (SELECT user_id, i, v FROM l WHERE v >= a AND v > b AND v >= 0.35),
    e AS (SELECT p.user_id, p.i, p.v, coalesce(max(o.i) FILTER (o.i < p.i AND o.v > p.v), -1) AS lo, coalesce(min(o.i) FILTER (o.i > p.i AND o.v > p.v), 1000000000) AS hi FROM p JOIN o ON o.user_id = p.user_id GROUP BY ALL)
    SELECT e.user_id, CAST(e.i AS INT) AS i, round(e.v - greatest(min(o.v) FILTER (o.i <= e.i), min(o.v) FILTER (o.i >= e.i)), 6) AS prominence
    FROM e JOIN o ON o.user_id = e.user_id AND o.i > e.lo AND o.i < e.hi GROUP BY e.user_id, e.i, e.v
""")
def prominence(spark, sf_dir):
    events = read(spark, sf_dir, "events", "user_id", "event_id", "ts", "value").withColumn("v", F.least(F.lit(1.0), F.col("value") / 100))
    rows = series.positions(events, "user_id", F.date_trunc("hour", "ts"), ["ts", "event_id"]).select(F.col("user_id").alias("key"), "i", "v")
    found = series.prominences(rows, series.local_maxima(rows, 0.35))
    return found.select(F.col("key").alias("user_id"), F.col("i").cast("int").alias("i"), _rounded("prominence").alias("prominence"))


def _line_signals(spark, sf_dir):
    """Signals of lines: blocks of a hundred events in order of time, scaled to 0..1."""
    events = read(spark, sf_dir, "events", "event_id", "ts", "value").withColumn("line", F.expr("event_id DIV 100"))
    return events.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: F.least(F.lit(1.0), x["value"] / 100)).alias("v"))


_LINES = "o AS (SELECT event_id // 100 AS line, least(1.0, value / 100) AS v, row_number() OVER (PARTITION BY event_id // 100 ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_id // 100) AS n FROM events)"


#: Peaks from the strongest down, each dropped if a kept one is nearer than 3.
_SUPPRESSED = """
    c AS (SELECT line, i, v, row_number() OVER (PARTITION BY line ORDER BY v DESC, i) AS n FROM l WHERE v >= a AND v > b AND v >= 0.35),
    m AS (SELECT DISTINCT line, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept FROM o
      UNION ALL SELECT m.line, c.n, CASE WHEN len(list_filter(kept, lambda k: abs(k - c.i) < 3)) = 0 THEN list_append(kept, c.i) ELSE kept END FROM m JOIN c ON c.line = m.line AND c.n = m.n + 1),
    k AS (SELECT line, list_sort(max_by(kept, n)) AS cuts FROM m GROUP BY line)
"""


@query(f"""
    WITH RECURSIVE {_LINES}, l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM o WINDOW w AS (PARTITION BY line ORDER BY i)),{_SUPPRESSED}
    , e AS (SELECT k.line, cuts, list_concat([0], cuts, [n]) AS e FROM k JOIN (SELECT line, max(n) AS n FROM o GROUP BY line) z USING (line))
    SELECT line, coalesce(list_aggregate(cuts, 'string_agg', ','), '') AS cuts, CAST(len(list_filter(range(1, len(e)), lambda j: e[j + 1] - e[j] >= 2)) AS INT) AS n_intervals FROM e
""")
def nms_peaks(spark, sf_dir):
    found = _line_signals(spark, sf_dir).withColumn("cuts", signal.peaks(F.col("v")))
    return found.select("line", F.array_join(F.col("cuts").cast("array<string>"), ",").alias("cuts"), F.size(signal.intervals(F.col("cuts"), F.size("v"))).alias("n_intervals"))


@query(f"""
    WITH RECURSIVE {_LINES.replace("o AS", "raw AS")}, d AS (SELECT line, i, n, v, unnest(range(-8, 9)) AS d FROM raw), t AS (SELECT line, i, n, v, d, greatest(1, 2 * (n - 1)) AS s FROM d),
    x AS (SELECT line, i, n, v, d, ((i + d) % s + s) % s AS k, s FROM t), y AS (SELECT x.line, x.i, x.n, x.v, list_sum(list(exp(-0.5 * (x.d / 2.0) ** 2) * r.v ORDER BY x.d)) / list_sum(list(exp(-0.5 * (x.d / 2.0) ** 2) ORDER BY x.d)) AS sm FROM x JOIN raw r ON r.line = x.line AND r.i = CASE WHEN x.k < x.n THEN x.k ELSE x.s - x.k END GROUP BY x.line, x.i, x.n, x.v),
    o AS (SELECT line, i, n, sm AS v, v AS own FROM y), l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM o WINDOW w AS (PARTITION BY line ORDER BY i)),{_SUPPRESSED},
    e AS (SELECT k.line, list_concat([0], cuts, [n]) AS e, vs FROM k JOIN (SELECT line, max(n) AS n, list(own ORDER BY i) AS vs FROM o GROUP BY line) z USING (line)),
    q AS (SELECT line, e, vs, unnest(range(1, len(e))) AS j FROM e), b AS (SELECT line, e[j] AS lo, e[j + 1] AS hi, vs[e[j] + 1 : e[j + 1]] AS part FROM q WHERE e[j + 1] - e[j] >= 2)
    SELECT line, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, round(list_max(part), 6) AS confidence, round(list_sum(part) / (hi - lo), 9) AS mean FROM b WHERE list_sum(part) / (hi - lo) >= 0.12
""")
def boundary_boxes(spark, sf_dir):
    """Smoothed peaks, intervals between them, and the objectness gate."""
    found = _line_signals(spark, sf_dir).withColumn("b", F.explode(signal.let(signal.peaks(F.col("v"), sigma=2.0), lambda cuts: signal.boxes(cuts, F.col("v")))))
    return found.select("line", "b.lo", "b.hi", _rounded("b.confidence").alias("confidence"), _rounded("b.mean", 9).alias("mean"))


@query(f"""
    WITH RECURSIVE {_LINES}, l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM o WINDOW w AS (PARTITION BY line ORDER BY i)), c AS (SELECT line, i, row_number() OVER (PARTITION BY line ORDER BY i) AS n FROM l WHERE v >= a AND v > b AND v >= 0.32),
    z AS (SELECT line, list(v ORDER BY i) AS vs FROM o GROUP BY line),
    m AS (SELECT line, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept FROM z
      UNION ALL SELECT line, n, CASE WHEN last IS NULL THEN [i] WHEN i - last < 5 AND low / (least(vs[last + 1], vs[i + 1]) + 1e-6) > 0.65 AND low > 0.45 THEN CASE WHEN vs[i + 1] > vs[last + 1] THEN list_append(kept[1 : len(kept) - 1], i) ELSE kept END ELSE list_append(kept, i) END
      FROM (SELECT m.line, c.n, kept, c.i, kept[-1] AS last, z.vs, list_min(z.vs[kept[-1] + 1 : c.i + 1]) AS low FROM m JOIN c ON c.line = m.line AND c.n = m.n + 1 JOIN z ON z.line = m.line) y),
    f AS (SELECT m.line, max_by(kept, n) AS k, any_value(vs) AS vs FROM m JOIN z USING (line) GROUP BY m.line)
    SELECT line, coalesce(list_aggregate(k, 'string_agg', ','), '') AS peaks, coalesce(list_aggregate(list_transform(range(1, len(k)), lambda j: k[j] + list_position(vs[k[j] + 1 : k[j + 1] + 1], list_min(vs[k[j] + 1 : k[j + 1] + 1])) - 1), 'string_agg', ','), '') AS cuts FROM f
""")
def line_bands(spark, sf_dir):
    """Maxima folded by pitch, and cuts in the valleys between them."""
    found = _line_signals(spark, sf_dir).withColumn("p", signal.collapse_close_peaks(F.col("v"), signal.local_maxima(F.col("v"), 0.32), F.lit(6)))
    return found.select("line", F.array_join(F.col("p").cast("array<string>"), ",").alias("peaks"), F.array_join(signal.valley_cuts(F.col("v"), F.col("p")).cast("array<string>"), ",").alias("cuts"))


@query(f"""
    WITH RECURSIVE {_LINES}, l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM o WINDOW w AS (PARTITION BY line ORDER BY i)),{_SUPPRESSED},
    e AS (SELECT k.line, list_concat([0], cuts, [n]) AS e, vs FROM k JOIN (SELECT line, max(n) AS n, list(v ORDER BY i) AS vs FROM o GROUP BY line) z USING (line)),
    s AS (SELECT line, e, vs, unnest(range(0, len(e) - 1)) AS i FROM e), t AS (SELECT line, e, vs, i, unnest(range(i + 1, least(i + 4, len(e)))) AS j FROM s),
    r AS (SELECT line, i, j, e[i + 1] AS lo, e[j + 1] AS hi, greatest(round(list_sum(vs[e[i + 1] + 1 : e[j + 1]]) / (e[j + 1] - e[i + 1]), 9), 0) - 0.55 AS reward FROM t),
    d AS (SELECT line, 0::BIGINT AS j, [0.0]::DOUBLE[] AS best, CAST([-1] AS BIGINT[]) AS back FROM e
      UNION ALL SELECT line, j, list_append(best, top.total), list_append(back, top.i) FROM (SELECT d.line, r.j, any_value(d.best) AS best, any_value(d.back) AS back, list_sort(list(struct_pack(minus := -(d.best[r.i + 1] + r.reward), i := r.i, total := d.best[r.i + 1] + r.reward)))[1] AS top FROM d JOIN r ON r.line = d.line AND r.j = d.j + 1 GROUP BY d.line, r.j) y),
    f AS (SELECT line, max_by(back, j) AS back FROM d GROUP BY line),
    w AS (SELECT line, back, len(back)::BIGINT - 1 AS j FROM f UNION ALL SELECT line, back, back[j + 1] FROM w WHERE back[j + 1] > 0)
    SELECT r.line, CAST(r.i AS INT) AS i, CAST(r.j AS INT) AS j, CAST(r.lo AS INT) AS lo, CAST(r.hi AS INT) AS hi, round(r.reward, 6) AS reward FROM w JOIN r ON r.line = w.line AND r.j = w.j AND r.i = w.back[w.j + 1]
""")
def span_lattice(spark, sf_dir):
    """Best segmentation of each user's series: spans of up to three intervals, by their mean."""
    lines = _line_signals(spark, sf_dir).withColumn("edges", F.concat(F.array(F.lit(0)), signal.peaks(F.col("v")), F.array(F.size("v"))))
    spans = lattice.arcs(lines.select("line", "edges"), "line", "edges").join(lines.select("line", "v"), "line")
    scored = spans.withColumn("reward", lattice.reward(F.round(numeric.array_mean(signal.span(F.col("v"), F.col("lo"), F.col("hi"))), 9)))
    return lattice.best_path(scored, "line").withColumn("reward", _rounded("reward"))


@query("""
    WITH RECURSIVE b AS (SELECT l_orderkey, l_linenumber AS pos, (l_partkey % 60)::DOUBLE AS cy, l_quantity::DOUBLE AS h FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY cy, pos) AS n FROM b), t AS (SELECT l_orderkey, greatest(8.0, 0.55 * list_sort(list(h))[CAST(count(*) // 2 AS INT) + 1]) AS near FROM b GROUP BY l_orderkey),
    m AS (SELECT l_orderkey, CAST(0 AS BIGINT) AS n, near, CAST([] AS STRUCT(total DOUBLE, ids INT[])[]) AS acc FROM t
      UNION ALL SELECT l_orderkey, n, near, CASE WHEN hit IS NULL THEN list_append(acc, struct_pack(total := cy, ids := [pos])) ELSE list_transform(acc, lambda a, i: CASE WHEN i = hit THEN struct_pack(total := a.total + cy, ids := list_append(a.ids, pos)) ELSE a END) END
      FROM (SELECT m.l_orderkey, o.n, near, acc, o.cy, CAST(o.pos AS INT) AS pos, list_position(list_transform(acc, lambda a: abs(o.cy - a.total / len(a.ids)) <= near), true) AS hit FROM m JOIN o ON o.l_orderkey = m.l_orderkey AND o.n = m.n + 1) s),
    f AS (SELECT l_orderkey, max_by(acc, n) AS acc FROM m GROUP BY l_orderkey), u AS (SELECT l_orderkey, unnest(acc) AS a FROM f)
    SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY a.total / len(a.ids), a.ids) - 1 AS INT) AS line, round(a.total / len(a.ids), 6) AS mean, list_aggregate(a.ids, 'string_agg', ',') AS members FROM u
""")
def line_clusters(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    box = F.struct(F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 60).alias("cy"), F.col("l_quantity").alias("h"))
    lines = rows.groupBy("l_orderkey").agg(layout.cluster_lines(F.collect_list(box)).alias("lines")).select("l_orderkey", F.posexplode("lines").alias("line", "x"))
    return lines.select("l_orderkey", "line", _rounded("x.mean").alias("mean"), F.array_join(F.col("x.members").cast("array<string>"), ",").alias("members"))


@query("""
    WITH s AS (SELECT o_custkey, list_sort(list(CAST(o_orderkey % 50 AS INT))) AS a, list_sort(list(CAST(o_totalprice AS INT) % 50)) AS b FROM orders GROUP BY o_custkey)
    SELECT o_custkey, len(list_distinct(list_concat(a, b))) AS n_union, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS n_except, len(list_distinct(a)) AS n_distinct, list_aggregate(list_distinct(list_concat(a, b)), 'sum') AS sum_union FROM s
""")
def cut_sets(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    s = orders.groupBy("o_custkey").agg(F.collect_list((F.col("o_orderkey") % 50).cast("int")).alias("a"), F.collect_list(F.rint("o_totalprice").cast("int") % 50).alias("b"))
    both = signal.union_cuts(F.col("a"), F.col("b"))
    return s.select("o_custkey", F.size(both).cast("bigint").alias("n_union"), F.size(F.array_except("a", "b")).cast("bigint").alias("n_except"), F.size(F.array_distinct("a")).cast("bigint").alias("n_distinct"), F.aggregate(both, F.lit(0).cast("bigint"), lambda t, v: t + v).alias("sum_union"))


@query("""
    WITH b AS (SELECT p_partkey, 200 + p_size * 10 AS w, 150 + p_size AS h, p_partkey % 60 AS x0, p_size AS y0, 200 + p_size * 10 - p_partkey % 90 AS x1, 150 + p_size - p_partkey % 40 AS y1 FROM part),
    m AS (SELECT *, (x1 - x0) * (y1 - y0) / CAST(w * h AS DOUBLE) AS ratio, y0 / h AS t, (h - y1) / h AS bo, x0 / w AS l, (w - x1) / w AS r FROM b)
    SELECT p_partkey, round(ratio, 6) AS ratio, CASE WHEN ratio >= 0.92 AND t + bo < 0.06 AND l + r < 0.06 THEN 'inscription_fills_frame' WHEN greatest(t, bo, l, r) < 0.035 THEN 'margins_too_small_to_help' WHEN ratio < 0.025 THEN 'no_clear_inscription_cluster'
      WHEN ((t + bo >= 0.10 OR l + r >= 0.10) AND (h >= 100 OR t + bo >= 0.18 OR l + r >= 0.18)) OR ((bo >= 0.08 OR t >= 0.08) AND (h >= 120 OR bo >= 0.20 OR t >= 0.20)) OR (t + bo >= 0.06 AND (y1 - y0) / h <= 0.88 AND (h >= 120 OR t + bo >= 0.22)) OR (l + r >= 0.06 AND ratio <= 0.82 AND (h >= 120 OR l + r >= 0.10)) THEN 'margin_trim' ELSE 'margins_too_small_to_help' END AS reason FROM m
""")
def region_rules(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    w, h = 200 + size * 10, 150 + size
    rule = boxes.region_rule(w, h, key % 60, size, w - key % 90, h - key % 40)
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", rule.alias("r")).select("p_partkey", _rounded("r.ratio").alias("ratio"), "r.reason")


# ---- vectors ----------------------------------------------------------------------------------------------------------


def _bank(vectors: DataFrame) -> DataFrame:
    """Mean vector of each label."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda t: t["m"]).alias("v"))


@query("""
    WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
    m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i), b AS (SELECT label, list(x ORDER BY i) AS p FROM m GROUP BY label),
    s AS (SELECT vec_id, b.label, list_dot_product(v, p) / ((sqrt(list_dot_product(v, v)) + 1e-6) * (sqrt(list_dot_product(p, p)) + 1e-6)) AS s FROM e, b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS n FROM s)
    SELECT vec_id, max(label) FILTER (n = 1) AS label, round(max(s) FILTER (n = 1), 6) AS similarity, round(max(s) FILTER (n = 1) - coalesce(max(s) FILTER (n = 2), -1), 6) AS margin FROM r GROUP BY vec_id
""")
def prototype_match(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    found = classify.prototype_match(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), _bank(vectors))
    return found.select(F.col("id").alias("vec_id"), "label", _rounded("similarity").alias("similarity"), _rounded("margin").alias("margin"))


@query("""
    WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
    st AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY i), z AS (SELECT vec_id, list((x - m) / s ORDER BY i) AS z FROM u JOIN st USING (i) GROUP BY vec_id),
    c AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i), b AS (SELECT label, list((x - m) / s ORDER BY i) AS p FROM c JOIN st USING (i) GROUP BY label),
    d AS (SELECT vec_id, b.label, list_distance(z, p) AS d FROM z, b), r AS (SELECT *, 1 / (1 + d) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS n FROM d)
    SELECT vec_id, max(label) FILTER (n = 1) AS label, round(max(s) FILTER (n = 1), 6) AS similarity, round(max(s) FILTER (n = 1) - coalesce(max(s) FILTER (n = 2), 0), 6) AS margin FROM r GROUP BY vec_id
""")
def shape_match(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    parts = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    stats = parts.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("t")).select(F.transform("t", lambda t: t["m"]).alias("mean"), F.transform("t", lambda t: t["s"]).alias("std"))
    found = classify.shape_match(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), _bank(vectors), stats)
    return found.select(F.col("id").alias("vec_id"), "label", _rounded("similarity").alias("similarity"), _rounded("margin").alias("margin"))


_GROUPS = ", ".join(f"({i}, '{m}')" for i, g in enumerate(K.SHAPE_GROUPS) for m in g)
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in K.HARD_PAIRS)


@query(f"""
    WITH g(k, label) AS (VALUES {_GROUPS}), h(a, b) AS (VALUES {_PAIRS}), e AS (SELECT a, b FROM h UNION SELECT b, a FROM h), c AS (SELECT DISTINCT x.label AS a, y.label AS b FROM g x JOIN g y ON x.k = y.k AND x.label <> y.label),
    n AS (SELECT coalesce(chr(CAST({K.FIRST_LETTER} + doc_id % 29 AS INT)), '') AS label, count(*) AS n FROM documents GROUP BY 1)
    SELECT c.a, c.b, e.a IS NOT NULL AS hard, x.n AS documents, coalesce(y.n, 0) AS others FROM c JOIN n x ON x.label = c.a LEFT JOIN n y ON y.label = c.b LEFT JOIN e ON c.a = e.a AND c.b = e.b
""")
def lookalike_pairs(spark, sf_dir):
    """Labels that could be mistaken for those predicted, whether they are hard to tell apart, and how often either was predicted."""
    letter = F.substring(F.lit("".join(K.LETTERS)), (F.col("doc_id") % 29 + 1).cast("int"), F.lit(1))
    predicted = read(spark, sf_dir, "documents", "doc_id").groupBy(letter.alias("a")).agg(F.count("*").alias("documents"))
    others = predicted.select(F.col("a").alias("b"), F.col("documents").alias("others"))
    hard = classify.hard_partners(spark).withColumn("hard", F.lit(True))
    pairs = classify.confusable(classify.group_members(spark)).join(hard, ["a", "b"], "left").withColumn("hard", F.coalesce("hard", F.lit(False)))
    return pairs.join(predicted, "a").join(others, "b", "left").select("a", "b", "hard", "documents", F.coalesce("others", F.lit(0)).alias("others"))


# ---- evaluation -------------------------------------------------------------------------------------------------------


def _truth(spark, sf_dir):
    at = F.datediff("l_shipdate", F.lit("1992-01-01"))
    # ids of lines repeat in some tables; with the part they don't
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity").select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), at.alias("lo"), (at + 5 + F.col("l_quantity").cast("int")).alias("hi"))
    return lines.where("id % 2 = 1"), lines.where("id % 2 = 0")


@query("""
    WITH i AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS id, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS lo, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + 5 + CAST(trunc(l_quantity) AS INT) AS hi FROM lineitem),
    p AS (SELECT g.l_orderkey, g.id AS g, q.id AS p, (least(g.hi, q.hi) - greatest(g.lo, q.lo)) AS x, (g.hi - g.lo) + (q.hi - q.lo) AS s FROM i g JOIN i q ON g.l_orderkey = q.l_orderkey AND g.id % 2 = 1 AND q.id % 2 = 0 AND g.lo < q.hi AND q.lo < g.hi)
    SELECT l_orderkey, g, p, round(x / greatest(s - x, 1), 6) AS iou FROM p WHERE x / greatest(s - x, 1) >= 0.5
""")
def interval_iou_pairs(spark, sf_dir):
    return matching.overlap_pairs(*_truth(spark, sf_dir), "l_orderkey").select("l_orderkey", "g", "p", _rounded("iou").alias("iou"))


@query("""
    WITH RECURSIVE i AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS id, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS lo, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + 5 + CAST(trunc(l_quantity) AS INT) AS hi FROM lineitem),
    x AS (SELECT g.l_orderkey, g.id AS g, q.id AS p, (least(g.hi, q.hi) - greatest(g.lo, q.lo)) AS x, (g.hi - g.lo) + (q.hi - q.lo) AS s FROM i g JOIN i q ON g.l_orderkey = q.l_orderkey AND g.id % 2 = 1 AND q.id % 2 = 0 AND g.lo < q.hi AND q.lo < g.hi),
    p AS (SELECT l_orderkey, g, p, x / greatest(s - x, 1) AS iou, row_number() OVER (PARTITION BY l_orderkey ORDER BY x / greatest(s - x, 1) DESC, g DESC, p DESC) AS n FROM x WHERE x / greatest(s - x, 1) >= 0.5),
    m AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS ps, false AS taken FROM p
      UNION ALL SELECT l_orderkey, n2, CASE WHEN f THEN list_append(gs, g2) ELSE gs END, CASE WHEN f THEN list_append(ps, p2) ELSE ps END, f FROM (SELECT m.*, p.n AS n2, p.g AS g2, p.p AS p2, NOT list_contains(gs, p.g) AND NOT list_contains(ps, p.p) AS f FROM m JOIN p ON p.l_orderkey = m.l_orderkey AND p.n = m.n + 1) y)
    SELECT p.l_orderkey, p.g, p.p, round(p.iou, 6) AS iou FROM m JOIN p USING (l_orderkey, n) WHERE m.taken
""")
def interval_match_greedy(spark, sf_dir):
    return matching.match_greedy(matching.overlap_pairs(*_truth(spark, sf_dir), "l_orderkey"), "l_orderkey").withColumn("iou", _rounded("iou"))


@query("""
    WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber % 2 AS odd, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS x FROM lineitem),
    g AS (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS n FROM i WHERE odd = 1), c AS (SELECT l_orderkey, list(DISTINCT x) AS cuts FROM i WHERE odd = 0 GROUP BY l_orderkey),
    m AS (SELECT l_orderkey, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS x, CAST(NULL AS BIGINT) AS cut FROM c
      UNION ALL SELECT l_orderkey, n, CASE WHEN best.d <= 20 THEN list_append(used, best.cut) ELSE used END, x, CASE WHEN best.d <= 20 THEN best.cut END
      FROM (SELECT m.l_orderkey, g.n, used, g.x, list_sort(list_transform(list_filter(c.cuts, lambda k: NOT list_contains(used, k)), lambda k: struct_pack(d := abs(k - g.x), cut := k)))[1] AS best FROM m JOIN g ON g.l_orderkey = m.l_orderkey AND g.n = m.n + 1 JOIN c ON c.l_orderkey = m.l_orderkey) y)
    SELECT l_orderkey, CAST(x AS INT) AS at, CAST(cut AS INT) AS cut FROM m WHERE cut IS NOT NULL
""")
def boundary_hits(spark, sf_dir):
    g, p = _truth(spark, sf_dir)
    return matching.boundary_hits(g.select("l_orderkey", F.col("lo").alias("at")), p.select("l_orderkey", F.col("lo").alias("at")), "l_orderkey", 20)


@query("""
    WITH RECURSIVE b AS (SELECT l_orderkey, CAST(l_partkey % 40 AS INT) AS x0, CAST(l_suppkey % 30 AS INT) AS y0, CAST(l_partkey % 40 + 20 + CAST(trunc(l_quantity) AS INT) % 30 AS INT) AS x1, CAST(l_suppkey % 30 + 30 AS INT) AS y1 FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (x1 - x0) * (y1 - y0) DESC, x0, y0, x1, y1) AS n FROM b),
    m AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(x0 INT, y0 INT, x1 INT, y1 INT)[]) AS kept FROM b
      UNION ALL SELECT l_orderkey, n, CASE WHEN hit IS NULL THEN list_append(kept, box) ELSE list_transform(kept, lambda k, i: CASE WHEN i <> hit THEN k WHEN kind[hit] = 1 THEN struct_pack(x0 := least(k.x0, box.x0), y0 := least(k.y0, box.y0), x1 := greatest(k.x1, box.x1), y1 := greatest(k.y1, box.y1)) ELSE box END) END
      FROM (SELECT *, list_position(list_transform(kind, lambda z: z > 0), true) AS hit FROM (SELECT m.l_orderkey, o.n, kept, struct_pack(x0 := o.x0, y0 := o.y0, x1 := o.x1, y1 := o.y1) AS box, list_transform(kept, lambda k: CASE
        WHEN k.x0 <= o.x0 AND k.y0 <= o.y0 AND k.x1 >= o.x1 AND k.y1 >= o.y1 THEN 1
        WHEN greatest(0, least(o.x1, k.x1) - greatest(o.x0, k.x0)) * greatest(0, least(o.y1, k.y1) - greatest(o.y0, k.y0)) / CAST(greatest((o.x1 - o.x0) * (o.y1 - o.y0) + (k.x1 - k.x0) * (k.y1 - k.y0) - greatest(0, least(o.x1, k.x1) - greatest(o.x0, k.x0)) * greatest(0, least(o.y1, k.y1) - greatest(o.y0, k.y0)), 1) AS DOUBLE) >= 0.15 THEN 1
        WHEN o.x0 <= k.x0 AND o.y0 <= k.y0 AND o.x1 >= k.x1 AND o.y1 >= k.y1 THEN 2 ELSE 0 END) AS kind FROM m JOIN o ON o.l_orderkey = m.l_orderkey AND o.n = m.n + 1) s) t),
    f AS (SELECT l_orderkey, max_by(kept, n) AS kept FROM m GROUP BY l_orderkey)
    SELECT l_orderkey, k.x0, k.y0, k.x1, k.y1 FROM (SELECT l_orderkey, unnest(kept) AS k FROM f) u
""")
def box_merge(spark, sf_dir):
    at = lambda c, n: (F.col(c) % n).cast("int")
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return matching.merge_boxes(lines.select("l_orderkey", at("l_partkey", 40).alias("x0"), at("l_suppkey", 30).alias("y0"), (at("l_partkey", 40) + 20 + at("l_quantity", 30)).alias("x1"), (at("l_suppkey", 30) + 30).alias("y1")), "l_orderkey")


@query("""
    WITH s AS (SELECT CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS part, 1 AS gt, 1 + toxic AS pred, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS hit FROM labels)
    SELECT coalesce(part, 'all') AS part, count(*) AS lines, sum(gt) AS gt_letters, sum(pred) AS pred_boxes, sum(hit) AS boxes_matched, round(sum(hit) / greatest(sum(gt), 1), 4) AS recall, round(sum(hit) / greatest(sum(pred), 1), 4) AS precision
    FROM s GROUP BY GROUPING SETS ((part), ())
""")
def eval_summary(spark, sf_dir):
    slot = F.col("doc_id") % 20
    scores = read(spark, sf_dir, "labels").select(F.when(slot < 14, "train").when(slot < 17, "val").otherwise("test").alias("part"), F.lit(1).cast("bigint").alias("gt_letters"), (1 + F.col("toxic")).cast("bigint").alias("pred_boxes"), F.when(F.col("quality") == 1, 1).otherwise(0).cast("bigint").alias("boxes_matched"))
    return evaluate.totals(scores, "part")


@query("""
    WITH g AS (SELECT DISTINCT source || ':' || doc_id % 50 AS k FROM documents), h AS (SELECT k, CAST('0x' || substr(md5('7:' || k), 1, 8) AS BIGINT) / 4294967296.0 AS x FROM g)
    SELECT k, CASE WHEN x < 0.70 THEN 'train' WHEN x < 0.85 THEN 'val' ELSE 'test' END AS part FROM h
""")
def frozen_split(spark, sf_dir):
    groups = read(spark, sf_dir, "documents", "doc_id", "source").select(F.concat("source", F.lit(":"), (F.col("doc_id") % 50).cast("string")).alias("k"))
    return evaluate.frozen_split(groups, "k")


@query("""
    WITH m AS (SELECT doc_id, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS kind FROM labels), c AS (SELECT count(*) FILTER (kind = 0) AS pos, count(*) FILTER (kind = 1) AS hard FROM m),
    e AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5('7:' || doc_id), doc_id) AS n FROM m)
    SELECT doc_id, CAST(kind AS INT) AS kind FROM e, c WHERE kind < 2 OR n <= greatest(0, greatest(pos, 2 * pos) - hard)
""")
def balance_cap(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").withColumn("kind", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2))
    return evaluate.balance_cap(rows, "doc_id", F.col("kind") == 0, F.col("kind") == 1).select("doc_id", "kind")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 500")
def reservoir(spark, sf_dir):
    return evaluate.reservoir(read(spark, sf_dir, "documents", "doc_id"), "doc_id", 500)


# ---- jobs -------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS state, max(ts) AS updated_at FROM events GROUP BY user_id")
def job_latest_state(spark, sf_dir):
    return jobs.latest_state(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


@query("""
    WITH j AS (SELECT user_id, min(ts) AS created, max(ts) AS updated FROM events GROUP BY user_id), n AS (SELECT max(updated) - INTERVAL 20 HOUR AS cut FROM j)
    SELECT user_id FROM j, n WHERE updated >= cut ORDER BY created DESC, user_id DESC LIMIT 100
""")
def job_prune(spark, sf_dir):
    records = read(spark, sf_dir, "events", "user_id", "ts").groupBy("user_id").agg(F.min("ts").alias("created"), F.max("ts").alias("updated"))
    now = F.broadcast(records.agg(F.max("updated").alias("now")))
    return jobs.pruned(records.crossJoin(now), F.col("now"), "created", "updated", "user_id", minutes=20 * 60).select("user_id")


@query("""
    WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS t, CAST(floor(value * 1e9) AS BIGINT) AS service FROM events),
    b AS (SELECT *, sum(service) OVER w - service AS before FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    c AS (SELECT *, max(t - before) OVER w + before AS begun FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT user_id, event_id, CAST(begun AS BIGINT) AS start, CAST(begun + service AS BIGINT) AS end FROM c
""")
def fifo_queue(spark, sf_dir):
    arrivals = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "value").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.floor(F.col("value") * 1e9).alias("service"))
    return jobs.fifo(arrivals, "user_id", "at", "service", "event_id").select("user_id", "event_id", "start", "end")


#: Events as those of jobs: what their types stand for, and ten jobs to a user.
_KINDS = {"signup": "queued", "view": "running", "purchase": "succeeded", "error": "failed", "click": "finalized"}


@query(f"""
    WITH e AS (SELECT user_id * 10 + event_id % 10 AS job, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS kind, round(value, 2) AS result, ts AS moment, event_id AS seq FROM events),
    k AS (SELECT job, bool_or(kind = 'running') AS runs, max(moment) AS updated_at FROM e GROUP BY job HAVING bool_or(kind <> 'finalized')),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY moment, seq) AS n FROM e WHERE kind IN ('succeeded', 'failed')) WHERE n = 1),
    b AS (SELECT e.job, arg_min(e.result, (e.moment, e.seq)) AS better FROM e JOIN d ON d.job = e.job WHERE e.kind = 'finalized' AND d.kind = 'succeeded' AND (e.moment, e.seq) > (d.moment, d.seq) GROUP BY e.job)
    SELECT job, coalesce(d.kind, CASE WHEN runs THEN 'running' ELSE 'queued' END) AS status, CASE WHEN d.kind = 'succeeded' THEN coalesce(better, d.result) END AS result, updated_at FROM k LEFT JOIN d USING (job) LEFT JOIN b USING (job)
""")
def job_results(spark, sf_dir):
    """Where each job ends, and its result, replaced once by the first better one."""
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("event_type")]
    events = read(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value", "ts").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("job"), kind.alias("kind"), F.round("value", 2).alias("result"), "ts", "event_id")
    return jobs.results(events, "job", "kind", "result", "ts", "event_id")


def queries() -> dict[str, Query]:
    from inkstone.plans import boundaries, pages, profiles, records, rules  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
