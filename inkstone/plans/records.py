"""Queries of records that are written, updated and looked up, and of the clients' rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.functions import fusion
from inkstone.functions import policy as rules
from inkstone.operators import classify, records
from inkstone.plans.registry import query
from inkstone.sources.tables import read


def _text(c):
    return F.col(c).cast("string")


@query(f"""
    SELECT doc_id AS scan_id, n_chars AS raw_length, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '{K.STORED_MARK}' END AS overlay, CASE WHEN doc_id % 2 = 0 THEN 'paper' ELSE 'stone' END AS mode, 's' || doc_id AS source_image_path,
           '{K.SCAN_STATUS}' AS status, CAST(doc_id % 101 AS INT) AS avg_confidence FROM documents
""")
def insert_scans(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    overlay = F.when(F.col("doc_id") % 3 != 0, "bytes")
    results = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("p"), _text("doc_id")).alias("public_id"), F.concat(F.lit("s"), _text("doc_id")).alias("source_path"), F.lit(None).cast("string").alias("overlay_path"), F.lit("cpu").alias("device"), F.when(F.col("doc_id") % 2 == 0, "paper").otherwise("stone").alias("mode"), F.struct("text", overlay.alias("overlayBase64"), "n_chars").alias("payload"))
    scans = records.scan_rows(results, (F.col("id") % 101).cast("int")).select("id", "source_image_path", "status", "avg_confidence")
    texts = records.text_rows(results).select("scan_id", F.col("raw_payload.n_chars").alias("raw_length"), F.col("raw_payload.overlayBase64").alias("overlay"), "mode")
    return texts.join(scans, texts["scan_id"] == scans["id"]).drop("id")


@query(f"""
    SELECT c_custkey AS id, c_nationkey AS scan_id, CASE WHEN c_custkey % 4 = 0 THEN '{K.UNTITLED}' ELSE c_name END AS title, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS region, c_acctbal AS confidence, '{K.DOCUMENTATION_STATUS}' AS status FROM customer
""")
def insert_documentations(spark, sf_dir):
    key = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_name", "c_mktsegment", "c_acctbal")
    title = F.when(key % 8 == 0, " \t").when(key % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("  "), "c_name", F.lit("\n")))
    inputs = rows.select(key.alias("id"), F.col("c_nationkey").alias("scan_id"), title.alias("title"), F.when(key % 5 != 0, F.concat("c_mktsegment", F.lit(" "))).alias("region"), F.col("c_acctbal").alias("confidence"))
    return records.documentation_rows(inputs, ["region"])


@query("""
    WITH e AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CASE l_returnflag WHEN 'R' THEN 'pdf' ELSE 'jpg' END AS x FROM lineitem WHERE l_linestatus = 'O')
    SELECT o_orderkey AS documentation_id, 'src' || o_orderkey AS storage_path, true AS is_primary, 0 AS sort_order FROM orders WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT l_orderkey, 'anonymous/' || l_orderkey || '/extra-' || lpad(CAST(n AS VARCHAR), 2, '0') || '.' || x, false, CAST(n AS INT) FROM e WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
""")
def insert_images(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("src"), _text("o_orderkey"))).alias("source_path"))
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")
    extras = lines.select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.when(F.col("l_linestatus") == "O", F.lit("x")).otherwise("").cast("binary").alias("content"), F.when(F.col("l_returnflag") == "R", "application/pdf").alias("mime"), F.lit("no suffix!").alias("filename"))
    return records.documentation_images(orders, extras)


@query(f"SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT {K.LOCAL_CAP}")
def newest_local(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus")
    stored = records.newest_local(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.struct(F.col("o_orderstatus").alias("status"), F.lit("bytes").alias("overlayBase64")).alias("result")))
    return stored.select("id", "created_at", "result.*")


@query("""
    WITH l AS (SELECT o_orderkey AS id, o_orderdate AS t, 's' || o_custkey AS a, CASE WHEN o_orderkey % 2 = 0 THEN 's' || (o_custkey + 1) END AS b FROM orders), w AS (SELECT 's' || c_custkey AS server_id FROM customer WHERE c_custkey % 3 = 0)
    SELECT server_id, max_by(id, (t, id)) AS id FROM w JOIN l ON server_id = a OR server_id = b GROUP BY server_id
""")
def local_by_server_id(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    named = lambda c: F.concat(F.lit("s"), c.cast("string"))
    local = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), named(F.col("o_custkey")).alias("server_scan_id"), F.when(F.col("o_orderkey") % 2 == 0, named(F.col("o_custkey") + 1)).alias("result_scan_id"))
    wanted = read(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 3 = 0").select(named(F.col("c_custkey")).alias("server_id"))
    return records.by_server_id(local, wanted)


def _policies(spark, sf_dir):
    n = F.col("n_nationkey")
    version = lambda i: F.concat_ws(".", n.cast("string"), F.lit(str(i)))
    return read(spark, sf_dir, "nation", "n_nationkey", "n_name").select(
        (n == 3).alias("is_active"), *[version(i).alias(c) for i, c in enumerate(("ios_minimum_supported_version", "ios_latest_version", "android_minimum_supported_version", "android_latest_version"))],
        F.concat(F.lit(" "), "n_name").alias("ios_store_url"), F.lit(None).cast("string").alias("android_store_url"), F.col("n_name").alias("update_message_ar"), F.lower("n_name").alias("update_message_en"),
    )


@query("SELECT '3.0' AS ios_min, '3.1' AS ios_latest, n_name AS ios_url, '3.2' AS android_min, '' AS android_url, n_name AS ar, lower(n_name) AS en FROM nation WHERE n_nationkey = 3")
def version_policy(spark, sf_dir):
    return records.policy(_policies(spark, sf_dir)).select(F.col("ios.minimumSupportedVersion").alias("ios_min"), F.col("ios.latestVersion").alias("ios_latest"), F.col("ios.storeUrl").alias("ios_url"), F.col("android.minimumSupportedVersion").alias("android_min"), F.col("android.storeUrl").alias("android_url"), F.col("updateMessage.ar").alias("ar"), F.col("updateMessage.en").alias("en"))


@query("SELECT '9.0.0' AS ios, '9.0.0' AS android, '3.1' AS latest FROM nation WHERE n_nationkey = 3")
def minimum_versions(spark, sf_dir):
    return records.set_minimums(_policies(spark, sf_dir), "9.0.0").select(F.col("ios_minimum_supported_version").alias("ios"), F.col("android_minimum_supported_version").alias("android"), F.col("ios_latest_version").alias("latest"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag <> 'N' AND l_suppkey % 2 = 0 AS own FROM lineitem")
def own_paths(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    name = F.concat(F.when(F.col("l_suppkey") % 2 == 0, _text("l_orderkey")).otherwise("x"), F.lit("/"), _text("l_linenumber"), F.lit("/a.png"))
    bucket = F.when(F.col("l_returnflag") == "N", "documentation-images").otherwise("scan-images")
    return lines.select("l_orderkey", "l_linenumber", records.own_path(bucket, name, _text("l_orderkey"), "scan-images").alias("own"))


@query(f"""
    WITH p AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'a' || l_linenumber || '.PDF' WHEN 1 THEN 'b' || l_linenumber ELSE 'c' || l_linenumber || '.png' END AS name, CASE WHEN l_linenumber % 3 = 1 THEN 'application/msword' END AS mime FROM lineitem WHERE l_linenumber <> 5),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM p WHERE l_linenumber % 3 < 2)
    SELECT o.l_orderkey, 6 + least({K.ATTACHMENTS_CAP} - 6, count(k.n)) AS n, coalesce(string_agg(k.name, ',' ORDER BY k.n) FILTER (k.n <= {K.ATTACHMENTS_CAP} - 6), '') AS added
    FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN k USING (l_orderkey) GROUP BY o.l_orderkey
""")
def attachment_list(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    n = F.col("l_linenumber")
    name = F.when(n % 3 == 0, F.concat(F.lit("a"), n.cast("string"), F.lit(".PDF"))).when(n % 3 == 2, F.concat(F.lit("c"), n.cast("string"), F.lit(".png")))
    asset = F.struct(n.alias("pos"), F.when(n != 5, F.concat(F.lit("file:///x/b"), n.cast("string"))).alias("uri"), name.alias("name"), F.when(n % 3 == 1, "application/msword").alias("mime"))
    picked = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(asset)), lambda a: F.struct(a["uri"].alias("uri"), a["name"].alias("name"), a["mime"].alias("mime"))).alias("picked"))
    before = F.array_repeat(F.struct(F.lit("u").alias("uri"), F.lit("old").alias("name"), F.lit("text/plain").alias("mime")), 6)
    out = picked.select("l_orderkey", rules.allowed_attachments(before, F.col("picked")).alias("all"))
    return out.select("l_orderkey", F.size("all").cast("bigint").alias("n"), F.array_join(F.transform(F.slice("all", 7, 9), lambda a: a["name"]), ",").alias("added"))


@query("SELECT event_id, event_type <> 'view' AND event_type <> 'purchase' AND (user_id % 2 = 0 OR user_id % 3 = 0) AS may FROM events")
def may_document(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id")
    record = F.concat(F.when(kind == "view", "server-").otherwise("local-"), _text("event_id"))
    may = rules.can_document(record, F.when(kind == "purchase", "t").when(kind == "click", "  "), F.when(user % 2 == 0, "s"), F.when(user % 3 == 0, "r"))
    return read(spark, sf_dir, "events", "event_id", "user_id", "event_type").select("event_id", may.alias("may"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'documented' ELSE o_orderstatus END AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN TIMESTAMP '2000-01-01' ELSE CAST(o_orderdate AS TIMESTAMP) END AS updated_at FROM orders")
def touch_updated(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority").withColumns({"status": F.col("o_orderstatus"), "updated_at": F.col("o_orderdate").cast("timestamp_ntz")})
    out = records.touched(orders, F.col("o_orderpriority") == "1-URGENT", {"status": F.lit("documented"), "updated_at": F.lit(None).cast("timestamp_ntz")}, F.lit("2000-01-01").cast("timestamp_ntz"))
    return out.select("o_orderkey", "status", "updated_at")


@query("SELECT count(*) AS found, count(*) FILTER (event_type <> 'error') AS deleted, count(*) FILTER (event_type = 'error') AS failed FROM events")
def deletion_counts(spark, sf_dir):
    return records.deletion_counts(read(spark, sf_dir, "events", "event_type").select(F.when(F.col("event_type") == "error", "failed").alias("error")))


@query("SELECT doc_id FROM documents WHERE lower(source) IN (SELECT lower(source) FROM documents WHERE doc_id % 4 = 1)")
def split_members(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "source")
    split = docs.select(F.upper("source").alias("name"), F.when(F.col("doc_id") % 4 == 1, "val").otherwise("train").alias("part"))
    return records.members(docs, F.col("source"), split, "val").select("doc_id")


@query("""
    WITH n AS (SELECT count(*) FILTER (l_returnflag <> 'R') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem), t AS (SELECT greatest(1, CAST(round_even(floor(a * 0.6 / 0.4) / greatest(b, 1), 0) AS INT)) AS t FROM n)
    SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'R' THEN t ELSE 1 END) AS BIGINT) AS copies FROM lineitem, t GROUP BY l_orderkey, l_linenumber
""")
def repeated_union(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    both = records.repeated_to_share(lines.where("l_returnflag <> 'R'"), lines.where("l_returnflag = 'R'"), 0.6)
    return both.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"))


@query("""
    WITH s AS (SELECT p_partkey, 800.0::DOUBLE AS iw, 600.0::DOUBLE AS ih, 300.0::DOUBLE AS bw, (200 + p_size * 8)::DOUBLE AS bh, (p_partkey % 280)::DOUBLE AS x, (p_partkey % 190)::DOUBLE AS y, (20 + p_size)::DOUBLE AS w, (10 + p_size * 3)::DOUBLE AS h, p_size % 2 = 0 AS cover FROM part),
    k AS (SELECT *, CASE WHEN cover THEN greatest(bw / iw, bh / ih) ELSE least(bw / iw, bh / ih) END AS f FROM s),
    o AS (SELECT *, greatest(0, least((x - (bw - iw * f) / 2) / f, iw - 1)) AS ox, greatest(0, least((y - (bh - ih * f) / 2) / f, ih - 1)) AS oy FROM k)
    SELECT p_partkey, CAST(floor(ox + 0.5) AS INT) AS x, CAST(floor(oy + 0.5) AS INT) AS y, CAST(floor(greatest(1, least(w / f, iw - ox)) + 0.5) AS INT) AS width, CAST(floor(greatest(1, least(h / f, ih - oy)) + 0.5) AS INT) AS height FROM o
""")
def selection_crop(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    d = lambda c: c.cast("double")
    selection = F.struct(d(key % 280).alias("x"), d(key % 190).alias("y"), d(20 + size).alias("width"), d(10 + size * 3).alias("height"))
    crop = rules.selection_crop(selection, F.lit(800.0), F.lit(600.0), F.lit(300.0), d(200 + size * 8), size % 2 == 0)
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", crop.alias("c")).select("p_partkey", "c.*")


@query("""
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' ELSE 'image/jpeg' END AS mime, CASE page_id % 3 WHEN 0 THEN 'scan.png' WHEN 1 THEN 'scan.webp' ELSE 'scan.jpg' END AS name FROM pages
""")
def guessed_file(spark, sf_dir):
    uri = F.concat(F.lit("file:///DCIM/"), _text("page_id"), F.when(F.col("page_id") % 3 == 0, ".PNG?w=1").when(F.col("page_id") % 3 == 1, ".WebP").otherwise(".heic"))
    return read(spark, sf_dir, "pages", "page_id").select("page_id", rules.guessed_file(uri).alias("f")).select("page_id", "f.*")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS TIMESTAMP) < TIMESTAMP '1996-01-31' - INTERVAL 30 DAY")
def older_than_cutoff(spark, sf_dir):
    before = rules.cutoff(F.lit("1996-01-31").cast("timestamp_ntz"), F.lit(30))
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").where(F.col("o_orderdate").cast("timestamp_ntz") < before).select("o_orderkey")


@query("SELECT p_partkey, round(CASE WHEN h <= 0 OR h >= 72 THEN 1.0 WHEN h < 40 THEN least(2.5, 96 / h) WHEN h < 64 THEN least(3.0, 128 / h) ELSE least(3.0, 104 / h) END, 6) AS factor FROM (SELECT p_partkey, (p_partkey % 90)::DOUBLE AS h FROM part)")
def upscale_factor(spark, sf_dir):
    return read(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.round(rules.upscale_factor(F.col("p_partkey") % 90), 6).alias("factor"))


_MEMBERS = ", ".join(f"({i}, '{m}')" for i, g in enumerate(K.SHAPE_GROUPS) for m in g)


@query(f"""
    WITH g(k, label) AS (VALUES {_MEMBERS}), c AS (SELECT DISTINCT x.label AS a, y.label AS b FROM g x JOIN g y ON x.k = y.k AND x.label <> y.label),
    p AS (SELECT doc_id, coalesce(chr(CAST({K.FIRST_LETTER} + doc_id % 29 AS INT)), '') AS label FROM documents)
    SELECT doc_id, count(b) AS partners FROM p LEFT JOIN c ON label = a GROUP BY doc_id
""")
def predicted_lookalikes(spark, sf_dir):
    """How many labels could be meant where a letter was predicted."""
    letter = F.substring(F.lit("".join(K.LETTERS)), (F.col("doc_id") % 29 + 1).cast("int"), F.lit(1))
    predicted = read(spark, sf_dir, "documents", "doc_id").select("doc_id", letter.alias("a"))
    return predicted.join(F.broadcast(classify.confusable(classify.group_members(spark))), "a", "left").groupBy("doc_id").agg(F.count("b").alias("partners"))  # fixed values


@query("""
    WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 4 = 0 THEN 'NUM_5' ELSE 'x' END AS c, (l_partkey % 37) / 36.0::DOUBLE AS cc, (l_partkey % 23) / 40.0::DOUBLE AS cm,
        CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'y' WHEN l_suppkey % 3 = 1 THEN 'x' ELSE 'NUM_5' END AS p, (l_suppkey % 41) / 40.0::DOUBLE AS p1, (l_suppkey % 19) / 90.0::DOUBLE AS p2,
        CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 'x' WHEN (l_partkey + l_suppkey) % 3 = 1 THEN 'y' ELSE 'NUM_5' END AS s, ((l_partkey + 7 * l_suppkey) % 31) / 40.0::DOUBLE AS s1, (l_partkey * 3 % 17) / 60.0::DOUBLE AS s2 FROM lineitem),
    i AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE p1 END AS ps, CASE WHEN p IS NULL THEN 0 ELSE p2 END AS pm, CASE WHEN s IS NULL THEN 0 ELSE s1 END AS ss, CASE WHEN s IS NULL THEN 0 ELSE s2 END AS sm, c LIKE 'NUM%' AS cn, p LIKE 'NUM%' AS pn, s LIKE 'NUM%' AS sn FROM v),
    w AS (SELECT *, 0.45 * cc AS wc, 0.40 * ps * CASE WHEN NOT cn AND pn THEN 0.35 ELSE 1 END AS wp, 0.45 * ss * CASE WHEN NOT cn AND sn THEN 0.35 ELSE 1 END * CASE WHEN s2 < 0.05 THEN 0.25 ELSE 1 END AS ws FROM i),
    t AS (SELECT *, wc + CASE WHEN p = c THEN wp ELSE 0 END + CASE WHEN s = c THEN ws ELSE 0 END AS tc, CASE WHEN p IS NULL THEN -1 ELSE wp + CASE WHEN c = p THEN wc ELSE 0 END + CASE WHEN s = p THEN ws ELSE 0 END END AS tp, CASE WHEN s IS NULL THEN -1 ELSE ws + CASE WHEN c = s THEN wc ELSE 0 END + CASE WHEN p = s THEN wp ELSE 0 END END AS ts FROM w),
    f AS (SELECT *, CASE WHEN tc >= tp AND tc >= ts THEN c WHEN tp >= ts THEN p ELSE s END AS f, greatest(tc, tp, ts) AS ft FROM t),
    g AS (SELECT *, coalesce(cn = pn, true) AS kp, coalesce(cn = sn, true) AS ks, cn <> (f LIKE 'NUM%') AND cc >= 0.22 AND NOT coalesce(p = f AND s = f AND ps >= 0.78 AND ss >= 0.28 AND sm >= 0.08, false) AS kind FROM f),
    h AS (SELECT *, p IS NOT NULL AND kp AND ps >= 0.68 AND cc < 0.40 AND (pm >= 0.02 OR cc < 0.30) AS by_p, s IS NOT NULL AND ks AND cc < 0.40 AND sm >= 0.08 AND ss >= 0.22 AND (p IS NULL OR ps < 0.82 OR p = s) AND NOT (p IS NOT NULL AND coalesce(p <> s, true) AND ps >= 0.80 AND pm >= 0.08 AND kp) AS by_s FROM g),
    k AS (SELECT *, CASE WHEN by_s THEN s WHEN by_p THEN p WHEN kind THEN c ELSE f END AS l, CASE WHEN by_s THEN 0.55 * ss + 0.25 * ps + 0.15 WHEN by_p THEN 0.65 * ps + 0.15 WHEN kind THEN 0.45 * cc + 0.15 ELSE ft END AS lt FROM h),
    m AS (SELECT *, l = c AS ac, coalesce(l = p, false) AS ap, coalesce(l = s, false) AS a_s, cn = (l LIKE 'NUM%') AS same FROM k),
    r AS (SELECT *, CASE WHEN p IS NULL AND s IS NULL THEN 'cnn_only' WHEN ap AND ac AND ps >= 0.45 AND (cc >= 0.35 OR ps >= 0.70) THEN 'cnn_proto_agree' WHEN ap AND a_s AND same AND ps >= 0.55 AND (ss >= 0.40 OR (ss >= 0.30 AND sm >= 0.10)) THEN 'proto_shape_agree'
        WHEN a_s AND same AND sm >= 0.08 AND ss >= 0.22 AND cc < 0.40 THEN 'shape_override' WHEN ap AND same AND ps >= 0.65 AND (pm >= 0.015 OR cc < 0.40 OR a_s) THEN 'prototype_override' WHEN a_s AND ss >= 0.50 AND (ac OR sm >= 0.12) THEN CASE WHEN same OR ac THEN 'shape_structure' ELSE 'type_mismatch_reject' END
        WHEN NOT same AND ac AND cc >= 0.20 THEN 'prefer_cnn_letter_number' WHEN ac AND cc >= 0.45 AND cm >= 0.08 THEN 'cnn_confident' ELSE 'disagree_reject' END AS reason FROM m)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, reason, CASE reason WHEN 'cnn_only' THEN CASE WHEN cc >= 0.55 AND cm >= 0.02 THEN c END WHEN 'type_mismatch_reject' THEN NULL WHEN 'disagree_reject' THEN NULL WHEN 'cnn_confident' THEN c ELSE l END AS label,
        round(CAST(least(1, greatest(0, CASE reason WHEN 'cnn_only' THEN cc * (0.5 + 0.5 * least(cm / 0.2, 1)) WHEN 'cnn_proto_agree' THEN lt WHEN 'proto_shape_agree' THEN 0.50 * ps + 0.35 * ss + 0.10 WHEN 'shape_override' THEN 0.55 * greatest(ss, 0.25) + 0.25 * sm + 0.15
        WHEN 'prototype_override' THEN CASE WHEN a_s THEN least(0.95, 0.65 * ps + 0.15 * pm + 0.18) ELSE 0.65 * ps + 0.15 * pm + 0.10 END WHEN 'shape_structure' THEN 0.50 * ss + 0.25 * greatest(ps, cc) + 0.15 WHEN 'type_mismatch_reject' THEN lt * 0.4
        WHEN 'prefer_cnn_letter_number' THEN 0.55 * greatest(cc, 0.25) + 0.25 WHEN 'cnn_confident' THEN 0.55 * cc + 0.2 ELSE lt * 0.5 END)) AS DOUBLE) + 1e-9, 6) AS trust FROM r
""")
def fused_verdict(spark, sf_dir):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    vote = lambda label, score, margin: F.struct(label.alias("label"), score.alias("score"), margin.alias("margin"))
    of = lambda k, a, b: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise("NUM_5")
    cnn = vote(F.when(part % 4 == 0, "NUM_5").otherwise("x"), part % 37 / 36.0, part % 23 / 40.0)
    proto = vote(F.when(supp % 5 != 0, of(supp, "y", "x")), supp % 41 / 40.0, supp % 19 / 90.0)
    shape = vote(F.when(F.col("l_linenumber") % 4 != 0, of(part + supp, "x", "y")), (part + 7 * supp) % 31 / 40.0, part * 3 % 17 / 60.0)
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    found = lines.withColumn("v", fusion.verdict(cnn, proto, shape))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v.reason", "v.label", F.round(F.col("v.trust") + 1e-9, 6).alias("trust"))
