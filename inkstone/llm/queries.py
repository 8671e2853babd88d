"""Registered queries of the subpackage, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import table, widen


#: Rules of op13 (fixed values): host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text")).withColumn("n_tokens", F.col("n_tokens").cast("bigint"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.quality import quality

    return quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.bpe import digests

    return digests(widen(table(spark, sf_dir, "documents", "doc_id", "text")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.tiff import media_digests

    return media_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.lm import score

    return score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.merkle import FIELDS, manifest

    return manifest(table(spark, sf_dir, "documents", *FIELDS))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.url_rules import judge

    return judge(table(spark, sf_dir, "pages", "page_id", "url"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: Cosines of all pairs of vectors, and what links reach, in plain SQL; rows of one vector each.
OP8_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT vec_id AS root, vec_id AS node FROM v UNION SELECT reach.root, links.b FROM reach JOIN links ON links.a = reach.node),
    low AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN low ON node = vec_id LEFT JOIN n ON a = vec_id
"""




def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds over all parts of all vectors, one after the other in plain SQL."""
    steps = []
    for r in range(rounds + 1):
        near = f"SELECT p.i, p.pos, b.k, sum((p.v - b.v) * (p.v - b.v)) AS d FROM p JOIN b{r} b USING (pos, j) GROUP BY p.i, p.pos, b.k"
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, pos, arg_min(k, (d, k)) AS k, min(d) AS d FROM ({near}) GROUP BY i, pos)")
        if r < rounds:
            means = f"SELECT pos, k, j, sum(v)::BIGINT AS s, count(*) AS n FROM a{r} JOIN p USING (i, pos) GROUP BY pos, k, j"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.pos, b.k, b.j, coalesce((s - ((s % n) + n) % n) // n, b.v) AS v FROM b{r} b LEFT JOIN ({means}) m USING (pos, k, j))")
    return f"""
    WITH good AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, embedding AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    items AS (SELECT i, len(e) // {parts} AS size, unnest(e) AS x, unnest(range(len(e))) AS ix FROM good),
    p AS MATERIALIZED (SELECT i, ix // size AS pos, ix % size AS j, floor(4096 * x::DOUBLE)::BIGINT AS v FROM items),
    b0 AS MATERIALIZED (SELECT pos, i - 1 AS k, j, v FROM p WHERE i <= {entries}),
    {", ".join(steps)},
    digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY pos, k, j)) AS codebooks_sha256 FROM b{rounds}),
    coded AS (SELECT i, string_agg(printf('%02x', k), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY i)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM good JOIN coded USING (i), digest
"""


#: All levels of all trees by recursion, then each leaf's siblings level by level.
OP12_SQL = """
    WITH RECURSIVE enc AS (
      SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents),
    leaves AS MATERIALIZED (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lower FROM enc),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
    crcs AS MATERIALIZED (SELECT r, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) AS crc FROM placed),
    up AS (SELECT 0 AS level, tree, pos, n, leaf AS hash FROM placed
      UNION ALL SELECT level + 1, tree, pos // 16, any_value((n + 15) // 16), sha256(string_agg(hash, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, tree, pos // 16),
    nodes AS MATERIALIZED (SELECT * FROM up),
    subs AS MATERIALIZED (SELECT tree, level AS height, hash, count(*) OVER () AS n FROM nodes WHERE n = 1),
    top AS (SELECT 0 AS level, tree AS pos, n, hash FROM subs
      UNION ALL SELECT level + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(hash, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 16),
    tops AS MATERIALIZED (SELECT * FROM top),
    runs AS MATERIALIZED (
      SELECT tree, level, pos // 16 AS run, list(hash ORDER BY pos) AS hashes FROM nodes WHERE n > 1 GROUP BY ALL
      UNION ALL SELECT -1, level, pos // 16, list(hash ORDER BY pos) FROM tops WHERE n > 1 GROUP BY ALL),
    walk AS (
      SELECT r, 0 AS k, tree, 0 AS level, pos, '' AS seen, CASE WHEN crc % 5 = 0 THEN lower ELSE leaf END AS folded FROM placed JOIN crcs USING (r)
      UNION ALL SELECT r, k + 1, CASE WHEN hashes IS NULL THEN -1 ELSE w.tree END, CASE WHEN hashes IS NULL THEN 0 ELSE w.level + 1 END, CASE WHEN hashes IS NULL THEN w.tree ELSE pos // 16 END,
        seen || coalesce(array_to_string(list_concat(hashes[1 : pos % 16], hashes[pos % 16 + 2 :]), ''), ''),
        CASE WHEN hashes IS NULL THEN folded ELSE sha256(array_to_string(list_concat(list_append(hashes[1 : pos % 16], folded), hashes[pos % 16 + 2 :]), '')) END
      FROM walk w LEFT JOIN runs u ON u.tree = w.tree AND u.level = w.level AND u.run = pos // 16 WHERE w.tree >= 0 OR hashes IS NOT NULL),
    ends AS (SELECT r, arg_max(seen, k) AS seen, arg_max(folded, k) AS folded FROM walk GROUP BY r)
    SELECT doc_id, leaf, s.hash AS subroot, t.hash AS root, sha256(seen) AS proof_sha256, folded AS folded_root, folded = t.hash AS verified
    FROM placed JOIN ends USING (r) JOIN subs s USING (tree) JOIN tops t ON t.n = 1
"""
#: Every page met with every rule; the longest of those that fit.
OP13_SQL = """
    WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_embedding_dedup": OP8_SQL, "op11_vector_codes": vector_codes_sql(), "op12_merkle": OP12_SQL, "op13_url_rules": OP13_SQL}
