"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, jaccard, langid, lines, lm, packing, sharding, substring, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "text_hash")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(_table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_table(spark, sf_dir, "documents")).drop("text_hash", "first")


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"), F.md5("text").alias("text_md5"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).drop("payload", "url")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_langid, op3_substring, op4_ann, op5_ngram_jaccard, op6_katz, op7_packing, op8_line_dedup, op9_warc, op10_sharding)}

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
               FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS x(s) WHERE len(w) > 0),
        dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
               FROM d, (SELECT DISTINCT n FROM bw) AS k, unnest(range(1, len(w) - k.n + 2)) AS x(s)),
        hit AS (SELECT r, s, n, item_id FROM dw JOIN bw USING (n, t)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) AS x(p) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
                  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, 'null') AS i FROM hit) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op5_ngram_jaccard": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
        s AS (SELECT DISTINCT r, hash(array_to_string(w[p:p + least(len(w), 5) - 1], ' ')) AS g
              FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS x(p) WHERE len(w) > 0),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        link AS (SELECT x.r AS a, y.r AS b FROM s AS x JOIN s AS y USING (g) JOIN n AS nx ON nx.r = x.r JOIN n AS ny ON ny.r = y.r WHERE x.r <> y.r
                 GROUP BY x.r, y.r, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
        reach(r, o) AS (SELECT r, r FROM d UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.o = link.a)
        SELECT min(d.doc_id) AS doc_id, min(coalesce(n.n, 0))::BIGINT AS n_shingles, min(e.doc_id) AS component_id
        FROM reach JOIN d ON d.r = reach.r JOIN d AS e ON e.r = reach.o LEFT JOIN n ON n.r = reach.r GROUP BY reach.r""",
    "op8_line_dedup": """
        WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        t AS (SELECT min(r) AS r, l FROM d GROUP BY doc_id, l),
        x AS (SELECT r, i - 1 AS line, list_sort(list_distinct(regexp_extract_all(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS ws
              FROM t, unnest(range(1, len(l) + 1)) AS u(i)),
        f AS (SELECT r, line, ws, len(ws) AS n, row_number() OVER (PARTITION BY ws ORDER BY r, line) AS copy FROM x WHERE len(ws) > 0),
        u AS (SELECT r, line, n, ws, unnest(ws) AS w FROM f WHERE copy = 1),
        c AS (SELECT w, count(*) AS c FROM u GROUP BY w),
        p AS (SELECT r, line, n, ws, w, row_number() OVER (PARTITION BY r, line ORDER BY c, w) AS place FROM u JOIN c USING (w)),
        q AS (SELECT * FROM p WHERE place <= n - (80 * n + 99) // 100 + 1),
        m AS (SELECT DISTINCT b.r, b.line, b.ws, b.n, a.ws AS other, a.n AS other_n FROM q AS a JOIN q AS b USING (w)
              WHERE (a.r, a.line) < (b.r, b.line) AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        near AS (SELECT DISTINCT ws FROM m WHERE 100 * len(list_intersect(ws, other)) >= 80 * (n + other_n - len(list_intersect(ws, other)))),
        gone AS (SELECT r, line FROM f WHERE copy > 1 OR ws IN (SELECT ws FROM near)),
        g AS (SELECT r, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS ls, list(line) AS li FROM gone GROUP BY r)
        SELECT d.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(ls, '') AS removed_lines,
               md5(array_to_string(CASE WHEN n IS NULL THEN d.l ELSE [d.l[i] FOR i IN range(1, len(d.l) + 1) IF NOT list_contains(li, i - 1)] END, chr(10))) AS text_md5
        FROM d JOIN t ON t.l IS NOT DISTINCT FROM d.l AND t.r IN (SELECT min(e.r) FROM d AS e WHERE e.doc_id IS NOT DISTINCT FROM d.doc_id AND e.l IS NOT DISTINCT FROM d.l) LEFT JOIN g ON g.r = t.r""",
    "op9_warc": """
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)""",
}
