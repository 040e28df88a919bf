"""The subpackage's queries: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, chat, classlm, decontam, htmlmain, kdtree, langid, packing, simhash, sufdedup
from .common import read_table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract_main(read_table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(read_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat.digest_windows(chat.format_conversations(table.unionByName(extra)))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufdedup.removed_spans(read_table(spark, sf_dir, "documents")).drop("spans")


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(read_table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_html_extraction, op3_best_fit_packing, op4_warc, op5_language_id, op6_decontamination, op7_chat_formatting, op8_suffix_array_dedup, op9_class_lm, op10_exact_top_k)}

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op10_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        wins AS (
            SELECT DISTINCT item_id, array_to_string(w[j : j + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS n
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS j FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM wins),
        spots AS (
            SELECT doc_id, n, j, array_to_string(w[j : j + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, sizes WHERE len(w) >= n)),
        found AS (SELECT s.doc_id, s.j, s.n, wins.item_id FROM spots s JOIN wins ON s.win = wins.win AND s.n = wins.n),
        hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM found) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
            FROM found GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
    """,
    # Windows are cut from chunks of 256 bytes, so that no long text is walked once a window.
    "op8_suffix_array_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        chunk AS (
            SELECT r, id, c, substr(h, 512 * c + 1, 610) AS part
            FROM (SELECT r, id, h, unnest(range(0, (length(h) // 2 - 50) // 256 + 1)) AS c FROM d WHERE length(h) >= 100)),
        win AS (
            SELECT r, id, 256 * c + i AS i, substr(part, 2 * i + 1, 100) AS s
            FROM (SELECT r, id, c, part, unnest(range(0, least(256, length(part) // 2 - 49))) AS i FROM chunk)),
        first AS (SELECT s, min(id) AS least_id FROM win GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT r, i FROM win JOIN first ON win.s = first.s AND least_id < id),
        marked AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS new FROM gone),
        numbered AS (SELECT r, i, count(*) FILTER (WHERE new) OVER (PARTITION BY r ORDER BY i) AS k FROM marked),
        span AS (SELECT r, k, min(i) AS a, max(i) + 50 AS z FROM numbered GROUP BY r, k),
        piece AS (SELECT r, k, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY k), 0) AS b FROM span),
        cut AS (
            SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY k) AS kept
            FROM piece JOIN d USING (r) GROUP BY r)
        SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
        FROM d LEFT JOIN cut USING (r)
    """,
    "op4_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        best AS (
            SELECT payload_digest, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
            CASE WHEN best.best <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN best.best <> p.page_id THEN best.best END AS refers_to
        FROM p LEFT JOIN best ON p.payload_digest = best.payload_digest AND p.payload_bytes >= 1000
    """,
}
