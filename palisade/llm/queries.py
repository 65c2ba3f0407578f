"""The registered queries of this subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import bpe, filter_audit, line_dedup, main_text, mixing, ngram_join, quality_cnn, quality_rules, source_divergence, suffix_dedup, token_files, topk_search, warc
from palisade.llm.common import shared_folder, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    token_files.write(docs, folder, added_tokens=True)
    return token_files.read_back(docs, folder)


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.classify(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.page_records(table(spark, sf_dir, "pages")), folder)
    return warc.archived_pages(spark, folder)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_files": op4_token_files,
    "op5_quality_cnn": op5_quality_cnn,
    "op6_main_text": op6_main_text,
    "op7_source_mixing": op7_source_mixing,
    "op8_topk_search": op8_topk_search,
    "op9_line_dedup": op9_line_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc": op12_warc,
    "op13_source_divergence": op13_source_divergence,
}

#: Whole numbers make scores and counts exact in SQL too; the other operators have no SQL form or are too slow in it.
ORACLES: dict[str, str] = {
    "op8_topk_search": """
        WITH sound AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS whole
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), scored AS (
            SELECT q.vec_id AS query_id, q.whole AS own, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.whole) + 1), lambda i: q.whole[i] * c.whole[i])) AS BIGINT) AS score
            FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.whole) = len(c.whole)
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_filter_audit": r"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
        firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
        counted AS (
            SELECT doc_id, part, text, first, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words
            FROM texts JOIN firsts USING (text)
        ), failed AS (
            SELECT doc_id, part,
                   CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
            FROM counted
        ), said AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
            FROM labels GROUP BY doc_id
        ), cells AS (
            SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
            FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, fails
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), steps AS (
            SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before
            FROM orders, range(1, 6) t(step)
        ), placed AS (
            SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS hit,
                   len(translate(fails, before, '')) = len(fails) AS reached
            FROM cells, steps
        ), summed AS (
            SELECT part, filter_order, step, own,
                   CAST(coalesce(sum(n) FILTER (WHERE reached AND NOT hit), 0) AS BIGINT) AS kept,
                   CAST(coalesce(sum(n) FILTER (WHERE reached AND hit), 0) AS BIGINT) AS removed,
                   CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT reached), 0) AS BIGINT) AS redundant,
                   CAST(coalesce(sum(n) FILTER (WHERE fails = own), 0) AS BIGINT) AS unique_fails,
                   CAST(coalesce(sum(good) FILTER (WHERE reached AND hit), 0) AS BIGINT) AS good_lost,
                   CAST(coalesce(sum(toxic) FILTER (WHERE reached AND hit), 0) AS BIGINT) AS toxic_lost
            FROM placed GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM summed
    """,
    "op12_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        placed AS MATERIALIZED (
            SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS last FROM payloads
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr(
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST(('0x' || substr(hex, 1 + 5 * (i // 4), 5)) AS INTEGER) // [32768, 1024, 32, 1][1 + i % 4] % 32, 1)), '') AS payload_digest,
               CASE WHEN page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
        FROM placed
    """,
    "op13_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), tokens AS MATERIALIZED (
            SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
        ), kept AS MATERIALIZED (
            SELECT lang, term, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS size, count(*) OVER (PARTITION BY lang) AS v
            FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= 3
        ), counts AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL),
        groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
        spelled AS (
            SELECT lang, source, term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY lang, source) AS size, v
            FROM groups JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)
        ), shares AS MATERIALIZED (
            SELECT lang, source, term, n, CAST(1 + 1000000000 * (n + 1) // (size + v) AS BIGINT) AS p FROM spelled
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), every_pair AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
        ), priced AS (
            SELECT s.lang, s.source, s.term, s.p, CAST(1 + 1000000000 * (k.n + 1) // (k.size + k.v) AS BIGINT) AS q
            FROM shares s JOIN kept k ON s.lang = k.lang AND s.term = k.term WHERE s.n > 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
            FROM (FROM every_pair UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM priced WHERE p > q)
        )
        SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
