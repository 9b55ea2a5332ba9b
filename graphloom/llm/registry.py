"""Queries over the training-data operators, and SQL for those that have it."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import decontaminate, exact_dedup, kneser_ney, language_id, pieces, simhash, substring_dedup, token_binary, url_filter, warc
from graphloom.session import read_table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), short_items=True)


def op6_token_binary(spark, sf_dir):
    manifest, _ = token_binary.write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_binary.read_tokens(manifest)


def op7_kneser_ney(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return kneser_ney.score_documents(docs, kneser_ney.train(docs, order=3))


def op8_url_filter(spark, sf_dir):
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark, sf_dir):
    """Encodes every text, decodes the ids, and digests both."""
    model = tokenizer_path("piece_bpe_32k.model")
    rows = pieces.encode_documents(read_table(spark, sf_dir, "documents"), model, decoded="decoded")
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_warc(spark, sf_dir):
    pages = warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages")), payload=False)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_simhash, op3_language_id, op4_substring_dedup, op5_decontaminate, op6_token_binary, op7_kneser_ney, op8_url_filter, op9_sentencepiece, op10_warc)
} | {"pipeline": corpus_pipeline.run}

SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER w AS keep_id,
               CAST(count(*) OVER w AS BIGINT) AS group_size,
               doc_id = min(doc_id) OVER w AS kept,
               text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op4_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM documents
        ), n AS (
            SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50
        ), s AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM n
        ), f AS (
            SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_id FROM s
        ), g AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM f WHERE first_id < doc_id
        ), r AS (
            SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id
        ), k AS (
            SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
                   CASE WHEN gone IS NULL THEN w
                        ELSE [w[x] FOR x IN range(1, len(w) + 1) IF NOT list_contains(gone, x)] END AS kept
            FROM d LEFT JOIN r USING (doc_id)
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
               sha256(array_to_string(kept, ' ')) AS kept_sha256
        FROM k
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM f
    """,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
