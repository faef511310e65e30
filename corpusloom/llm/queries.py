"""Queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extract, langid, minhash, mixing, packing, pii, simhash, tokens, vectors, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixing.taken_words(mixed).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_blocks")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op7_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_main_text": op3_main_text,
    "op4_simhash_near_duplicates": op4_simhash_near_duplicates,
    "op5_pack_sequences": op5_pack_sequences,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_vector_near_duplicates": op7_vector_near_duplicates,
    "op8_language_id": op8_language_id,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_personal_data": op10_personal_data,
}
#: Base32 of a SHA-1 given in hexadecimal as ``digits``: eight groups of five digits, four letters each.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(digits, {at}, 5))::BIGINT >> {by}) & 31 AS BIGINT) + 1, 1)" for at in range(1, 41, 5) for by in (15, 10, 5, 0)
)
SQL: dict[str, str] = {
    "op1_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, md5(coalesce(text, '')) AS tag, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
                CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents
        ), sized AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
        weighed AS (
            SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1] AS DOUBLE) AS weight FROM sized
        ), caps AS (
            SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS fills_at FROM weighed
        ), levels AS (
            SELECT *, row_number() OVER w AS rank,
                (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM caps WINDOW w AS (ORDER BY fills_at, skey)
        ), goals AS (
            SELECT skey, source_size,
                least(most, weight * (SELECT arg_min(level, rank) FROM levels WHERE level <= fills_at)) AS target
            FROM levels
        ), laid AS (
            SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS words,
                sum(size) OVER (PARTITION BY skey ORDER BY md5(concat_ws(':', 'mix', doc_id, tag)), doc_id NULLS LAST, size
                    ROWS UNBOUNDED PRECEDING) - size AS start
            FROM d JOIN goals USING (skey)
        ), parts AS (
            SELECT *, greatest(0, least(size, words - start)) AS once, greatest(0, least(size, words - start - source_size)) AS twice FROM laid
        ), due AS (
            SELECT skey, words, CAST(ceil(words / 512) AS BIGINT) AS turns, sum(words) OVER (ORDER BY skey) AS upto, sum(words) OVER () AS all_words
            FROM (SELECT skey, CAST(round(target) AS BIGINT) AS words FROM goals) WHERE words > 0
        ), points AS (
            SELECT slot, ((slot * 2654435769) & 4294967295) / 4294967296.0::DOUBLE AS point FROM (SELECT unnest(range(CAST((SELECT sum(turns) FROM due) AS BIGINT))) AS slot)
        ), hits AS (
            SELECT skey, turns, slot, row_number() OVER (PARTITION BY skey ORDER BY slot) - 1 AS turn
            FROM points JOIN due ON point >= (upto - words)::DOUBLE / all_words::DOUBLE AND point < upto::DOUBLE / all_words::DOUBLE
        ), owed AS (
            SELECT skey, unnest(range(coalesce(given, 0), turns)) AS turn FROM due LEFT JOIN (SELECT skey, count(*) AS given FROM hits GROUP BY skey) USING (skey)
        ), slots AS (
            SELECT skey, turn, slot FROM hits WHERE turn < turns
            UNION ALL SELECT skey, turn, (SELECT sum(turns) FROM due) + row_number() OVER (ORDER BY turn, skey) - 1 FROM owed
        )
        SELECT doc_id, size, source_size, target, CAST(once + twice AS BIGINT) AS taken, CAST(CASE WHEN once > 0 THEN slot END AS BIGINT) AS first_slot,
            CAST(CASE WHEN once > 0 THEN (start + once - 1) // 512 - start // 512 + 1 ELSE 0 END
                + CASE WHEN twice > 0 THEN (start + source_size + twice - 1) // 512 - (start + source_size) // 512 + 1 ELSE 0 END AS BIGINT) AS n_blocks
        FROM parts LEFT JOIN slots ON slots.skey = parts.skey AND slots.turn = CAST(parts.start AS BIGINT) // 512
    """,
    "op6_warc_round_trip": rf"""
        WITH d AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digits FROM pages),
        first AS (SELECT *, first_value(page_id) OVER w AS first_id, row_number() OVER w AS place FROM d WINDOW w AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST))
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN place > 1 THEN first_id END AS refers_to
        FROM first
    """,
}
