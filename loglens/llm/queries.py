"""The queries op1_ to op10_: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import decontaminate, extendible, licenses, main_text, repeats, sentencepiece_bpe, simhash, spotsigs, toxicity, warc
from loglens.llm.common import new_path, table


#: Bytes of a shard.
SHARD_BYTES = 1 << 20


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(warc.planned(table(spark, sf_dir, "pages")), path)
    return warc.read(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "complete")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compared(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"), length=400)


def op7_extendible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       CASE WHEN page_id <> first THEN 1 ELSE (block + 65535) // 65536 END::BIGINT AS segments, true AS complete
FROM (SELECT d.*, f.first, 87 + 5 + payload_bytes + 4 * ((payload_bytes + 8191) // 8192)
             + 4 * (payload_bytes // 8192) + CASE WHEN payload_bytes % 8192 > 0 THEN length(printf('%x', payload_bytes % 8192)) ELSE 0 END AS block
      FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_toxicity": op2_toxicity,
        "op3_decontaminate": op3_decontaminate,
        "op4_main_text": op4_main_text,
        "op5_spotsigs": op5_spotsigs,
        "op6_repeats": op6_repeats,
        "op7_extendible": op7_extendible,
        "op8_licenses": op8_licenses,
        "op9_simhash": op9_simhash,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op7_extendible": extendible.oracle_sql(SHARD_BYTES),
    }
