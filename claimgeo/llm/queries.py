"""Registered queries of the corpus operators: ``opN_<name>`` applies
operator N to its whole table. ``ORACLE`` has DuckDB SQL where SQL can
express the result; the others are tested against brute force in tests/llm.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import chat, decontam, licenses, lm, minhash, mixing, ngram_join, pii, resampling, simhash, toxicity, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.to_json("evidence").alias("evidence"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = pii.bare_spans(F.col("base"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[pii.count_of(base, rank).alias(f"n_{kind}") for rank, kind in enumerate(pii.KINDS)],
        F.sha2(pii.spell(base), 256).alias("base_sha256"),
        pii.spell(F.array_sort(F.concat(base, "extra"))).alias("spans"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "mix_topic", "mix_tokens", F.round("mix_rate", 6).alias("mix_rate"), "mix_copies")


ORACLE["op5_mixing"] = mixing.oracle_sql()


@query
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.succession_fingerprints(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False)


ORACLE["op9_warc"] = """
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                      max(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < original THEN original END AS refers_to
    FROM p
"""


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of quality 1; background: all others. Every
    word of the corpus is in the vocabulary."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), good, words=None)


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.stale_reply_preferences(table(spark, sf_dir, "conversations"))


ORACLE["op8_chat_formatting"] = chat.oracle_sql()


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, sf_dir, "documents"))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
