"""A corpus-cleaning pipeline over ``documents``: five stages, each of which
calls one corpus operator and works on all that its predecessor kept.

``run`` writes every stage's rows as Parquet in the shared checkpoint folder
and rereads them as the next one's input. No stage is expressible in SQL as a
whole (nearest examples, edit distances), so there is no ``ORACLE_SQL``; the
stages are tested against their operators and planted rows.

Every row gets its own decision, also without an id or under an id that other
texts have, too (``_named``). Null and empty texts hold nothing to reject; to
the deduplication they are equal texts. Repeated rows and copies are one group
there and one stays; ties go to the smallest id. Very long texts are worked on
whole; an empty table gives an empty result; extra columns are carried along,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgeo.llm import decontam, mixing, pii, simhash, toxicity
from claimgeo.llm.common import columns, cut, free_name, table
from claimgeo.session import checkpoint_dir


UNNAMED = 1 << 62          # ids from here on are names made from hashes
BROADCAST_IDS = 100_000    # ids that several texts have: a megabyte of numbers; more are joined by a shuffle


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a further column that names each text, and its name.

    The name is ``doc_id`` where one text has that id; rows without an id, of
    an id with several texts or of one from 2^62 on are named by 62 bits of a
    hash of id and text. Only rows of the latter kinds could share a name by
    chance (in 10^9 of them with probability 0.1). A null and an empty text are
    the same. No row is named differently by a second evaluation. The ids of
    several texts are found once, by numbers only; up to ``BROADCAST_IDS`` of
    them are broadcast, so that no text is shuffled for its name.
    """
    name, shared = free_name(docs, "row_name"), free_name(docs, "shared_id")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = (docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(shared))
               .agg(F.min(text).alias("lo"), F.max(text).alias("hi")).filter("lo <> hi").select(shared))
    several = cut(several)
    if several.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        several = F.broadcast(several)
    made = F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), 2)
    own = F.col("doc_id").isNotNull() & F.col(shared).isNull() & (F.col("doc_id") < UNNAMED)
    marked = docs.join(several, docs["doc_id"] == several[shared], "left")
    return marked.select(*columns(docs), F.when(own, F.col("doc_id")).otherwise(made).alias(name)), name


def _keep(named: DataFrame, name: str, names: DataFrame, how: str) -> DataFrame:
    """The rows of ``named`` by a semi or anti join on their names, which go."""
    return named.join(names.select(name).distinct(), name, how).select(*columns(named.drop(name)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go. The label of
    an id that several texts have is not learnt from."""
    named, name = _named(docs)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(name), "toxic")
    return _keep(named, name, toxicity.scores(named, labels, id_col=name).filter("predicted = 1"), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest name
    stays (its id, if it has one of its own), once if its row is repeated."""
    named, name = _named(docs)
    first = simhash.near_duplicates(named, id_col=name).filter(F.col(name) == F.col("component_id")).select(name).distinct()
    return named.join(first, name, "left_semi").dropDuplicates([name]).select(*columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within the edit budget go."""
    named, name = _named(docs)
    found = decontam.contaminated(named, table(spark, sf_dir, "benchmark"), id_col=name)
    return _keep(named, name, found, "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes ``[KIND]``; ``n_chars`` follows."""
    out = pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                          .otherwise(F.length("text").cast("long"))).select(*columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights, with how often each is to be
    seen (``mix_copies``, at least 1)."""
    return mixing.mixed(docs).filter("mix_copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact),
    ("mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and reread."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
