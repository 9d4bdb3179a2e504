"""Importance resampling towards a target distribution.

Word n-grams of 1 to ``words`` words fall into hashed buckets. A batch's texts
are joined with separator sentinels; one regex pass finds all words of the
batch, a binary search in the document offsets names each word's document,
and n-grams that reach over a document's end are masked before they are
counted. Counts of the whole corpus and of the target give a gain per bucket;
a document's weight is the sum over its n-grams, its score adds
Gumbel noise from its id, and the highest scores are drawn.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut, texts

WORDS = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
BATCH_BYTES = 1 << 19
SENTINEL = b"\n"
# In UTF-8 every byte of a character beyond ASCII is 0x80 or more, so the
# class over bytes cuts the same words as over characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def pieces(texts: Iterable[bytes], size: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of ``(document, piece)`` of about ``size`` bytes each. A text
    that is longer is cut between words; all others are whole."""
    held, total = [], 0
    for doc, text in enumerate(texts):
        at = 0
        while len(text) - at > size:
            gap = GAP.search(text, at + size)
            if gap is None:
                break
            if held:
                yield held
                held, total = [], 0
            yield [(doc, text[at:gap.start()])]
            at = gap.start()
        held.append((doc, text[at:] if at else text))
        total += len(text) - at
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def features(texts: list[bytes], words: int = WORDS, buckets: int = BUCKETS,
             size: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(document of each n-gram, its bucket, document of each word)`` of
    lower-cased texts, batch by batch. The bucket is the CRC-32 of the
    n-gram's bytes (words joined by one space) modulo ``buckets``."""
    last_doc, tail = -1, []                         # the last words of the batch before, if its text goes on
    for part in pieces(texts, size):
        lead = tail if part[0][0] == last_doc else []
        chunks = [SENTINEL.join(lead + [part[0][1]])] + [t for _, t in part[1:]]
        joined = SENTINEL.join(chunks).lower()
        starts = np.cumsum([0] + [len(c) + len(SENTINEL) for c in chunks[:-1]])
        found = list(WORD.finditer(joined))
        ws = [m[0] for m in found]
        at = np.fromiter((m.start() for m in found), dtype=np.int64, count=len(found))
        doc = np.array([d for d, _ in part])[np.searchsorted(starts, at, side="right") - 1]
        seen = len(lead)                            # n-grams that end in these were counted before
        spaced = [b" " + w for w in ws]
        crc = list(map(crc32, ws))
        grams, docs = [np.array(crc[seen:], dtype=np.uint32)], [doc[seen:]]
        for k in range(1, words):
            crc = list(map(crc32, spaced[k:], crc))                # each goes on from the n-gram one shorter
            value = np.array(crc, dtype=np.uint32)
            whole = (doc[k:] == doc[:-k]) if len(doc) > k else np.zeros(0, dtype=bool)
            whole &= np.arange(k, k + len(whole)) >= seen
            grams.append(value[whole])
            docs.append(doc[k:][whole])
        yield np.concatenate(docs), (np.concatenate(grams) % np.uint32(buckets)).astype(np.int64), doc[seen:]
        last_doc = part[-1][0]
        tail = ws[max(0, int(np.searchsorted(doc, last_doc)), len(ws) - words + 1):] if words > 1 else []


def bucket_counts(docs: DataFrame, text_col: str = "text", words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` over all texts: every task sends its own counts once."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        n = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, bucket, _ in features(b.column(0).to_pylist(), words, buckets):
                n += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(n)
        yield batch({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(n[at])}, schema)

    return (docs.select(texts(docs, text_col).cast("binary").alias("t")).mapInArrow(run, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket, from two tables of :func:`bucket_counts` (at most
    ``buckets`` rows each, whatever the corpus)."""
    s, t = [0] * buckets, [0] * buckets
    for of, df in ((s, corpus), (t, target)):
        for r in df.collect():
            of[r["bucket"]] = r["n"]
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t)],
                    dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """``(id, n_words, n_features, weight)`` per row."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches):
        for b in batches:
            n = b.num_rows
            n_words, n_features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for doc, bucket, word_doc in features(b.column(1).to_pylist(), words, len(gain)):
                n_words += np.bincount(word_doc, minlength=n)
                n_features += np.bincount(doc, minlength=n)
                weight += np.bincount(doc, weights=gain[bucket], minlength=n).astype(np.int64)
            yield batch({"id": b.column(0), "n_words": pa.array(n_words), "n_features": pa.array(n_features),
                         "weight": pa.array(weight)}, schema)

    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), texts(docs, f"`{text_col}`").cast("binary").alias("t"))
            .mapInArrow(run, "id long, n_words long, n_features long, weight long"))


def places(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``place``: its rows counted from 1 in ``order``. The rows
    are sorted over all tasks and numbered inside each; the tasks' sizes (one
    row a task) give the offsets, so no task sees more than its share."""
    at = cut(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    sizes = at.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("task", F.coalesce(before, F.lit(0)).alias("before"))
    return (at.withColumn("task", task).join(F.broadcast(offsets), "task")
            .withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("at", "task", "before"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", words: int = WORDS, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``(<id_col>, n_features, weight, score, rank)`` per row of ``docs``, all
    long; ``rank`` is null where a row is not drawn.

    Words are runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z lower-cased. Features are all runs of 1 to ``words`` words of a
    text. ``weight`` sums the gains
    ``floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))`` of a row's
    features; ``score`` adds ``floor(-1000 ln(-ln u))`` with u from the hash
    of ``<seed>:<id>``. Of the N rows of at least ``min_words`` words the
    ``floor(percent * N / 100)`` highest scores are drawn.

    Nulls: a null text has no words (weight 0); a null id is hashed as the
    empty text and comes after all other ids. Ties go to the smaller id, then
    to the row read first. Repeated rows count and are drawn each by itself. An
    empty table gives an empty result; an empty target gives gains against a
    flat distribution. Very long texts are cut between words into pieces and
    n-grams across the cuts are kept. Other columns, whatever their names, are
    ignored. Only the buckets' gains (``buckets`` numbers) go to the tasks.
    """
    gain = gains(bucket_counts(docs, f"`{text_col}`", words, buckets),
                 bucket_counts(target, f"`{target_text_col}`", words, buckets), buckets)
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8),
               16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((u + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = cut(weights(docs, gain, id_col, text_col, words)
                 .select("*", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row")))
    eligible = F.col("n_words") >= min_words
    many = scored.filter(eligible).count()
    ranked = places(scored, eligible.desc(), F.desc("score"), F.asc_nulls_last("id"), F.col("row"))
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score",
                         F.when(F.col("place") <= percent * many // 100, F.col("place")).alias("rank"))
