"""Document fingerprints by MinHash.

A fingerprint is the MinHash signature of a text's word shingles under
universal hash permutations, computed in vectorised numpy inside tasks, and
spelled as hex digits.

:func:`succession_fingerprints` compares every document with its edited text
and its successor in descending id order. The order is made without a global
sort in one task: ids are cut at quantiles into ranges, each range is sorted
in one task, and the head of the next range is sent along as its tail.

:func:`near_duplicates` joins signature bands in Spark and verifies exact
Jaccard similarities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, cut, texts, whole_groups
from .graph import components

PERMUTATIONS = 128
SHINGLE = 5
SEED = 11
ROWS_PER_RANGE = 500
MAX_RANGES = 20_000
BAND_ROWS = 4                      # 32 bands of 4: similarity 0.8 is missed with probability 5e-8
THRESHOLD = 0.8
MARGIN = 0.15                      # over four standard errors of an estimate from 128 values at 0.8
PART = 1024
LEAST = -(1 << 63)


def permutations(count: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of ``x -> a x + b mod 2**32``: with odd ``a`` each is a
    permutation of the 32-bit numbers."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32))


def shingle_hashes(raw: bytes, words_per_shingle: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of the word shingles of a UTF-8 text, repeats included.
    Words are runs of bytes other than ASCII white space, ASCII-lower-cased.
    Fewer words than a shingle: the whole sequence, also if it is empty."""
    words = raw.lower().split()
    if len(words) < words_per_shingle:
        return np.array([xxhash.xxh32_intdigest(b" ".join(words))], dtype=np.uint32)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in words], dtype=np.uint64)
    n = len(w) - words_per_shingle + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(words_per_shingle):               # order-dependent: rotate, then add the next word
        h = ((h << np.uint64(13)) | (h >> np.uint64(51))) * np.uint64(0x9E3779B97F4A7C15) + w[j:j + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Least value of each permutation over the hashes; of it the 16 low bits,
    which tell the hashes apart however many there are."""
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(hashes), chunk):
        x = hashes[at:at + chunk]
        np.minimum(low, (a[:, None] * x[None, :] + b[:, None]).min(axis=1), out=low)
    return (low & np.uint32(0xFFFF)).astype(">u2")


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal signature values: an estimate of the shingles' Jaccard."""
    return float((x == y).mean())


class Fingerprinter:
    """Signatures of texts with one set of permutations."""

    def __init__(self, words_per_shingle: int = SHINGLE, count: int = PERMUTATIONS, seed: int = SEED):
        self.words = words_per_shingle
        self.a, self.b = permutations(count, seed)

    def __call__(self, raw: bytes) -> np.ndarray:
        return signature(shingle_hashes(raw, self.words), self.a, self.b)


def spell(sig: np.ndarray) -> str:
    return sig.tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE,
                 count: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """``(<id_col>, fingerprint)`` per row. Null text counts as empty; empty
    texts have a fingerprint of their own. Equal texts have equal ones."""
    schema = pa.schema([("id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        make = Fingerprinter(words_per_shingle, count, seed)
        for b in batches:
            yield batch({"id": b.column(0), "fingerprint": [spell(make(t)) for t in b.column(1).to_pylist()]}, schema)

    return (docs.select(F.col(id_col).cast("long").alias("id"), texts(docs, text_col).cast("binary").alias("t"))
            .mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col))


def _ranges(keys: DataFrame, rows_per_range: int) -> tuple[list[int], list[int]]:
    """Ascending cut points of the keys and the greatest key of each range
    that has rows (at most ``MAX_RANGES`` numbers each)."""
    rows = keys.count()
    n = max(1, min(MAX_RANGES, rows // rows_per_range))
    cuts: list[int] = []
    if n > 1:
        at = F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)
        cuts = sorted(set(keys.agg(at.alias("c")).first().c))
    sent = keys.sparkSession.sparkContext.broadcast(np.array(cuts, dtype=np.int64))

    @F.pandas_udf(T.IntegerType())
    def number(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, key.to_numpy(), side="left").astype(np.int32))

    heads = keys.groupBy(number("key").alias("r")).agg(F.max("key").alias("head")).collect()
    return cuts, sorted(h.head for h in heads)


def succession(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int) -> DataFrame:
    """Rows ``(range, tail, key, id, t)``, each range in one partition and in
    descending key order, followed (``tail = 1``) by the row after its last."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("key"),
                        F.col(id_col).cast("long").alias("id"), texts(docs, text_col).alias("t"))
    cuts, heads = _ranges(keyed.select("key"), rows_per_range)
    order = np.searchsorted(np.array(cuts, dtype=np.int64), np.array(heads, dtype=np.int64), side="left")
    # The head of each range follows the last row of the range above it; the
    # greatest one follows the last row of all.
    tails = {h: int(order[(i + 1) % len(heads)]) for i, h in enumerate(heads)}
    sent = docs.sparkSession.sparkContext.broadcast((np.array(cuts, dtype=np.int64), tails))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def slots(key: pd.Series) -> pd.Series:
        bounds, follows = sent.value
        own = np.searchsorted(bounds, key.to_numpy(), side="left")
        return pd.Series([[2 * r] if k not in follows else [2 * r, 2 * follows[k] + 1]
                          for r, k in zip(own.tolist(), key.tolist())])

    dealt = keyed.select("key", "id", "t", F.explode(slots("key")).alias("slot"))
    dealt = dealt.select(F.shiftright("slot", 1).alias("range"), F.col("slot").bitwiseAND(1).alias("tail"), "key", "id", "t")
    return dealt.repartition("range").sortWithinPartitions("range", "tail", F.desc("key"), F.desc("t"))


def edited(text: str, following: str) -> str:
    """The last third of the text (in code points, rounded down) replaced by
    the first as many, or all, of the following one."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def succession_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            words_per_shingle: int = SHINGLE, count: int = PERMUTATIONS, seed: int = SEED,
                            rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``(<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)`` per row.

    The edited text is :func:`edited` with the next document in descending id
    order; the first one follows the last. Null texts are empty ones. Rows
    with equal ids follow each other in descending order of their texts, rows
    with null ids come after all others. A single row follows itself. An empty
    table gives an empty result; other columns are ignored, whatever their
    names. Whole texts are used; a task holds two of them at a time.
    """
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]):
        make = Fingerprinter(words_per_shingle, count, seed)
        held = None                                              # (range, id, text, signature) that awaits its next
        for b in batches:
            rows = []
            for r, tail, i, t in zip(*(b.column(c).to_pylist() for c in ("range", "tail", "id", "t"))):
                if tail and (held is None or held[0] != r):
                    continue                                     # a further row under the tail's id
                sig = make(t.encode())
                if held is not None and held[0] == r:
                    _, j, text, own = held
                    new = edited(text, t).encode()
                    other = make(new)
                    rows.append((j, len(text), hashlib.sha256(new).hexdigest(), spell(own), spell(other),
                                 likeness(own, other), likeness(own, sig)))
                held = None if tail else (r, i, t, sig)
            yield batch(dict(zip(schema.names, map(list, zip(*rows)))) if rows else dict.fromkeys(schema.names, []), schema)

    out = succession(docs, id_col, text_col, rows_per_range).mapInArrow(
        run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def _forest(sig: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest of the signatures' likenesses from
    ``least`` on (Prim, one row of likenesses at a time)."""
    n = len(sig)
    best, parent, left = np.full(n, -1.0), np.full(n, -1), np.ones(n, dtype=bool)
    edges = []
    for _ in range(n):
        at = int(np.argmax(np.where(left, best, -2.0)))
        left[at] = False
        if best[at] >= least:
            edges.append((at, int(parent[at])))
        near = (sig == sig[at]).mean(axis=1)
        closer = left & (near > best)
        best[closer], parent[closer] = near[closer], at
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    words_per_shingle: int = SHINGLE, count: int = PERMUTATIONS, seed: int = SEED,
                    part_size: int = PART) -> DataFrame:
    """``(<id_col>, class_id, n_links)`` per row: the smallest id of its class
    of near-duplicates, and its text's verified links to other texts.

    Texts are reduced to distinct ones; signatures meet on equal bands; inside
    a band value (cut into hashed parts, each pair of parts a group, if it
    holds many) the likenesses give a maximum spanning forest, whose edges are
    verified by the exact Jaccard similarity of the shingle sets: what is at
    least ``threshold`` links. A maximum spanning forest connects whatever is
    connected at a threshold, so no pair needs to be spelled out; the
    estimate only orders edges, and ``MARGIN`` below the threshold is kept for
    verification. Null texts are empty; rows with null ids are in no class
    (null); repeated rows get equal results. Empty tables give an empty
    result; other columns are ignored.
    """
    rows_per_band = BAND_ROWS
    out_schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("sig", pa.binary()),
                            ("bands", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int32()))])

    def sign(batches):
        make = Fingerprinter(words_per_shingle, count, seed)
        for b in batches:
            sigs, bands, sets = [], [], []
            for t in b.column(2).to_pylist():
                h = shingle_hashes(t, words_per_shingle)
                sig = signature(h, make.a, make.b)
                sigs.append(sig.tobytes())
                bands.append([xxhash.xxh64_intdigest(sig[i:i + rows_per_band].tobytes(), i) - (1 << 63)
                              for i in range(0, count, rows_per_band)])
                sets.append(np.unique(h).view(np.int32).tolist())
            yield batch({"id": b.column(0), "text_hash": b.column(1), "sig": sigs, "bands": bands, "shingles": sets}, out_schema)

    t = texts(docs, text_col)
    signed = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("text_hash"), t.cast("binary").alias("t"))
                 .mapInArrow(sign, "id long, text_hash long, sig binary, bands array<long>, shingles array<int>"))
    first = signed.filter("id is not null").groupBy("text_hash").agg(F.min("id").alias("id"))
    nodes = signed.join(first, ["text_hash", "id"], "left_semi").dropDuplicates(["text_hash"])
    keyed = nodes.select(F.col("id").alias("node"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(shared, "key").withColumn("parts", F.ceil(F.col("n") / part_size).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.select("key", "node", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node")
    met = met.join(nodes.select(F.col("id").alias("node"), "sig"), "node")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def forests(batches):
        for g in whole_groups(batches, ["key", "lo", "hi"]):
            key, lo, hi, node = (g.column(c).to_numpy() for c in ("key", "lo", "hi", "node"))
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), dtype=">u2").reshape(len(key), -1)
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(key) | np.diff(lo) | np.diff(hi)) + 1, [len(key)]])
            u, v = [], []
            for a, z in zip(bounds[:-1], bounds[1:]):
                for i, j in _forest(sig[a:z], threshold - MARGIN):
                    u.append(int(max(node[a + i], node[a + j])))
                    v.append(int(min(node[a + i], node[a + j])))
            yield batch({"u": u, "v": v}, schema)

    met = met.select("key", "lo", "hi", "node", "sig").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = met.mapInArrow(forests, "u long, v long").distinct()
    sets = nodes.select(F.col("id").alias("node"), "shingles")
    both = (pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v"))
    common = F.size(F.array_intersect("x", "y"))
    links = cut(both.filter(common / (F.size("x") + F.size("y") - common) >= threshold).select("u", "v"))
    roots = components(links).withColumnRenamed("node", "of")
    degree = links.select(F.explode(F.array("u", "v")).alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("n_links"))
    classes = (first.join(roots, first.id == roots.of, "left").drop("of").join(degree, first.id == degree.of, "left")
               .select("text_hash", F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return (signed.select("id", "text_hash").join(classes, "text_hash", "left")
            .select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"),
                    F.when(F.col("id").isNotNull(), F.col("n_links")).alias("n_links")))
