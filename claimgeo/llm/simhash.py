"""Near-duplicates by SimHash fingerprints and bit-sliced comparison.

Fingerprints are made by Arrow batches inside tasks. Distinct fingerprints
meet in Spark on exact keys: with ``radius + 2`` blocks of bits, two
fingerprints that differ in at most ``radius`` bits agree on at least two
whole blocks, so joining on every pair of blocks loses no link. Within a key
the fingerprints are compared bit-sliced (see :func:`near_pairs`) and each
task emits a spanning forest, never all pairs. A key with many fingerprints
is cut into hashed parts, and every pair of parts is a group of its own, so
no group grows with the data.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, texts, whole_groups
from .graph import components

BITS = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(raw: bytes, words_per_shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text (UTF-8): a bit is set if it is set in over
    half of the XXH64 hashes of the text's word shingles, repeats included.
    Fewer words than a shingle: the whole sequence is the one shingle; no
    words: 0."""
    words = raw.lower().split()          # bytes: ASCII case and ASCII white space only
    n = len(words)
    if not n:
        return 0
    k = min(words_per_shingle, n)
    joined = b" ".join(words)
    ends = [c + i for i, c in enumerate(accumulate(map(len, words)))]
    starts = [0] + [e + 1 for e in ends]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1:])], dtype=np.uint64)
    ones = _ones_per_bit(h)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _ones_per_bit(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits: bits are widened to
    bytes and added eight at a time in uint64 words, 255 rows at most before
    the byte counters are widened."""
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 255 * 4096):
        rows = np.unpackbits(h[at:at + 255 * 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(rows.view(np.uint64), np.arange(0, len(rows), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(id, fp)`` per row: the fingerprint as a signed bigint. Null text
    counts as empty. Other columns are ignored."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fp = [fingerprint(t, words_per_shingle, seed) for t in b.column(1).to_pylist()]
            yield batch({"id": b.column(0), "fp": pa.array(np.array(fp, dtype=np.uint64).view(np.int64))}, schema)

    return (docs.select(F.col(id_col).cast("long").alias("id"), texts(docs, text_col).cast("binary").alias("t"))
            .mapInArrow(run, "id long, fp long"))


def block_keys(fp: Column, radius: int) -> Column:
    """Array of the exact keys of a fingerprint: one per pair of its
    ``radius + 2`` blocks, tagged with the pair's number."""
    n = radius + 2
    width = [BITS // n + (i < BITS % n) for i in range(n)]
    at = [sum(width[:i]) for i in range(n)]
    part = [F.shiftrightunsigned(fp, at[i]).bitwiseAND(F.lit((1 << width[i]) - 1).cast("long")) for i in range(n)]
    keys = [F.lit(number).cast("long") * F.lit(1 << (2 * max(width))) + part[i] * F.lit(1 << width[j]) + part[j]
            for number, (i, j) in enumerate(combinations(range(n), 2))]
    return F.array(*keys)


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose carry-save count exceeds ``radius``, compared bit by bit."""
    gt, eq = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for c, bit in zip(reversed(counters), range(len(counters) - 1, -1, -1)):
        if radius >> bit & 1:
            eq &= c
        else:
            gt |= eq & c
            eq &= ~c
    return gt


def near_pairs(fp: np.ndarray, run_end: np.ndarray, radius: int, chunk: int = 1 << 15):
    """Yield index arrays ``(i, j)``, i < j < run_end[i], of fingerprints that
    differ in at most ``radius`` bits.

    Bit planes are stored vertically: plane p holds bit p of 64 fingerprints
    per word. One step XORs a plane's word with a query's bit and adds it to
    64 distances at once with carry-save counters; a block of 64 lanes is
    abandoned as soon as all its lanes exceed the radius. Memory is bounded by
    ``chunk`` blocks at a time.
    """
    n = len(fp)
    words = (n + 63) // 64
    bits = np.zeros((words * 64, BITS), dtype=np.uint8)
    bits[:n] = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)   # (64, words)
    index = np.arange(n)
    first, last = (index + 1) // 64, (run_end - 1) // 64
    spans = np.where(run_end > index + 1, last - first + 1, 0)
    cum = np.cumsum(spans)
    levels = max(2, radius.bit_length())
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + chunk, side="right")))
        q = np.repeat(index[at:upto], spans[at:upto])
        if len(q):
            offset = np.arange(len(q)) - np.repeat(cum[at:upto] - spans[at:upto] - (cum[at - 1] if at else 0),
                                                   spans[at:upto])
            yield from _compare(fp, planes, q, first[q] + offset, run_end[q], radius, levels)
        at = upto


def _compare(fp, planes, q, w, end, radius, levels):
    low = np.clip(q + 1 - 64 * w, 0, 63).astype(np.uint64)
    high = np.clip(64 * w + 64 - end, 0, 63).astype(np.uint64)
    over = ~((ALL << low) & (ALL >> high))                   # lanes outside the run count as exceeded
    value, zero = fp[q], np.uint64(0)
    counters = [np.zeros(len(q), dtype=np.uint64) for _ in range(levels)]
    for p in range(BITS):
        x = planes[p][w] ^ (zero - ((value >> np.uint64(p)) & np.uint64(1)))
        for c in counters:
            carry = c & x
            c ^= x
            x = carry
        over |= x
        if p % 8 == 7:
            over |= _over(counters, radius)
            alive = over != ALL
            if not alive.any():
                return
            if not alive.all():
                q, w, value, over = q[alive], w[alive], value[alive], over[alive]
                counters = [c[alive] for c in counters]
    lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    task, lane = np.nonzero(lanes)
    yield q[task], 64 * w[task] + lane


def _join(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union the pairs in a forest of fully compressed parents."""
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def links(nodes: DataFrame, radius: int, part_size: int = 4096) -> DataFrame:
    """Edges ``(u, v)`` that connect exactly the nodes ``(node, fp)`` reachable
    by steps of at most ``radius`` bits: a spanning forest per key."""
    keyed = nodes.select("node", "fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(shared, "key").withColumn("parts", F.ceil(F.col("n") / part_size).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = met.select("key", "node", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "fp")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for t in whole_groups(batches, ["key", "lo", "hi"]):
            key, lo, hi, node, fp = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "node", "fp"))
            new = np.flatnonzero(np.diff(key) | np.diff(lo) | np.diff(hi)) + 1
            bounds = np.concatenate([[0], new, [len(key)]])
            run_end = np.repeat(bounds[1:], np.diff(bounds))
            parent = np.arange(len(key))
            for i, j in near_pairs(np.ascontiguousarray(fp).view(np.uint64), run_end, radius):
                parent = _join(parent, i, j)
            child = np.flatnonzero(parent != np.arange(len(key)))
            yield batch({"u": pa.array(node[child]), "v": pa.array(node[parent[child]])}, schema)

    return (met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(run, "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4,
                    radius: int = 4, seed: int = 42) -> DataFrame:
    """``(<id_col>, fingerprint, component_id)`` per row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest
    id reachable over links of at most ``radius`` differing bits, the row's
    own id included.

    Nulls: a null text is an empty text (fingerprint zero, linked like any
    other); a row with a null id keeps its fingerprint and gets the component
    of that fingerprint, null if no row with an id has it. Repeated rows each
    get their row. Ties have no effect. An empty table gives an empty result.
    Other columns, whatever their names, are ignored. A word is a run of
    bytes other than space and \\t\\n\\v\\f\\r; lower-casing is ASCII only.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words_per_shingle, seed))
    nodes = prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("node"))
    roots = components(links(nodes, radius)).withColumnRenamed("node", "of")
    groups = (nodes.join(roots, nodes.node == roots.of, "left")
              .select("fp", F.coalesce("root", "node").alias("component_id")))
    return (prints.join(groups, "fp", "left")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"),
                    "component_id"))
