"""Cross-entropy difference scores (Moore and Lewis, 2010).

Two bigram models, one of the target documents and one of the others, share
one vocabulary: every word of the corpus, known by a 64-bit hash, and a
boundary; or, if a caller asks for it, a fixed number of words and hashed
classes of all others. Counts cover every document and stay in Spark.

Scale: texts are read twice, to count the words and to code them; what is
shuffled and kept are codes, two bytes for each of the ``CODED`` most frequent
words. Sides of documents are joined to the codes. Counts of coded words and of
the bigrams of the ``HOT`` most frequent ones are tables of fixed size and are
broadcast; hot bigrams are scored where the codes are read. A bigram of two
coded words goes to a bucket of the pair, one with a rarer word to a bucket of
that word, which holds all it takes to count and score it. Occurrences travel
packed: the document is a two-byte number inside its chunk of documents. Sums
come back packed by chunk. No rare word holds more than one part in ``CODED``
of the tokens; a bucket is one task's memory, so at ``T`` tokens it may have to
hold ``T / CODED`` occurrences of a word, or those of one pair outside the hot
words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, texts, whole_groups

WORDS = 960                 # words with a class of their own, if the vocabulary is not whole
UNKNOWN = 63                # hashed classes of all other words
HOT = 960                   # most frequent words, whose bigrams are broadcast
CODED = 65_535              # most frequent words, whose counts are broadcast: codes of two bytes
SMOOTHING = 20.0            # pseudo-counts of the unigram model in each context
FLUSH = 600_000             # distinct words a task remembers or counts at a time
CHUNK = 1_000_000           # tokens a task works on at a time
CHUNK_ROWS = 1 << 16        # documents a task works on at a time
BUCKET = 500_000            # occurrences meant for a bucket
RARE = 1 << 62              # classes from here on are hashes
# Kinds of packed rows: documents; sums that come back; a rare word that follows a coded one; so, and ends its
# text; a rare word before a coded one; a pair of coded words; as the first two, after another rare word.
DOCUMENTS, SUMS, AHEAD, LAST, BEHIND, PAIR, AHEAD_RARE, LAST_RARE = range(8)

PACKED = {"bucket": "long", "chunk": "long", "kind": "int", "side": "int", "keys": "binary", "others": "binary",
          "locals": "binary", "ids": "array<long>"}
PACKED_SCHEMA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("side", pa.int32()),
                           ("keys", pa.binary()), ("others", pa.binary()), ("locals", pa.binary()),
                           ("ids", pa.list_(pa.int64()))])


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def tokens(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs without ASCII white space, ASCII-lower-cased."""
    return raw.lower().split()


class Vocabulary(dict):
    """Word -> class. Class 0 is the boundary, classes up to ``coded`` are
    numbers: of the words whose hashes are ``known``, in that order, and all
    other classes are hashes of words; or of the given ``words``, and then
    ``unknown`` hashed classes of all others. Classes are remembered up to a
    bound."""

    def __init__(self, known: np.ndarray | None, words: list[bytes] | None = None, unknown: int = 0):
        super().__init__((w, i) for i, w in enumerate(words or [], 1))
        self.number = None if known is None else {h: i for i, h in enumerate(known.tolist(), 1)}
        self.first, self.unknown = len(words or []) + 1, unknown

    def __missing__(self, word: bytes) -> int:
        if self.number is None:
            c = self.first + xxhash.xxh32_intdigest(word) % self.unknown
        else:
            h = digest(word)
            c = self.number.get(h) or RARE + (h & RARE - 1)
        if len(self) < FLUSH:
            self[word] = c
        return c


def digest(word: bytes) -> int:
    """64-bit hash of a word, signed."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def counted(docs: DataFrame, of, kind: str, arrow: pa.DataType) -> DataFrame:
    """``(word, n)``: occurrences of each ``of(word)`` in the texts ``t``."""
    schema = pa.schema([("word", arrow), ("n", pa.int64())])

    def run(batches):
        n = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(tokens(t))
                if len(n) > FLUSH:
                    yield batch({"word": [of(w) for w in n], "n": list(n.values())}, schema)
                    n = Counter()
        yield batch({"word": [of(w) for w in n], "n": list(n.values())}, schema)

    return docs.select("t").mapInArrow(run, f"word {kind}, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, count: int) -> list:
    """The most frequent words, ties by the word."""
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(count).collect()]


def coded(source: DataFrame, vocabulary) -> DataFrame:
    """``(id, is_target, codes, rare)`` of rows ``(id, is_target, t)``: two
    bytes a word, 0 for a class beyond them, which follows in ``rare``."""
    schema = pa.schema([("id", pa.int64()), ("is_target", pa.bool_()), ("codes", pa.binary()), ("rare", pa.binary())])

    def run(batches):
        known = vocabulary()
        for b in batches:
            codes, rare = [], []
            for t in b.column(2).to_pylist():
                x = np.array([known[w] for w in tokens(t)], dtype=np.int64)
                far = x >= RARE
                rare.append(x[far].tobytes())
                codes.append(np.where(far, 0, x).astype(np.uint16).tobytes())
            yield batch({"id": b.column(0), "is_target": b.column(1), "codes": codes, "rare": rare}, schema)

    return source.select("id", "is_target", "t").mapInArrow(run, "id long, is_target boolean, codes binary, rare binary")


class Chunk:
    """Coded documents as one array of classes, each from its boundary on."""

    def __init__(self, number: int, rows: list[tuple]):
        self.ids, target, codes, rare = zip(*rows)
        self.number = TaskContext.get().partitionId() << 20 | number
        self.n = np.array([len(c) // 2 for c in codes])
        words = np.frombuffer(b"".join(codes), dtype=np.uint16).astype(np.int64)
        words[words == 0] = np.frombuffer(b"".join(rare), dtype=np.int64)
        ends = np.cumsum(self.n + 1)
        self.row = np.repeat(np.arange(len(rows)), self.n + 1)
        self.word = np.ones(len(self.row), dtype=bool)
        self.word[ends - self.n - 1] = False
        self.classes = np.zeros(len(self.row), dtype=np.int64)
        self.classes[self.word] = words
        self.context = np.ones(len(self.row), dtype=bool)
        self.context[ends - 1] = False
        self.side = np.where(np.array(target, dtype=bool), 0, 1)      # of a document: 0 target, 1 background

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        """Chunks of batches ``(id, is_target, codes, rare)``."""
        rows, size, number = [], 0, 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(r)
                size += len(r[2]) // 2 + 1
                if size >= CHUNK or len(rows) == CHUNK_ROWS:
                    yield cls(number, rows)
                    rows, size, number = [], 0, number + 1
        if rows:
            yield cls(number, rows)


def tallies(docs: DataFrame, last: int, hot: int) -> DataFrame:
    """``(kind, code, target, background)`` over all coded documents: words
    (kind 0, 0 stands for the rare ones together) and contexts (1) up to class
    ``last``, and pairs (2) up to class ``hot`` as ``context * (hot + 1) +
    word``. A task sends its sums once."""
    schema = pa.schema([("kind", pa.int32()), ("code", pa.int64()), ("target", pa.int64()), ("background", pa.int64())])

    def run(batches):
        sums = [np.zeros((2, n), dtype=np.int64) for n in (last + 1, last + 1, (hot + 1) ** 2)]
        for x in Chunk.of(batches):
            side = x.side[x.row]
            near = np.where(x.classes <= last, x.classes, 0)
            c, w = x.classes[:-1], x.classes[1:]
            pair = np.flatnonzero(x.context[:-1] & (c <= hot) & (w <= hot))
            lead = x.context & (x.classes <= last)
            for total, code, s in ((sums[0], near[x.word], side[x.word]), (sums[1], near[lead], side[lead]),
                                   (sums[2], c[pair] * (hot + 1) + w[pair], side[pair])):
                for k in (0, 1):
                    total[k] += np.bincount(code[s == k], minlength=total.shape[1])
        for kind, total in enumerate(sums):
            seen = np.flatnonzero(total.any(axis=0))
            for lo in range(0, len(seen), 100_000):
                part = seen[lo:lo + 100_000]
                yield batch({"kind": pa.array(np.full(len(part), kind, dtype=np.int32)), "code": pa.array(part),
                             "target": pa.array(total[0, part]), "background": pa.array(total[1, part])}, schema)

    return (docs.mapInArrow(run, "kind int, code long, target long, background long")
            .groupBy("kind", "code").agg(F.sum("target").alias("target"), F.sum("background").alias("background")))


def packed(of: dict, size: int) -> pa.RecordBatch:
    """Packed rows of the given columns, null in all others."""
    return batch({f.name: of.get(f.name, pa.nulls(size, f.type)) for f in PACKED_SCHEMA}, PACKED_SCHEMA)


def slices(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [values[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist())]


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def sums_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys and the sums of the values of each."""
    keys, at = np.unique(key, return_inverse=True)
    return keys, [np.bincount(at, weights=v, minlength=len(keys)) for v in values]


def pair_logs(key: np.ndarray, side: np.ndarray, last: int, unigram: np.ndarray) -> list[np.ndarray]:
    """Log numerators of the occurrences of pairs of coded words, by either model."""
    pairs, at = np.unique(key, return_inverse=True)
    return [np.log(np.bincount(at[side == s], minlength=len(pairs)) + unigram[s][pairs % (last + 1)])[at] for s in (0, 1)]


def rare_logs(key: np.ndarray, other: np.ndarray, kind: np.ndarray, side: np.ndarray, unigram: np.ndarray,
              spread: list[int], smoothing: float) -> list[np.ndarray]:
    """Log numerators of the occurrences of pairs with a rare word ``key``,
    less the log denominators of those words' own contexts."""
    behind = kind == BEHIND
    _, word = np.unique(key, return_inverse=True)
    order = np.lexsort((other, behind, word))
    change = np.ones(len(order), dtype=bool)
    change[1:] = ((np.diff(other[order]) != 0) | (np.diff(word[order]) != 0) | (behind[order][1:] != behind[order][:-1]))
    pair = np.empty(len(order), dtype=np.int64)
    pair[order] = np.cumsum(change) - 1
    logs = []
    for s in (0, 1):
        mine = side == s
        n = np.bincount(word[mine & ~behind], minlength=word.max() + 1)[word]
        led = np.bincount(word[mine & (kind == AHEAD)], minlength=word.max() + 1)[word]
        mass = smoothing * (n + 1) / spread[s]
        mass[behind] = unigram[s][other[behind]]
        logs.append(np.log(np.bincount(pair[mine], minlength=pair.max() + 1)[pair] + mass)
                    - np.where(kind == AHEAD, np.log(led + smoothing), 0.0))
    return logs


def cross_entropy_difference(docs: DataFrame, is_target: Column | DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             words: int | None = WORDS, unknown: int = UNKNOWN, smoothing: float = SMOOTHING,
                             hot_words: int = HOT, bucket_tokens: int = BUCKET, coded_words: int = CODED) -> DataFrame:
    """``(<id_col>, n_tokens, ce_target, ce_background, ce_difference)`` per
    row: mean losses per token in nats, and the mean of the per-token loss
    differences; the lower, the more the document is like the targets.

    A bigram's probability is its count with ``smoothing`` pseudo-counts of
    the unigram model, which adds one to each word of the vocabulary. The
    vocabulary is every word if ``words`` is None, else the ``words`` most
    frequent ones and ``unknown`` hashed classes of all others (65,535 together
    at most). ``hot_words``, ``coded_words`` and ``bucket_tokens`` say where a
    bigram is counted, not how it is scored.

    ``is_target`` marks the rows of the target model (null counts as false) or
    is a table of their ids (column ``<id_col>``; nulls and repeated ids do no
    harm, a row without an id is none of them); all other rows train the
    background model. Texts without words (null, empty) have zero tokens and
    zero scores. Rows with null ids and repeated rows train and are scored like
    all others, each on its own. A side without rows leaves its model uniform
    over the vocabulary. Empty tables give an empty result; other columns are
    ignored, whatever their names. Whole texts are used, of any length.
    """
    sc = docs.sparkSession.sparkContext
    by_id = isinstance(is_target, DataFrame)
    source = docs.select(F.col(id_col).cast("long").alias("id"), texts(docs, text_col).cast("binary").alias("t"),
                         F.lit(False).alias("is_target") if by_id else F.coalesce(is_target, F.lit(False)).alias("is_target"))
    if words is None:
        counts = cut(counted(source, digest, "long", pa.int64()))
        size = counts.count()
        known = sc.broadcast(np.array(frequent(counts, min(coded_words, CODED)), dtype=np.int64))
        last = len(known.value)
        hot = min(hot_words, last)
        docs_coded = coded(source, lambda: Vocabulary(known.value))
    else:
        named = [bytes(w) for w in frequent(counted(source, bytes, "binary", pa.binary()), words)]
        last = size = len(named) + unknown
        if last > CODED:
            raise ValueError(f"at most {CODED} classes")
        hot = min(hot_words + unknown, last)
        docs_coded = coded(source, lambda: Vocabulary(None, named, unknown))
    if by_id:
        # A merge join at every size: the ids grow with the documents. Null ids spread by their text.
        ids = (is_target.select(F.col(id_col).cast("long").alias("key")).filter("key IS NOT NULL").distinct()
               .withColumns({"known": F.lit(True), "hit": F.lit(True)}))
        keyed = docs_coded.withColumns({"key": F.coalesce("id", F.xxhash64("codes", "rare")), "known": F.col("id").isNotNull()})
        docs_coded = (keyed.join(ids.hint("merge"), ["key", "known"], "left")
                      .select("id", F.coalesce("hit", F.lit(False)).alias("is_target"), "codes", "rare"))
    docs_coded = cut(docs_coded)                             # fixes the chunks, too
    found = tallies(docs_coded, last, hot).toPandas()        # at most 2 * last + hot squared rows
    tables = []
    for kind, n in enumerate((last + 1, last + 1, (hot + 1) ** 2)):
        one, table = found[found["kind"] == kind], np.zeros((2, n))
        table[0, one["code"].to_numpy(dtype=np.int64)] = one["target"]
        table[1, one["code"].to_numpy(dtype=np.int64)] = one["background"]
        tables.append(table)
    n_words, led, pairs = tables
    total = n_words.sum(axis=1)
    spread = [int(t) + size for t in total]
    n_words[:, 0] = 0
    unigram = np.array([smoothing * (n_words[s] + 1) / max(spread[s], 1) for s in (0, 1)])
    joint = np.log(pairs + np.tile(unigram[:, :hot + 1], hot + 1))
    sent = sc.broadcast((unigram, joint, np.log(led + smoothing)))
    buckets = max(1, int(total.sum()) // bucket_tokens)

    def deal(batches):
        """A packed row per chunk of documents (scored as far as words are
        coded and bigrams hot) and per bucket, kind and side of its other
        bigrams."""
        _, joint, context = sent.value
        for x in Chunk.of(batches):
            at = np.flatnonzero(x.context[:-1])
            c, w, row = x.classes[at], x.classes[at + 1], x.row[at]
            both, leads = (c <= hot) & (w <= hot), c <= last
            code = c[both] * (hot + 1) + w[both]
            logs = [np.bincount(row[both], weights=joint[s, code], minlength=len(x.n))
                    - np.bincount(row[leads], weights=context[s, c[leads]], minlength=len(x.n)) for s in (0, 1)]
            yield packed({"chunk": [x.number], "kind": [DOCUMENTS], "keys": [x.n.astype(np.int64).tobytes()],
                          "others": [np.array(logs).tobytes()], "ids": [list(x.ids)]}, 1)
            far = w > last
            kind = np.where(far, np.where(leads, np.where(x.context[at + 1], AHEAD, LAST),
                                          np.where(x.context[at + 1], AHEAD_RARE, LAST_RARE)), np.where(leads, PAIR, BEHIND))
            go = np.flatnonzero(~both)
            kind, c, w, row, far = kind[go], c[go], w[go], row[go], far[go]
            key = np.where(far, w, np.where(kind == PAIR, c * (last + 1) + w, c))
            other = np.where(far, c, w)
            mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bucket = ((mixed >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
            part = (bucket * 8 + kind) * 2 + x.side[row]
            order = np.argsort(part, kind="stable")
            part, key, other, row = part[order], key[order], other[order], row[order].astype(np.uint16)
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(starts[1:], len(part))
            part = part[starts]
            kinds = part // 2 % 8
            bounds = list(zip(kinds.tolist(), starts.tolist(), ends.tolist()))
            pair, near = key.astype(np.uint32), other.astype(np.uint16)
            keys = [(pair if k == PAIR else key)[a:z].tobytes() for k, a, z in bounds]
            others = [b"" if k == PAIR else (other if k > PAIR else near)[a:z].tobytes() for k, a, z in bounds]
            yield packed({"bucket": pa.array(part // 16), "chunk": [x.number] * len(part),
                          "kind": pa.array(kinds.astype(np.int32)), "side": pa.array((part % 2).astype(np.int32)),
                          "keys": keys, "others": others, "locals": slices(row, starts, ends)}, len(part))

    def back(rows: list[np.ndarray], logs: list[np.ndarray]) -> pa.RecordBatch:
        """Sums by document, packed by chunk."""
        row, sums = sums_by(np.concatenate(rows), *np.concatenate(logs, axis=1))
        starts = np.flatnonzero(np.diff(row >> 16, prepend=-1))
        ends = np.append(starts[1:], len(row))
        pair = [sums[0][a:z].tobytes() + sums[1][a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist())]
        return packed({"chunk": pa.array(row[starts] >> 16), "kind": pa.array(np.full(len(starts), SUMS, dtype=np.int32)),
                       "others": pair, "locals": slices((row & 0xFFFF).astype(np.uint16), starts, ends)}, len(starts))

    def meet(batches):
        """Log probabilities of the occurrences of whole buckets, added up by
        document; rows of documents as they are."""
        unigram = sent.value[0]
        rows, logs, held = [], [], 0
        for g in whole_groups(batches, ["bucket"]):
            plain = g.filter(g.column("bucket").is_null())
            if plain.num_rows:
                yield from plain.to_batches()
            g = g.filter(g.column("bucket").is_valid())
            number = g.column("bucket").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)] if len(number) else []
            for a, z in zip(bounds[:-1], bounds[1:]):
                one = g.slice(a, z - a)
                kinds = one.column("kind").to_numpy()
                pairs, near, far = (one.filter(pa.array(which)) for which in (kinds == PAIR, kinds < PAIR, kinds > PAIR))
                for part in (pairs, pa.concat_tables([near, far])):
                    if not part.num_rows:
                        continue
                    sizes = np.array([len(b) // 2 for b in part.column("locals").to_pylist()])
                    row = np.repeat(part.column("chunk").to_numpy() << 16, sizes) | joined(part.column("locals"), np.uint16)
                    side = np.repeat(part.column("side").to_numpy(), sizes)
                    if part is pairs:
                        found = pair_logs(joined(part.column("keys"), np.uint32).astype(np.int64), side, last, unigram)
                    else:
                        kind = np.repeat(part.column("kind").to_numpy(), sizes)
                        kind = np.where(kind > PAIR, kind - AHEAD_RARE + AHEAD, kind)
                        other = np.concatenate([joined(near.column("others"), np.uint16).astype(np.int64),
                                                joined(far.column("others"), np.int64)])
                        found = rare_logs(joined(part.column("keys"), np.int64), other, kind, side, unigram, spread, smoothing)
                    rows.append(row)
                    logs.append(np.array(found))
                    held += len(row)
                if held >= 4 * CHUNK:
                    yield back(rows, logs)
                    rows, logs, held = [], [], 0
        if held:
            yield back(rows, logs)

    scored = pa.schema([("id", pa.int64()), *((k, pa.float64()) for k in ("target", "background")), ("n", pa.int64())])

    def gather(batches):
        """The documents of whole chunks with all that was added up for them."""
        for g in whole_groups(batches, ["chunk"]):
            number = g.column("chunk").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, z in zip(bounds[:-1], bounds[1:]):
                one = g.slice(a, z - a)
                kinds = one.column("kind").to_numpy()
                docs = one.filter(pa.array(kinds == DOCUMENTS))
                n = joined(docs.column("keys"), np.int64)
                logs = joined(docs.column("others"), np.float64).reshape(2, -1).copy()
                sums = one.filter(pa.array(kinds == SUMS))
                for where, more in zip(sums.column("locals").to_pylist(), sums.column("others").to_pylist()):
                    logs[:, np.frombuffer(where, dtype=np.uint16)] += np.frombuffer(more, dtype=np.float64).reshape(2, -1)
                yield batch({"id": docs.column("ids").to_pylist()[0], "target": pa.array(logs[0]),
                             "background": pa.array(logs[1]), "n": pa.array(n)}, scored)

    dealt = docs_coded.mapInArrow(deal, ddl(PACKED)).repartition(F.coalesce("bucket", F.xxhash64("chunk"))).sortWithinPartitions("bucket")
    sums = dealt.mapInArrow(meet, ddl(PACKED)).repartition("chunk").sortWithinPartitions("chunk")
    done = sums.mapInArrow(gather, "id long, target double, background double, n long")

    def mean(log: Column) -> Column:
        return F.when(F.col("n") > 0, log / F.col("n")).otherwise(0.0)

    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), mean(-F.col("target")).alias("ce_target"),
                       mean(-F.col("background")).alias("ce_background"),
                       mean(F.col("background") - F.col("target")).alias("ce_difference"))
