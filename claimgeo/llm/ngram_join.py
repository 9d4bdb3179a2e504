"""Exact Jaccard self-join of documents on word n-grams, by adaptive prefixes
with several matches.

A document is the set of its distinct shingles, in one global order: rare
ones first, by a count of all shingles in hashed buckets (any fixed order
gives the same links; the counts only make it cheap). Two sets of Jaccard at
least t share, for every l, at least l shingles among the first
``n - ceil(t n) + l`` of either. So each document takes an l of its own:
longer prefixes cost more entries, but fewer of the documents met share l of
them and have to be verified; l is where the two estimated costs are least
together. A pair is verified if it shares as many prefix shingles as the
smaller l of the two asks.

Work is bounded in hot groups in three ways. Equal sets are one node.
Every prefix shingle that several nodes hold first links each to one of them,
the one with the fewest shingles of its own, then those still apart to a few
more (so many pairs an entry, never all pairs), and what verifies is joined into
classes. Only then are the pairs of a shingle spelled out that lie in two
different classes; no other pair can change a class. Before a pair is
verified, a small sketch of either set bounds their difference from below,
which leaves out almost all pairs that are no links and never a link.
Verification is exact: the texts of the pairs left are read again, only they
are shuffled, and their sets intersected.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import batch, cut, free_shuffles, texts, whole_groups
from .graph import components

SHINGLE = 3
PERCENT = 90
SKETCH_BITS = 18
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
TRIES = 8                            # further members of its class that a node is tried against
ENTRY_COST = 4.0                     # an entry met in the index, in shingles compared
MARK_WORDS = 1 << 18                 # longs in the marks of the ids whose texts are read again
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes, words_per_shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. Words are runs
    of bytes other than ASCII white space, A-Z lower-cased. Fewer words than a
    shingle: the whole sequence; none: empty."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in words], dtype=np.uint64)
    n = len(w) - k + 1
    h = np.full(n, k, dtype=np.uint64)                # sequences of other lengths have other hashes
    for j in range(k):
        h = (h ^ w[j:j + n]) * MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def prefix_length(n: int, matches: int, percent: int) -> int:
    return n - -(-percent * n // 100) + matches


def odd_bits(h: np.ndarray) -> np.ndarray:
    """Odd sketch of a set: as many bits as the least power of two (64 or
    more) that is not below its size, each the parity of the elements hashed
    to it. Two of them differ in no more bits than their sets in elements; a
    wide one's longs xored with those half the width on give the narrower one."""
    words = 1 << max(0, (len(h) - 1).bit_length() - 6)
    odd = np.bincount((h & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def choose_matches(met: np.ndarray, n: int, percent: int, options: tuple[int, ...] = MATCHES) -> int:
    """The l of least estimated cost for a set whose shingles, in the global
    order, are expected to be met ``met`` times each: entries met in the
    prefix, and verifications of n shingles for the documents that may share l
    of them."""
    upto = np.cumsum(met)
    best, least = 1, np.inf
    for l in options:
        p = prefix_length(n, l, percent)
        if p > n:
            break
        cost = ENTRY_COST * (p + upto[p - 1]) + n * upto[p - 1] / l
        if cost < least:
            best, least = l, cost
    return best


def sketch(docs: DataFrame, text_col: str, words_per_shingle: int, bits: int) -> np.ndarray:
    """Counts of all documents' shingles in ``2**bits`` hashed buckets: that
    many numbers come to the driver and go to the tasks, at any size."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        n = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(n, bucket(shingles(t, words_per_shingle), bits), 1)
        at = np.flatnonzero(n)
        yield batch({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(n[at])}, schema)

    rows = (docs.select(texts(docs, text_col).cast("binary").alias("t")).mapInArrow(run, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(1 << bits, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def signed(docs: DataFrame, counts: np.ndarray, id_col: str, text_col: str, words_per_shingle: int, percent: int,
           bits: int) -> DataFrame:
    """``(id, key, n, matches, prefix, odd)`` per row: a 128-bit hash of the
    set, its size, its l, its prefix in the global order and its odd sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64))
    usual = float(counts.mean())                     # what a bucket holds beside the shingle asked for
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("matches", pa.int32()),
                        ("prefix", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def run(batches):
        count = sent.value
        for b in batches:
            keys, sizes, ls, prefixes, odds = [], [], [], [], []
            for t in b.column(1).to_pylist():
                h = shingles(t, words_per_shingle)
                n = len(h)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(n)
                odds.append(odd_bits(h))
                if not n:
                    ls.append(0)
                    prefixes.append([])
                    continue
                c = count[bucket(h, bits)]
                by = np.lexsort((h, c))
                l = choose_matches(np.maximum(c[by] - 1.0 - usual, 0.02), n, percent)
                ls.append(l)
                prefixes.append(h[by[:prefix_length(n, l, percent)]].view(np.int64))
            yield batch({"id": b.column(0), "key": keys, "n": sizes, "matches": ls, "prefix": prefixes, "odd": odds}, schema)

    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), texts(docs, text_col).cast("binary").alias("t"))
            .mapInArrow(run, "id long, key binary, n int, matches int, prefix array<long>, odd array<long>"))


def met_entries(nodes: DataFrame, counts: np.ndarray, bits: int, part_size: int) -> DataFrame:
    """``(token, node, pos, matches, low)``: the prefix entries whose shingle
    several nodes hold, with the l of their node and the least l of the
    shingle's nodes. Entries of a shingle travel once, to one task; those that
    the counts show to be frequent are dealt over several keys, as many for
    all entries of a shingle."""
    spare = np.maximum(counts - 4 * counts.mean(), 0)
    hot = np.flatnonzero(spare > part_size)
    spark = nodes.sparkSession
    table = spark.createDataFrame([(int(b), int(spare[b] // part_size) + 1) for b in hot], "bucket long, parts int")
    entries = (nodes.select("node", "matches", F.posexplode("prefix").alias("pos", "token"))
               .withColumn("bucket", F.shiftrightunsigned("token", 64 - bits)))
    kept = ["token", "node", "pos", "matches", "low"]
    of = Window.partitionBy("token")                 # a rare shingle: as many entries as its bucket's count at most
    rare = (entries.join(F.broadcast(table), "bucket", "left_anti").drop("bucket")
            .withColumn("df", F.count(F.lit(1)).over(of)).withColumn("low", F.min("matches").over(of)).filter("df > 1").select(kept))
    if not len(hot):
        return rare
    entries = entries.join(F.broadcast(table), "bucket").drop("bucket")          # at most 2**bits rows are broadcast
    shared = (entries.groupBy("token", "parts").agg(F.count(F.lit(1)).alias("df"), F.min("matches").alias("low")).filter("df > 1")
              .select("token", "low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    dealt = entries.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A merge join at every size: the shared shingles grow with the documents.
    return rare.unionByName(dealt.join(shared.hint("merge"), ["token", "part"]).select(kept))


def asked(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v, shared)`` whose sizes allow the similarity and which
    share as many prefix shingles as the smaller l."""
    sizes = nodes.select("node", "n", "matches")
    both = (pairs.join(sizes.toDF("u", "n_u", "l_u"), "u").join(sizes.toDF("v", "n_v", "l_v"), "v"))
    return both.filter((F.lit(100) * F.least("n_u", "n_v") >= F.lit(percent) * F.greatest("n_u", "n_v"))
                       & (F.col("shared") >= F.least("l_u", "l_v"))).select("u", "v")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: lineage is cut and
    its size known, so that Spark broadcasts it only where it is small."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/ngram-join-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def core(met: DataFrame, nodes: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """The entries of nodes that can be in a link. The ends of a link share l
    shingles among their first ``prefix_length(n, l)``, for the smaller l of
    the two, so each of these shingles is held by a node whose own l is as
    small. (What of a prefix only its node holds may well be common: the other
    end's prefix may end before it.) What goes may leave shingles with one
    node, hence the rounds."""
    start = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int")
    of = Window.partitionBy("node")                  # one prefix
    enough = F.lit(False)
    for l in MATCHES:
        enough |= F.count_if((F.col("low") <= l) & (F.col("matches") >= l) & (F.col("pos") < start + l)).over(of) >= l
    kept = ["token", "node", "pos", "n", "matches"]
    met = met.join(nodes.select("node", "n"), "node")
    for _ in range(rounds):
        met = met.withColumn("able", enough).filter("able").select(kept)
        left = met.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("matches").alias("low")).filter("df > 1")
        met = met.join(left, "token")
    return met.select("token", "node", "pos", "df")


def near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` whose odd sketches do not show that the sets
    differ in more elements than a link may."""
    sides = nodes.select("node", "n", "odd")
    both = pairs.join(sides.toDF("u", "n_u", "x"), "u").join(sides.toDF("v", "n_v", "y"), "v")
    words = F.least(F.size("x"), F.size("y"))

    def narrow(c: str):                              # half as wide; wider than that the sizes of a link are not
        halves = F.zip_with(F.slice(c, F.lit(1), words), F.slice(c, words + 1, words), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(c) > words, halves).otherwise(F.col(c))

    differ = F.aggregate(F.zip_with(narrow("x"), narrow("y"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)
    # |x n y| >= percent |x u y| / 100 allows this much of |x| + |y| outside the intersection.
    possible = F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("n_u") + F.col("n_v"))
    return both.filter((F.greatest(F.size("x"), F.size("y")) > 2 * words) | possible).select(*pairs.columns)


def marked(rows: DataFrame, need: DataFrame, words: int = MARK_WORDS) -> DataFrame:
    """The rows whose ``id`` is in ``need`` and few others: a hash of each id
    asked for sets one of 64 * ``words`` bits, and that table is broadcast, of
    the same size at any size of ``need``."""
    h = F.xxhash64("id")
    word, bit = h.bitwiseAND(words - 1), F.shiftrightunsigned(h, 58).cast("int")
    marks = (need.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    return (rows.withColumn("word", word).join(F.broadcast(marks), "word").filter(F.getbit("bits", bit) == 1)
            .drop("word", "bits"))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int,
             percent: int) -> DataFrame:
    """Of the pairs ``(u, v)`` those whose sets have the Jaccard asked for.
    The sets are made again from the texts of the nodes' first documents; only
    the two texts of a pair travel, each once a pair."""
    ends = written(pairs.select("u", "v", F.explode(F.array("u", "v")).alias("node"))
                   .join(nodes.select("node", "key", F.col("least").alias("id")), "node").select("u", "v", "key", "id"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), texts(docs, text_col).cast("binary").alias("t"))
    # Merge joins at every size: what is asked grows with the documents.
    found = marked(rows, ends.select("id")).toDF("doc", "t")
    both = (ends.hint("merge").join(found, F.col("id").eqNullSafe(F.col("doc"))).select("u", "v", "key", "t")
            .repartition("u", "v").sortWithinPartitions("u", "v"))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        at, sets, before = None, {}, {}
        for b in batches:
            us, vs = [], []
            for u, v, key, t in zip(*(c.to_pylist() for c in b.columns)):
                if at != (u, v):
                    at, sets, before = (u, v), {}, sets
                if key in sets:                       # an id or a text may be repeated
                    continue
                h = before.get(key)
                if h is None:
                    h = shingles(t, words_per_shingle)
                    if xxhash.xxh3_128_digest(h.tobytes()) != key:
                        continue                      # another text of this id
                sets[key] = h
                if len(sets) == 2:
                    x, y = sets.values()
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        us.append(u)
                        vs.append(v)
            yield batch({"u": us, "v": vs}, schema)

    return both.mapInArrow(run, "u long, v long")


def counted(pairs: DataFrame) -> DataFrame:
    """``(u, v, shared)`` of rows ``(a, b)``, one for each shingle that both hold."""
    return (pairs.filter("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .agg(F.count(F.lit(1)).alias("shared")))


def fronts(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(token, front, others)``: of the nodes that hold a shingle the one
    with the fewest prefix shingles that no other node holds, then with the
    most frequent ones: the least edited of a group of near copies, the same
    one for all shingles of the group. ``others``: by either rule alone."""
    held = (met.groupBy("node").agg(F.sum("df").alias("df"), F.count(F.lit(1)).alias("m"))
            .join(nodes.select("node", F.size("prefix").alias("size")), "node"))
    top = (1 << 20) - 1
    own = F.least(F.col("size") - F.col("m"), F.lit(top)).cast("long")
    rare = F.lit(top) - F.least(F.floor(F.lit(16) * F.col("df") / F.col("size")), F.lit(top))
    tie = F.xxhash64("node").bitwiseAND(top)
    place = [own * F.lit(1 << 40) + rare * F.lit(1 << 20) + tie, own * F.lit(1 << 20) + tie, rare * F.lit(1 << 20) + tie]
    held = held.select("node", *[p.alias(f"p{i}") for i, p in enumerate(place)])
    return (met.join(held, "node").groupBy("token").agg(*[F.min_by("node", f"p{i}").alias(f"f{i}") for i in range(3)])
            .select("token", F.col("f0").alias("front"), F.array_distinct(F.array("f1", "f2")).alias("others")))


def apart(met: DataFrame, front: DataFrame, classed: DataFrame, tries: int) -> DataFrame:
    """``(u, v, shared)``: nodes outside the class of their shingle's front
    with ``tries`` members of that class, drawn by hashes of the nodes."""
    main = front.join(classed.withColumnRenamed("node", "front"), "front").select("token", F.col("class").alias("main"))
    rows = met.select("token", "node").join(classed, "node").join(main, "token")
    drawn = rows.filter("class = main").groupBy("token").agg(
        *[F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"f{i}") for i in range(tries)])
    drawn = drawn.select("token", F.array_distinct(F.array(*[f"f{i}" for i in range(tries)])).alias("drawn"))
    return counted(rows.filter("class <> main").join(drawn, "token").select(F.col("node").alias("a"), F.explode("drawn").alias("b")))


def joined(classed: DataFrame, links: DataFrame) -> DataFrame:
    """``classed`` after the links ``(u, v)`` have joined its classes."""
    between = (links.join(classed.toDF("u", "a"), "u").join(classed.toDF("v", "b"), "v")
               .select(F.col("a").alias("u"), F.col("b").alias("v")))
    top = components(between).toDF("class", "top")
    out = cut(classed.join(top, "class", "left").select("node", F.coalesce("top", "class").alias("class")))
    free_shuffles(out.sparkSession)
    return out


def crossing(met: DataFrame, classed: DataFrame, nodes: DataFrame, percent: int, part_size: int) -> DataFrame:
    """``(u, v, shared)``: pairs of nodes of different classes, with the number
    of prefix shingles they share. A shingle that many nodes hold is cut into
    hashed parts and every pair of parts is a group of its own. A pair is
    named where what follows a shared shingle on either side is enough for the
    intersection asked for, and the shingle among the first ones that the
    smaller l of the two asks for, as at the first one of every link."""
    classed = met.join(classed, "node")
    mixed = (classed.groupBy("token").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a <> z")
             .select("token"))
    rows = classed.join(mixed, "token", "left_semi").join(nodes.select("node", "n", "matches"), "node")
    rows = rows.withColumn("parts", F.ceil(F.col("df") / part_size).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.select("token", "node", "class", "n", "matches", "pos", "part",
                       F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("token", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part",
                       "node", "class", "n", "matches", "pos")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for g in whole_groups(batches, ["token", "lo", "hi"]):
            token, lo, hi, part, node, cls, n, l, pos = (g.column(c).to_numpy() for c in (
                "token", "lo", "hi", "part", "node", "class", "n", "matches", "pos"))
            new = (np.diff(token) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)
            ends = np.concatenate([np.flatnonzero(new) + 1, [len(token)]])
            end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
            for i, j in pairs_of(end):
                ok = (cls[i] != cls[j]) & ((part[i] != part[j]) | (lo[i] == hi[i]))
                a, b = n[i].astype(np.int64), n[j].astype(np.int64)
                least = -(-percent * (a + b) // (100 + percent))         # the intersection asked for
                smaller = np.minimum(l[i], l[j])
                ok &= np.minimum(a - pos[i], b - pos[j]) >= least
                ok &= (pos[i] < prefix_length(a, smaller, percent)) & (pos[j] < prefix_length(b, smaller, percent))
                i, j = i[ok], j[ok]
                yield batch({"u": pa.array(np.minimum(node[i], node[j])), "v": pa.array(np.maximum(node[i], node[j]))}, schema)

    rows = rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    pairs = rows.mapInArrow(run, "u long, v long").distinct()
    if "odd" in nodes.columns:
        pairs = written(near(pairs, nodes, percent))
    ends = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("node")).join(nodes.select("node", "prefix"), "node")
    both = ends.groupBy("u", "v").agg(*[F.first(F.when(F.col("node") == F.col(e), F.col("prefix")), ignorenulls=True).alias(name)
                                        for e, name in (("u", "x"), ("v", "y"))])
    return both.select("u", "v", F.size(F.array_intersect("x", "y")).alias("shared"))


def pairs_of(end: np.ndarray, chunk: int = 1 << 20):
    """Index arrays ``(i, j)`` of all ``i < j < end[i]``, some ``chunk`` pairs at a time."""
    index = np.arange(len(end))
    many = end - index - 1
    upto = np.cumsum(many)
    at = 0
    while at < len(end):
        done = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + chunk, side="right")))
        i = np.repeat(index[at:stop], many[at:stop])
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(upto[at:stop] - many[at:stop] - done, many[at:stop])
        at = stop


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE,
                 percent: int = PERCENT, sketch_bits: int = SKETCH_BITS, part_size: int = 1024,
                 tries: int = TRIES) -> DataFrame:
    """``(<id_col>, n_shingles, component_id, n_equal)`` per row of ``docs``.

    Rows link when ``100 * common >= percent * union`` of their sets of
    distinct word shingles; ``component_id`` is the smallest id reachable by
    links, the row's own included; ``n_equal`` the number of rows (itself
    included) whose set is equal.

    A word is a run of bytes other than space and \\t\\n\\v\\f\\r, A-Z
    lower-cased; fewer words than a shingle make one shingle. Null and empty
    texts and such without words have the empty set, which links with nothing
    (``component_id`` is the row's id, ``n_equal`` 1). Rows with a null id
    link like others; a component of such rows alone has the id null. Repeated
    rows each get their row. Ties (equal counts in the global order) go by the
    shingle's hash and change no result. An empty table gives an empty result.
    Whole texts are used, however long; a task holds one set at a time (four
    in verification). Other columns, whatever their names, are ignored.
    """
    text = f"`{text_col}`"
    counts = sketch(docs, text, words_per_shingle, sketch_bits)
    made = cut(signed(docs, counts, id_col, text, words_per_shingle, percent, sketch_bits))
    nodes = cut(made.filter("n > 0").groupBy("key").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("n_equal"),
        *[F.first(c).alias(c) for c in ("n", "matches", "prefix", "odd")])
        .withColumn("node", F.monotonically_increasing_id()))
    made = cut(made.select("id", "n", "key"))        # the prefixes are held once from here on
    free_shuffles(docs.sparkSession)
    met = cut(met_entries(nodes, counts, sketch_bits, part_size))
    free_shuffles(docs.sparkSession)
    met = cut(core(met, nodes, percent))
    free_shuffles(docs.sparkSession)

    def links(pairs: DataFrame) -> DataFrame:
        return verified(pairs, nodes, docs, id_col, text, words_per_shingle, percent)

    def drawn(pairs: DataFrame) -> DataFrame:
        return links(near(asked(pairs, nodes, percent), nodes, percent))

    front = cut(fronts(met, nodes))
    classed = nodes.select("node", F.col("node").alias("class"))
    first = F.explode(F.array_distinct(F.concat(F.array("front"), "others")))
    classed = joined(classed, drawn(counted(met.join(front, "token").select(F.col("node").alias("a"), first.alias("b")))))
    classed = joined(classed, drawn(apart(met, front, classed, tries)))
    classed = joined(classed, links(asked(crossing(met, classed, nodes, percent, part_size), nodes, percent)))
    classes = nodes.join(classed, "node").select("key", "least", "n_equal", F.col("class").alias("root"))
    first = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(first, "root").select("key", "n_equal", "component_id")
    return (made.select("id", "n", "key").join(classes, "key", "left")
            .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                    F.coalesce("n_equal", F.lit(1)).alias("n_equal")))
