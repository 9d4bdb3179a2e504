"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgeo.llm import ngram_join

from ..conftest import SF001, SF01


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) or (frozenset([tuple(w)]) if w else frozenset())


def plain(rows, percent=90):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                c = len(x & y)
                if 100 * c >= percent * (len(x) + len(y) - c):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((v for v in (least.get(r), d) if v is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)], max(1, sum(s == sets[i] for s in sets) if sets[i] else 1))
                   for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "n_equal"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_query_table_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got(ngram_join.similar_sets(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def edits(rng, words, count, vocabulary):
    out = list(words)
    for _ in range(count):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return " ".join(out)


def families(seed, members, length):
    """Texts around the threshold: copies of a few texts with 0 to 4 % of the words edited, and mixtures."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, length))] for _ in range(12)]
    rows = []
    for i in range(members):
        base = rng.choice(bases)
        rows.append(edits(rng, base, rng.randrange(0, 1 + len(base) // 25 + (i % 3 == 0)), vocabulary))
    rows += [" ".join(b + bases[0]) for b in bases]
    return [(rng.randrange(10 ** 6), t) for t in rows]


@pytest.mark.parametrize("seed,length,part_size", [(1, 40, 1024), (2, 150, 5), (3, 12, 3)])
def test_links_around_the_threshold_are_all_found(spark, seed, length, part_size):
    rows = families(seed, 260, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert got(ngram_join.similar_sets(docs, part_size=part_size)) == want
    assert 12 < len({r[2] for r in want}) < len(rows)


def test_a_small_sketch_changes_nothing(spark):
    rows = families(4, 150, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (1, 6):
        assert got(ngram_join.similar_sets(docs, sketch_bits=bits)) == plain(rows)
    assert got(ngram_join.similar_sets(docs, percent=70)) == plain(rows, 70)


def test_one_group_of_near_copies_holding_most_rows(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows = [(i, edits(rng, base, rng.choice([1, 2]), vocabulary)) for i in range(400)]
    rows += [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(100))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.similar_sets(docs, part_size=64)) == plain(rows)


def test_nulls_empty_short_long_repeated_and_clashing_columns(spark):
    rng = random.Random(1)
    long = [rng.choice(["a", "bb", "ccc", "é"]) + str(rng.randrange(4000)) for _ in range(30_000)]
    rows = [(5, None), (3, ""), (9, " \t\n"), (7, "One two"), (8, "one\vTWO"), (2, "one two three"), (None, "one two three"),
            (4, " ".join(long)), (4, " ".join(long)), (6, " ".join(long[:-900])), (None, " ".join(long[:-1700])),
            (11, " ".join(long[:-2800])), (None, "no such text anywhere"), (None, None), (1, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS id", "'x' AS key", "2 AS n", "3 AS node", "4 AS `a.b`")
    want = plain(rows)
    assert got(ngram_join.similar_sets(docs)) == want
    assert {r[2] for r in want if r[0] in (4, 6, 11)} == {4}          # 11 is reached over a row without an id


def test_every_link_is_among_the_pairs_of_the_join(spark):
    """Also where the prefix of one end goes on beyond that of the other, and where the ends ask for different numbers."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(102)]
    rows = [" ".join(base)] + [" ".join(base + [f"own{j}_{i}" for i in range(n)]) for j, n in enumerate((10, 10, 9, 3))]
    rows += [" ".join(base[k:] + [f"end{k}"]) for k in range(6)] + [t for _, t in families(7, 120, 90)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    counts = ngram_join.sketch(docs, "text", 3, 18)
    made = ngram_join.signed(docs, counts, "doc_id", "text", 3, 90, 18)
    options = [o for o in ngram_join.MATCHES if o <= 8]
    for mixed in (False, True):
        nodes = [r.asDict() for r in made.filter("n > 0").dropDuplicates(["key"]).collect()]
        sets = {r["id"]: plain_set(rows[r["id"]]) for r in nodes}
        for r in nodes:
            if mixed:                                 # any l of its own, as hot shingles would make it
                h = ngram_join.shingles(rows[r["id"]].encode())
                c = counts[ngram_join.bucket(h, 18)]
                r["matches"] = rng.choice([o for o in options if ngram_join.prefix_length(r["n"], o, 90) <= r["n"]])
                r["prefix"] = h[np.lexsort((h, c))][:ngram_join.prefix_length(r["n"], r["matches"], 90)].view(np.int64).tolist()
        table = spark.createDataFrame([(r["id"], r["n"], r["matches"], r["prefix"]) for r in nodes],
                                      "node long, n int, matches int, prefix array<long>").localCheckpoint()
        met = ngram_join.core(ngram_join.met_entries(table, counts, 18, 1024), table, 90).localCheckpoint()
        pairs = ngram_join.crossing(met, table.select("node", F.col("node").alias("class")), table, 90, 16)
        found = {(r.u, r.v) for r in ngram_join.asked(pairs, table, 90).collect()}
        links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
        assert len(links) >= 50 and links <= found


def test_only_pairs_that_may_be_links_are_verified(spark, monkeypatch):
    """Texts 0.6 to 0.8 alike share prefix shingles; their whole texts or sets must not travel for that."""
    rng = random.Random(11)
    rows = []
    for f in range(8):
        base = [f"b{f}_{i}" for i in range(300)]
        for k in range(30):
            at = rng.randrange(270)
            rows.append((len(rows), " ".join(base[:at] + [f"own{f}_{k}_{i}" for i in range(22)] + base[at + 22:])))
    rows += [(1000 + i, t + " end") for i, t in rows[::40]]
    asked, real = [], ngram_join.verified

    def counting(pairs, *rest):
        pairs = pairs.localCheckpoint()
        asked.append(pairs.count())
        return real(pairs, *rest)
    monkeypatch.setattr(ngram_join, "verified", counting)
    want = plain(rows)
    assert got(ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert len(rows) - len({r[2] for r in want}) == 6 and 6 <= sum(asked) <= 20


def test_odd_sketches_bound_the_difference_at_any_two_widths():
    rng = np.random.default_rng(5)
    for n, m, common in ((0, 0, 0), (1, 1, 0), (64, 65, 60), (120, 130, 118), (1000, 1030, 950), (3000, 3000, 0)):
        h = np.unique(rng.integers(0, 2 ** 64, n + m, dtype=np.uint64))
        x, y = h[:n], h[n - common:n - common + m]
        a, b = ngram_join.odd_bits(x), ngram_join.odd_bits(y)
        for wide in (a, b):
            assert len(wide) & (len(wide) - 1) == 0
        while len(a) != len(b):
            a, b = (a[:len(a) // 2] ^ a[len(a) // 2:], b) if len(a) > len(b) else (a, b[:len(b) // 2] ^ b[len(b) // 2:])
        differ = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64))
        assert differ <= len(np.setxor1d(x, y)) and (differ > 0) == (len(np.setxor1d(x, y)) > 0)


def test_marks_keep_all_ids_asked_for_and_few_others(spark):
    rows = spark.range(-20_000, 20_000).selectExpr("id", "'t' AS t").unionAll(spark.sql("SELECT CAST(NULL AS LONG), 'n'"))
    need = spark.sql("SELECT id * 7 AS id FROM range(-50, 50) UNION ALL SELECT NULL")
    kept = [r.id for r in ngram_join.marked(rows, need, 1 << 10).collect()]
    assert {7 * i for i in range(-50, 50)} | {None} <= set(kept) and 101 <= len(kept) < 400


def test_empty_table(spark):
    assert got(ngram_join.similar_sets(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_prefixes_and_costs():
    assert ngram_join.prefix_length(10, 1, 90) == 2 and ngram_join.prefix_length(1, 1, 90) == 1
    rare, met = np.zeros(400), np.full(400, 3000.0)
    assert ngram_join.choose_matches(rare, 400, 90) == 1
    assert ngram_join.choose_matches(met, 400, 90) > 8
    for n in (1, 2, 5, 30):
        assert ngram_join.prefix_length(n, ngram_join.choose_matches(met[:n], n, 90), 90) <= n


def test_pairs_of_is_exact():
    end = np.array([3, 3, 3, 4, 9, 9, 9, 9, 9])
    for chunk in (1, 4, 100):
        pairs = [(int(a), int(b)) for i, j in ngram_join.pairs_of(end, chunk) for a, b in zip(i, j)]
        assert sorted(pairs) == [(i, j) for i in range(9) for j in range(i + 1, end[i])]
