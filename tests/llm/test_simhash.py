"""SimHash near-duplicates against brute force."""

import re
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from claimgeo.llm import graph, simhash

from ..conftest import SF001


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, radius=4):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, i in enumerate(ids):
        for j in ids[a + 1:]:
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def got(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_query_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    comp = plain_components(fps)
    assert got(simhash.near_duplicates(docs)) == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_nulls_empty_long_repeated_and_extra_columns(spark):
    long = " ".join(random.Random(1).choice(["a", "bb", "ccc", "é", " x"]) for _ in range(60_000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (7, "One two"), (8, "one TWO"), (4, long), (4, long), (None, "one two"),
            (None, "nothing else like it here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS node", "2 AS key")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert {by[i].component_id for i in (3, 5, 9)} == {3} and by[3].fingerprint == "0" * 16
    assert by[7].component_id == by[8].component_id == 7
    assert by[4].fingerprint == f"{plain_fingerprint(long):016x}" and by[4].component_id == 4
    assert sorted((r.component_id is None, r.component_id) for r in out if r.doc_id is None) == [(False, 7), (True, None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(docs).count() == 0


def test_near_pairs_is_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    fp = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)] + [base])
    for radius in (0, 1, 3, 4, 7):
        for runs in ([len(fp)], [1, 2, 100, len(fp) - 103]):
            ends = np.repeat(np.cumsum(runs), runs)
            want = {(i, j) for i in range(len(fp)) for j in range(i + 1, ends[i])
                    if int(fp[i] ^ fp[j]).bit_count() <= radius}
            have = set()
            for i, j in simhash.near_pairs(fp, ends, radius, chunk=50):
                have |= set(zip(i.tolist(), j.tolist()))
            assert have == want


def test_hot_key_is_cut_into_parts_without_losing_links(spark):
    rng = random.Random(5)
    fps, x = {}, 0x0123456789ABCDEF
    for i in range(300):                    # a chain: neighbours differ in 3 bits, ends in many
        fps[i] = x
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(i, sign(v)) for i, v in fps.items()], "node long, fp long")
    for part_size in (7, 4096):
        roots = {r.node: r.root for r in graph.components(simhash.links(nodes, 4, part_size)).collect()}
        assert {i: roots.get(i, i) for i in fps} == plain_components(fps)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1300)]
    edges = spark.createDataFrame(path + star + [(7, 7)], "u long, v long").orderBy(F.rand(1))
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}
