"""MinHash fingerprints against plain Python and exact Jaccard."""

import hashlib
import random

import numpy as np

from claimgeo.llm import minhash

from ..conftest import SF001


def plain(rows):
    """Expected (id, n_chars, edited sha) in the documented order."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] if r[0] is not None else -2 ** 63, r[1].encode()), reverse=True)
    out = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        new = t[:len(t) - k] + nxt[:k]
        out.append((str(i), len(t), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out)


def jaccard(x, y):
    def sh(t):
        w = t.encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    a, b = sh(x), sh(y)
    return len(a & b) / len(a | b)


def got(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in df.collect())


def test_query_table_in_many_ranges(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for per in (7, 500):
        df = minhash.succession_fingerprints(docs, rows_per_range=per)
        out = df.collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == plain(rows)
    text = dict(rows)
    order = sorted(text, reverse=True)
    follow = dict(zip(order, order[1:] + order[:1]))
    by = {r.doc_id: r for r in out}
    miss = []
    for i, r in by.items():
        t, n = text[i], text[follow[i]]
        miss += [r.near_edited - jaccard(t, minhash.edited(t, n)), r.near_next - jaccard(t, n)]
        assert r.near_next == sum(by[follow[i]].fingerprint[k:k + 4] == r.fingerprint[k:k + 4] for k in range(0, 512, 4)) / 128
    assert np.abs(miss).max() < 0.2 and np.abs(np.mean(miss)) < 0.01


def test_signature_estimates_jaccard():
    rng = random.Random(4)
    make = minhash.Fingerprinter()
    for share in (0.2, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            x = [str(rng.random()) for _ in range(400)]
            y = x[:int(400 * share)] + [str(rng.random()) for _ in range(400 - int(400 * share))]
            a, b = " ".join(x), " ".join(y)
            errors.append(minhash.likeness(make(a.encode()), make(b.encode())) - jaccard(a, b))
        assert abs(np.mean(errors)) < 0.03


def test_nulls_ties_repeats_single_and_empty(spark):
    long = " ".join(str(i * i) for i in range(40_000))
    rows = [(5, None), (3, ""), (3, "bb aa"), (3, "aa bb"), (3, "aa bb"), (None, "no id é😀"), (9, long), (1, "ééé😀😀😀 x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS range", "'t' AS t", "3 AS id")
    for per in (1, 500):
        assert got(minhash.succession_fingerprints(docs, rows_per_range=per)) == plain(rows)
    prints = minhash.fingerprints(docs).collect()
    assert len({r.fingerprint for r in prints if r.doc_id == 5} | {r.fingerprint for r in prints if r.doc_id == 3}) == 3
    one = spark.createDataFrame([(4, "x y z")], "doc_id long, text string")
    assert got(minhash.succession_fingerprints(one)) == plain([(4, "x y z")])
    assert minhash.succession_fingerprints(one.limit(0)).count() == 0


def plain_classes(rows, threshold=0.8):
    rows = [(i, t or "") for i, t in rows if i is not None]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for a, (i, t) in enumerate(rows):
        for j, u in rows[:a]:
            if t == u or jaccard(t, u) >= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_band_joined_classes_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    base = [str(rng.random()) for _ in range(120)]
    for k in range(60):                       # near copies of one text, among them chains
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = str(rng.random())
        rows.append((10_000 + k, " ".join(w)))
    rows += [(20_000, None), (20_001, ""), (20_002, "a b"), (20_003, "A  b"), (20_002, "a b")]
    docs = spark.createDataFrame(rows + [(None, "x y")], "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS key")
    want = plain_classes(rows)
    for part_size in (16, 1024):
        out = minhash.near_duplicates(docs, part_size=part_size).collect()
        assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == want and len(out) == len(rows) + 1
        assert [r.class_id for r in out if r.doc_id is None] == [None]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_forest_connects_what_is_connected():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 3, (40, 24))
    sig[10:20] = sig[0]
    sig[15, :3] = 9
    for least in (0.4, 0.6, 0.9):
        root = list(range(40))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for i, j in minhash._forest(sig, least):
            root[find(i)] = find(j)
        for i in range(40):
            seen, todo = {i}, [i]
            while todo:
                x = todo.pop()
                for y in np.flatnonzero((sig == sig[x]).mean(axis=1) >= least):
                    if int(y) not in seen:
                        seen.add(int(y))
                        todo.append(int(y))
            assert seen == {k for k in range(40) if find(k) == find(i)}
