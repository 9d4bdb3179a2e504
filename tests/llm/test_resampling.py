"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from claimgeo.llm import resampling

from ..conftest import SF001


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    grams = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def plain(rows, target, min_words=20, percent=5):
    """Rows ``(id, n_features, weight, score, rank)`` in the order of ``rows``."""
    made = [plain_features(t) for _, t in rows]
    s = Counter(b for _, bs in made for b in bs)
    t = Counter(b for x in target for b in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)}
    out = []
    for (i, _), (n, bs) in zip(rows, made):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in bs)
        out.append([i, len(bs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((k for k, r in enumerate(out) if r[5] >= min_words),
                  key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, k in enumerate(able[:percent * len(able) // 100], 1):
        out[k][4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_table_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    target = spark.read.parquet(f"{SF001}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    have = got(resampling.resample(docs, target))
    assert have == want
    assert sorted(r[4] for r in have if r[4]) == list(range(1, 1 + sum(r[4] is not None for r in have))) != []


def awkward():
    rng = random.Random(7)
    words = ["One", "two", "drei", "été", "4th", "x" * 300, "ß1"]
    long = " ".join(rng.choice(words) for _ in range(9000))
    return ([(5, None), (3, ""), (9, " ,;\t\n"), (7, "One"), (8, "a b"), (4, long), (4, long), (None, long + " end"), (None, None)]
            + [(100 + i, " ".join(rng.choice(words) for _ in range(19 + i % 3)) + rng.choice(["", ".", "\x00\x7f", "　"])) for i in range(60)])


@pytest.mark.parametrize("size", [1, 50, 1000, 1 << 19])
def test_awkward_rows_in_batches_of_any_size(spark, monkeypatch, size):
    rows = awkward()
    found = {}
    for docs, buckets, words in resampling.features([(t or "").encode() for _, t in rows], size=size):
        for d, b in zip(docs.tolist(), buckets.tolist()):
            found.setdefault(d, Counter())[b] += 1
        for d in words.tolist():
            found.setdefault(("words", d), Counter())[0] += 1
    for d, (_, t) in enumerate(rows):
        n, bs = plain_features(t)
        assert found.get(d, Counter()) == Counter(bs)
        assert found.get(("words", d), Counter())[0] == n


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr(
        "*", "1 AS id", "'x' AS row", "2 AS at", "3 AS place", "4 AS bucket", "5 AS `n.words`")
    target = spark.createDataFrame([("One two drei two drei two",), (None,), ("",)], "text string")
    assert got(resampling.resample(docs, target, percent=30)) == plain(rows, ["One two drei two drei two"], percent=30)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert got(resampling.resample(docs, docs)) == []
    assert got(resampling.resample(some, docs, percent=100)) == plain([(1, "a " * 30)], [], percent=100)


def test_places_over_many_partitions(spark):
    df = spark.range(1000).repartition(17).selectExpr("id", "id % 7 AS k")
    got = [(r.k, r.id) for r in resampling.places(df, "k", "id").orderBy("place").collect()]
    assert got == sorted((i % 7, i) for i in range(1000))


def test_drawn_documents_are_nearer_to_the_target(spark):
    rng = random.Random(3)
    near, far = [f"t{i}" for i in range(40)], [f"f{i}" for i in range(40)]
    text = lambda ws: " ".join(rng.choice(ws) for _ in range(60))
    docs = spark.createDataFrame([(i, text(near if i % 10 == 0 else far)) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(text(near),) for _ in range(20)], "text string")
    drawn = [r.doc_id for r in resampling.resample(docs, target).filter("rank IS NOT NULL").collect()]
    assert len(drawn) == 20 and all(i % 10 == 0 for i in drawn)
