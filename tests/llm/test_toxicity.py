"""Toxicity: the index against brute-force cosines, held-out accuracy, edge rows."""

import random
import zlib

import numpy as np

from claimgeo.llm import toxicity

from ..conftest import SF01


def test_index_returns_the_exact_nearest_examples():
    rng = np.random.default_rng(0)
    rows, dense = [], np.zeros((500, 40))
    for e in range(500):
        t = sorted(rng.choice(40, rng.integers(1, 6), replace=False).tolist())
        w = toxicity.weigh(t, rng.integers(1, 5, len(t)), np.linspace(1, 3, 40))
        rows.append((e, int(e % 3 == 0), t, w))
        dense[e, t] = w
    index = toxicity.BlockMaxIndex.build(rows, 40)
    for _ in range(100):
        t = sorted(rng.choice(40, 3, replace=False).tolist())
        w = toxicity.weigh(t, [1, 2, 1], np.linspace(1, 3, 40))
        q = np.zeros(40)
        q[t] = w
        near, cosine = index.nearest(t, w, 25)
        true = np.sort(dense @ q)[::-1][:25]
        assert np.allclose(cosine, true[true > 0][:len(cosine)]) and len(cosine) == (true > 0).sum()
        assert np.allclose(dense[index.ids[near]] @ q, cosine)


def test_held_out_documents_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    out = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert len(out) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    bad = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron"}
    rude = {r.doc_id for r in docs.collect() if bad & set(toxicity.terms(r.text))}
    held = [i for i in truth if out[i].held_out]
    assert sum(out[i].predicted for i in held if i in rude) >= 0.8 * sum(i in rude for i in held)
    assert sum(out[i].predicted for i in held if not truth[i]) <= 0.03 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_nulls_empty_repeated_long_and_extra_columns(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(20)) + (" vile" if i % 2 else "")) for i in range(80)]
    docs = rows + [(100, None), (101, ""), (102, "vile " * 50_000), (None, "vile"), (3, rows[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS id", "3 AS t")
    lab = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(5, 0), (None, 1), (6, None)],
                                "doc_id long, toxic int")
    out = toxicity.scores(d, lab).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[102].predicted == 1 and by[100].predicted == by[101].predicted == 0
    assert by[100].score == by[101].score and by[100].evidence == []
    assert [r.predicted for r in out if r.doc_id is None] == [1]
    assert {e.toxic for e in by[102].evidence} == {1}
    assert all(by[i].predicted == i % 2 for i in range(80))


def test_labels_of_the_held_out_fold_are_never_learnt(spark):
    rows = [(i, "vile thing" if zlib.crc32(str(i).encode()) % 5 == 0 else "fair thing") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int("vile" in t)) for i, t in rows], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.scores(d, lab).collect()} == {0}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scores(d, lab).count() == 0
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.scores(one, lab).collect()] == [0]
