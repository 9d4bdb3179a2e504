"""Cross-entropy difference against a plain-Python model."""

import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from claimgeo.llm import lm
from claimgeo.llm.common import table
from claimgeo.llm.queries import QUERIES

from ..conftest import SF001, SF01


def plain(rows, words, unknown, smoothing):
    """rows: (id, text, is_target) -> {id: (n, ce_t, ce_b)}"""
    split = lambda t: (t or "").encode().lower().split()
    n = Counter(w for _, t, _ in rows for w in split(t))
    known = sorted(n, key=lambda w: (-n[w], w))[:words]
    cls = {w: i + 1 for i, w in enumerate(known)}
    code = lambda w: cls.get(w) or len(known) + 1 + xxhash.xxh32_intdigest(w) % unknown
    size = len(known) + 1 + unknown
    bi, uni, ctx = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    seqs = []
    for i, t, target in rows:
        ids = [0] + [code(w) for w in split(t)]
        seqs.append((i, ids))
        s = 0 if target else 1
        for h, w in zip(ids, ids[1:]):
            bi[s][h, w] += 1
            uni[s][w] += 1
            ctx[s][h] += 1
    out = []
    for i, ids in seqs:
        ce = []
        for s in (0, 1):
            total = sum(uni[s].values()) + size - 1
            ps = [(bi[s][h, w] + smoothing * (uni[s][w] + 1) / total) / (ctx[s][h] + smoothing) for h, w in zip(ids, ids[1:])]
            ce.append(-sum(map(math.log, ps)) / max(1, len(ps)))
        out.append((i, len(ids) - 1, *ce))
    return out


def test_table_against_plain_models(spark):
    docs = table(spark, SF001, "documents")
    rows = [(r.doc_id, r.text, r.source == "src1") for r in docs.collect()]
    want = {i: x for i, *x in plain(rows, 50, 7, 5.0)}
    got = lm.cross_entropy_difference(docs, F.col("source") == "src1", words=50, unknown=7, smoothing=5.0).collect()
    assert len(got) == len(rows)
    for r in got:
        n, t, b = want[r.doc_id]
        assert r.n_tokens == n and (r.ce_target, r.ce_background, r.ce_difference) == pytest.approx((t, b, t - b), abs=1e-9)


def test_held_out_targets_score_lower(spark):
    """German as the target, half of it held out of its model."""
    docs = table(spark, SF01, "documents")
    out = lm.cross_entropy_difference(docs, (F.col("lang") == "de") & (F.col("doc_id") % 2 == 0))
    rows = out.join(docs, "doc_id").filter("doc_id % 2 = 1 and n_tokens > 20").select("lang", "ce_difference").collect()
    de, other = [r[1] for r in rows if r[0] == "de"], [r[1] for r in rows if r[0] == "es"]
    assert sum(a < b for a in de for b in other) > 0.95 * len(de) * len(other)


def test_nulls_empty_long_repeated_and_empty_tables(spark):
    rows = [(1, "a b a b", True), (1, "a b a b", True), (2, None, False), (3, "", None), (4, "c " * 60_000, False), (None, "é A", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean").selectExpr("*", "1 AS t", "2 AS id", "3 AS is_target")
    got = lm.cross_entropy_difference(docs, F.col("good"), words=3, unknown=2).collect()
    want = plain(rows, 3, 2, lm.SMOOTHING)
    key = lambda x: (str(x[0]), x[1])
    for g, w in zip(sorted([(r.doc_id, r.n_tokens, r.ce_target, r.ce_background) for r in got], key=key), sorted(want, key=key)):
        assert g == pytest.approx(w, abs=1e-9) if g[0] is not None else g[1:] == pytest.approx(w[1:], abs=1e-9)
    assert lm.cross_entropy_difference(docs.limit(0), F.col("good")).count() == 0
    assert lm.cross_entropy_difference(docs.filter("doc_id = 1"), F.lit(True)).count() == 2


def test_whole_vocabulary_against_plain_models(spark):
    """No words beyond the corpus's own and every word its own class; hot and
    bucketed bigrams score alike."""
    docs = table(spark, SF001, "documents")
    rows = [(r.doc_id, r.text, r.source == "src1") for r in docs.collect()]
    distinct = len({w for _, t, _ in rows for w in (t or "").encode().lower().split()})
    want = {i: x for i, *x in plain(rows, distinct, 0, lm.SMOOTHING)}
    for options in ({}, {"hot_words": 3, "bucket_tokens": 5_000}, {"hot_words": 3, "coded_words": 40, "bucket_tokens": 5_000},
                    {"hot_words": 0, "coded_words": 0}):
        got = lm.cross_entropy_difference(docs, F.col("source") == "src1", words=None, **options).collect()
        assert len(got) == len(rows)
        for r in got:
            n, t, b = want[r.doc_id]
            assert r.n_tokens == n and (r.ce_target, r.ce_background, r.ce_difference) == pytest.approx((t, b, t - b), abs=1e-9)


def test_rare_words_tell_documents_apart(spark):
    """Documents of common words and one rare word each, known to one side."""
    common = " ".join(f"w{i}" for i in range(1200))
    rows = [(i, f"{common} {common} rare{i % 500}x{i % 2}", i % 2 == 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean").repartition(4)
    got = {r.doc_id: r.ce_difference for r in lm.cross_entropy_difference(docs, F.col("good"), words=None).collect()}
    assert max(got[i] for i in range(0, 2000, 2)) < min(got[i] for i in range(1, 2000, 2))


def test_query_uses_the_whole_vocabulary(spark):
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    rows = [(r.doc_id, r.text, r.doc_id in good) for r in docs.collect()]
    distinct = len({w for _, t, _ in rows for w in (t or "").encode().lower().split()})
    want = {i: x for i, *x in plain(rows, distinct, 0, lm.SMOOTHING)}
    got = QUERIES["op10_lm_scoring"](spark, SF001).collect()
    assert len(got) == len(rows)
    for r in got:
        n, t, b = want[r.doc_id]
        assert r.n_tokens == n and (r.ce_target, r.ce_background, r.ce_difference) == pytest.approx((t, b, t - b), abs=1e-9)


def test_targets_as_a_table_of_ids(spark):
    """Null and repeated ids among the targets and the rows; clashing names; a rare word with many occurrences."""
    rows = [(i, f"w{i % 7} spam x{i} spam y{i % 3}") for i in range(300)] + [(5, "w5 once more"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS known", "3 AS hit", "4 AS is_good")
    ids = [*range(0, 300, 4), 5, 5, None, 9999]
    good = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    triples = [(i, t, i is not None and i in ids) for i, t in rows]
    distinct = len({w for _, t in rows for w in t.split()})
    key = lambda x: (str(x[0]), *x[1:])
    want = sorted(plain(triples, distinct, 0, lm.SMOOTHING), key=key)
    got = lm.cross_entropy_difference(docs, good, words=None, hot_words=2, coded_words=5, bucket_tokens=100).collect()
    for g, w in zip(sorted([(r.doc_id, r.n_tokens, r.ce_target, r.ce_background) for r in got], key=key), want, strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=1e-9)
