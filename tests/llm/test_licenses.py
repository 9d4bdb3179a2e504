"""License scans against brute-force containment."""

import random

import numpy as np

from claimgeo.llm import licenses as L
from claimgeo.llm.common import table

from ..conftest import SF01


def contained(text, template):
    """Greatest share of the template's shingles in any stretch of twice its length."""
    w, t = L.words_of((text or "").encode()), L.words_of(template.encode())
    own = set(L.shingles(t))
    have = L.shingles(w)
    span = 2 * max(1, len(t) - 4)
    return max((len(own & set(have[i:i + span])) / len(own) for i in range(max(1, len(have) - span + 1))), default=0.0)


def test_table_against_brute_force(spark):
    docs = table(spark, SF01, "documents")
    got = {(r.doc_id, r.license) for r in L.licenses(docs).collect()}
    want = {(d.doc_id, name) for d in docs.collect() for name, t in L.TEMPLATES.items()
            if "icens" in d.text and contained(d.text, t) >= 0.8}
    assert got == want and len({n for _, n in want}) >= 4


def test_planted_and_damaged_notices():
    rng = random.Random(9)
    scanner = L.Scanner(L.TEMPLATES)
    filler = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))
    texts, plans = [], []
    for _ in range(40):
        for name, t in L.TEMPLATES.items():
            w = t.split()
            if len(w) > 30:                                   # a few words replaced still leave 0.8 of the shingles
                w[rng.randrange(len(w))] = "zzz"
            texts.append(f"{filler(rng.randint(0, 300))} {' '.join(w).upper()} {filler(rng.randint(0, 300))}".encode())
            plans.append(name)
    for name, hits, text in zip(plans, scanner.scan(texts), texts):
        share = {n: c for n, c, _, _ in hits}
        assert name in share and abs(share[name] - contained(text.decode(), L.TEMPLATES[name])) < 1e-9


def test_bands_keep_their_promise():
    rng = np.random.default_rng(1)
    scanner = L.Scanner({"t": " ".join(f"w{i}" for i in range(12))})
    stride, _, values = scanner.classes[0]
    template = scanner.templates[0][2]
    missed = 0
    for _ in range(2000):
        part = np.concatenate([rng.choice(template, 7, replace=False), rng.integers(0, 1 << 32, 2 * stride - 7).astype(np.uint32)])
        missed += not (scanner.bands(part)[:len(values)].min(axis=1) == values[:, 0]).any()
    assert missed <= 2


def test_nulls_empty_long_repeats_and_empty_table(spark):
    note = L.TEMPLATES["MIT"]
    long = "word " * 60_000
    rows = [(1, note), (1, note), (2, None), (3, ""), (4, long + note + " " + long), (None, note), (5, "MIT License"), (6, "?!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS license", "2 AS id", "'t' AS t")
    got = sorted((str(r.doc_id), r.license, r.containment, r.first_word, r.end_word) for r in L.licenses(docs).collect())
    assert got == sorted([("1", "MIT", 1.0, 0, 5)] * 2 + [("4", "MIT", 1.0, 60_000, 60_005), ("None", "MIT", 1.0, 0, 5)])
    assert L.licenses(docs.limit(0)).count() == 0 and L.licenses(docs, templates={"x": "?"}).count() == 0
    assert {r.license for r in L.licenses(docs, templates={"a": "MIT license", "b": "mit LICENSE."}).collect()} == {"a", "b"}
