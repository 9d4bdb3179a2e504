"""Benchmark decontamination against plain edit distance."""

import random

from claimgeo.llm import decontam

from ..conftest import SF001


def plain(pattern, text):
    """Best (distance, first end) of pattern anywhere in text, full table."""
    col = list(range(len(pattern) + 1))
    best = (col[-1], 0)
    for at, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(col[i - 1] + (p != c), col[i] + 1, new[i - 1] + 1))
        col = new
        if col[-1] < best[0]:
            best = (col[-1], at)
    return best


def test_myers_equals_the_full_table():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        want = plain(p, t)
        for e in (0, 3, len(p)):
            got = decontam.myers(decontam.symbol_bits(p), len(p), t, e)
            if want[1] and want[0] <= e:
                assert got == want
            elif want[0] > e:
                assert got is None


def test_finds_every_occurrence_within_the_budget():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "pi", "rho", "sigma"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(1, 30))) for i in range(25)]
    matcher = decontam.Matcher(items, 0.1)
    for _ in range(60):
        i, item = rng.choice(items)
        edited = list(item)
        for _ in range(rng.randint(0, len(item) // 8)):
            edited[rng.randrange(len(edited))] = rng.choice("abxyz")
        text = say(20) + " " + "".join(edited) + " " + say(20)
        have = {h[0]: h for h in matcher.find(text)}
        t = decontam.normal(text)
        for item_id, body in items:
            p = decontam.normal(body)
            e = decontam.budget(len(p), 0.1)
            want = plain(p, t)
            assert (item_id in have) == (want[0] <= e)
            if want[0] <= e:
                _, distance, allowed, start, end = have[item_id]
                assert (distance, allowed) == (want[0], e)
                assert plain(p, t[start:end]) == (distance, end - start)


def rows(df):
    return sorted((str(r.doc_id), r.item_id, r.distance) for r in df.collect())


def test_table_against_plain_search_of_exact_items(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = spark.read.parquet(f"{SF001}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).filter("distance = 0").collect()}
    body = {r.item_id: decontam.normal(r.text) for r in items.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, b in body.items() if b in decontam.normal(d.text)}
    assert got == want and want


def test_edge_rows_and_blocks_of_items(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    long = "word " * 50_000
    docs = spark.createDataFrame(
        [(1, "x " + item.upper().replace(" ", "!! ") + " y"), (2, None), (3, ""), (4, long + item + long), (1, item),
         (None, item), (5, "nothing"), (6, item.replace("quick", "quack").replace("lazy", "hazy"))],
        "doc_id long, text string").selectExpr("*", "7 AS item_id", "'q' AS body", "1 AS item")
    items = spark.createDataFrame([(1, item), (1, item), (2, item), (3, None), (4, ""), (5, "?!"), (6, "something else")],
                                  "item_id long, text string").selectExpr("*", "3 AS doc_id")
    want = sorted((d, i, k) for i in (1, 2) for d, k in
                  (("1", 0), ("1", 0), ("4", 0), ("None", 0), ("6", 2)))
    assert rows(decontam.contaminated(docs, items)) == want
    assert rows(decontam.contaminated(docs, items, items_per_block=1)) == want
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
