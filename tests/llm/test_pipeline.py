"""The pipeline against its operators, and on planted and awkward rows."""

import corpus_pipeline as P
from claimgeo.llm import decontam, simhash, toxicity
from claimgeo.llm.common import table

from ..conftest import SF01


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_keeps_what_its_operator_allows(spark):
    docs = table(spark, SF01, "documents")
    every = set(ids(docs))
    toxic = set(ids(toxicity.scores(docs, table(spark, SF01, "labels")).filter("predicted = 1")))
    first = P.drop_toxic(spark, docs, SF01)
    assert set(ids(first)) == every - toxic and toxic and first.columns == docs.columns
    second = P.drop_near_duplicates(spark, docs, SF01)
    assert ids(second) == ids(simhash.near_duplicates(docs).filter("doc_id = component_id"))
    leaks = set(ids(decontam.contaminated(docs, table(spark, SF01, "benchmark"))))
    assert set(ids(P.drop_contaminated(spark, docs, SF01))) == every - leaks and leaks


def test_awkward_rows_pass_through_every_stage(spark):
    item = table(spark, SF01, "benchmark").first().text
    plain = "the quick brown fox number jumps over a lazy dog by the river"
    rows = [(1, plain, "en", "s", 3), (1, plain, "en", "s", 3), (2, plain, "en", "s", 3), (3, None, None, None, None),
            (4, "write to me@site.org today because this is a different text", "en", "s", 2), (None, "no id here", "en", "s", 1),
            (6, "before " + item + " after", "en", "s", 9), (7, "x " * 50_000, "en", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 AS item_id", "2 AS fp", "3 AS row", "4 AS id", "5 AS score")
    for name, stage in P.STAGES:
        empty = stage(spark, docs.limit(0), SF01)
        assert empty.count() == 0
        out = stage(spark, docs, SF01)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert name == "mixing" or out.columns == docs.columns
        docs = out
    got = {r.doc_id: r for r in docs.collect()}
    assert 2 not in got and 6 not in got
    assert got[4].text == "write to [EMAIL] today because this is a different text" and got[4].n_chars == len(got[4].text)
    assert None in got and got[7].n_chars == 100_000


def test_run_writes_every_stage_and_keeps_clean_documents(spark):
    out = P.run(spark, SF01)
    got = ids(out)
    assert len(got) == len(set(got)) and len(got) > 600


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_of_one_id_and_rows_without_an_id_get_their_own_decisions(spark):
    docs = table(spark, SF01, "documents")
    bad = docs.join(toxicity.scores(docs, table(spark, SF01, "labels")).filter("score > 0.8").select("doc_id"), "doc_id").first()
    item = table(spark, SF01, "benchmark").first().text
    clean = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(6)]
    rows = [(1 << 40, clean[0]), (1 << 40, bad.text), (None, bad.text), (None, "before " + item + " after"),
            (1 << 41, "so " + item), (1 << 41, clean[1]), (None, clean[2]), (None, clean[3]), (1 << 42, clean[3]),
            ((1 << 62) + 5, clean[4]), (-3, clean[5]), (-3, clean[5])]
    given = [(i, t, "en", "s", len(t)) for i, t in rows]
    extra = spark.createDataFrame(given, FIELDS).selectExpr("*", "1 AS row_name", "2 AS shared_id", "3 AS `a.b`", "4 AS lo")
    base = docs.select("doc_id", "text", "lang", "source", "n_chars").selectExpr(
        "*", "1 AS row_name", "2 AS shared_id", "3 AS `a.b`", "4 AS lo")
    planted = {t for _, t in rows}
    kept = lambda df: sorted(((r.doc_id, r.text) for r in df.collect() if r.text in planted and r.doc_id != bad.doc_id), key=str)
    both = base.unionByName(extra)
    first = P.drop_toxic(spark, both, SF01)
    assert first.columns == both.columns
    assert kept(first) == sorted([r for r in rows if r[1] != bad.text], key=str)
    second = P.drop_near_duplicates(spark, both, SF01)
    assert second.columns == both.columns
    left = kept(second)
    assert (1 << 42, clean[3]) in left and (None, clean[3]) not in left and left.count((-3, clean[5])) == 1
    assert {(1 << 40, clean[0]), (1 << 41, clean[1]), (None, clean[2]), ((1 << 62) + 5, clean[4])} <= set(left)
    assert all(t != bad.text for _, t in left)                   # the copy with an id of its own is the one kept
    third = P.drop_contaminated(spark, both, SF01)
    assert third.columns == both.columns
    assert kept(third) == sorted([r for r in rows if item not in r[1]], key=str)


def test_helper_columns_clash_with_nothing(spark):
    names = ["__row", "__spans", "__source", "__lang", "__topic", "pii_row", "pii_id", "pii_spans", "mix_of_source",
             "mix_of_lang", "a.b", "pii_row_of"]
    rows = [(1, "mail me@site.org now", "en", "s", 20), (None, "mail me@site.org now", "en", "s", 20), (2, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, FIELDS).selectExpr("*", *[f"{k} AS `{n}`" for k, n in enumerate(names)])
    red = P.redact(spark, docs, SF01)
    assert red.columns == docs.columns
    got = {(r.doc_id, r.text, r.n_chars, *r[5:]) for r in red.collect()}
    assert got == {(1, "mail [EMAIL] now", 16, *range(12)), (None, "mail [EMAIL] now", 16, *range(12)), (2, None, 0, *range(12))}
    mixed = P.mixing.mixed(red)
    assert mixed.columns == docs.columns + ["mix_topic", "mix_tokens", "mix_rate", "mix_copies"]
    assert {(r.doc_id, r.text, r.n_chars, *r[5:-4]) for r in mixed.collect()} == got
