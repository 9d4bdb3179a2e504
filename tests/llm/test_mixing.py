"""Mixing: raked weights against plain raking, SQL, edge rows."""

import duckdb
import pytest

from check_oracle import compare
from claimgeo.llm import mixing
from claimgeo.llm.queries import ORACLE, QUERIES

from ..conftest import SF001


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    line, ok = compare(spark, con, "op5_mixing", QUERIES["op5_mixing"], ORACLE["op5_mixing"], SF001)
    assert ok, line


def test_raked_weights_meet_the_targets(spark):
    cells = spark.createDataFrame([(f"s{i}", lang, t, 10 + 37 * i % 23 + len(lang + t)) for i in range(3)
                                   for lang in ("en", "de") for t in ("x", "yy")],
                                  "source string, lang string, topic string, tokens long")
    goal = {"source": {"s0": 1, "s1": 1, "s2": 2, "gone": 9}, "lang": {"en": 3, "de": 1}, "topic": {"x": 0.5, "yy": 0.5}}
    out = mixing.rake(cells, mixing.MARGINS, goal, rounds=8).collect()
    total = sum(r.tokens for r in out)
    for m, k, share in [("source", "s2", 0.5), ("lang", "en", 0.75), ("topic", "x", 0.5), ("source", "s0", 0.25)]:
        assert sum(r.tokens * r.rate for r in out if r[m] == k) / total == pytest.approx(share, abs=1e-4)


def test_nulls_empty_repeated_and_clashing_columns(spark):
    rows = [(1, "a b c", "s", "en"), (1, "a b c", "s", "en"), (2, None, None, None), (3, "", "s", "en"),
            (None, "mail a@b.co", "s", None), (4, "w " * 60_000, "t", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr(
        "*", "5 AS tokens", "6 AS mix_rate", "7 AS topic", "8 AS w")
    out = mixing.mixed(d)
    assert out.columns == ["doc_id", "text", "source", "lang", "tokens", "topic", "w", "mix_topic", "mix_tokens",
                           "mix_rate", "mix_copies"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].mix_tokens == 0 and by[2].mix_rate == 1 and by[2].source is None and by[4].mix_tokens == 60_000
    assert by[None].mix_topic == "contact" and by[3].mix_tokens == 0
    assert len({r.mix_copies for r in got if r.doc_id == 1}) == 1
    assert mixing.mixed(d.limit(0)).count() == 0
