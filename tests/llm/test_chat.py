"""Preference formatting: SQL, and a plain version on awkward rows."""

import duckdb

from check_oracle import compare
from claimgeo.llm import chat
from claimgeo.llm.queries import ORACLE, QUERIES

from ..conftest import SF001


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF001}/conversations.parquet')")
    line, ok = compare(spark, con, "op8_chat_formatting", QUERIES["op8_chat_formatting"], ORACLE["op8_chat_formatting"], SF001)
    assert ok, line


def show(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def plain(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return n, show(chosen[:n]), show(chosen[n:]), show(rejected[n:])


CASES = {
    1: ([("user", "a"), ("assistant", "b"), ("user", "c")], [("user", "a"), ("assistant", "b"), ("assistant", "d")]),
    2: ([("user", "a")], [("user", "a"), ("assistant", "é😀")]),
    3: ([("user", "a"), ("assistant", "x")], [("user", "b"), ("assistant", "x")]),
    4: ([("user", "same"), ("assistant", "same")], [("user", "same"), ("assistant", "same")]),
    5: ([("system", ""), ("user", "q"), ("assistant", "long " * 50_000)], [("system", ""), ("user", "q")]),
    6: ([("user", "a")], None),
}


def test_pairs_against_plain_version(spark):
    rows = [(i, None if c is None else [(k, *t) for k, t in enumerate(c)], None if r is None else [(k, *t) for k, t in enumerate(r)])
            for i, (c, r) in CASES.items()]
    turn = "array<struct<turn:bigint,role:string,text:string>>"
    out = chat.preferences(spark.createDataFrame(rows, f"pair_id int, chosen {turn}, rejected {turn}")).collect()
    assert len(out) == len(CASES)
    for r in out:
        c, j = CASES[r.pair_id]
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == plain(c, j or [])
        for text, spans, turns in ((r.chosen, r.chosen_mask, c), (r.rejected, r.rejected_mask, j or [])):
            cut = [text[int(s.split(":")[0]):int(s.split(":")[1])] for s in spans.split(",") if s]
            assert cut == [t + "<|im_end|>\n" for role, t in turns[r.n_common:] if role == "assistant"]


def test_conversations_with_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 2, "user", None), (1, 3, "assistant", "two"),
            (2, 0, "assistant", "alone"), (3, 0, "user", "no reply"), (4, 0, "user", "x"), (4, 1, "assistant", "y"),
            (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 2, "assistant", "r"), (5, 2, "assistant", "r"),
            (None, 0, "user", "u"), (None, None, "assistant", "v"), (6, 0, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS id", "2 AS turns")
    got = {r.pair_id: r for r in chat.stale_reply_preferences(d).collect()}
    assert len(got) == 7
    assert got[1].n_common == 3 and got[1].rejected == show([("assistant", "one")])
    assert got[2].rejected == show([("assistant", "")]) and got[2].prompt == ""
    assert got[3].chosen == got[3].rejected == "" and got[3].prompt == show([("user", "no reply")])
    assert got[4].rejected == show([("assistant", "x")])
    assert got[5].prompt == show([("user", "a"), ("user", "b"), ("assistant", "r"), ("assistant", "r")])
    assert got[None].chosen == show([("assistant", "v"), ("user", "u")]) and got[6].prompt == show([("", "")])
    assert chat.stale_reply_preferences(d.limit(0)).count() == 0
    assert "Python" not in chat.stale_reply_preferences(d)._jdf.queryExecution().optimizedPlan().toString()
