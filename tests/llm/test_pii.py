"""Personal data: base spans against a plain search, contextual spans on planted contexts."""

import hashlib
import re

from claimgeo.llm import pii
from claimgeo.llm.queries import QUERIES

from ..conftest import SF001

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0,
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def spell(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_query_against_plain_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = QUERIES["op3_pii"](spark, SF001).collect()
    assert len(out) == len(docs)
    seen = 0
    for r in out:
        want = plain(docs[r.doc_id])
        seen += len(want)
        assert r.base_sha256 == hashlib.sha256(spell(want).encode()).hexdigest(), r
        assert set(filter(None, spell(want).split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[1] == k for w in want) for k in range(4)]
    assert seen > 20


HARD = [
    "a@b.c_x@d.e a@b@c.d x@y.z.@w.v é@b.co 😀a@b.cd.", "1.2.3.4.5.6.7.8 256.1.1.1 00000255.1.1.1 1.2.3 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111111111111111--2", "+1 (234) 567-8901) +12 +1 2 3 4 5 6 7 8 9 + 1",
    "😀 +49 30 1234567 ümläut 10.0.0.1", "4" * 5000 + " x" + "a" * 3000 + "@", "1 " * 4000, "a.b@" * 2000 + "c.d",
    "1.2.3.4 " * 1500, None, "", " \n\t",
]


def test_hard_texts_nulls_and_repeated_rows(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(0, HARD[0]), (None, HARD[4])]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS base", "2 AS t")
    out = pii.personal_data(d).select("id", pii.spell(pii.bare_spans(pii.F.col("base"))).alias("s")).collect()
    assert sorted((str(r.id), r.s) for r in out) == sorted((str(i), spell(plain(t))) for i, t in rows)


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [(i, f"Please write. Call customer line +1 (222) 555-{1000 + i} for help with order {i}") for i in range(12)]
    cards = [(50 + i, f"random words {w} 123456789{i} more") for i, w in enumerate("abcdefgh")]
    d = spark.createDataFrame(seeds + cards + [(90, "Ask. Call customer line 555-77812, for help"), (91, "see 555-77812 there"),
                                               (92, "nothing 44444444 here")], "doc_id long, text string")
    got = {r.id: [tuple(x) for x in r.extra] for r in pii.personal_data(d).collect()}
    text = dict(seeds + cards)
    at = "Ask. Call customer line 555-77812, for help".index("555")
    assert got[90] == [(at, 3, at + 9)] and got[91] == [(4, 3, 13)]
    assert all(not got[i] for i in got if i not in (90, 91)) and text


def test_patterns_are_bound_to_a_shape(spark):
    rows = [(i, f"now write to the desk u{i}@site{i}.org please") for i in range(20)] + [(50, "now write to the desk 12345678 please"),
                                                                                    (51, "now write to the desk someone@host please")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: [tuple(x) for x in r.extra] for r in pii.personal_data(d).collect()}
    assert got[50] == [] and got[51] == [(22, 0, 34)]


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "mail a@b.co and +1 (222) 555-1234!"), (1, "mail a@b.co and +1 (222) 555-1234!"), (2, None), (3, "clean"),
            (None, "ip 1.2.3.4"), (4, "1.2.3.4@b.co")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' AS all", "1 AS row")
    out = pii.redacted(d)
    assert out.columns == d.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted([
        ("1", "mail [EMAIL] and [PHONE]!")] * 2 + [("2", "None"), ("3", "clean"), ("None", "ip [IP]"), ("4", "[EMAIL]")])


def test_empty_table_and_no_python(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(d).count() == 0 and pii.redacted(d).count() == 0
    plan = pii.personal_data(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


CARDS = ["4111111111111111", "5500005555555559", "4012888888881881"]


def extracted(d):
    """(id, extracted text) of all contextual spans."""
    rows = d.withColumnRenamed("doc_id", "id").join(pii.personal_data(d).select("id", "extra"), "id").collect()
    return sorted((r.id, r.text[x.start:x.end], pii.KINDS[x.rank]) for r in rows for x in r.extra)


def test_three_seeds_find_letters_and_spaced_groups(spark):
    """Letter-bearing and spaced identifiers in a context of three seeds, not
    the same kind of tokens elsewhere."""
    rows = [(i, f"please use account number {c} today") for i, c in enumerate(CARDS)]
    rows += [(10, "please use account number GB33BUKB20201555555555 today"), (11, "my account number DE89 3704 0044 0532 0130 07, thanks"),
             (12, "a token = 9f86d081884c7d65 there"), (13, "chapters AB12 3456 7890 follow")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert extracted(d) == [(10, "GB33BUKB20201555555555", "card"), (11, "DE89 3704 0044 0532 0130 07", "card")]


def test_contexts_are_of_the_text_not_of_the_gap(spark):
    """Context words that hold digits themselves."""
    rows = [(i, f"see form w2 line 5b {c} now") for i, c in enumerate(CARDS)] + [(10, "see form w2 line 5b X1234567 now"),
                                                                               (11, "see form w2 line 6b X7654321 now")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert extracted(d) == [(10, "X1234567", "card")]


def test_a_pattern_of_mostly_unknown_numbers_is_not_trusted(spark):
    rows = [(i, f"order {c} sent") for i, c in enumerate(CARDS)] + [(10 + i, f"order 7700{i}13 sent") for i in range(4)]
    assert extracted(spark.createDataFrame(rows, "doc_id long, text string")) == []
