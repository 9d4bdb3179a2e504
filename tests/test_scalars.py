"""Scalar functions (X1–X20) on literal edge rows (FIXTURES §1.5)."""

from pyspark.sql import functions as F

from claimgeo.functions import constants as K
from claimgeo.functions import scalars as X


def _col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_code_number_and_category(spark):
    codes = ["D0099", "D0100", "D0999", "D5899", "D5900", "D5999", "D6000", "D6199", "D6200",
             "D9999", "D12A4", "99213", None, "D1234\n"]
    nums = _col(spark, codes, X.code_number)
    assert nums == [99, 100, 999, 5899, 5900, 5999, 6000, 6199, 6200, 9999, None, None, None, None]
    cats = _col(spark, codes, lambda c: X.category(X.code_number(c)))
    assert cats == ["Uncategorized", "Diagnostic", "Diagnostic", "Prosthodontics (removable)",
                    "Maxillofacial Prosthetics", "Maxillofacial Prosthetics", "Implant Services",
                    "Implant Services", "Prosthodontics (fixed)", "Adjunctive General Services",
                    "Uncategorized", "Uncategorized", "Uncategorized", "Uncategorized"]
    assert _col(spark, codes, X.code_category) == cats
    keys = _col(spark, ["Oral and Maxillofacial Surgery", "Uncategorized"], X.layer_key)
    assert keys == ["oral_max_surgery", None]
    assert _col(spark, ["oral_max_surgery"], X.layer_label) == ["Oral & Maxillofacial Surgery"]


def test_classify_id(spark):
    ids = [None, "", "0000000000", "9999999999", "1999999999", "1999999992", "A875718600",
           "M447402100", "K123456789", "110141879A", "1234567893", " a875718600 ", "1111111111", "   "]
    got = _col(spark, ids, X.classify_id)
    assert got == [
        K.ID_BUCKET_NULL, K.ID_BUCKET_NULL, K.ID_BUCKET_ZEROS, K.ID_BUCKET_NINES, K.ID_BUCKET_NINES,
        K.ID_BUCKET_NPI,  # the documented 1999999992 is not made of 1s and 9s only (D5)
        K.ID_BUCKET_A, K.ID_BUCKET_M, "state-assigned: K-prefix", K.ID_BUCKET_MALFORMED, K.ID_BUCKET_NPI,
        K.ID_BUCKET_A, K.ID_BUCKET_NPI, K.ID_BUCKET_MALFORMED,
    ]


def test_refine_id(spark):
    df = spark.createDataFrame([("NPI-format", True, True), ("NPI-format", False, True),
                                ("NPI-format", False, False), ("NULL", False, False)],
                               "b string, s boolean, a boolean")
    got = [r[0] for r in df.select(X.refine_id("b", "s", "a")).collect()]
    assert got == [K.ID_BUCKET_SAME, K.ID_BUCKET_OTHER, K.ID_BUCKET_NEVER, "NULL"]


def test_zip_and_pad(spark):
    assert _col(spark, ["071034521", "7103", "", None, "02139"], X.normalize_zip5) == \
        ["07103", "07103", None, None, "02139"]
    assert _col(spark, ["1001", "01001", " 1001 ", "", None, "123456"], lambda c: X.pad_id(c, 5)) == \
        ["01001", "01001", "01001", None, None, "123456"]
    assert _col(spark, [" 123 ", "", None], lambda c: X.prefix(c, 2, trim=True)) == ["12", None, None]


def test_months(spark):
    assert _col(spark, ["2018-01", "201801", "2018/01", "2018-01-15", None], X.normalize_month) == \
        ["201801", "201801", "201801", "201801", None]
    assert _col(spark, ["201812"], lambda c: X.shift_month(c, 1)) == ["201901"]
    assert _col(spark, ["201901"], lambda c: X.shift_month(c, -1)) == ["201812"]
    assert _col(spark, ["201801"], lambda c: X.shift_month(c, 13)) == ["201902"]
    assert _col(spark, ["201801"], lambda c: X.shift_month(c, -13)) == ["201612"]
    assert _col(spark, ["201801"], X.dash_month) == ["2018-01"]
    assert _col(spark, ["2018-03"], lambda c: X.month_distance(c, F.lit("201712"))) == [3]


def test_text_and_address(spark):
    assert _col(spark, ["  12  main st\t", None, "straße"], X.normalize_text) == ["12 MAIN ST", "", "STRASSE"]
    df = spark.createDataFrame([(" 12 Main St ", None, "Boston", "MA", "02139"),
                                ("12 MAIN ST", "", "BOSTON", "ma", "02139"),
                                ("12 Main St", "Suite 4", "Boston", "MA", "02139")],
                               "l1 string, l2 string, c string, s string, z string")
    rows = df.select(X.address_id(["l1", "l2", "c", "s", "z"]).alias("id"),
                     X.address_full("l1", "l2", "c", "s", "z").alias("full")).collect()
    assert rows[0].id == rows[1].id != rows[2].id
    import hashlib
    assert rows[0].id == hashlib.md5(b"12 MAIN ST||BOSTON|MA|02139").hexdigest()
    assert rows[0].full == "12 Main St, Boston, MA 02139"
    assert rows[2].full == "12 Main St Suite 4, Boston, MA 02139"


def test_primary_value(spark):
    df = spark.createDataFrame([("a", "N", "b", "Y", "c", "N"), ("a", "Y", "b", "Y", None, None),
                                ("a", "N", "b", "N", "c", "N"), (None, "Y", "b", "Y", "c", "N")],
                               "c1 string, s1 string, c2 string, s2 string, c3 string, s3 string")
    got = [r[0] for r in df.select(X.primary_value([("c1", "s1"), ("c2", "s2"), ("c3", "s3")])).collect()]
    assert got == ["b", "a", None, "b"]


def test_survey_numbers(spark):
    df = spark.createDataFrame([("1", "2", "3"), ("1", None, "3"), (None, None, None),
                                ("1", "-666666666", "3"), ("1", "N/A", "3")], "a string, b string, c string")
    cols = [X.clean_survey_number(c).alias(c) for c in "abc"]
    out = df.select(*cols).select(X.strict_sum(list("abc")).alias("s"), X.margin_of_sum(list("abc")).alias("m"))
    rows = out.collect()
    assert rows[0].s == 6.0 and abs(rows[0].m - 14 ** 0.5) < 1e-12
    assert all(r.s is None and r.m is None for r in rows[1:])
    for s in K.SURVEY_SENTINELS:
        assert _col(spark, [str(s)], X.clean_survey_number) == [None]


def test_safe_rate_and_avg(spark):
    df = spark.createDataFrame([(150, 1000), (12, 1000), (1, 3), (2, 3), (5, None), (5, 0), (5, -1)],
                               "n bigint, d bigint")
    got = [r[0] for r in df.select(X.safe_rate("n", "d", 6)).collect()]
    assert got == [0.15, 0.012, 0.333333, 0.666667, None, None, None]
    got = [r[0] for r in df.select(X.avg_paid("n", "d")).collect()]
    assert got[0] == 0.15 and got[4:] == [None, None, None]


def test_county_label(spark):
    df = spark.createDataFrame([("6037", "Los Angeles", "County"), ("99001", "Nowhere", "Parish"),
                                ("123456", "Long", "County")], "g string, n string, l string")
    got = [r[0] for r in df.select(X.county_label("g", "n", "l")).collect()]
    assert got == ["Los Angeles County, CA", "Nowhere Parish, 99", None]


def test_rates_of_large_counts_are_exact(spark):
    from fractions import Fraction
    pairs = [(5 * 10 ** 12, 7), (9 * 10 ** 18, 1), (9 * 10 ** 18, 9 * 10 ** 18 - 1), (1, 3), (2, 3), (1, 2_000_000), (3, 2_000_000),
             (0, 5), (4_600_000_000_001, 3), (7, 0)]
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    got = [r[0] for r in df.select(X.safe_rate("n", "d", 6).alias("r")).collect()]
    for (n, d), r in zip(pairs, got):
        want = None if d == 0 else float((2 * n * 10 ** 6 + d) // (2 * d)) / 1e6
        assert r == want, (n, d, r, want, Fraction(n, d or 1))
