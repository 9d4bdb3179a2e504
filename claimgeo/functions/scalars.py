"""Scalar functions as Column expressions.

All of them compile to built-in Catalyst expressions, so they stay inside
whole-stage codegen and never cross into Python. Each takes and returns a
``Column``; string arguments are column names.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- months (X1, X2) -------------------------------------------------------

def normalize_month(s) -> Column:
    """Keep the digits, first six -> ``YYYYMM`` (``2018-01-15`` -> ``201801``)."""
    return F.substring(F.regexp_replace(_c(s), r"[^0-9]", ""), 1, 6)


def dash_month(yyyymm) -> Column:
    """``201801`` -> ``2018-01``."""
    c = _c(yyyymm)
    return F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 2))


def month_index(ym) -> Column:
    """Months since year 0 (``12*y + m - 1``) of a ``YYYYMM`` or ``YYYY-MM`` string."""
    n = normalize_month(ym)
    return (F.substring(n, 1, 4).cast("int") * 12 + F.substring(n, 5, 2).cast("int") - 1)


def month_from_index(idx, dashed: bool = False) -> Column:
    """Inverse of :func:`month_index`; ``YYYYMM`` (or ``YYYY-MM``)."""
    i = _c(idx)
    y = F.lpad(F.floor(i / 12).cast("string"), 4, "0")
    m = F.lpad((F.pmod(i, F.lit(12)) + 1).cast("string"), 2, "0")
    return F.concat(y, F.lit("-"), m) if dashed else F.concat(y, m)


def shift_month(ym, delta: int, dashed: bool = False) -> Column:
    """``shift_month('201812', 1) = '201901'``; wraps years both ways."""
    return month_from_index(month_index(ym) + F.lit(delta), dashed)


def month_distance(a, b) -> Column:
    """Absolute distance in months."""
    return F.abs(month_index(a) - month_index(b))


# --- ids and codes (X3–X6) -------------------------------------------------

def normalize_zip5(s) -> Column:
    """First five characters, empty -> NULL, left-padded with zeros to five."""
    head = F.substring(_c(s), 1, 5)
    return F.lpad(F.nullif(head, F.lit("")), 5, "0")


def pad_id(s, n: int) -> Column:
    """Trim, empty -> NULL, zero-pad to ``n`` without truncating longer values."""
    t = F.nullif(F.trim(_c(s)), F.lit(""))
    return F.lpad(t, F.greatest(F.length(t), F.lit(n)), "0")


def prefix(s, n: int, trim: bool = False) -> Column:
    """First ``n`` characters; with ``trim`` the value is trimmed and
    nullified first (ZIP3); without, only nullified (state FIPS)."""
    c = F.trim(_c(s)) if trim else _c(s)
    return F.substring(F.nullif(c, F.lit("")), 1, n)


def geoid(state, county) -> Column:
    """Five-digit county GEOID from padded state and county parts."""
    return F.concat(pad_id(state, 2), pad_id(county, 3))


# --- text and addresses (X7–X9) ---------------------------------------------

_WS = r"(?U)\s+"


def normalize_text(s) -> Column:
    """NULL -> '', upper-case, every whitespace run -> one space, stripped."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(_c(s), F.lit(""))), _WS, " "))


def strip_ws(s) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(_c(s), r"(?U)^\s+|\s+$", "")


def address_id(parts: list) -> Column:
    """md5 hex of the ``|``-joined normalised parts (NULL parts become '')."""
    return F.md5(F.concat_ws("|", *[normalize_text(p) for p in parts]))


def address_full(line1, line2, city, state, zip5) -> Column:
    """``LINE1 LINE2, CITY, ST ZIP`` from raw values, whitespace collapsed."""
    def part(x):
        return strip_ws(F.coalesce(_c(x), F.lit("")))
    l1, l2 = part(line1), part(line2)
    first = F.when(l2 == "", l1).otherwise(F.concat(l1, F.lit(" "), l2))
    full = F.concat(first, F.lit(", "), part(city), F.lit(", "), part(state), F.lit(" "), part(zip5))
    return strip_ws(F.regexp_replace(full, _WS, " "))


# --- procedure codes (X10, X11, J14) -----------------------------------------

def code_number(code) -> Column:
    """``D`` + exactly four digits -> the number, else NULL."""
    c = _c(code)
    return F.when(c.rlike(r"\AD[0-9]{4}\z"), F.substring(c, 2, 4).cast("int"))


def category(n, ranges=K.CATEGORY_RANGES, other: str = K.UNCATEGORIZED) -> Column:
    """X11: closed ranges -> label, anything else (NULL too) -> ``Uncategorized``."""
    c = _c(n)
    expr = None
    for lo, hi, label in ranges:
        cond = c.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(other))


def code_category(code) -> Column:
    """X10 + X11 in one expression that tests the code pattern once per row."""
    c = _c(code)
    n = F.substring(c, 2, 4).cast("int")
    return F.when(c.rlike(r"\AD[0-9]{4}\z"), category(n)).otherwise(F.lit(K.UNCATEGORIZED))


def layer_key(cat) -> Column:
    """Category label -> layer key; unknown (Uncategorized) -> NULL."""
    pairs = []
    for k, v in K.CATEGORY_TO_LAYER.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), _c(cat))


def layer_label(key) -> Column:
    """Layer key -> its display label."""
    pairs = []
    for k, v in K.LAYER_LABELS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), _c(key))


# --- identifier classes (X12, X13) ---------------------------------------------

def classify_id(s) -> Column:
    """Bucket of a servicing identifier, tested in a fixed order."""
    raw = _c(s)
    t = F.upper(strip_ws(raw))
    letter = F.regexp_extract(t, K.ID_LETTER_PREFIX, 1)
    return (
        F.when(raw.isNull() | raw.isin("", "nan", "<NA>"), F.lit(K.ID_BUCKET_NULL))
        .when(t == K.ID_ALL_ZEROS, F.lit(K.ID_BUCKET_ZEROS))
        .when(t.rlike(K.ID_NINES_PATTERN) & t.contains("9"), F.lit(K.ID_BUCKET_NINES))
        .when(letter == "A", F.lit(K.ID_BUCKET_A))
        .when(letter == "M", F.lit(K.ID_BUCKET_M))
        .when(letter != "", F.format_string(K.ID_BUCKET_LETTER_FMT.replace("{}", "%s"), letter))
        .when(t.rlike(K.ID_TEN_DIGITS), F.lit(K.ID_BUCKET_NPI))
        .otherwise(F.lit(K.ID_BUCKET_MALFORMED))
    )


def refine_id(bucket, in_same_month, in_any_month) -> Column:
    """Split the NPI-format bucket by snapshot membership."""
    b = _c(bucket)
    return (
        F.when(b != K.ID_BUCKET_NPI, b)
        .when(_c(in_same_month), F.lit(K.ID_BUCKET_SAME))
        .when(_c(in_any_month), F.lit(K.ID_BUCKET_OTHER))
        .otherwise(F.lit(K.ID_BUCKET_NEVER))
    )


# --- snapshot attributes (X14) ------------------------------------------------

def primary_value(pairs: list) -> Column:
    """First code whose switch is 'Y', in slot order; a NULL code leaves
    the search open for the next slot."""
    return F.coalesce(*[F.when(_c(sw) == "Y", _c(code)) for code, sw in pairs])


# --- survey numbers (X15, A16, A17) ----------------------------------------------

def clean_survey_number(s, sentinels=K.SURVEY_SENTINELS) -> Column:
    """Text -> DOUBLE; unparsable and sentinel values -> NULL."""
    v = F.expr(f"try_cast({s} AS DOUBLE)") if isinstance(s, str) else s.try_cast("double")
    return F.when(~v.isin(*[float(x) for x in sentinels]), v)


def strict_sum(cols: list) -> Column:
    """Sum of the columns, NULL if any of them is NULL."""
    return reduce(add, [_c(c) for c in cols])


def margin_of_sum(cols: list) -> Column:
    """``sqrt(sum(moe^2))``, NULL if any margin is NULL."""
    return F.sqrt(reduce(add, [_c(c) * _c(c) for c in cols]))


# --- ratios (X16–X18) -----------------------------------------------------------

def safe_rate(num, den, decimals: int | None = None) -> Column:
    """``num/den``, NULL when the denominator is NULL or not positive.

    With ``decimals`` the ratio is rounded half-up in exact decimal arithmetic
    (``(2*num*10^d + den) div (2*den)`` over 38 digits), so no binary rounding
    of the quotient can move a digit and no count of a long overflows up to 18
    decimals. Requires integral, non-negative ``num``.
    """
    n, d = _c(num), _c(den)
    if decimals is None:
        return F.when(d > 0, n.cast("double") / d.cast("double"))
    top = (n.cast("decimal(19,0)") * F.lit(2 * 10 ** decimals).cast("decimal(19,0)") + d.cast("decimal(19,0)")).cast("decimal(38,0)")
    low = (d.cast("decimal(19,0)") * F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)")
    q = (top - F.pmod(top, low)).cast("decimal(38,0)")
    return F.when(d > 0, (q / low).cast("double") / F.lit(float(10 ** decimals)))


def avg_paid(paid, claims) -> Column:
    """Paid per claim, NULL when claims is NULL or not positive."""
    c = _c(claims)
    return F.when(c > 0, _c(paid).cast("double") / c.cast("double"))


def period_year(period) -> Column:
    """The year of an annual (``YYYY``) or monthly (``YYYY-MM``) period."""
    return F.substring(_c(period), 1, 4)


# --- county labels (X20) -----------------------------------------------------------

def county_label(geoid_col, name, lsad, postal=None) -> Column:
    """``NAME LSAD, ST`` for a five-digit GEOID; ST is the postal code of
    the state prefix, falling back to the prefix itself; a missing LSAD is
    ``County``. Other ids -> NULL."""
    g = pad_id(geoid_col, 5)
    st = F.coalesce(_c(postal) if postal is not None else state_postal(F.substring(g, 1, 2)),
                    F.substring(g, 1, 2))
    label = F.concat_ws(", ", F.concat_ws(" ", _c(name), F.coalesce(_c(lsad), F.lit("County"))), st)
    return F.when(g.rlike(r"\A[0-9]{5}\z"), label)


def state_postal(fips2) -> Column:
    """FIPS prefix -> postal code through a literal map (NULL when unknown)."""
    pairs = []
    for k, v in K.STATE_FIPS_TO_POSTAL.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), _c(fips2))


def state_name(postal) -> Column:
    """Postal code -> state name (NULL when unknown)."""
    pairs = []
    for k, v in K.STATE_POSTAL_TO_NAME.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), _c(postal))
