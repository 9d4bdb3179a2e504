"""Personal data by base patterns and bootstrapped contextual extraction.

Only DataFrame functions run here. Base spans (e-mail, IP, card, phone) come
from one pass over each whole text. They seed a graph of lexical patterns
(the words around an entity) and instances (identifier-like tokens): pattern
and instance scores are iterated in Spark, and the occurrences of instances
that high-confidence patterns extract are added as spans.

What leaves the pass over the texts is spans and tokens with their contexts,
never texts. Patterns with too few distinct seeds are pruned by a map-side
combined aggregate before any join of the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, free_name, texts

# The base patterns and their order. A run of the first class
# can only match from its start, or from where the last match ended (\G), so
# looking for a start inside a run is left out: long runs stay linear.
# Possessive quantifiers take what the greedy ones take, without recursion.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
# A token with an '@' or a digit, from its first character on.
TOKEN = r"(?:(?<!\S)|\G)[^\s0-9@]*+[0-9@]\S*+"
# Two to ten short groups that hold digits, with single spaces between them.
SPACED = r"(?<!\S)[A-Za-z]{0,4}+[0-9]{1,4}+[A-Za-z]{0,4}+(?:\x20[A-Za-z]{0,4}+[0-9]{1,4}+[A-Za-z]{0,4}+(?![\w@-])){1,9}+"
LEAD = r"""^["'(\[{<]++"""
TRAIL = r"""(?<!["')\]}>.,;:!?%$&*#])["')\]}>.,;:!?%$&*#]++$"""
CONTEXT = 48               # characters on either side that hold the context words
NEAR = 4                   # matches before (after, half of them) another that its context words may come from
MIN_DIGITS = 5             # digits that make a token identifier-like
MIN_SEEDS = 3              # distinct seed values that a pattern must extract
MIN_CONFIDENCE = 0.85
ROUNDS = 3
CHUNK = 256


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array, in chunks: appending to an array
    copies it, so one fold over a long array would be quadratic."""
    def fold(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0).cast("long")),
                           lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    n = F.size(values)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / CHUNK), F.lit(0)).cast("int")),
                         lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    inner = F.transform(chunks, fold)
    before = fold(F.transform(inner, lambda a: F.element_at(a, -1)))
    return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)),
                                lambda a, o: F.transform(F.slice(a, 2, CHUNK), lambda x: x + o)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    ds = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int"))
                          .otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        def fits(p: Column) -> Column:
            bare = F.regexp_replace(p, "^0+", "")
            return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("long"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), fits)
    if kind == "card":
        d = digits_of(value)
        return F.length(d).between(12, 19) & luhn(d)
    if kind == "phone":
        return F.length(digits_of(value)).between(9, 15)
    return F.lit(True)


def matches(hits: Column, gaps: Column) -> Column:
    """Array of ``(start, end, value, before, after)`` from the matches of a
    pattern and the text between them; offsets are code points. ``before``
    and ``after`` are of the text itself, other matches included."""
    n = F.size(hits)
    at = F.zip_with(F.slice(gaps, 1, n), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
    ends = F.zip_with(F.slice(gaps, 1, n), hits, lambda g, h: F.concat(F.substring(g, -CONTEXT, CONTEXT),
                                                                       F.substring(h, -CONTEXT, CONTEXT)))
    begins = F.zip_with(hits, F.slice(gaps, 2, n), lambda h, g: F.concat(F.substring(h, 1, CONTEXT), F.substring(g, 1, CONTEXT)))
    before = F.transform(F.slice(gaps, 1, n), lambda g: F.substring(g, -CONTEXT, CONTEXT))
    after = F.transform(F.slice(gaps, 2, n), lambda g: F.substring(g, 1, CONTEXT))
    for k in range(1, NEAR + 1):
        shifted = F.slice(F.concat(F.array_repeat(F.lit(""), k), ends), 1, n)
        before = F.zip_with(shifted, before, lambda e, b: F.substring(F.concat(e, b), -CONTEXT, CONTEXT))
    for k in range(1, NEAR // 2 + 1):
        shifted = F.slice(F.concat(begins, F.array_repeat(F.lit(""), k)), k + 1, n)
        after = F.zip_with(after, shifted, lambda a, b: F.substring(F.concat(a, b), 1, CONTEXT))
    near = F.zip_with(before, after, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    return F.zip_with(F.zip_with(hits, running_sums(at), lambda h, e: F.struct(h.alias("value"), e.alias("end"))),
                      F.slice(near, 1, F.size(hits)),
                      lambda m, c: F.struct((m.end - F.length(m.value)).alias("start"), m.end.alias("end"),
                                            m.value.alias("value"), c.before.alias("before"), c.after.alias("after")))


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``id``, ``row`` (a hash of id and text that links
    the later steps to it), ``base`` (valid base spans in order, each
    ``(start, rank, end, value, before, after)``) and ``tokens``
    (identifier-like tokens, also of several short groups)."""
    df = docs.select(F.col(id_col).alias("id"), texts(docs, text_col).alias("t"))
    df = df.withColumn("row", F.xxhash64("id", "t"))
    patterns = {**PATTERNS, "token": TOKEN, "spaced": SPACED}
    none = F.array().cast("array<string>")
    for kind, p in patterns.items():
        need = NEEDS.get(kind, "")
        hits = F.regexp_extract_all("t", F.lit(p), F.lit(0))
        df = df.withColumn(f"h_{kind}", F.when(F.contains("t", F.lit(need)), hits).otherwise(none) if need else hits)
    for kind, p in patterns.items():
        df = df.withColumn(f"g_{kind}", F.when(F.size(f"h_{kind}") > 0, F.split("t", p, -1)).otherwise(none))
    df = df.select("id", "row", *[matches(F.col(f"h_{k}"), F.col(f"g_{k}")).alias(k) for k in patterns])

    def base_spans(rank: int, kind: str) -> Column:
        return F.transform(F.filter(kind, lambda m: valid(kind, m.value)), lambda m: F.struct(
            m.start.alias("start"), F.lit(rank).alias("rank"), m.end.alias("end"), m.value.alias("value"),
            m.before.alias("before"), m.after.alias("after")))

    base = [base_spans(rank, kind) for rank, kind in enumerate(KINDS)]

    def bare(m: Column) -> Column:
        open_ = F.regexp_replace(m.value, LEAD, "")
        inner = F.regexp_replace(open_, TRAIL, "")
        lead = F.length(m.value) - F.length(open_)
        return F.struct((m.start + lead).alias("start"), (m.start + lead + F.length(inner)).alias("end"),
                        inner.alias("value"), m.before.alias("before"), m.after.alias("after"))

    def like_identifier(m: Column) -> Column:
        d = digits_of(m.value)
        known = (m.value.rlike(PATTERNS["email"]) | m.value.rlike(PATTERNS["ip"])
                 | (F.length(d).between(12, 19) & luhn(d)))
        return ((F.length(d) >= MIN_DIGITS) | F.contains(m.value, F.lit("@"))) & ~known

    tokens = F.filter(F.transform(F.concat("token", "spaced"), bare), like_identifier)
    return df.select("id", "row", F.array_sort(F.concat(*base)).alias("base"), tokens.alias("tokens"))


def contexts(before: Column, after: Column) -> Column:
    """Lexical patterns around an entity: two words on the left, one word on
    the left, and one word on either side. None where words are missing."""
    left = F.split(F.trim(F.lower(F.regexp_replace(before, r"\s+", " "))), " ")
    right = F.element_at(F.split(F.trim(F.lower(F.regexp_replace(after, r"\s+", " "))), " "), 1)
    one = F.try_element_at(left, F.lit(-1))
    two = F.try_element_at(left, F.lit(-2))
    full = F.length(one) > 0
    return F.filter(F.array(
        F.when(full, F.concat(one, F.lit(" _"))),
        F.when(full & (F.length(two) > 0), F.concat_ws(" ", two, one, F.lit("_"))),
        F.when(full & (F.length(right) > 0), F.concat(one, F.lit(" _ "), right)),
    ), lambda p: p.isNotNull())


def shape(value: Column) -> Column:
    """What an identifier looks like; a pattern is bound to one shape, so that
    mail addresses do not vouch for numbers. Each shape has base kinds that
    seed it: e-mail, and all others (numbers, with letters or without)."""
    return F.when(F.contains(value, F.lit("@")), "@").otherwise("#")


def confident_instances(spans: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
                        min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(value, rank, score)`` of unseen instances that high-confidence
    patterns extract.

    Edges link patterns (words around an instance, and its :func:`shape`) to
    the distinct instances they extract. A pattern's
    confidence is Riloff's RlogF, at most 1: the mean score of its instances,
    times the binary logarithm of the sum of their scores. The logarithm counts
    up to twice ``min_confidence``, so that a confident pattern has a mean of
    a half. An instance's score is 1 for seeds, else the noisy-or of its
    confident patterns. Both are iterated
    ``rounds`` times. The kind is that of most seeds of its best pattern."""
    def edges_of(column: str, rank: Column) -> DataFrame:
        one = spans.select(F.explode(column).alias("m")).select("m", rank.alias("rank"), F.explode(
            contexts(F.col("m.before"), F.col("m.after"))).alias("around"))
        return one.select(F.concat_ws(" ", shape(F.col("m.value")), "around").alias("pattern"),
                          F.lower("m.value").alias("value"), "rank")

    seeds, unseen = edges_of("base", F.col("m.rank")), edges_of("tokens", F.lit(None).cast("int"))
    edges = (seeds.unionByName(unseen).groupBy("pattern", "value").agg(F.min("rank").alias("rank")))
    support = (edges.groupBy("pattern")
               .agg(F.count("rank").alias("seeds"),
                    *[F.count(F.when(F.col("rank") == r, 1)).alias(f"k{r}") for r in range(len(KINDS))])
               .filter(F.col("seeds") >= min_seeds))
    top = F.greatest(*[F.col(f"k{r}") for r in range(len(KINDS))])
    kind = F.coalesce(*[F.when(F.col(f"k{r}") == top, F.lit(r)) for r in range(len(KINDS))])
    edges = cut(edges.join(support.select("pattern", kind.alias("kind")), "pattern"))
    scored = edges.withColumn("score", F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0))
    for number in range(rounds):
        strength = F.least(F.log2(F.sum("score")), F.lit(2 * min_confidence))
        pattern = scored.groupBy("pattern").agg(F.least(F.avg("score") * strength, F.lit(1.0)).alias("confidence"))
        graded = edges.join(pattern, "pattern")
        sure = F.when(F.col("confidence") >= min_confidence, F.col("confidence"))
        # An instance that is a seed anywhere scores 1 wherever it occurs.
        instance = graded.groupBy("value").agg(
            F.max(F.col("rank").isNotNull()).alias("seed"),
            (1 - F.exp(F.sum(F.log(1 - F.least(F.coalesce(sure, F.lit(0.0)), F.lit(0.999)))))).alias("or"),
            F.max(F.struct(sure.alias("confidence"), (-F.col("kind")).alias("k"))).alias("best"))
        instance = instance.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.col("or")))
        if number < rounds - 1:
            scored = edges.join(instance.select("value", "score"), "value")
    return (instance.filter(~F.col("seed") & (F.col("score") >= min_confidence) & F.col("best.confidence").isNotNull())
            .select("value", (-F.col("best.k")).alias("rank"), "score"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
                  min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(id, row, base, extra)`` per row of ``docs``.

    ``base``: valid base spans ``(start, rank, end, value, ...)`` by start,
    then kind (``KINDS[rank]``). ``extra``: contextual spans ``(start, rank,
    end)`` that overlap no base span. Offsets are code points, ends exclusive.
    ``row`` is a hash of id and text.

    A null text is an empty one: no spans. Rows with null ids and repeated
    rows each get their own row and spans. A value with several best patterns
    takes the first kind in order. Empty tables give an empty result; other
    columns are ignored, whatever their names. Whole texts are searched; a
    context word farther than 48 characters is not seen.
    """
    spans = cut(found(docs, id_col, text_col))
    known = confident_instances(spans, rounds, min_seeds, min_confidence)
    extra = (spans.select("row", F.explode("tokens").alias("m")).select("row", "m.start", "m.end",
                                                                        F.lower("m.value").alias("value"))
             .join(known, "value").groupBy("row")
             .agg(F.array_sort(F.collect_set(F.struct("start", "rank", "end"))).alias("extra")))
    joined = spans.drop("tokens").join(extra, "row", "left")
    apart = F.filter("extra", lambda e: ~F.exists("base", lambda b: (b.start < e.end) & (e.start < b.end)))
    return joined.select("id", "row", "base",
                         F.coalesce(apart, F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")).alias("extra"))


def spell(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s.rank + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def count_of(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s.rank == rank)).cast("long")


def bare_spans(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.rank.alias("rank"), s.end.alias("end")))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every personal-data span of the text replaced by
    ``[KIND]``; overlapping spans become one, of the first one's kind. Null
    texts stay null; all columns, whatever their names, row count and other
    values stay. Repeated rows are redacted alike, rows with a null id by their
    text; empty texts and tables stay empty; texts of any length are whole."""
    hits = personal_data(docs, id_col, text_col).withColumn(
        "all", F.array_sort(F.concat(bare_spans(F.col("base")), "extra"))).filter(F.size("all") > 0)
    hits = hits.groupBy("id", "row").agg(F.first("all").alias("all"))   # repeated rows have equal spans
    merged = F.aggregate("all", F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s.start < F.element_at(acc, -1).end),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1).start.alias("start"), F.element_at(acc, -1).rank.alias("rank"),
            F.greatest(F.element_at(acc, -1).end, s.end).alias("end"))))).otherwise(F.array_append(acc, s)))
    row, key, spans = (free_name(docs, n) for n in ("pii_row", "pii_id", "pii_spans"))
    hits = hits.select(F.col("row").alias(row), F.col("id").alias(key), merged.alias(spans))
    df = docs.select("*", F.xxhash64(F.col(id_col), texts(docs, text_col)).alias(f"{row}_of"))
    df = df.join(hits, (F.col(f"{row}_of") == F.col(row)) & F.col(id_col).eqNullSafe(F.col(key)), "left")
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s.end))
    kept = F.zip_with(begins, spans, lambda b, s: F.concat(
        F.substring(F.col(text_col), (b + 1).cast("int"), F.coalesce(s.start - b, F.lit(2 ** 31 - 1)).cast("int")),
        F.when(s.isNotNull(), F.element_at(marks, s.rank + 1)).otherwise(F.lit(""))))
    text = F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(F.col(text_col))
    return df.select(*[text.alias(text_col) if name == text_col else c for name, c in zip(docs.columns, columns(docs))])
