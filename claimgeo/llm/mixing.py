"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted once into cells (one per combination of the margins);
the token weights of the cells are raked to the target of each margin in
turn. Every step is a map-side combined aggregate over the cells joined to
the other margins' factors, so neither documents nor cells of one category meet in one task.
Then each document is sampled by its cell's calibrated rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, free_name, texts

MARGINS = ["source", "lang", "topic"]
ROUNDS = 8
TEMPERATURE = 0.8
SEED = 7
BROADCAST_CELLS = 50_000          # cells (about 100 bytes each) that may be broadcast
WORD = r"[^\x20\x09-\x0D]+"
# The topic rules, first match wins.
TOPICS = [
    ("legal", r"(?i)licen[sc]e|copyright"),
    ("table", r"\|"),
    ("contact", r"@|\+[0-9]"),
    ("noisy", r"[%&#*$!]{2,}"),
]
OTHER_TOPIC = "prose"
MISSING = "(none)"


def topic(text: Column) -> Column:
    """Topic of a text by rules over the whole text."""
    out = F.lit(OTHER_TOPIC)
    for name, rule in reversed(TOPICS):
        out = F.when(text.rlike(rule), F.lit(name)).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id alone."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets_of(cells: DataFrame, margin: str, wanted: dict[str, float] | None, temperature: float) -> DataFrame:
    """``(margin, share)``: the wanted weights, or the token shares raised to
    ``temperature``, normalised over the categories that hold tokens."""
    held = cells.groupBy(margin).agg(F.sum("tokens").alias("held")).filter("held > 0")
    if wanted is None:
        raw = held.select(margin, F.pow("held", F.lit(temperature)).alias("raw"))
    else:
        given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in wanted.items()], f"{margin} string, raw double")
        raw = held.join(given, margin, "left").select(margin, F.coalesce("raw", F.lit(0.0)).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total"))
    return raw.select(margin, (F.col("raw") / total.scalar()).alias("share"))


def rake(cells: DataFrame, margins: list[str], targets: dict[str, dict[str, float]] | None = None,
         rounds: int = ROUNDS, temperature: float = TEMPERATURE) -> DataFrame:
    """``cells`` (margins, ``tokens``) with ``rate``: raked token weight over
    tokens, 1 where a cell has no tokens. After ``rounds`` rounds the last
    margin is met exactly and the others as far as the cells allow."""
    cells = cut(cells.withColumn("tokens", F.col("tokens").cast("double")))
    few = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    small = F.broadcast if few else (lambda df: df)             # no margin has more categories than there are cells
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    aims = {m: cut(targets_of(cells, m, (targets or {}).get(m), temperature)) for m in margins}
    # The raked weight is the tokens times one factor per margin; only the
    # factors change, and each new set of them is one aggregate over the cells.
    factors = {m: cells.select(m).distinct().withColumn(f"f_{m}", F.lit(1.0)) for m in margins}
    for _ in range(rounds):
        for m in margins:
            weight, joined = F.col("tokens"), cells
            for other in margins:
                if other != m:
                    joined, weight = joined.join(small(factors[other]), other), weight * F.col(f"f_{other}")
            now = joined.groupBy(m).agg(F.sum(weight).alias("now")).join(small(aims[m]), m, "left")
            factors[m] = cut(now.select(m, F.coalesce(F.when(F.col("now") > 0, F.col("share") * F.lit(total) / F.col("now")),
                                                      F.lit(1.0)).alias(f"f_{m}")))
    rate = F.lit(1.0)
    for m in margins:
        cells, rate = cells.join(small(factors[m]), m), rate * F.col(f"f_{m}")
    return cells.select(*margins, "tokens", F.when(F.col("tokens") > 0, rate).otherwise(1.0).alias("rate"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          lang_col: str = "lang", topic_col: str | None = None, targets: dict[str, dict[str, float]] | None = None,
          rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """``docs`` with ``mix_topic``, ``mix_tokens``, ``mix_rate`` (how often a
    document of its cell is to be seen so that the tokens meet the targets)
    and ``mix_copies`` (that number rounded up or down at random by id, 0 for
    documents left out).

    ``targets`` maps a margin (``source``, ``lang``, ``topic``) to wanted
    shares; a margin without one aims at its token shares raised to
    ``temperature``. Without ``topic_col`` the topic comes from rules over the
    text. Null margins are the category ``(none)``; null and empty texts hold
    no tokens, and cells without tokens have rate 1. Repeated rows and rows
    with null ids are sampled like others; rows of equal ids alike. An empty
    table gives an empty result. Columns of ``docs`` keep their names and
    values; ones named like the four are replaced.
    """
    names = {"source": source_col, "lang": lang_col}
    clash = [c for c in docs.columns if c.lower() in ("mix_topic", "mix_tokens", "mix_rate", "mix_copies")]
    docs = docs.drop(*clash)
    keys = [free_name(docs, f"mix_of_{m}") for m in ("source", "lang")] + ["mix_topic"]
    margin = [F.coalesce(F.col(names[m]).cast("string"), F.lit(MISSING)).alias(k) for m, k in zip(("source", "lang"), keys)]
    margin.append((topic(texts(docs, text_col)) if topic_col is None else
                   F.coalesce(F.col(topic_col).cast("string"), F.lit(MISSING))).alias("mix_topic"))
    marked = docs.select("*", *margin, n_tokens(texts(docs, text_col)).alias("mix_tokens"))
    cells = marked.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens"))
    cells = cells.select(*[F.col(k).alias(m) for k, m in zip(keys, MARGINS)], "tokens")
    rates = cut(rake(cells, MARGINS, targets, rounds, temperature))
    few = rates.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    rates = rates.select(*[F.col(m).alias(k) for k, m in zip(keys, MARGINS)], F.col("rate").alias("mix_rate"))
    out = marked.join(F.broadcast(rates) if few else rates, keys)
    copies = F.floor("mix_rate") + (uniform(F.col(id_col), seed) < F.col("mix_rate") - F.floor("mix_rate")).cast("long")
    return out.select(*columns(docs), "mix_topic", "mix_tokens", "mix_rate", copies.alias("mix_copies"))


def oracle_sql(rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """The query over ``documents`` in SQL: the rounds unrolled."""
    rules = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{rule}') THEN '{name}'" for name, rule in TOPICS)
    ctes = [f"""d AS (SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang,
        CASE {rules} ELSE '{OTHER_TOPIC}' END AS topic,
        len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n FROM documents)""",
            "c0 AS (SELECT source, lang, topic, sum(n)::DOUBLE AS t, sum(n)::DOUBLE AS w FROM d GROUP BY ALL)",
            "total AS (SELECT sum(t) AS all_t FROM c0)"]
    for m in MARGINS:
        ctes.append(f"a_{m} AS (SELECT {m}, pow(sum(t), {temperature}) / sum(pow(sum(t), {temperature})) OVER () AS share "
                    f"FROM c0 GROUP BY {m} HAVING sum(t) > 0)")
    at = 0
    for _ in range(rounds):
        for m in MARGINS:
            ctes.append(f"c{at + 1} AS (SELECT c.source, c.lang, c.topic, t, w * coalesce(share * all_t / "
                        f"nullif(sum(w) OVER (PARTITION BY c.{m}), 0), 1) AS w "
                        f"FROM c{at} c CROSS JOIN total LEFT JOIN a_{m} USING ({m}))")
            at += 1
    ctes.append(f"r AS (SELECT source, lang, topic, CASE WHEN t > 0 THEN w / t ELSE 1 END AS rate FROM c{at})")
    u = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT / {float(1 << 52)}"
    return "WITH " + ",\n".join(ctes) + f"""
        SELECT doc_id, topic AS mix_topic, n AS mix_tokens, round(rate, 6) AS mix_rate,
               (floor(rate) + ({u} < rate - floor(rate))::INT)::BIGINT AS mix_copies
        FROM d JOIN r USING (source, lang, topic)"""
