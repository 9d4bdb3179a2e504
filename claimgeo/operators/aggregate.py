"""Categorised base, category aggregates, roll-ups and invariant checks.

Plan shape (what ``.explain`` shows): one scan of the merged claims, a
broadcast hash join to the 56-row FIPS -> postal dimension (a fixed-size
table, so the broadcast is bounded by construction), then hash aggregates.
``fine_aggregate`` shrinks the claim rows once to
(county, zip3, month, category) and every published output is a roll-up of
it, so the six outputs share one shuffle of the raw rows and the additivity
invariants hold by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as X

MEASURES = ("total_beneficiaries_served", "total_claims", "total_amount_paid")
LEVEL_KEYS = {"state": "state", "county": "county_fips", "zip3": "zip3"}
GRAIN_PERIODS = {"annual": ("year", "year"), "monthly": ("year_month", "year_month")}


def fips_dimension(spark: SparkSession) -> DataFrame:
    """The fixed FIPS prefix -> postal map as a DataFrame (56 rows)."""
    return spark.createDataFrame(list(K.STATE_FIPS_TO_POSTAL.items()), "state_fips string, postal string")


def state_names(spark: SparkSession) -> DataFrame:
    """Postal -> state name (56 rows)."""
    return spark.createDataFrame(list(K.STATE_POSTAL_TO_NAME.items()), "postal string, state_name string")


def attach_parent(df: DataFrame, child: str, parent_map: DataFrame, map_key: str = "state_fips",
                  map_value: str = "postal", n: int = 2, alias: str = "state") -> DataFrame:
    """Left join on the first ``n`` characters of ``child`` to a parent
    map. Whether it is broadcast is left to Spark's size check."""
    pm = parent_map.select(F.col(map_key).alias("__pk"), F.col(map_value).alias(alias))
    return (df.withColumn("__pfx", X.prefix(child, n))
              .join(pm, F.col("__pfx") == F.col("__pk"), "left")
              .drop("__pfx", "__pk"))


def strict_parent(df: DataFrame, child: str, parent_map: DataFrame, n: int = 2,
                  map_key: str = "state_fips", map_value: str = "postal",
                  alias: str = "state") -> DataFrame:
    """As :func:`attach_parent`, but raise ``ValueError`` listing the
    prefixes that have no parent. This is an action (a distinct of the
    unmapped prefixes)."""
    out = attach_parent(df, child, parent_map, map_key, map_value, n, alias)
    bad = (out.filter(F.col(alias).isNull() & F.col(child).isNotNull())
              .select(X.prefix(child, n).alias("p")).distinct().orderBy("p").collect())
    if bad:
        raise ValueError(f"unmapped {child} prefixes: {[r.p for r in bad]}")
    return out


def categorised_base(merged: DataFrame, fips_map: DataFrame, code: str = "code",
                     county: str = "county_fips", zip5: str = "practice_zip5",
                     month: str = "year_month") -> DataFrame:
    """One row per merged claim row with its geography, period and category."""
    # The code number is its own projection so the regex runs once per row;
    # the 12-range CASE then reads the integer (Catalyst does not inline a
    # non-trivial expression that is referenced many times).
    numbered = merged.select(
        F.nullif(F.col(county), F.lit("")).alias("county_fips"),
        X.prefix(zip5, 3, trim=True).alias("zip3"),
        F.col(month).alias("year_month"),
        F.substring(month, 1, 4).alias("year"),
        X.code_number(code).alias("__code_n"),
        F.col("benef"), F.col("claims"), F.col("paid"),
    )
    base = numbered.select("county_fips", "zip3", "year_month", "year",
                           X.category("__code_n").alias("category"), "benef", "claims", "paid")
    return attach_parent(base, "county_fips", fips_map)


def _sums(benef="benef", claims="claims", paid="paid") -> list[Column]:
    return [
        F.sum(benef).cast("bigint").alias("total_beneficiaries_served"),
        F.sum(claims).cast("bigint").alias("total_claims"),
        F.sum(paid).cast("decimal(38,2)").alias("total_amount_paid"),
    ]


def _resum() -> list[Column]:
    return _sums(*MEASURES)


def category_aggregate(base: DataFrame, key: str, period: str, from_fine: bool = False) -> DataFrame:
    """A1 (+F4): sums by (key, period, category) over the rows where ``key``
    is known. Each level keeps the rows its own geography covers."""
    agg = _resum() if from_fine else _sums()
    return (base.filter(F.col(key).isNotNull())
                .groupBy(F.col(key).alias("key"), F.col(period).alias("period"), "category")
                .agg(*agg))


def fine_aggregate(base: DataFrame) -> DataFrame:
    """Additive pre-aggregate at (state, county, zip3, month, category); the
    six outputs and both invariants are roll-ups of it."""
    return (base.groupBy("state", "county_fips", "zip3", "year_month", "year", "category")
                .agg(*_sums()))


def all_aggregates(base: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """K4: the six outputs {annual, monthly} x {state, county, zip3} as lazy
    roll-ups of the fine aggregate. To write all six, use
    ``sources.sinks.write_all_outputs``, which computes them in one
    persisted multi-level aggregate."""
    fine = fine_aggregate(base)
    out = {}
    for grain, (pcol, _) in GRAIN_PERIODS.items():
        for level, kcol in LEVEL_KEYS.items():
            out[(grain, level)] = category_aggregate(fine, kcol, pcol, from_fine=True)
    return out


def multi_level_aggregate(base: DataFrame, levels: dict[str, str] = LEVEL_KEYS,
                          periods: tuple[str, ...] = ("year",)) -> DataFrame:
    """Several (grain, level) outputs in one aggregate.

    The claim rows shrink once to the fine aggregate; each fine row is then
    exploded into one row per (period column, level) with its key, and a
    single group-by on (grain, level, key, period, category) produces every
    output. One shuffle of raw rows instead of one per output, and no
    per-level filter pushed under the shared aggregate.
    """
    fine = fine_aggregate(base)
    specs = [F.struct(F.lit(p).alias("grain"), F.lit(level).alias("level"),
                      F.col(k).alias("key"), F.col(p).alias("period"))
             for p in periods for level, k in levels.items()]
    ex = fine.select(F.inline(F.array(*specs)), "category", *MEASURES)
    return (ex.filter(F.col("key").isNotNull())
              .groupBy("grain", "level", "key", "period", "category").agg(*_resum()))


def output_invariants(multi: DataFrame) -> DataFrame:
    """A3 over every output of :func:`multi_level_aggregate` (both grains):
    per level, ``grain_unique`` counts (key, period, category) that occur more
    than once, ``annual_is_months`` those whose annual sums differ from the
    sums of their months (a side without the group counts as 0)."""
    keys = ["level", "key", "category"]
    year = F.substring("period", 1, 4).alias("year")
    per_output = multi.groupBy("grain", *keys, "period").agg(F.count(F.lit(1)).alias("n"), *_resum())
    annual = F.col("grain") == "year"
    differs = F.lit(False)
    sums = []
    for m in MEASURES:
        sums += [F.coalesce(F.sum(F.when(annual, F.col(m))), F.lit(0)).alias(f"y_{m}"),
                 F.coalesce(F.sum(F.when(~annual, F.col(m))), F.lit(0)).alias(f"m_{m}")]
        differs = differs | (F.col(f"y_{m}") != F.col(f"m_{m}"))
    g = per_output.groupBy(*keys, year).agg(F.count_if(F.col("n") > 1).alias("repeats"), *sums)
    t = g.groupBy("level").agg(F.sum("repeats").cast("bigint").alias("grain_unique"), F.count_if(differs).alias("annual_is_months"))
    return t.select("level", F.stack(F.lit(2), F.lit("grain_unique"), F.col("grain_unique"), F.lit("annual_is_months"),
                                     F.col("annual_is_months")).alias("check", "n_bad")) \
            .select("level", "check", "n_bad", (F.col("n_bad") == 0).alias("ok"))


def roll_up(child_agg: DataFrame, parent_map: DataFrame, n: int = 2) -> DataFrame:
    """A2: parent totals from child totals (state = sum of its counties)."""
    with_parent = attach_parent(child_agg, "key", parent_map, n=n, alias="parent")
    return (with_parent.filter(F.col("parent").isNotNull())
            .groupBy(F.col("parent").alias("key"), "period", "category").agg(*_resum()))


def check_additive(fine: DataFrame, coarse: DataFrame, keys: list[str],
                   measures=MEASURES) -> DataFrame:
    """A3: rows where the coarse table differs from the sum of the fine one
    (full outer join on ``keys``; a key missing on one side counts as 0).
    Empty means the invariant holds."""
    f = fine.groupBy(*keys).agg(*[F.sum(m).alias(f"f_{m}") for m in measures])
    c = coarse.select(*keys, *[F.col(m).alias(f"c_{m}") for m in measures])
    j = f.join(c, keys, "full_outer")
    diff = None
    for m in measures:
        d = F.coalesce(F.col(f"f_{m}"), F.lit(0)) != F.coalesce(F.col(f"c_{m}"), F.lit(0))
        diff = d if diff is None else (diff | d)
    return j.filter(diff)


def unmapped_prefixes(base: DataFrame, limit: int = 10) -> DataFrame:
    """A4: number of rows with a county FIPS but no state, and the first
    ``limit`` distinct prefixes (sorted) as one comma-separated string."""
    bad = base.filter(F.col("county_fips").isNotNull() & F.col("state").isNull())
    return bad.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.concat_ws(",", F.slice(F.array_sort(F.collect_set(X.prefix("county_fips", 2))), 1, limit))
         .alias("prefixes"),
    )


CLAIMS_FIELDS = {"category": "string", "total_beneficiaries_served": "bigint", "total_claims": "bigint",
                 "total_amount_paid": "decimal(38,2)"}
ENROLLMENT_FIELDS = {"medicaid_enrollees": "bigint"}


def ndjson_lines(agg: DataFrame, period_field: str = "year", fields: dict[str, str] = CLAIMS_FIELDS) -> DataFrame:
    """K3: one JSON line per key ``{"<key>": [records...]}``; records sorted
    by period, then the fields in order, with a fixed field order and nulls
    kept. ``fields``: the record's fields besides the period.

    ``collect_list`` gathers one key's records: a key is one region (at most
    a few thousand period x category records), never a whole table.
    """
    rec = F.struct(F.col("period").alias(period_field), *[F.col(m) for m in fields])
    per_key = agg.groupBy("key").agg(F.array_sort(F.collect_list(rec)).alias("records"),
                                      F.count(F.lit(1)).alias("n_records"))
    line = F.to_json(F.create_map(F.col("key"), F.col("records")), {"ignoreNullFields": "false"})
    return per_key.select("key", line.alias("line"), "n_records")


def record_schema(period_field: str = "year", fields: dict[str, str] = CLAIMS_FIELDS) -> str:
    inner = ", ".join(f"{name}: {kind}" for name, kind in {period_field: "string", **fields}.items())
    return f"MAP<STRING, ARRAY<STRUCT<{inner}>>>"


def parse_ndjson_lines(lines: DataFrame, period_field: str = "year", col: str = "value",
                       fields: dict[str, str] | None = None) -> DataFrame:
    """Keyed NDJSON text -> (key, period, fields). Blank lines are
    skipped; a line that is no such record raises; a key that occurs on two
    lines is an error (D9), checked by :func:`duplicate_keys`."""
    schema = record_schema(period_field, fields or CLAIMS_FIELDS)
    parsed = (lines.filter(F.trim(F.col(col)) != "")
                   .select(F.from_json(F.col(col), schema, {"mode": "FAILFAST"}).alias("m"))
                   .select(F.explode("m").alias("key", "records"))
                   .filter(F.col("key") != ""))
    return (parsed.select("key", F.inline("records"))
                  .withColumnRenamed(period_field, "period"))


def duplicate_keys(lines: DataFrame, col: str = "value") -> DataFrame:
    """Keys present on more than one line."""
    keys = (lines.filter(F.trim(F.col(col)) != "")
                 .select(F.explode(F.map_keys(F.from_json(F.col(col), "MAP<STRING, STRING>"))).alias("key")))
    return keys.groupBy("key").count().filter(F.col("count") > 1)


def output_counts(multi: DataFrame) -> DataFrame:
    """Number of keys and records per output, one row per output, from
    :func:`multi_level_aggregate` over both grains."""
    grain_name = F.when(F.col("grain") == "year", "annual").otherwise("monthly")
    return multi.groupBy("grain", "level").agg(
        F.count_distinct("key").alias("n_keys"), F.count(F.lit(1)).alias("n_records")
    ).select(F.concat(grain_name, F.lit("_"), F.col("level")).alias("output"), "n_keys", "n_records")
