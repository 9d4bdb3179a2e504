"""Geocoder hand-off: reading the reply, joining it back, ledger and gate
(S6, S7, W6, J2, J10, J11, X19, A6, A14, A15, Q1, Q2).

The claim side is always pre-aggregated to one row per address id before it
meets the geocoder reply (``seen_counts``), so every reconciliation is a join
of two address-sized tables. The row-level enrichment (J2) is a plain left
equi join: the reply is one row per address (tens of thousands in practice),
and AQE turns the join into a broadcast only when the measured size is below
``spark.sql.autoBroadcastJoinThreshold``; no unchecked broadcast hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as X
from ..sources.csv import quoted, read_csv

GEOCODER_COLUMNS = {  # source header -> our name
    "address_id": "address_id",
    "Status": "geocode_status",
    "CountyFIPS": "county_fips",
    "CountyNAME": "county_name",
    "Latitude": "latitude",
    "Longitude": "longitude",
}
REASONS = ("geocoder_unmatched", "join_miss", "unexpected_missing_coords")


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per ``key``, the first under ``order`` (a total order).

    Runs as a hash aggregate with ``min_by`` on a struct, so each map task
    keeps one candidate per key before the shuffle; a key repeated a
    million times costs one row per task, not a skewed window partition."""
    others = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*others), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(best.alias("__r")).select(key, *[F.col("__r")[c].alias(c) for c in others])


def read_geocoded(spark: SparkSession, path: str) -> DataFrame:
    """Geocoder CSV (BOM tolerated), the six columns by name, FIPS padded
    to five digits (empty -> NULL), coordinates as DOUBLE, and duplicate
    address ids reduced to the first by file name, place in the file's split,
    and content (a total order that does not depend on how files are read)."""
    raw = read_csv(spark, path)
    plain = {c.lstrip("\ufeff"): c for c in raw.columns}
    missing = [c for c in GEOCODER_COLUMNS if c not in plain]
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    sel = raw.select(*[quoted(plain[src]).alias(dst) for src, dst in GEOCODER_COLUMNS.items()],
                     F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                     F.monotonically_increasing_id().alias("__pos"))
    sel = sel.select(
        "address_id", "geocode_status", X.pad_id("county_fips", 5).alias("county_fips"), "county_name",
        F.expr("try_cast(latitude AS DOUBLE)").alias("latitude"),
        F.expr("try_cast(longitude AS DOUBLE)").alias("longitude"), "__file", "__block", "__pos")
    order = ["__file", "__block", "__pos", "geocode_status", "county_fips", "latitude", "longitude"]
    return keep_first(sel, "address_id", order).drop("__file", "__block", "__pos")


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Number of rows beyond the first per key (the warning count of S6)."""
    return df.agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("n_duplicates"))


def select_existing(df: DataFrame, want: list[str], key: str) -> DataFrame:
    """Keep whichever of ``want`` exist, one row per ``key``."""
    cols = [c for c in want if c in df.columns]
    return keep_first(df.select(*cols), key, [c for c in cols if c != key] or [key]) if len(cols) > 1 \
        else df.select(*cols).distinct()


def located(lat: str = "latitude", lon: str = "longitude") -> F.Column:
    """a row is located only when both coordinates are present."""
    return F.col(lat).isNotNull() & F.col(lon).isNotNull()


def with_address_id(df: DataFrame, parts: list[str]) -> DataFrame:
    return df.withColumn("address_id", X.address_id(parts))


def geocode_join(claims: DataFrame, geo: DataFrame, salt: int | None = None) -> DataFrame:
    """Enrich claim rows (carrying ``address_id``) with the reply.

    With ``salt=N`` the join key gets a salt in [0, N): claim rows take a
    deterministic salt from a hash of the row (the same on a retry), and each
    reply row is replicated N times (the reply is address-sized). One address
    holding a third of all claims then spreads over N tasks instead of one.
    Without it, AQE's skew-join split handles a hot key."""
    g = geo.select("address_id", "geocode_status", "county_fips", "county_name", "latitude", "longitude")
    c = claims.drop("county_fips") if "county_fips" in claims.columns else claims
    if not salt:
        return c.join(g, "address_id", "left")
    cs = c.withColumn("__salt", F.pmod(F.xxhash64(*c.columns), F.lit(salt)).cast("int"))
    gs = g.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return cs.join(gs, ["address_id", "__salt"], "left").drop("__salt")


HOT_SHARE = 1000          # at most so many raw addresses hold more than 1 / HOT_SHARE of the rows


def raw_addresses(claims: DataFrame, parts: list[str]) -> DataFrame:
    """The distinct raw addresses (the ``parts`` as they are, NULLs too), each
    with its row count ``n_rows_seen``: a map-side combined count."""
    return claims.groupBy(*parts).agg(F.count(F.lit(1)).alias("n_rows_seen")).filter("n_rows_seen > 0")


def address_dictionary(seen: DataFrame, geo: DataFrame, parts: list[str]) -> DataFrame:
    """:func:`raw_addresses` with ``address_id`` and the reply's columns: the
    id's normalisation and hash run once per raw address, not once per claim row."""
    g = geo.select("address_id", "geocode_status", "county_fips", "county_name", "latitude", "longitude")
    return with_address_id(seen, parts).join(g, "address_id", "left")


def geocode_join_by_dictionary(claims: DataFrame, geo: DataFrame, parts: list[str], rows_per_task: int = 1_000_000) -> DataFrame:
    """J2 without a regex or hash per claim row: claim rows meet the
    :func:`address_dictionary` on their raw address parts.

    The dictionary's counts show the hot addresses exactly. A raw address with
    more than ``rows_per_task`` rows, and more than 1 / ``HOT_SHARE`` of all,
    is split: its dictionary row is repeated once per part and its claim rows
    are dealt over the parts by a hash of the row (the same on a retry). There
    are at most ``HOT_SHARE`` such addresses at any size, so their list is
    broadcast; all other rows join on one key each. NULL parts match NULL
    parts, as in the address id."""
    c = claims.drop("county_fips") if "county_fips" in claims.columns else claims
    # The three uses of the counts differ above the exchange only, which Spark reuses.
    seen = raw_addresses(c, parts)
    total = seen.agg(F.sum("n_rows_seen")).scalar()
    bound = F.greatest(F.lit(rows_per_task), F.ceil(total / F.lit(HOT_SHARE)))
    spread = F.ceil(F.col("n_rows_seen") / bound).cast("int").alias("__parts")
    hot = seen.select(*[F.col(p).alias(f"__{p}") for p in parts], spread).filter("__parts > 1")
    words = address_dictionary(seen, geo, parts).select("*", spread).drop("n_rows_seen")

    def same(a: DataFrame, b: DataFrame):
        on = F.lit(True)
        for p in parts:
            on = on & a[p].eqNullSafe(b[f"__{p}"])
        return on

    dealt = c.join(F.broadcast(hot), same(c, hot), "left").select(
        *c.columns, F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*c.columns), "__parts")).cast("int").alias("__part"))
    repeated = words.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).select(
        *[F.col(p).alias(f"__{p}") for p in parts], "__slot", *[x for x in words.columns if x not in (*parts, "__parts")])
    out = dealt.join(repeated, same(dealt, repeated) & (dealt["__part"] == repeated["__slot"]), "left")
    return out.drop("__part", "__slot", *[f"__{p}" for p in parts])


def seen_counts(claims: DataFrame) -> DataFrame:
    """Claim rows per address id (partial aggregate before the shuffle)."""
    return claims.groupBy("address_id").agg(F.count(F.lit(1)).alias("n_claim_rows"))


def geocode_summary(geo: DataFrame, joined: DataFrame) -> DataFrame:
    """Reply addresses, those without coordinates / county; claim rows,
    located and failed rows with their shares. One row."""
    g = geo.agg(F.count(F.lit(1)).alias("n_addresses"),
                F.count_if(~located()).alias("n_without_latlon"),
                F.count_if(F.col("county_fips").isNull()).alias("n_without_county"))
    j = joined.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(located()).alias("located_rows"))
    n_a, n_ll, n_c = (g.select(c).scalar() for c in ("n_addresses", "n_without_latlon", "n_without_county"))
    tot = F.col("total_rows")
    return j.select(
        n_a.alias("n_addresses"), n_ll.alias("n_without_latlon"), n_c.alias("n_without_county"),
        "total_rows", "located_rows", (tot - F.col("located_rows")).alias("failed_rows"),
        F.round(F.when(tot > 0, F.lit(100.0) * F.col("located_rows") / tot), 6).alias("located_pct"),
        F.round(F.when(tot > 0, F.lit(100.0) * (tot - F.col("located_rows")) / tot), 6).alias("failed_pct"))


def reconcile_ids(seen: DataFrame, geo: DataFrame) -> DataFrame:
    """J10 + X19: one full outer join of the seen and geocoded id sets; each
    id gets ``side`` (seen_only / both / geo_only) and its failure reason."""
    g = geo.select("address_id", "geocode_status", "latitude", "longitude",
                   *[c for c in ("address_full", "n_rows") if c in geo.columns],
                   F.lit(True).alias("__in_geo"))
    s = seen.withColumn("__in_seen", F.lit(True))
    j = s.join(g, "address_id", "full_outer")
    in_s = F.coalesce(F.col("__in_seen"), F.lit(False))
    in_g = F.coalesce(F.col("__in_geo"), F.lit(False))
    no_coords = ~located()
    reason = (F.when(in_s & ~in_g, "join_miss")
              .when(in_s & in_g & no_coords & (F.col("geocode_status") == "U"), "geocoder_unmatched")
              .when(in_s & in_g & no_coords, "unexpected_missing_coords"))
    side = F.when(in_s & in_g, "both").when(in_s, "seen_only").otherwise("geo_only")
    return j.withColumn("side", side).withColumn("failure_reason", reason).drop("__in_seen", "__in_geo")


def geocode_ledger(seen: DataFrame, geo: DataFrame) -> DataFrame:
    """Q1: per failed address: reason, claim rows, reply status and full
    address (both NULL for a join miss), ordered by reason, then rows desc."""
    r = reconcile_ids(seen, geo).filter(F.col("failure_reason").isNotNull())
    full = F.col("address_full") if "address_full" in geo.columns else F.lit(None).cast("string")
    return r.select(
        "address_id", "failure_reason", F.col("n_claim_rows").cast("bigint").alias("n_claim_rows"),
        F.when(F.col("failure_reason") != "join_miss", F.col("geocode_status")).alias("geocode_status"),
        F.when(F.col("failure_reason") != "join_miss", full).alias("address_full"),
    ).orderBy("failure_reason", F.desc("n_claim_rows"), "address_id")


def failure_totals(ledger: DataFrame) -> DataFrame:
    """Addresses and claim rows per reason (every reason, 0 where none
    failed), plus a TOTAL row."""
    counts = [F.count(F.lit(1)).alias("addresses"), F.sum("n_claim_rows").cast("bigint").alias("claim_rows")]
    per = ledger.rollup("failure_reason").agg(*counts).select(
        F.coalesce("failure_reason", F.lit("TOTAL")).alias("failure_reason"), "addresses", "claim_rows")
    names = ledger.sparkSession.createDataFrame([(r,) for r in (*K.FAILURE_REASONS, "TOTAL")], "failure_reason string")
    return names.join(per, "failure_reason", "left").select(
        "failure_reason", F.coalesce("addresses", F.lit(0).cast("bigint")).alias("addresses"),
        F.coalesce("claim_rows", F.lit(0).cast("bigint")).alias("claim_rows"))


def reconcile_counts(seen: DataFrame, geo: DataFrame) -> DataFrame:
    """Per id present on both sides, expected ``n_rows`` (NULL -> 0)
    against the claim rows seen, and whether they differ."""
    j = seen.join(geo.select("address_id", "n_rows"), "address_id", "inner")
    exp = F.coalesce(F.col("n_rows").cast("bigint"), F.lit(0).cast("bigint"))
    act = F.coalesce(F.col("n_claim_rows").cast("bigint"), F.lit(0).cast("bigint"))
    return j.select("address_id", exp.alias("expected_rows"), act.alias("actual_rows"), (exp != act).alias("mismatch"))


def geocode_gate(seen: DataFrame, geo: DataFrame) -> DataFrame:
    """Q2: the integrity checks, one row each, and an overall row. Expected
    loss (geocoder_unmatched) does not fail the gate; a reply without
    ``n_rows`` has no row-count check."""
    r = reconcile_ids(seen, geo)
    c = r.agg(
        F.count_if(F.col("side") == "geo_only").alias("unused_geocoded"),
        F.coalesce(F.sum(F.when(F.col("failure_reason") == "join_miss", F.col("n_claim_rows"))), F.lit(0))
         .alias("join_miss_rows"),
        F.coalesce(F.sum(F.when(F.col("failure_reason") == "unexpected_missing_coords", F.col("n_claim_rows"))),
                   F.lit(0)).alias("unexpected_missing_rows"))
    checks = c.select(F.explode(F.array(
        F.struct(F.lit(1).alias("n"), F.lit("unused_geocoded").alias("check"),
                 F.col("unused_geocoded").cast("bigint").alias("n_bad")),
        F.struct(F.lit(2).alias("n"), F.lit("join_miss_rows").alias("check"),
                 F.col("join_miss_rows").cast("bigint").alias("n_bad")),
        F.struct(F.lit(3).alias("n"), F.lit("unexpected_missing_rows").alias("check"),
                 F.col("unexpected_missing_rows").cast("bigint").alias("n_bad")),
    )).alias("c")).select("c.*")
    allc = checks
    if "n_rows" in geo.columns:
        mism = reconcile_counts(seen, geo).agg(F.count_if("mismatch").cast("bigint").alias("n_bad"))
        allc = allc.unionByName(mism.select(F.lit(4).alias("n"), F.lit("n_rows_mismatch").alias("check"), "n_bad"))
    total = allc.agg(F.sum("n_bad").alias("s")).select(
        F.lit(5).alias("n"), F.lit("all_checks").alias("check"), F.col("s").cast("bigint").alias("n_bad"))
    return allc.unionByName(total).select("check", "n_bad", (F.col("n_bad") == 0).alias("ok"))
