"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(u, v)``;
    ``root`` is the smallest node of the component (for the root itself, too).

    Large-star and small-star rounds (Kiveris et al., 2014): each round links
    every node's larger neighbours, then its smaller ones, to its minimum.
    The per-node minimum is a map-side combined aggregate and hubs meet it
    through an equi-join that AQE may split; no neighbour list is collected.
    Each round's edges are checkpointed. Stops when a round changes nothing;
    raises if ``max_rounds`` (far above the logarithmic bound) do not do.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .filter("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small_low.select("u", F.col("m").alias("v"))))
        e = cut(small.filter("u <> v").distinct())
        seen = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if seen == mark:
            stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
