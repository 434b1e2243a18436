"""Connected components of a graph by alternating stars, in Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import cut, drop


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Least vertex reachable from every vertex of ``links`` (u long, v long): ``(vertex, root)``.

    Large-star and small-star steps (Kiveris and others, 2014) take a number of rounds logarithmic in the size of a
    component. Each round is one aggregation with partial sums and one join; nothing is collected but one count. Self
    links and repeated links do no harm; vertices are those that occur in a link. An empty input gives no rows.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges, last = cut(small, "stars"), edges
        drop(last)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
