"""Connected components of an edge list whose hubs may be huge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlens.session import cut


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of an edge; the component is its smallest id.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Neighbour minima are
    map-side aggregates, written before they are joined, so that both sides of each join are plain
    shuffles and a hub's edges can be split over tasks. Empty input gives no rows; self-loops and
    repeated edges are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    vertices = e.select("u").union(e.select(F.col("v").alias("u"))).distinct()
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return vertices.join(e, "u", "left").select(F.col("u").alias("id"), F.coalesce("v", "u").alias("component"))
        before = now
    raise RuntimeError("components did not converge")
