"""Connected components and proximity clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlens.functions import geo
from stormlens.session import cut


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of the edge list; the component is its smallest id.

    Alternating large-star / small-star rounds (Kiveris et al., 2014): the number of rounds
    grows with the logarithm of the component size, and every step is a min-aggregate and
    an equi-join, so a hub does not gather its neighbours in one task.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut(e.distinct())
    vertices = e.select("u").union(e.select(F.col("v").alias("u"))).distinct()
    signature = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError("components did not converge")
    return vertices.join(e, "u", "left").select(
        F.col("u").alias("id"), F.coalesce("v", "u").alias("component"))


def proximity_components(nodes: DataFrame, node_id: str, lat: str, lon: str, max_km: float,
                         min_size: int = 3) -> DataFrame:
    """Clusters of nodes linked by pairs at most `max_km` apart (planar metric with the cosine
    at the smaller id); clusters below `min_size` are dropped.

    Nodes in one half-radius cell are always linked, so only one representative per cell
    enters the graph. Two cells are linked if any pair qualifies, tested with a semi join:
    pairs are never listed.
    """
    r_m = max_km * 1000.0
    h_lat, h_lon = r_m / 2 / geo.M_PER_DEG_LAT, r_m / 2 / geo.M_PER_DEG_LON_EQ
    n = nodes.select(F.col(node_id).alias("id"), F.col(lat).alias("la"), F.col(lon).alias("lo"))
    n = n.where(F.col("la").isNotNull() & F.col("lo").isNotNull())
    n = n.withColumn("ci", F.floor(F.col("la") / h_lat)).withColumn("cj", F.floor(F.col("lo") / h_lon))
    n = cut(n)
    reps = n.groupBy("ci", "cj").agg(F.min("id").alias("rep"))

    reach = F.ceil(2 / F.greatest(F.cos(F.radians(F.abs("la") + 2 * h_lat)), F.lit(1e-3))).cast("int")
    probe = (n.withColumn("di", F.explode(F.sequence(F.lit(-2), F.lit(2))))
             .withColumn("dj", F.explode(F.sequence(-reach, reach)))
             .where("di <> 0 or dj <> 0")
             .withColumn("oi", F.col("ci") + F.col("di")).withColumn("oj", F.col("cj") + F.col("dj")))
    other = n.select(F.col("id").alias("id2"), F.col("la").alias("la2"), F.col("lo").alias("lo2"),
                     F.col("ci").alias("oi2"), F.col("cj").alias("oj2"))
    d = F.when(F.col("id") < F.col("id2"), geo.planar_km("la", "lo", "la2", "lo2")).otherwise(
        geo.planar_km("la2", "lo2", "la", "lo"))
    near = probe.join(other, (F.col("oi") == F.col("oi2")) & (F.col("oj") == F.col("oj2"))
                      & (d <= max_km), "left_semi")
    links = near.select("ci", "cj", "oi", "oj").distinct()
    links = links.join(reps.withColumnRenamed("rep", "a"), ["ci", "cj"]).join(
        reps.select(F.col("ci").alias("oi"), F.col("cj").alias("oj"), F.col("rep").alias("b")),
        ["oi", "oj"]).select("a", "b")
    comp = components(links, "a", "b")
    member = (n.join(reps, ["ci", "cj"]).join(comp.withColumnRenamed("id", "rep"), "rep", "left")
              .select("id", F.coalesce("component", "rep").alias("component")))
    big = member.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return member.join(big, "component").select(F.col("id").alias(node_id), "component", "size")
