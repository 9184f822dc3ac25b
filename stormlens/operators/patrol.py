"""Watch sectors, revisit schedules, patrol results and nearest-node picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlens.functions import geo
from stormlens.operators.joins import radius_join
from stormlens.operators.reach import radius_first

# Watch window, camera range, floor and ceiling of the recency ramp.
MAX_AGE_H = 72.0
MAX_RANGE_KM = 30.0
RAMP_FLOOR, RAMP_TOP = 5.0, 50.0


def watch_sectors(strikes: DataFrame, nodes: DataFrame, node: str, lat: str, lon: str, *,
                  time: str, now: str, unit_per_hour=3600.0, max_age_h: float = MAX_AGE_H,
                  max_range_km: float = MAX_RANGE_KM) -> DataFrame:
    """Bearing, range, age and risk of each recent strike in reach of each node.

    `strikes` has lat, lon, `time`, `now` and a nullable risk; an unscored strike gets a
    recency ramp capped at 50. Both gates are inclusive.
    """
    fresh, risk = _fresh(strikes, time, now, unit_per_hour, max_age_h)
    pairs = radius_join(fresh, nodes.select(node, lat, lon), max_range_km, point_ll=("lat", "lon"),
                        target_ll=(lat, lon), out="__km", planar=True)
    return pairs.select(
        node, *[c for c in strikes.columns if c != "risk"],
        F.round(geo.bearing_deg(lat, lon, "lat", "lon"), 1).alias("bearing_deg"),
        F.round("__km", 2).alias("range_km"), F.round("__age", 1).alias("age_h"),
        risk)


def _fresh(strikes: DataFrame, time: str, now: str, unit_per_hour, max_age_h: float) -> tuple[DataFrame, Column]:
    """Strikes young enough, with their age in hours (`__age`), and the risk they are shown with."""
    age = (F.col(now) - F.col(time)) / F.lit(float(unit_per_hour))
    ramp = F.greatest(F.lit(RAMP_FLOOR), F.lit(RAMP_TOP) * (F.lit(1.0) - F.col("__age") / max_age_h))
    return (strikes.withColumn("__age", age).where(F.col("__age").between(0.0, max_age_h)),
            F.round(F.coalesce(F.col("risk"), ramp), 1).alias("risk"))


def top_sectors(strikes: DataFrame, nodes: DataFrame, node: str, lat: str, lon: str, strike: str, k: int = 5, *,
                time: str, now: str, unit_per_hour=3600.0, max_age_h: float = MAX_AGE_H,
                max_range_km: float = MAX_RANGE_KM) -> DataFrame:
    """The `k` riskiest watch sectors of each node, then the youngest, then by `strike` (an id): node, strike, age_h, risk.

    Those of `watch_sectors`, whose pairs are not listed.
    """
    fresh, risk = _fresh(strikes, time, now, unit_per_hour, max_age_h)
    fresh = fresh.select(strike, "lat", "lon", F.round("__age", 1).alias("age_h"), risk)
    x = radius_first(fresh, nodes.select(node, F.col(lat).alias("__n_lat"), F.col(lon).alias("__n_lon")), [node], max_range_km, k,
                     [F.desc("risk"), F.asc("age_h"), F.asc(strike)], target_ll=("__n_lat", "__n_lon"))
    return x.select(node, strike, "age_h", "risk")


def revisit_schedule(sectors: DataFrame, revisit_min: int = 20, hours: int = 72) -> DataFrame:
    """One row per planned visit: offsets 0, 20, 40 ... minutes up to the end of the window."""
    n = hours * 60 // revisit_min
    x = sectors.withColumn("visit_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n).cast("bigint"))))
    return x.withColumn("offset_min", F.col("visit_no") * revisit_min)


def before_after_pairs(frames: DataFrame, by: list[str], order: str, frame: str) -> DataFrame:
    """Previous frame of the same (sector, visit) beside each frame; visits hold few frames."""
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(order)
    return frames.withColumn("before", F.lag(frame).over(w)).withColumn("after", F.col(frame)).where(
        F.col("before").isNotNull())


def apply_head(pairs: DataFrame, head, columns: list[str], out: str = "detections") -> DataFrame:
    """Run a user-supplied detection head (a pandas_udf over the named columns) on frame pairs."""
    return pairs.withColumn(out, head(*columns))


def mark_loudest(clips: DataFrame, by: list[str], level: str, clip: str, top: int = 5) -> DataFrame:
    """Loudest-first rank of the `top` clips of each case; other clips have no rank.

    Ranks are limited before the shuffle, so a case with very many clips is no burden.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(F.col(level).desc(), clip)
    best = clips.withColumn("loud_rank", F.row_number().over(w)).where(F.col("loud_rank") <= top)
    x = clips.join(best.select(*by, clip, "loud_rank"), [*by, clip], "left")
    return x.withColumn("default_clip", F.coalesce(F.col("loud_rank") == 1, F.lit(False)))


def patrol_result(visits: DataFrame, by: list[str], detections: str, caption: str) -> DataFrame:
    """Visited and flagged counts; a visit is flagged by detections or a plume caption."""
    flagged = (F.col(detections) > 0) | F.coalesce(
        F.lower(F.trim(F.col(caption))).startswith("plume"), F.lit(False))
    x = visits.withColumn("flagged", flagged)
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("visited"),
                              F.sum(F.col("flagged").cast("bigint")).alias("flagged"),
                              F.sum(F.when(F.col("flagged"), F.col(detections)).otherwise(0)).alias("detections"))


def k_nearest(nodes: DataFrame, node: str, lat: str, lon: str, at_lat: float, at_lon: float, k: int,
              preferred: list | None = None, min_preferred: int = 4) -> DataFrame:
    """The k nodes nearest to a point, or the preferred ones if enough of them exist."""
    x = nodes.withColumn("dist_km", geo.planar_km(at_lat, at_lon, lat, lon))
    near = x.orderBy("dist_km", node).limit(k)
    if not preferred:
        return near
    listed = x.where(F.col(node).isin(preferred))
    enough = listed.agg((F.count(F.lit(1)) >= min_preferred).alias("e")).scalar()
    return listed.where(enough).unionByName(near.where(~enough))
