"""Study ranking and dry-storm screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlens.functions.timecols import DAY_US, HOUR_US
from stormlens.operators.counters import counter_deltas
from stormlens.operators.gathered import radius_nearest

# Weights of the study score, holdover window, dry-storm screen.
WEIGHTS = {"c_fire_prox": 0.26, "c_node_prox": 0.16, "c_storm": 0.16, "c_audio": 0.22,
           "c_imagery": 0.12, "c_holdover": 0.08}
HOLDOVER_MAX_H = 120
HOLDOVER_OTHER = 0.3
DRY_MM = 2.5
FIRE_WINDOW_H = 72
FIRE_RADIUS_KM = 35.0
BEFORE_H, AFTER_H = 3, 9


def minmax_norms(df: DataFrame, specs: dict[str, tuple[Column, bool, bool]]) -> DataFrame:
    """Add min-max normalised columns: {out: (value, log, invert)}.

    Missing values become 0 before inversion (so a missing inverted value scores 1); a
    constant or empty column gives 0 even when inverted. The bounds are one aggregated row,
    read as a scalar subquery.
    """
    x = df
    for n, (v, log, _) in specs.items():
        v = v.cast("double")
        v = F.when(~F.isnan(v), v)
        x = x.withColumn("__" + n, F.log1p(F.greatest(v, F.lit(0.0))) if log else v)
        if log:
            x = x.withColumn("__" + n, F.when(v.isNotNull(), F.col("__" + n)))
    # read twice, once for the bounds and once for the rows, which are too many to be kept in between
    bounds = x.agg(F.struct(
        *[F.min("__" + n).alias("lo_" + n) for n in specs],
        *[F.max("__" + n).alias("hi_" + n) for n in specs]).alias("b")).scalar()
    cols = []
    for n, (_, _, invert) in specs.items():
        lo, hi = bounds["lo_" + n], bounds["hi_" + n]
        z = F.coalesce((F.col("__" + n) - lo) / (hi - lo), F.lit(0.0))
        cols.append(F.when(hi > lo, (1.0 - z) if invert else z).otherwise(0.0).alias(n))
    return x.select(*df.columns, *cols)


def study_scores(ev: DataFrame) -> DataFrame:
    """Composite score of fire events that saw lightning; every component stays a column."""
    e = ev.where(F.col("n_flashes") > 0)
    imagery = F.coalesce("image_uploads", F.lit(0)) + F.coalesce("ptz_frames", F.lit(0))
    e = minmax_norms(e, {
        "c_fire_prox": (F.col("nearest_km"), False, True),
        "c_node_prox": (F.col("dist_node_km"), False, True),
        "c_storm": (F.col("n_flashes"), True, False),
        "c_audio": (F.col("audio_clips"), True, False),
        "c_imagery": (imagery, True, False)})
    e = e.withColumn("c_holdover", F.when(F.col("holdover_h").between(0, HOLDOVER_MAX_H), 1.0)
                     .otherwise(HOLDOVER_OTHER))
    total = None
    for c, w in WEIGHTS.items():
        part = F.lit(w) * F.col(c)
        total = part if total is None else total + part
    return e.withColumn("study_score", total)


def dry_candidates(storms: DataFrame, rain: DataFrame, fires: DataFrame, nodes: DataFrame, *,
                   dry_mm: float = DRY_MM) -> DataFrame:
    """Storm days that stayed dry and were followed by a fire near the node.

    storms: vsn, day, first_flash, last_flash, ... ; rain: vsn, hour, lo, hi; fires: fire_id,
    discovery, f_lat, f_lon; nodes: vsn, n_lat, n_lon. Rain of the storm window (3 h before to
    9 h after) counts, else that of the UTC day; the screen is inclusive. The nearest fire
    within 35 km discovered in [last flash, + 72 h] is kept.
    """
    first, last, day = F.col("first_flash"), F.col("last_flash"), F.col("day")
    w = storms.withColumns({"__a": first - BEFORE_H * HOUR_US, "__z": last + AFTER_H * HOUR_US, "__d": day * DAY_US, "__e": (day + 1) * DAY_US})
    s = counter_deltas(rain, w, "vsn", "hour", {"rain_storm_mm": ("__a", "__z"), "rain_day_mm": ("__d", "__e")})
    s = s.where(F.coalesce("rain_storm_mm", "rain_day_mm") <= dry_mm).drop("__a", "__z", "__d", "__e")
    t = s.join(nodes.select("vsn", "n_lat", "n_lon"), "vsn")
    best = radius_nearest(fires.select("fire_id", "discovery", "f_lat", "f_lon"), t, s.columns, "fire_id", FIRE_RADIUS_KM, time="discovery",
                          start="last_flash", span=FIRE_WINDOW_H * HOUR_US, point_ll=("f_lat", "f_lon"), target_ll=("n_lat", "n_lon"))
    return best.select(*s.columns, "fire_id", F.col("dist_km").alias("fire_dist_km"),
                       ((F.col("discovery") - F.col("last_flash")) / HOUR_US).alias("lag_h"))


def top_dry(candidates: DataFrame, n: int = 25) -> DataFrame:
    """The n candidates with the most flashes; of equal ones the first node and day."""
    return candidates.orderBy(F.desc("n_flashes"), "vsn", "day").limit(n)
