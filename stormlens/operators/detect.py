"""Thunder event score and gate, on the output of `event_shape` and `best_anchor`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlens.functions.geo import _c


@dataclass(frozen=True)
class DetectorConfig:
    """Detector thresholds (seconds, dB, km, m/s)."""

    hop_s: float = 0.05
    nperseg_s: float = 0.35
    floor_pct: float = 20.0
    excess_margin_db: float = 3.0
    on_db: float = 6.0
    off_db: float = 3.0
    min_gap_s: float = 0.6
    max_dur_s: float = 20.0
    min_dur_s: float = 0.7
    anchored_min_dur_s: float = 0.4
    min_decay_rise_ratio: float = 1.2
    anchored_decay_rise_ratio: float = 0.5
    min_mid_fraction: float = 0.12
    windy_ms: float = 8.0
    windy_sub_over_mid_db: float = 12.0
    extreme_sub_over_mid_db: float = 25.0
    range_tol_km: float = 5.0
    standalone_score: float = 0.55
    anchored_score: float = 0.30
    anchored_on_db: float = 3.5
    anchored_off_db: float = 2.0
    r_min_km: float = 0.3
    r_max_km: float = 30.0
    temp_c: float = 20.0


def _share(x: Column, full: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / full))


def event_score(cfg: DetectorConfig = DetectorConfig(), *, peak="peak", duration="duration", rise="rise",
                decay="decay", mid_fraction="mid_fraction") -> Column:
    """0.35 energy + 0.25 length + 0.2 shape + 0.2 band, each clipped to 0..1."""
    ratio = _c(decay) / F.greatest(_c(rise), F.lit(1e-3))
    return (F.lit(0.35) * _share(_c(peak), 15.0)
            + F.lit(0.25) * _share(_c(duration) - cfg.min_dur_s, 4.0)
            + F.lit(0.2) * _share(ratio, 4.0)
            + F.lit(0.2) * _share(_c(mid_fraction), 0.4))


def gate(events: DataFrame, cfg: DetectorConfig = DetectorConfig(), wind: str | None = None) -> DataFrame:
    """Add score, reject_reason ('' if none) and passed; the first failing rule names the reason.

    events: duration, peak, rise, decay, mid_fraction, sub_over_mid, anchored, miss_km,
    implied_range_km, anchor_km. `wind` is a nullable wind-speed column.
    """
    a = F.col("anchored")
    w = F.col(wind) if wind else F.lit(None).cast("double")
    som = F.col("sub_over_mid")
    ratio = F.col("decay") / F.greatest(F.col("rise"), F.lit(1e-3))
    windy = F.when(w.isNotNull(), w > cfg.windy_ms).otherwise(~a)
    limit = F.when(a, cfg.anchored_score).otherwise(cfg.standalone_score)
    x = events.withColumn("score", event_score(cfg))
    dominates = F.format_string("sub-band dominates by %.0f dB raw ", som)
    reason = (
        F.when(F.col("duration") < F.when(a, cfg.anchored_min_dur_s).otherwise(cfg.min_dur_s),
               "too short (raindrop/impulse)")
        .when(F.col("duration") > cfg.max_dur_s, "too long (stationary noise shift)")
        .when(ratio < F.when(a, cfg.anchored_decay_rise_ratio).otherwise(cfg.min_decay_rise_ratio),
              "no fast-attack/slow-decay shape")
        .when(F.col("mid_fraction") < cfg.min_mid_fraction, "pure sub-60 Hz excess (wind buffeting)")
        .when(som > cfg.extreme_sub_over_mid_db, F.concat(dominates, F.lit("(wind buffeting)")))
        .when(windy & (som > cfg.windy_sub_over_mid_db),
              F.concat(dominates, F.when(w.isNotNull(), "(windy)").otherwise("(wind unknown)")))
        .when(a & F.col("anchor_km").isNotNull() & (F.col("miss_km") > cfg.range_tol_km),
              F.format_string("range-inconsistent: implied %.1f km vs anchor's %.1f km (Δ%.1f > "
                              f"{cfg.range_tol_km:.0f} km tol)", "implied_range_km", "anchor_km", "miss_km"))
        .when(F.col("score") < limit, F.format_string("score %.2f < %.2f", "score", limit))
        .otherwise(""))
    x = x.withColumn("reject_reason", reason)
    return x.withColumn("passed", F.col("reject_reason") == "")


def clip_scores(clips: DataFrame, events: DataFrame, clip: str = "clip_id") -> DataFrame:
    """Best event score per clip, 0 when nothing was extracted."""
    best = events.groupBy(clip).agg(F.max("score").alias("clip_score"))
    return clips.join(best, clip, "left").withColumn("clip_score", F.coalesce("clip_score", F.lit(0.0)))
