"""Thunder detection over clip tables, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlens.functions.physics import window_offsets_s
from stormlens.operators.detect import DetectorConfig, gate
from stormlens.operators.pairing import add_sensitive, best_anchor
from stormlens.operators.sequence import event_shape, hysteresis_islands, merge_intervals
from stormlens.operators.signal import spectral_frames, whitened_excess
from stormlens.session import cut

BLOCK_S = 60.0


def _extract(env: DataFrame, by: list[str], on: float, off: float, cfg: DetectorConfig) -> DataFrame:
    isl = hysteresis_islands(env, by, "t", "exc", on=on, off=off, block=BLOCK_S)
    ev = merge_intervals(isl, by, cfg.min_gap_s, block=BLOCK_S)
    return event_shape(env, ev, by, "t", "exc", hop=cfg.hop_s, block=BLOCK_S, index="frame_idx",
                       low="sub", mid="mid", raw_low="raw_sub", raw_mid="raw_mid")


def detect_thunder(clips: DataFrame, anchors: DataFrame | None = None, cfg: DetectorConfig = DetectorConfig(),
                   wind: DataFrame | None = None) -> DataFrame:
    """Scored and gated thunder events per clip.

    clips: clip_id, samples, sr. anchors: clip_id, anchor_t (seconds from clip start, may be
    negative), range_km (nullable). wind: clip_id, wind_ms.
    """
    by = ["clip_id"]
    spec = spectral_frames(clips, by, "samples", "sr", cfg)
    env = cut(whitened_excess(spec, by, "frame_idx", keep=["t"], cfg=cfg))
    ev = _extract(env, by, cfg.on_db, cfg.off_db, cfg).withColumnRenamed("start", "onset_s")
    if anchors is not None:
        lo, hi = window_offsets_s(cfg.r_min_km, cfg.r_max_km, cfg.temp_c)
        weak = _extract(env, by, cfg.anchored_on_db, cfg.anchored_off_db, cfg).withColumnRenamed("start", "onset_s")
        w = anchors.select("clip_id", (F.col("anchor_t") + lo).alias("w_lo"),
                           (F.col("anchor_t") + hi).alias("w_hi"), "range_km")
        ev = cut(add_sensitive(cut(ev), weak, w, by, t="onset_s", separation=1.0, bucket=hi - lo))
        ev = best_anchor(ev, anchors, by, event_t="onset_s", lo_off=lo, hi_off=hi, temp_c=cfg.temp_c,
                         bucket=hi - lo)
    else:
        none = F.lit(None).cast("double")
        ev = ev.select("*", F.lit(False).alias("anchored"),
                       *[none.alias(c) for c in ("anchor_t", "implied_range_km", "anchor_km", "miss_km")])
    if wind is not None:
        ev = ev.join(wind.select("clip_id", "wind_ms"), "clip_id", "left")
    return gate(ev, cfg, "wind_ms" if wind is not None else None)
