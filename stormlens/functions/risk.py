"""Ignition-risk score, alert rows and review cards as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormlens.functions.geo import _c

# The wetting threshold and the four weights of the score.
DRY_MM = 2.5
WEIGHT_DRY = 35.0
WEIGHT_DRYNESS = 30.0
WEIGHT_FUEL = 20.0
WEIGHT_THUNDER = 15.0
NODES_FOR_FULL_CONFIDENCE = 4


def clip01(x) -> Column:
    return F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))


def dry_component(rain_mm) -> Column:
    """1 for no rain, falling linearly to 0 at the wetting threshold."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - _c(rain_mm) / DRY_MM)


def dryness_from_wetness(wetness) -> Column:
    """1 - soil wetness, rounded to 3; null for missing or negative fill values."""
    return F.when(_c(wetness) >= 0, F.round(1 - _c(wetness), 3))


def thunder_confidence(n_nodes) -> Column:
    return F.least(F.lit(1.0), _c(n_nodes) / float(NODES_FOR_FULL_CONFIDENCE))


def risk_parts(rain_mm, dryness, fuel, thunder) -> dict[str, Column]:
    return {
        "dry": F.lit(WEIGHT_DRY) * dry_component(rain_mm),
        "dryness": F.lit(WEIGHT_DRYNESS) * clip01(dryness),
        "fuel": F.lit(WEIGHT_FUEL) * clip01(fuel),
        "thunder": F.lit(WEIGHT_THUNDER) * clip01(thunder),
    }


def risk_score(rain_mm, dryness, fuel, thunder, strike_present=True) -> Column:
    """struct<total, breakdown, dry_lightning>, or null without a strike.

    The dry flag is strict (< 2.5 mm) here, unlike the catalog's inclusive screen.
    """
    parts = risk_parts(rain_mm, dryness, fuel, thunder)
    total = parts["dry"] + parts["dryness"] + parts["fuel"] + parts["thunder"]
    present = F.lit(strike_present) if isinstance(strike_present, bool) else _c(strike_present)
    return F.when(
        present,
        F.struct(
            F.round(total, 1).alias("total"),
            F.struct(*[F.round(v, 1).alias(k) for k, v in parts.items()]).alias("breakdown"),
            (_c(rain_mm) < DRY_MM).alias("dry_lightning"),
        ),
    )


# Title prefixes by provenance.
PROVENANCE_PREFIX = {
    "demo": "[DEMO — SYNTHETIC] ",
    "live": "",
    "unknown": "[UNVERIFIED SOURCE] ",
}
POSTURE = "human review only — no automated dispatch"


def provenance_prefix(provenance) -> Column:
    p = _c(provenance)
    out = F.lit("")
    for name, text in PROVENANCE_PREFIX.items():
        out = F.when(p == name, text).otherwise(out)
    return out


def alert_title(total, time_epoch, provenance) -> Column:
    when = F.date_format(F.timestamp_micros((_c(time_epoch) * 1e6).cast("bigint")),
                         "yyyy-MM-dd HH:mm:ss")
    return F.concat(provenance_prefix(provenance),
                    F.format_string("Ignition risk %.0f/100 — strike ", _c(total)),
                    when, F.lit("Z"))


def alert_row(strike, risk, provenance, n_corroboration) -> dict[str, Column]:
    """Text columns of the alert table."""
    s, r = _c(strike), _c(risk)
    return {
        "title": alert_title(r["total"], s["time_epoch"], provenance),
        "rain_flag": F.when(r["dry_lightning"], "DRY").otherwise("wet"),
        "uncertainty": F.when(s["semi_major_m"].isNotNull(),
                              F.format_string("±%.0f m", s["semi_major_m"]))
                        .otherwise("no ellipse"),
        "nodes": F.format_string("%d node(s)", s["n_nodes"].cast("int")),
        "corroboration": F.when(_c(n_corroboration) > 0,
                                F.format_string("%d external anchor(s)",
                                                _c(n_corroboration).cast("int")))
                          .otherwise("single modality only"),
    }


def risk_card(strike, risk, factors, sources, provenance,
              revisit_min: int = 20, hours: int = 72) -> Column:
    """Nested review card: strike, score with each input beside its source, watch plan."""
    s, r, f, src = _c(strike), _c(risk), _c(factors), _c(sources)

    def sourced(name, key):
        return F.struct(f[name].alias("value"),
                        F.coalesce(src[key], F.lit("unspecified")).alias("source")).alias(name)

    return F.struct(
        _c(provenance).alias("provenance"),
        alert_title(r["total"], s["time_epoch"], provenance).alias("title"),
        r["dry_lightning"].alias("dry_lightning"),
        F.struct(
            s["lat"].alias("lat"), s["lon"].alias("lon"),
            F.array(s["semi_major_m"], s["semi_minor_m"]).alias("ellipse_m"),
            s["gdop"].alias("gdop"), s["quality"].alias("quality"),
            s["n_nodes"].alias("n_nodes"), s["ranges"].alias("ranges_km"),
        ).alias("strike"),
        F.struct(
            r["total"].alias("total"), r["breakdown"].alias("breakdown"),
            F.struct(sourced("rain_mm", "rain"), sourced("dryness", "dryness"),
                     sourced("fuel", "fuel"), sourced("thunder_conf", "thunder")).alias("inputs"),
        ).alias("score"),
        F.struct(F.lit(revisit_min).alias("revisit_min"), F.lit(hours).alias("hours")).alias("watch"),
        F.lit(POSTURE).alias("posture"),
    )
