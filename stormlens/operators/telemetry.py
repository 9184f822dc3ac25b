"""Long-format telemetry: queries, trends, resampling, trailing features, schema drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlens.operators.joins import interval_join

# Ambient sensor, in-enclosure sensor, trend length and its minimum.
AMBIENT_SENSOR, ENCLOSURE_SENSOR = "bme680", "bme280"
TREND_ROWS, TREND_MIN_ROWS = 20, 40


def series(df: DataFrame, start, end, name_regex: str | None = None, equal: dict | None = None,
           time: str = "t") -> DataFrame:
    """Rows in an inclusive window with name and equality filters, value made numeric."""
    x = df.where(F.col(time).between(start, end))
    if name_regex:
        x = x.where(F.col("name").rlike(name_regex))
    for c, v in (equal or {}).items():
        x = x.where(F.col(c) == v)
    return x.withColumn("value", F.expr("try_cast(value as double)")).where(F.col("value").isNotNull())


def preferred_sensor_mean(at: DataFrame, readings: DataFrame, *, keys: list[str], half, bucket,
                          ambient=AMBIENT_SENSOR, enclosure=ENCLOSURE_SENSOR) -> DataFrame:
    """Mean reading within +-half of each instant: the ambient sensor if it reported, else every
    sensor but the in-enclosure one. at: vsn, t0, keys; readings: vsn, t, sensor, value."""
    w = at.select("vsn", *[F.col(k).alias("__a_" + k) for k in keys], (F.col("t0") - half).alias("__lo"),
                  (F.col("t0") + half).alias("__hi"))
    hit = interval_join(readings.select("vsn", "t", "sensor", "value"), w, ["vsn"], "t", "__lo", "__hi",
                        bucket=bucket)
    s, v = F.col("sensor"), F.col("value")
    mean = F.coalesce(F.avg(F.when(s == ambient, v)),
                      F.avg(F.when(s.isNull() | (s != enclosure), v)))
    m = hit.groupBy(*["__a_" + k for k in keys]).agg(mean.alias("mean_value"))
    return at.join(m.select(*[F.col("__a_" + k).alias(k) for k in keys], "mean_value"), keys, "left")


def resample_mean(df: DataFrame, by: list[str], time: str, width_us: int, value: str) -> DataFrame:
    """Mean per fixed bin; empty bins do not appear."""
    start = (F.floor(F.col(time) / width_us) * width_us).cast("bigint")
    return df.groupBy(*by, start.alias("bin")).agg(F.avg(value).alias("mean_value"))


def met_trend(df: DataFrame, by: list[str], time: str, name: str, value: str, *, pressure: str, wind: str,
              scale: float = 100.0) -> DataFrame:
    """Pressure fall (first 20 minus last 20 readings, only with more than 40) and maximum wind.

    Rank-limited windows keep 20 rows per key before the shuffle.
    """
    p = df.where(F.col(name) == pressure)
    asc, desc = (Window.partitionBy(*by).orderBy(o) for o in (F.col(time), F.col(time).desc()))

    def end_mean(w, out):
        x = p.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= TREND_ROWS)
        return x.groupBy(*by).agg(F.avg(value).alias(out))
    rest = df.groupBy(*by).agg(
        F.max(F.when(F.col(name) == wind, F.col(value))).alias("__g"),
        F.sum((F.col(name) == pressure).cast("bigint")).alias("__n"))
    x = rest.join(end_mean(asc, "__a"), by, "left").join(end_mean(desc, "__b"), by, "left")
    drop = F.when(F.col("__n") > TREND_MIN_ROWS,
                  F.greatest((F.col("__a") - F.col("__b")) / F.lit(scale), F.lit(0.0))).otherwise(0.0)
    return x.select(*by, drop.alias("pressure_drop"), F.coalesce("__g", F.lit(0.0)).alias("gust"))


def trailing_features(steps: DataFrame, pts: DataFrame, on: list[str], *, step: str, t: str, span, near_km: float,
                      bucket, first: int = 2) -> DataFrame:
    """Per step t: points in [t - span, t): count, any near one, nearest, first few near points.

    pts: on, t, dist_km, id.
    """
    w = steps.select(*on, F.col(step).alias("__s"), (F.col(step) - span).alias("__lo"),
                     F.col(step).alias("__hi"))
    hit = interval_join(pts, w, on, t, "__lo", "__hi", bucket=bucket, closed_end=False)
    near = F.col("dist_km") <= near_km
    agg = hit.groupBy(*on, F.col("__s").alias(step)).agg(
        F.count(F.lit(1)).alias("n_window"), F.max(near.cast("int")).alias("__any"),
        F.min("dist_km").alias("nearest_km"))
    rank = Window.partitionBy(*on, "__s").orderBy(t, "id")
    top = hit.where(near).withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= first)
    top = top.groupBy(*on, F.col("__s").alias(step)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__r", "id"))), lambda s: s["id"]).alias("first_ids"))
    x = steps.join(agg, [*on, step], "left").join(top, [*on, step], "left")
    return x.select(*steps.columns, F.coalesce("n_window", F.lit(0)).alias("n_window"),
                    F.coalesce(F.col("__any") == 1, F.lit(False)).alias("local"), "nearest_km",
                    F.coalesce("first_ids", F.array().cast("array<bigint>")).alias("first_ids"))


def drift_union(parts: list[DataFrame], into: str, *older: str) -> DataFrame:
    """Union of shards whose column was renamed over time; rows without either are dropped."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    present = [c for c in (into, *older) if c in out.columns]
    merged = F.coalesce(*[F.col(c) for c in present])
    keep = [c for c in out.columns if c not in present]
    return out.select(*keep, merged.alias(into)).where(F.col(into).isNotNull())


def gated(cheap: Column, costly: Column) -> Column:
    """Use the costly feed's value only while the cheap one is elevated."""
    return F.when(cheap, costly)


def to_measurements(df: DataFrame, values: dict[str, str], time_ns: Column, meta: dict[str, Column],
                    keep: list[str]) -> DataFrame:
    """Wide events to long (name, value, timestamp_ns, meta) rows; meta values are strings."""
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"))
                      for n, c in values.items()])
    x = df.select(*keep, time_ns.cast("bigint").alias("timestamp_ns"), F.create_map(*pairs).alias("meta"),
                  F.explode(items).alias("m"))
    return x.select(*keep, "m.name", "m.value", "timestamp_ns", "meta")


def batch_count(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn(
        "name", F.lit(name))
