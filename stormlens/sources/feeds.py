"""Landed feeds: manifests, incidents, flashes, lightning, storm cells, ground truth, logs, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlens import schemas
from stormlens.functions.geo import _c
from stormlens.functions.text import blank_to_null
from stormlens.functions.timecols import clock_to_epoch, iso_epoch, units_base_epoch


def node_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Nodes with capability flags; only W and V ids that have a microphone, camera or thermal sensor."""
    raw = spark.read.schema(schemas.MANIFEST).option("multiLine", "true").json(path)
    caps = F.flatten(F.transform("sensors", lambda s: s["hardware"]["capabilities"]))
    has = lambda c: F.coalesce(F.array_contains(F.col("caps"), c), F.lit(False))
    models = F.array_sort(F.array_distinct(F.array_compact(F.transform("sensors", lambda s: s["hardware"]["hw_model"]))))
    x = raw.withColumn("caps", caps)
    x = x.select(
        "vsn", "phase", "project", "address", "name", has("Microphone").alias("mic"), has("Camera").alias("cam"),
        has("Thermal Camera").alias("thermal"), F.expr("try_cast(gps_lat as double)").alias("lat"),
        F.expr("try_cast(gps_lon as double)").alias("lon"), has("Rain Gauge").alias("rain_gauge"),
        models.alias("sensor_models"))
    return x.where(F.col("vsn").rlike("^[WV]") & (F.col("mic") | F.col("cam") | F.col("thermal"))).orderBy("vsn")


def nodes_by_sensor_name(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None,
                         address_keys: list[str] | None = None) -> DataFrame:
    """Deployed nodes with a position, flags taken from sensor names; optional box (lat0, lat1,
    lon0, lon1) and address words."""
    raw = spark.read.schema(schemas.MANIFEST).option("multiLine", "true").json(path)
    named = lambda w: F.coalesce(F.exists("sensors", lambda s: F.contains(F.lower(s["name"]), F.lit(w))), F.lit(False))
    x = raw.select("vsn", "phase", F.regexp_replace(F.coalesce("address", F.lit("")), r"\s+", " ").alias("address"),
                   F.expr("try_cast(gps_lat as double)").alias("lat"), F.expr("try_cast(gps_lon as double)").alias("lon"),
                   named("microphone").alias("mic"), named("camera").alias("cam"))
    x = x.where((F.col("phase") == "Deployed") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if box:
        x = x.where(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))
    if address_keys:
        x = x.where(F.lower("address").rlike("|".join(address_keys)))
    return x


def deployed_listening(nodes: DataFrame, with_gps: bool = False) -> DataFrame:
    x = nodes.where((F.col("phase") == "Deployed") & (F.col("mic") | F.col("cam")))
    return x.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()) if with_gps else x


def fire_feed(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None,
              since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Feature pages to raw incident rows."""
    pages = spark.read.schema(schemas.FIRE_PAGE).option("multiLine", "true").json(path)
    x = pages.select(F.explode("features").alias("f")).select(
        "f.attributes.*", F.col("f.geometry.y").alias("geom_lat"), F.col("f.geometry.x").alias("geom_lon"))
    if box:
        x = x.where(F.col("geom_lat").between(box[0], box[1]) & F.col("geom_lon").between(box[2], box[3]))
    if since_ms is not None:
        x = x.where(F.col("FireDiscoveryDateTime") >= since_ms)
    if until_ms is not None:
        x = x.where(F.col("FireDiscoveryDateTime") <= until_ms)
    return x


def flash_granules(raw: DataFrame) -> DataFrame:
    """Landed granule rows to flashes.

    raw: lat, lon, offset_s, units, energy (nullable), quality (nullable), sat. Missing energy
    is NaN and missing quality 0, as in the original definition.
    """
    epoch = units_base_epoch("units") + F.col("offset_s")
    return raw.select(
        epoch.alias("epoch"), F.col("lat").alias("flash_lat"), F.col("lon").alias("flash_lon"),
        F.coalesce("energy", F.lit(float("nan"))).alias("flash_energy_j"),
        F.coalesce("quality", F.lit(0)).cast("smallint").alias("quality"), "sat",
        F.to_date(F.timestamp_micros((epoch * 1e6).cast("bigint"))).alias("date"))


def event_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Streaming flash and thunder events, one JSON object per line; blank lines are skipped."""
    r = spark.readStream.schema(schemas.FUSION_EVENT)
    for k, v in options.items():
        r = r.option(k, v)
    return r.json(path).where(F.col("type").isNotNull())


def ground_truth(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(flashes, arrivals) of ground-truth documents with epochs; one document a file, or a line."""
    d = spark.read.schema(schemas.GROUND_TRUTH).option("multiLine", str(not lines).lower()).json(path)
    f = d.select("node", F.explode("glm_flashes").alias("f")).select(
        F.col("node.vsn").alias("vsn"), iso_epoch("f.time").alias("epoch"), "f.lat", "f.lon", "f.dist_node_km")
    a = d.select("node", F.explode("thunder_arrivals").alias("a")).select(
        F.col("node.vsn").alias("vsn"), iso_epoch("a.time").alias("epoch"), "a.range_km", "a.snr")
    return f, a


def near_anchors(flashes: DataFrame, max_km: float = 30.0) -> DataFrame:
    """Flash times worth listening for."""
    return flashes.where(F.col("dist_node_km") <= max_km).select(
        "vsn", F.col("epoch").alias("anchor_t"), F.col("dist_node_km").alias("range_km"))


def html_object(pages: DataFrame, html: str, pattern: str, schema) -> DataFrame:
    """JSON object embedded in a page, by regex and schema."""
    return pages.withColumn("object", F.from_json(F.regexp_extract(html, pattern, 1), schema))


def clock_epochs(df: DataFrame, hms: str, day: str) -> DataFrame:
    return df.withColumn("epoch", clock_to_epoch(hms, day))


def lightning_epochs(df: DataFrame, body: str) -> DataFrame:
    """Epochs of a lightning response, nested field first."""
    r = F.from_json(body, schemas.LIGHTNING)
    x = df.select(*[c for c in df.columns if c != body], F.explode_outer(r["response"]).alias("o"))
    t = F.coalesce(F.col("o.ob.timestamp"), F.col("o.timestamp")).cast("double")
    return x.withColumn("epoch", t).drop("o").where(F.col("epoch").isNotNull())


def nearest_cell_km(response) -> Column:
    """Smallest cell distance of a response array, nested field first (a 0 counts)."""
    return F.array_min(F.transform(_c(response), lambda o: F.coalesce(o["ob"]["distanceKM"], o["distanceKM"])))


def id_or_null(c) -> Column:
    return blank_to_null(c)
