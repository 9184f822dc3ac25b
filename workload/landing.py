"""Sources and sinks: tables written out in the shape of a landed feed, and read back from it.

Each query writes rows of the given tables to the shared folder as a feed would hold them and reads
them with the library's reader; the SQL says what must come back.
"""

import uuid

from pyspark.sql import functions as F

from stormlens.functions import geo, physics
from stormlens.functions.timecols import micros
from stormlens.operators.localize import fixes
from stormlens.operators.patrol import k_nearest
from stormlens.plans import scan, study
from stormlens.plans.events import ranked_events
from stormlens.session import ensure_checkpoint_dir
from stormlens.sources import feeds, tables
from stormlens.streaming import reviews
from workload.base import DAY, EVENTS, FLASHES, HOUR, NODES, ORACLES, QUERIES, events, flashes, nodes, query, r6, table
from workload.catalog import EVENT_COLS, _events


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _documents(spark, rows, page, name, wrap=lambda items: items):
    """One JSON document per value of `page`, a few hundred rows each, one file per document."""
    path = _folder(spark, name)
    docs = rows.groupBy(page.alias("page")).agg(F.collect_list(F.struct(*rows.columns)).alias("items"))
    docs.select("page", F.to_json(wrap(F.col("items"))).alias("value")).write.partitionBy("page").text(path)
    return path


def _suppliers(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    hardware = lambda cap: F.struct(F.lit("hw").alias("hw_model"), F.array(F.lit(cap)).alias("capabilities"))
    sensor = lambda name, cap: F.struct(F.lit(name).alias("name"), hardware(cap).alias("hardware"))
    sensors = F.array_compact(F.array(
        F.when(k % 2 == 0, sensor("ETS Microphone", "Microphone")), F.when(k % 3 == 0, sensor("top Camera", "Camera")),
        F.when(k % 7 == 0, sensor("mobotix", "Thermal Camera")), F.when(k % 5 == 0, sensor("rain", "Rain Gauge"))))
    return s.select(F.concat(F.when(k % 11 == 0, "X").otherwise("W"), k).alias("vsn"),
                    F.when(F.col("s_nationkey") % 4 == 0, "Retired").otherwise("Deployed").alias("phase"), F.lit("p").alias("project"),
                    F.col("s_name").alias("address"), F.col("s_name").alias("name"),
                    F.when(k % 13 == 0, "n/a").otherwise((F.lit(35) + k % 90 / 100).cast("string")).alias("gps_lat"),
                    (F.lit(-120) + k % 140 / 100).cast("string").alias("gps_lon"), sensors.alias("sensors"))


MANIFEST = """m AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 0 THEN 'X' ELSE 'W' END || s_suppkey AS vsn, s_nationkey % 4 <> 0 AS deployed,
  s_suppkey % 2 = 0 AS mic, s_suppkey % 3 = 0 AS cam, s_suppkey % 7 = 0 AS thermal, s_suppkey % 5 = 0 AS rain_gauge, s_suppkey % 13 <> 0 AS placed,
  35 + (s_suppkey % 90) / 100.0::DOUBLE AS lat, -120 + (s_suppkey % 140) / 100.0::DOUBLE AS lon FROM supplier)"""


@query("manifest_nodes", f"""
WITH {MANIFEST} SELECT vsn, mic, cam, thermal, rain_gauge, CASE WHEN placed THEN round(lat, 6) END AS lat, round(lon, 6) AS lon,
 deployed AND (mic OR cam) AS listening FROM m WHERE vsn LIKE 'W%' AND (mic OR cam OR thermal)
""")
def manifest_nodes(spark, sf):
    page = F.floor(F.substring("vsn", 2, 20).cast("bigint") / 200)
    x = feeds.node_manifest(spark, _documents(spark, _suppliers(spark, sf), page, "manifest"))
    on = feeds.deployed_listening(x).select("vsn", F.lit(True).alias("listening"))
    return x.join(on, "vsn", "left").select("vsn", "mic", "cam", "thermal", "rain_gauge", r6("lat").alias("lat"), r6("lon").alias("lon"),
                                            F.coalesce("listening", F.lit(False)).alias("listening"))


@query("sensor_name_nodes", f"""
WITH {MANIFEST} SELECT vsn, mic, cam FROM m WHERE deployed AND placed AND lat BETWEEN 35.1 AND 35.7 AND lon BETWEEN -119.9 AND -118.9
""")
def sensor_name_nodes(spark, sf):
    page = F.floor(F.substring("vsn", 2, 20).cast("bigint") / 200)
    path = _documents(spark, _suppliers(spark, sf), page, "manifest")
    return feeds.nodes_by_sensor_name(spark, path, (35.1, 35.7, -119.9, -118.9)).select("vsn", "mic", "cam")


@query("fire_pages", f"""
SELECT o_orderkey AS "OBJECTID", epoch_us(o_orderdate) // 1000 AS discovered_ms, o_orderstatus AS cause, round(o_totalprice, 2) AS size
FROM orders WHERE epoch_us(o_orderdate) // 1000 >= {820454400000} AND o_orderkey % 90 BETWEEN 10 AND 70
""")
def fire_pages(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    attributes = F.struct(k.alias("OBJECTID"), F.floor(micros("o_orderdate") / 1000).alias("FireDiscoveryDateTime"),
                          F.col("o_orderstatus").alias("FireCause"), F.col("o_totalprice").cast("double").alias("IncidentSize"))
    rows = o.select(attributes.alias("attributes"), F.struct((F.lit(-120) + k % 90 / 100).alias("x"), (F.lit(35) + k % 90 / 100).alias("y")).alias("geometry"))
    path = _documents(spark, rows, F.floor(F.col("attributes.OBJECTID") / 20_000), "fires", lambda x: F.struct(x.alias("features")))
    x = feeds.fire_feed(spark, path, (35.0995, 35.7005, -121.0, -119.0), since_ms=820454400000)
    return x.select("OBJECTID", F.col("FireDiscoveryDateTime").alias("discovered_ms"), F.col("FireCause").alias("cause"), F.round("IncidentSize", 2).alias("size"))


@query("flash_granules", """
SELECT l_orderkey, l_linenumber, epoch(l_shipdate::TIMESTAMP) + l_linenumber * 0.5 AS epoch, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber % 2 END AS SMALLINT) AS quality,
 l_quantity IS NULL OR l_linenumber % 4 = 0 AS no_energy, CAST(l_shipdate AS DATE) AS date FROM lineitem
""")
def flash_granules(spark, sf):
    l, n = table(spark, sf, "lineitem"), F.col("l_linenumber")
    layout = F.when(n % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    raw = l.select((F.col("l_orderkey") * 8 + n).cast("double").alias("lat"), F.lit(0.0).alias("lon"), (n * 0.5).alias("offset_s"),
                   F.concat(F.lit("seconds since "), layout).alias("units"), F.when(n % 4 != 0, F.col("l_quantity").cast("double")).alias("energy"),
                   F.when(n % 3 != 0, n % 2).alias("quality"), F.lit(16).alias("sat"))
    x = feeds.flash_granules(raw)
    key = F.col("flash_lat").cast("bigint")
    return x.select(F.floor((key - 1) / 8).alias("l_orderkey"), ((key - 1) % 8 + 1).cast("int").alias("l_linenumber"), "epoch", "quality",
                    F.isnan("flash_energy_j").alias("no_energy"), "date")


@query("event_lines", f"""
WITH {EVENTS} SELECT vsn::VARCHAR AS vsn, name AS type, count(*) AS n, round(sum(t / 1e6 - 1704067200), 3) AS sum_s FROM ev GROUP BY 1, 2
""")
def event_lines(spark, sf):
    """The live event source: JSON lines with blanks between, read as a stream until it is empty."""
    base = _folder(spark, "events")
    e = events(spark, sf).select(F.to_json(F.struct(F.col("name").alias("type"), F.col("vsn").cast("string").alias("vsn"),
                                                    (F.col("t") / 1e6).alias("time_epoch"))).alias("value"))
    e.select(F.explode(F.array("value", F.lit(""))).alias("value")).write.text(f"{base}/lines")
    q = (feeds.event_stream(spark, f"{base}/lines").writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    x = spark.read.parquet(f"{base}/out")
    return x.groupBy("vsn", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("time_epoch") - 1704067200), 3).alias("sum_s"))


@query("truth_anchors", f"""
WITH {EVENTS} SELECT vsn::VARCHAR AS vsn, 'flash' AS kind, t // 1000000 AS s, value AS km FROM ev WHERE name = 'view' AND value <= 30
UNION ALL SELECT vsn::VARCHAR, 'arrival', t // 1000000, value FROM ev WHERE name = 'purchase'
""")
def truth_anchors(spark, sf):
    """Ground-truth documents, one per node and six hours, with ISO times."""
    iso = F.date_format(F.timestamp_seconds(F.floor(F.col("t") / 1e6)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = events(spark, sf)
    flash = F.when(F.col("name") == "view", F.struct(iso.alias("time"), F.lit(35.0).alias("lat"), F.lit(-119.0).alias("lon"), F.col("value").alias("dist_node_km")))
    arrival = F.when(F.col("name") == "purchase", F.struct(iso.alias("time"), F.col("value").alias("range_km"), F.lit(9.0).alias("snr")))
    path = _folder(spark, "truth")
    d = e.groupBy("vsn", F.floor(F.col("t") / (6 * HOUR))).agg(F.collect_list(flash).alias("glm_flashes"), F.collect_list(arrival).alias("thunder_arrivals"))
    d.select(F.to_json(F.struct(F.struct(F.col("vsn").cast("string").alias("vsn")).alias("node"), "glm_flashes", "thunder_arrivals")).alias("value")).write.text(path)
    f, a = feeds.ground_truth(spark, path, lines=True)
    near = feeds.near_anchors(f).select("vsn", F.lit("flash").alias("kind"), F.col("anchor_t").cast("bigint").alias("s"), F.col("range_km").alias("km"))
    return near.unionByName(a.select("vsn", F.lit("arrival").alias("kind"), F.col("epoch").cast("bigint").alias("s"), F.col("range_km").alias("km")))


@query("clock_times", f"""
WITH {EVENTS} SELECT event_id, CAST(t // 1000000 % 86400 + (t // {DAY} + CASE WHEN t // {HOUR} % 24 < 12 THEN 1 ELSE 0 END) * 86400 AS DOUBLE) AS epoch, k FROM ev
""")
def clock_times(spark, sf):
    """Clock-only times beside their evening's date, with an object embedded in a page."""
    e = events(spark, sf)
    ts = F.timestamp_micros("t")
    pages = e.select("event_id", F.date_format(ts, "HH:mm:ss").alias("hms"), F.to_date(ts).alias("day"),
                     F.concat(F.lit("<html><script>var DATA = "), F.to_json(F.struct("k")), F.lit(";</script></html>")).alias("html"))
    x = feeds.html_object(feeds.clock_epochs(pages, "hms", "day"), "html", r"DATA = (\{.*?\});", "k int")
    return x.select("event_id", "epoch", F.col("object.k").alias("k"))


@query("lightning_response", f"""
WITH {EVENTS} SELECT vsn, t / 1e6 AS epoch, min(value) OVER (PARTITION BY vsn, t // {6 * HOUR}) AS nearest_km FROM ev
""")
def lightning_response(spark, sf):
    """One response a node and six hours."""
    e = events(spark, sf)
    stamp, nested = (F.col("t") / 1e6).alias("timestamp"), F.col("k") % 2 == 0
    item = F.struct(F.when(nested, F.struct(stamp)).alias("ob"), F.when(~nested, F.col("t") / 1e6).alias("timestamp"))
    cell = F.struct(F.when(nested, F.struct(F.col("value").alias("distanceKM"))).alias("ob"), F.when(~nested, F.col("value")).alias("distanceKM"))
    d = e.groupBy("vsn", F.floor(F.col("t") / (6 * HOUR))).agg(F.to_json(F.struct(F.collect_list(item).alias("response"))).alias("body"), F.collect_list(cell).alias("cells"))
    x = feeds.lightning_epochs(d.withColumn("nearest_km", feeds.nearest_cell_km("cells")).drop("cells"), "body")
    return x.select("vsn", "epoch", "nearest_km")


@query("replaced_shards", f"""
WITH {FLASHES} SELECT sat, count(*) AS n, round(sum(CASE WHEN sat = 17 THEN 2 * energy ELSE energy END), 2) AS energy FROM flashes GROUP BY 1
""")
def replaced_shards(spark, sf):
    """Shards per satellite; one is written again and replaces only itself."""
    path = _folder(spark, "shards")
    f = flashes(spark, sf).select("sat", "energy")
    tables.write_shards(f, path, ["sat"])
    tables.write_shards(f.where("sat = 17").withColumn("energy", F.col("energy") * 2), path, ["sat"])
    x = spark.read.parquet(path)
    return x.groupBy(F.col("sat").cast("bigint").alias("sat")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("energy"), 2).alias("energy"))


def _strikes(spark, sf):
    e = events(spark, sf).where("name = 'view'")
    q = F.when(F.col("k") % 3 == 0, "fix").when(F.col("k") % 3 == 1, "ambiguous").otherwise("range-only")
    return e.select((F.col("t") / 1e6).alias("t_strike"), "event_id", q.alias("quality"), F.create_map((F.col("vsn") % 100).alias("k"), "value").alias("ranges"))


@query("strike_documents", f"""
WITH {EVENTS}, {NODES}, s AS (SELECT DISTINCT t, vsn % 100 AS v FROM ev WHERE name = 'view')
SELECT s.t / 1e6 AS t_strike, count(n.vsn) AS n_nodes, round(min(n_lat), 3) AS lat FROM s LEFT JOIN nodes n ON n.vsn = s.v GROUP BY 1
""")
def strike_documents(spark, sf):
    path = _folder(spark, "strikes")
    at = nodes(spark, sf).select("vsn", F.col("n_lat").alias("lat"), F.col("n_lon").alias("lon"))
    ranged = _strikes(spark, sf).select("t_strike", F.explode("ranges").alias("vsn", "km")).groupBy("t_strike", "vsn").agg(F.min("km").alias("km"))
    one = ranged.groupBy("t_strike").agg(F.map_from_entries(F.collect_list(F.struct("vsn", "km"))).alias("ranges"))
    tables.write_documents(tables.strike_documents(one, at), path)
    x = spark.read.schema("t_strike double, nodes array<struct<vsn:bigint,lat:double,lon:double>>").json(path)
    lat = F.array_min(F.transform("nodes", lambda n: n["lat"]))
    return x.select("t_strike", F.greatest(F.coalesce(F.size("nodes"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_nodes"), F.round(lat, 3).alias("lat"))


@query("fix_strikes", f"WITH {EVENTS} SELECT event_id FROM ev WHERE name = 'view' AND k % 3 = 0")
def fix_strikes(spark, sf):
    return fixes(_strikes(spark, sf)).select("event_id")


@query("review_stream", f"""
WITH {EVENTS} SELECT 'decision' AS kind, count(*) AS n FROM ev WHERE k % 4 < 3 UNION ALL
SELECT CASE k % 4 WHEN 0 THEN 'prioritize_sector' ELSE 'extend_watch' END, count(*) FROM ev WHERE k % 4 IN (0, 2) GROUP BY 1
""")
def review_stream(spark, sf):
    base = _folder(spark, "reviews")
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    action = F.when(k % 4 == 0, "confirm_smoke").when(k % 4 == 1, "false_positive").when(k % 4 == 2, "keep_watching")
    actions = raw.select(F.col("ts").cast("timestamp").alias("time"), F.col("user_id").cast("string").alias("strike_id"), action.alias("action"),
                         F.lit("r").alias("reviewer"), F.lit("").alias("comment")).where("action is not null")
    reviews.run_reviews(actions, f"{base}/decisions", f"{base}/directives", f"{base}/state", {"availableNow": True}).awaitTermination()
    d = spark.read.json(f"{base}/decisions").select(F.lit("decision").alias("kind"))
    v = spark.read.json(f"{base}/directives").select(F.col("directive").alias("kind"))
    return d.unionByName(v).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("dry_top25", f"SELECT * FROM ({ORACLES['dry_storm_fire']}) ORDER BY n_flashes DESC, vsn, day LIMIT 25")
def dry_top25(spark, sf):
    return study.top_dry(QUERIES["dry_storm_fire"](spark, sf))


@query("events_ranked", f"SELECT * FROM ({ORACLES['fire_events']}) ORDER BY n_flashes DESC, nearest_km, fire_id, vsn")
def events_ranked(spark, sf):
    x = _events(spark, sf)
    return ranked_events(x).select(*EVENT_COLS, *[r6(c).alias(c) for c in ("dist_node_km", "nearest_km", "holdover_h", "nearest_to_node_km")])


@query("listening_windows", f"""
WITH {EVENTS} SELECT event_id, round(t / 1e6 + 1000 / 343.2, 3) AS from_s, round(t / 1e6 + 30000 / 343.2, 3) AS to_s FROM ev WHERE name = 'view'
""")
def listening_windows(spark, sf):
    c = physics.sound_speed_ms(20.0)
    lo, hi = physics.window_offsets_s(c / 343.2, 30.0 * c / 343.2)
    e = events(spark, sf).where("name = 'view'")
    return e.select("event_id", F.round(F.col("t") / 1e6 + lo, 3).alias("from_s"), F.round(F.col("t") / 1e6 + hi, 3).alias("to_s"))


@query("target_keys", "SELECT 'fire' AS kind, c_custkey || ':' || c_mktsegment AS ref FROM customer UNION ALL SELECT 'node', s_suppkey::VARCHAR FROM supplier")
def target_keys(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    keys = c.select(F.concat(F.lit("fire:"), "c_custkey", F.lit(":"), "c_mktsegment").alias("key")).union(s.select(F.concat(F.lit("node:"), "s_suppkey")))
    return scan.split_key(keys).select("kind", "ref")


@query("uncertainty_ellipses", f"""
WITH {NODES} SELECT vsn, 73 AS n_points, round((400 + vsn % 100) / 110540.0::DOUBLE, 7) AS half_lat FROM nodes
""")
def uncertainty_ellipses(spark, sf):
    """An ellipse whose major axis points north reaches its semi-major axis north of its centre."""
    n = nodes(spark, sf)
    e = n.select("vsn", "n_lat", geo.ellipse_points("n_lat", "n_lon", F.lit(400.0) + F.col("vsn") % 100, F.lit(100.0), F.lit(90.0)).alias("p"))
    top = F.array_max(F.transform("p", lambda p: p["lat"]))
    return e.select("vsn", F.size("p").alias("n_points"), F.round(top - F.col("n_lat"), 7).alias("half_lat"))


@query("preferred_nodes", f"WITH {NODES} SELECT vsn FROM nodes WHERE vsn IN (1, 2, 3, 5, 8)")
def preferred_nodes(spark, sf):
    n = nodes(spark, sf)
    return k_nearest(n, "vsn", "n_lat", "n_lon", 35.3, -119.4, 6, preferred=[1, 2, 3, 5, 8]).select("vsn")
