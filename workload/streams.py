"""Streaming jobs run to completion over the event table, and their batch twins."""

import uuid

from pyspark.sql import functions as F

from stormlens.functions.timecols import micros
from stormlens.session import ensure_checkpoint_dir
from stormlens.functions.physics import sound_speed_ms
from stormlens.streaming import clock, frames as fr, fusion, tiers
from workload.base import DAY, EVENTS, events, planar, query, r6, table
from workload.sequences import spike_sql


def _stream(spark, sf):
    """The event table as a stream of files, in the shape of `events`."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select("event_id", micros("ts").alias("t"), F.col("user_id").alias("vsn"), F.col("event_type").alias("name"),
                      "value", F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"))


def _ended(spark, rows, time="time_epoch", kind="type"):
    """(folder, stream of `rows` with a clock): what `_finish` runs to its end."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    clock.open_clock(spark, base + "/clock", time)
    return base, clock.with_clock(rows, base + "/clock", time, kind)


def _finish(spark, base, writer, time="time_epoch"):
    """Run a stream over all there is, until its last window has come out."""
    clock.run_to_end(spark, base + "/clock", lambda: writer.option("checkpointLocation", base + "/state").trigger(availableNow=True).start(), time)


def _watch_inputs(e):
    """Signups raise the outlook, clicks are cells, errors regional strikes, views flashes, purchases thunder."""
    n, v = F.col("name"), F.col("value")
    strike = F.struct((F.lit(35.2) + F.col("k") / 500.0).alias("lat"), (F.lit(-119.6) + F.col("k") / 400.0).alias("lon"),
                      (F.col("t") / 1e6).alias("time_epoch"), F.when(F.col("k") % 2 == 0, v).alias("risk"))
    return e.select(
        "vsn", (F.col("t") / 1e6).alias("t"), (n == "signup").alias("outlook_elevated"),
        F.when(n == "click", v * 4).alias("nearest_cell_km"), F.when(n == "error", F.col("k") % 6).otherwise(0).alias("regional_strikes"),
        F.lit(0.0).alias("pressure_drop_hpa_3h"), F.lit(0.0).alias("gust_ms"),
        ((n == "view") & (v > 20)).alias("local_flash"), ((n == "purchase") & (v > 20)).alias("local_thunder"),
        F.when((n == "view") & (v > 20), F.array(strike)).otherwise(F.array().cast(
            "array<struct<lat:double,lon:double,time_epoch:double,risk:double>>")).alias("strikes"))


def _watch_nodes(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("vsn"), (F.lit(35.2) + F.col("c_custkey") % 50 / 1000.0).alias("lat"),
                    (F.lit(-119.6) + F.col("c_custkey") % 70 / 1000.0).alias("lon"))


def _audit_columns(x):
    return x.select("vsn", "t", "kind", "detail", "tier", F.size("sectors").alias("n_sectors"))


#: The table has a few rows a node and day; three days are one block.
WATCH_BLOCK_S = 3 * 86400.0

# one row at a time: state after row rn of each node, and what the row did
WATCH = f"""
WITH RECURSIVE {EVENTS}, x AS (SELECT vsn, event_id, t / 1e6::DOUBLE AS t, name = 'signup' AS outlook, CASE WHEN name = 'click' THEN value * 4 END AS cell,
  CASE WHEN name = 'error' THEN k % 6 ELSE 0 END AS strikes, name = 'view' AND value > 20 AS flash, name = 'purchase' AND value > 20 AS thunder, value, k FROM ev),
y AS (SELECT *, coalesce(cell <= 100, false) OR strikes >= 3 AS near, flash OR thunder AS here, row_number() OVER (PARTITION BY vsn ORDER BY t, event_id) - 1 AS rn FROM x),
m(vsn, rn, t, was, since0, active, tier, since, armed, used, day, log, newest, clr, off, arms, allowed) AS (
  SELECT DISTINCT vsn, -1::BIGINT, 0::DOUBLE, NULL::INT, 0::DOUBLE, 0::DOUBLE, 0, 0::DOUBLE, NULL::DOUBLE, 0::DOUBLE, -1::BIGINT, false, NULL::DOUBLE, -1::BIGINT, false, false, false FROM y
  UNION ALL
  SELECT vsn, rn, t, CASE WHEN nt IS NOT NULL THEN tier END, since, active, coalesce(nt, tier), CASE WHEN nt IS NULL THEN since ELSE t END,
    CASE WHEN arms AND used2 < 36000 THEN t WHEN NOT off THEN armed END, used2, CASE WHEN arms THEN floor(t / 86400)::BIGINT ELSE day END,
    log AND NOT clears, CASE WHEN NOT clears THEN newest END, CASE WHEN clears THEN rn ELSE clr END, off, arms, arms AND used2 < 36000
  FROM (SELECT *, CASE WHEN arms AND day <> floor(t / 86400) THEN 0 WHEN off THEN used + t - armed ELSE used END AS used2
  FROM (SELECT *, coalesce(nt = 2 OR (tier = 4 AND nt = 3), false) AS arms, coalesce(tier = 4 AND nt < 2, false) AS clears,
      armed IS NOT NULL AND coalesce(tier = 3 OR (tier = 2 AND nt < 2), false) AND nt IS NOT NULL AS off
  FROM (SELECT *, CASE tier WHEN 0 THEN CASE WHEN near THEN 2 WHEN outlook THEN 1 END
      WHEN 1 THEN CASE WHEN near THEN 2 WHEN NOT outlook AND t - since > 86400 THEN 0 END
      WHEN 2 THEN CASE WHEN here THEN 3 WHEN t - active > 14400 THEN outlook::INT END
      WHEN 3 THEN CASE WHEN (t - since) / 3600 >= 6 OR (t - active) / 60 >= 30 THEN CASE WHEN log THEN 4 ELSE outlook::INT END END
      ELSE CASE WHEN here THEN 3 WHEN t - newest > 259200 THEN outlook::INT END END AS nt
  FROM (SELECT m.vsn, y.rn, y.t, m.tier, m.since, CASE WHEN near OR here THEN y.t ELSE m.active END AS active, m.armed, m.used, m.day, m.log OR flash AS log,
      greatest(m.newest, CASE WHEN flash THEN y.t END) AS newest, m.clr, y.near, y.here, y.outlook FROM m JOIN y ON y.vsn = m.vsn AND y.rn = m.rn + 1) z)))),
names AS (SELECT unnest(['IDLE', 'OUTLOOK', 'APPROACH', 'STORM', 'AFTERMATH']) AS name, unnest(range(5)) AS n),
logged AS (SELECT vsn, rn, t, 35.2::DOUBLE + k / 500.0::DOUBLE AS lat, -119.6::DOUBLE + k / 400.0::DOUBLE AS lon, CASE WHEN k % 2 = 0 THEN value END AS risk FROM y WHERE flash),
watch AS (SELECT m.vsn, m.rn, count(DISTINCT (l.lat, l.lon, l.t, l.risk)) AS n_log, count(DISTINCT (l.lat, l.lon, l.t, l.risk)) FILTER (
    m.t - l.t BETWEEN 0 AND 259200 AND {planar("c.lat", "c.lon", "l.lat", "l.lon")} <= 30) AS n_sectors
  FROM m JOIN logged l ON l.vsn = m.vsn AND l.rn <= m.rn AND l.rn > m.clr LEFT JOIN (
    SELECT c_custkey AS vsn, 35.2::DOUBLE + c_custkey % 50 / 1000.0::DOUBLE AS lat, -119.6::DOUBLE + c_custkey % 70 / 1000.0::DOUBLE AS lon FROM customer) c ON c.vsn = m.vsn
  WHERE m.was = 3 AND m.tier = 4 GROUP BY 1, 2),
d AS (SELECT m.*, a.name AS from_name, b.name AS to_name, n_log, n_sectors, CASE WHEN was = 0 AND m.tier = 2 THEN 'storm evidence from idle' WHEN was = 0 THEN 'elevated outlook'
    WHEN was = 1 AND m.tier = 2 THEN 'approach evidence' WHEN was = 1 THEN 'outlook expired' WHEN was = 2 AND m.tier = 3 THEN 'first local flash/thunder'
    WHEN was = 2 THEN 'approach timeout auto-revert' WHEN m.tier = 4 THEN 'storm quiet ' || format('{{:.0f}}', (m.t - active) / 60) || ' min; ' || n_log || ' strike(s) logged'
    WHEN was = 3 THEN 'storm quiet, no localized strikes' WHEN m.tier = 3 THEN 'renewed local activity' ELSE 'aftermath complete' END AS why
  FROM m JOIN names b ON b.n = m.tier LEFT JOIN names a ON a.n = m.was LEFT JOIN watch w ON w.vsn = m.vsn AND w.rn = m.rn WHERE m.rn >= 0),
audit(vsn, t, kind, detail, tier, n_sectors) AS (
  SELECT vsn, t, 'transition', from_name || ' -> ' || to_name || ': ' || why, tier, NULL::INT FROM d WHERE was IS NOT NULL
  UNION ALL SELECT vsn, t, 'poll', to_name, tier, NULL FROM d WHERE was IS NOT NULL OR rn % 12 = 0
  UNION ALL SELECT vsn, t, 'notify', 'storm-mode entered', tier, NULL FROM d WHERE was = 2 AND tier = 3
  UNION ALL SELECT vsn, t, 'guardrail', 'approach timed out with no storm', was, NULL FROM d WHERE was = 2 AND tier < 2
  UNION ALL SELECT vsn, t, 'guardrail', 'max storm hours (6.0) reached', was, NULL FROM d WHERE was = 3 AND (t - since0) / 3600 >= 6
  UNION ALL SELECT vsn, t, 'guardrail', 'daily continuous-capture budget exhausted; NOT arming', tier, NULL FROM d WHERE arms AND NOT allowed
  UNION ALL SELECT vsn, t, 'action', 'arm continuous capture', tier, NULL FROM d WHERE allowed
  UNION ALL SELECT vsn, t, 'action', 'revert to baseline sampling', was, NULL FROM d WHERE off
  UNION ALL SELECT vsn, t, 'action', 'stop holdover watch', was, NULL FROM d WHERE was = 4 AND tier < 2
  UNION ALL SELECT vsn, t, 'action', 'start holdover watch: ' || n_sectors || ' sector(s), 72 h', tier, n_sectors::INT FROM d WHERE was = 3 AND tier = 4)
"""


@query("tier_batch", WATCH + " SELECT vsn, t, kind, detail, tier, n_sectors FROM audit")
def tier_batch(spark, sf):
    return _audit_columns(tiers.tier_batch(_watch_inputs(events(spark, sf)), _watch_nodes(spark, sf), block_s=WATCH_BLOCK_S))


@query("tier_stream", WATCH + " SELECT vsn, t, kind, detail, tier, n_sectors FROM audit")
def tier_stream(spark, sf):
    base, rows = _ended(spark, _watch_inputs(_stream(spark, sf)), time="t", kind="none")
    x = tiers.tier_stream(rows, _watch_nodes(spark, sf), stretch_s=86400.0)
    _finish(spark, base, x.writeStream.format("parquet").option("path", base + "/out").outputMode("append"), "t")
    return _audit_columns(spark.read.parquet(base + "/out"))


@query("replay_metrics", WATCH + """
, f AS (SELECT vsn, min(t) / 1e6::DOUBLE AS first_t FROM ev WHERE name = 'view' AND value > 20 GROUP BY 1)
SELECT vsn, coalesce(array_to_string(list_sort(list(DISTINCT regexp_extract(detail, '-> (\\w+):', 1)) FILTER (kind = 'transition')), ','), '') AS tiers,
  round((any_value(first_t) - min(t) FILTER (kind = 'transition' AND regexp_extract(detail, '-> (\\w+):', 1) = 'APPROACH')) / 60, 3) AS lead_min,
  count(*) FILTER (starts_with(detail, 'start holdover watch')) AS watches, coalesce(sum(n_sectors), 0)::BIGINT AS sectors_watched,
  count(*) FILTER (kind = 'guardrail') AS guardrails, count(*) FILTER (kind NOT IN ('poll', 'notify')) AS audit_records
FROM audit LEFT JOIN f USING (vsn) GROUP BY vsn""")
def replay_metrics(spark, sf):
    e = events(spark, sf)
    audit = tiers.tier_batch(_watch_inputs(e), _watch_nodes(spark, sf), block_s=WATCH_BLOCK_S)
    first = e.where("name = 'view' and value > 20").groupBy("vsn").agg((F.min("t") / 1e6).alias("first_t"))
    x = tiers.replay_metrics(audit, first)
    return x.select("vsn", F.array_join("tiers", ",").alias("tiers"), F.round("lead_min", 3).alias("lead_min"), "watches",
                    "sectors_watched", "guardrails", "audit_records")


FUSED = f"""
WITH RECURSIVE {EVENTS}, o AS (SELECT vsn % 8 AS region, t, row_number() OVER (PARTITION BY vsn % 8 ORDER BY t) AS rn FROM ev WHERE name = 'view'),
g(region, rn, t, s) AS (SELECT region, rn, t, t FROM o WHERE rn = 1 UNION ALL
  SELECT o.region, o.rn, o.t, CASE WHEN o.t - g.s <= 90000000 THEN g.s ELSE o.t END FROM g JOIN o ON o.region = g.region AND o.rn = g.rn + 1),
st AS (SELECT DISTINCT region, s FROM g),
p AS (SELECT DISTINCT st.region, s, vsn, round((t / 6e7::DOUBLE - s / 6e7::DOUBLE) * {sound_speed_ms(20.0)}::DOUBLE / 1000.0, 3) AS km
  FROM st JOIN ev ON ev.vsn % 8 = st.region AND t - s BETWEEN 54000000 AND 5400000000 WHERE name = 'purchase')
SELECT region::VARCHAR AS region, round(s / 60000000.0::DOUBLE, 3) AS t_strike, vsn::VARCHAR AS vsn, count(*) AS n_ranges,
  round(min(km), 3) AS nearest_km, round(max(km), 3) AS farthest_km, round(sum(km), 3) AS sum_km FROM p GROUP BY 1, 2, 3
"""


@query("fusion_stream", FUSED)
def fusion_stream(spark, sf):
    """A minute of the table is a second of the storm; eight regions of nodes, each with its own strikes."""
    e = _stream(spark, sf)
    ev = e.select((F.col("vsn") % 8).cast("string").alias("region"),
                  F.when(F.col("name") == "view", "flash").when(F.col("name") == "purchase", "thunder").otherwise("other").alias("type"),
                  "vsn", (F.col("t") / 6e7).alias("time_epoch"), F.lit(None).cast("double").alias("implied_range_km"))
    base, ev = _ended(spark, ev)
    x = fusion.incident_stream(ev, region="region")
    _finish(spark, base, x.writeStream.format("parquet").option("path", base + "/out").outputMode("append"))
    km = F.col("ranges")
    return spark.read.parquet(base + "/out").select(
        "region", F.round("t_strike", 3).alias("t_strike"), "vsn", F.size(km).cast("bigint").alias("n_ranges"), F.round(F.array_min(km), 3).alias("nearest_km"),
        F.round(F.array_max(km), 3).alias("farthest_km"), F.round(F.aggregate(km, F.lit(0.0), lambda a, k: a + k), 3).alias("sum_km"))


def _frame_windows(spark, sf, seconds, handle):
    """Run the frame job over the event table; `handle(rows)` is written for each micro-batch, which replaces itself if repeated."""
    f = _stream(spark, sf).select("vsn", (F.col("t") / 1e6).alias("t"), F.col("value").alias("luma"))
    base, f = _ended(spark, f, time="t", kind="none")

    def write(batch, batch_id):
        handle(batch).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
    _finish(spark, base, fr.frame_batches(f, seconds=seconds).writeStream.foreachBatch(write).outputMode("append"), "t")
    return spark.read.parquet(base + "/out").drop("batch")


@query("frame_batches", f"""
WITH {EVENTS} SELECT vsn, (t // {DAY}) * 86400.0::DOUBLE AS batch_start, count(*) AS frames_checked FROM ev GROUP BY 1, 2
""")
def frame_batches(spark, sf):
    """Frame counters of the streaming job; a day of the table is one batch."""
    return _frame_windows(spark, sf, 86400, fr.batch_counters)


@query("spike_stream", spike_sql(f"SELECT vsn, week * 604800.0::DOUBLE AS batch_start, t / 1000000.0::DOUBLE AS t, round(d, 6) AS rise, round(z, 4) AS z FROM h",
                                 f"t // {7 * DAY} AS week", "vsn, week"))
def spike_stream(spark, sf):
    """Spikes of the streaming job; a week of the table is one batch."""
    got = _frame_windows(spark, sf, 604800, lambda b: fr.batch_spikes(b, seconds=604800))
    return got.select("vsn", "batch_start", "t", r6("rise").alias("rise"), F.round("z", 4).alias("z"))
