"""Interval, as-of and tolerance joins, counters, trends and archive questions over events.

Second-scale windows of the original signals are scaled to hours, because a user of the
event table has a few dozen events in thirty days.
"""

from pyspark.sql import functions as F

from stormlens.functions.timecols import micros
from stormlens.operators import counters, evaluate, pairing, telemetry
from stormlens.operators.blocks import with_block, with_carry, key_window
from stormlens.operators.joins import asof_backward
from stormlens.plans import coverage as cov_plan, scan
from stormlens.sources.logs import failed_units
from workload.base import DAY, EVENTS, HOUR, MINUTE, UPLOADS, events, query, r6, table, uploads


def _named(spark, sf, name):
    return events(spark, sf).where(F.col("name") == name)


# ------------------------------------------------------------------ pairing

@query("flash_thunder_pairs", f"""
WITH {EVENTS}, st AS (SELECT DISTINCT vsn % 50 AS region, t AS st FROM ev WHERE name = 'view'),
p AS (SELECT region, st, vsn, round(coalesce(CASE WHEN k > 90 THEN k::DOUBLE END, (t - st) / {HOUR}.0::DOUBLE * 343.0 / 1000.0), 3) AS km
 FROM ev JOIN st ON region = vsn % 50 AND t - st BETWEEN 0.9 * {HOUR} AND 12.0 * {HOUR} WHERE name = 'purchase')
SELECT region, st, vsn, count(DISTINCT km) AS n_ranges, min(km) AS nearest_km, max(km) AS farthest_km FROM p GROUP BY 1, 2, 3
""")
def flash_thunder_pairs(spark, sf):
    # thunder beyond its region is never heard, so the region is part of the key
    e = events(spark, sf).withColumn("region", F.col("vsn") % 50)
    strikes = e.where("name = 'view'").select("region", F.col("t").alias("st")).distinct()
    thunder = e.where("name = 'purchase'").select(
        "region", "vsn", "t", F.when(F.col("k") > 90, F.col("k").cast("double")).alias("implied_range_km"))
    x = pairing.flash_thunder_candidates(strikes, thunder, "st", on=["region"], per_second=HOUR, hi_s=12.0)
    return x.select("region", "st", "vsn", F.size("ranges").cast("bigint").alias("n_ranges"),
                    F.element_at("ranges", 1).alias("nearest_km"), F.element_at("ranges", -1).alias("farthest_km"))


@query("anchors_in_clips", f"""
WITH {EVENTS}, c AS (SELECT event_id AS clip_id, vsn, t AS t0, t + {4 * HOUR} AS t1 FROM ev WHERE name = 'signup'),
a AS (SELECT vsn, t AS anchor_t, value FROM ev WHERE name = 'view')
SELECT clip_id, anchor_t - t0 AS rel_t, value AS range_km FROM c JOIN a ON a.vsn = c.vsn AND anchor_t + {20 * HOUR} >= t0 AND anchor_t + {1 * HOUR} <= t1
""")
def anchors_in_clips(spark, sf):
    e = events(spark, sf)
    clips = e.where("name = 'signup'").select(F.col("event_id").alias("clip_id"), "vsn", F.col("t").alias("t0"),
                                              (F.col("t") + 4 * HOUR).alias("t1"))
    anchors = e.where("name = 'view'").select("vsn", F.col("t").alias("anchor_t"), F.col("value").alias("range_km"))
    x = pairing.anchors_in_clips(clips, anchors, ["vsn"], lo_off=1 * HOUR, hi_off=20 * HOUR, bucket=DAY)
    return x.select("clip_id", "rel_t", "range_km")


ANCHORED = f"""{EVENTS}, e AS (SELECT event_id, vsn, t FROM ev WHERE name = 'purchase'),
a AS (SELECT vsn, t AS anchor_t, CASE WHEN k % 4 = 0 THEN NULL ELSE value / 10 END AS anchor_km FROM ev WHERE name = 'view'),
h AS (SELECT event_id, anchor_t, anchor_km, (t - anchor_t) / {HOUR}.0::DOUBLE * 343.0 / 1000.0 AS implied FROM e JOIN a USING (vsn)
  WHERE t BETWEEN anchor_t + {1 * HOUR} AND anchor_t + {36 * HOUR}),
m AS (SELECT *, CASE WHEN anchor_km IS NULL THEN 0.0 ELSE abs(implied - anchor_km) END AS miss FROM h),
b AS (SELECT event_id, min(miss) AS miss, arg_min(anchor_t, (miss, anchor_t)) AS anchor_t, arg_min(implied, (miss, anchor_t)) AS implied,
  arg_min(coalesce(anchor_km, -1), (miss, anchor_t)) AS anchor_km FROM m GROUP BY 1)"""


def _anchored(spark, sf):
    e = events(spark, sf)
    ev = e.where("name = 'purchase'").select("event_id", "vsn", "t")
    anchors = e.where("name = 'view'").select("vsn", F.col("t").alias("anchor_t"),
                                              F.when(F.col("k") % 4 != 0, F.col("value") / 10).alias("range_km"))
    return pairing.best_anchor(ev, anchors, ["vsn"], lo_off=1 * HOUR, hi_off=36 * HOUR, per_second=HOUR, bucket=36 * HOUR)


@query("anchor_windows_match", f"""
WITH {ANCHORED} SELECT event_id, b.event_id IS NOT NULL AS anchored, b.anchor_t, round(implied, 6) AS implied_range_km,
 CASE WHEN b.anchor_km >= 0 THEN round(b.anchor_km, 6) END AS anchor_km, round(miss, 6) AS miss_km FROM e LEFT JOIN b USING (event_id)
""")
def anchor_windows_match(spark, sf):
    return _anchored(spark, sf).select("event_id", "anchored", "anchor_t", *[
        r6(c).alias(c) for c in ("implied_range_km", "anchor_km", "miss_km")])


@query("sensitive_add", f"""
WITH {EVENTS}, e AS (SELECT event_id, vsn, t FROM ev WHERE name = 'purchase'), s AS (SELECT event_id, vsn, t FROM ev WHERE name = 'error'),
w AS (SELECT vsn, t AS lo, t + {24 * HOUR} AS hi FROM ev WHERE name = 'view' AND k % 4 <> 0)
SELECT event_id, vsn, t FROM e UNION ALL SELECT event_id, vsn, t FROM s WHERE EXISTS (SELECT 1 FROM w WHERE w.vsn = s.vsn AND s.t BETWEEN lo AND hi)
 AND NOT EXISTS (SELECT 1 FROM e WHERE e.vsn = s.vsn AND abs(e.t - s.t) < {6 * HOUR})
""")
def sensitive_add(spark, sf):
    e = events(spark, sf)
    known = e.where("name = 'purchase'").select("event_id", "vsn", "t")
    weak = e.where("name = 'error'").select("event_id", "vsn", "t")
    w = e.where("name = 'view'").select("vsn", F.col("t").alias("w_lo"), (F.col("t") + 24 * HOUR).alias("w_hi"),
                                        F.when(F.col("k") % 4 != 0, 1.0).alias("range_km"))
    return pairing.add_sensitive(known, weak, w, ["vsn"], separation=6 * HOUR, bucket=24 * HOUR)


@query("asof_backward", f"""
WITH {EVENTS}, b AS (SELECT event_id, vsn, t FROM ev WHERE name = 'purchase'), f AS (SELECT vsn, t AS ft, value FROM ev WHERE name = 'view')
SELECT event_id, CASE WHEN t - ft <= {6 * HOUR} THEN ft END AS flash_t, CASE WHEN t - ft <= {6 * HOUR} THEN value END AS flash_value
FROM b ASOF LEFT JOIN f ON b.vsn = f.vsn AND b.t >= f.ft
""")
def q_asof_backward(spark, sf):
    e = events(spark, sf)
    b = e.where("name = 'purchase'").select("event_id", "vsn", "t")
    f = e.where("name = 'view'").select("vsn", F.col("t").alias("flash_t"), F.col("value").alias("flash_value"))
    x = asof_backward(b, f, ["vsn"], "t", "flash_t", ["flash_value"], block=5 * DAY, tolerance=6 * HOUR)
    return x.select("event_id", "flash_t", "flash_value")


@query("conditions_at_strike", f"""
WITH {EVENTS}, b AS (SELECT event_id, vsn, t FROM ev WHERE name = 'signup'), f AS (SELECT vsn, t AS rt, value FROM ev WHERE name = 'click')
SELECT event_id, coalesce(value, 0.0) AS rain_mm FROM b ASOF LEFT JOIN f ON b.vsn = f.vsn AND b.t >= f.rt
""")
def conditions_at_strike(spark, sf):
    e = events(spark, sf)
    b = e.where("name = 'signup'").select("event_id", "vsn", "t")
    f = e.where("name = 'click'").select("vsn", F.col("t").alias("rt"), F.col("value").alias("mm"))
    x = asof_backward(b, f, ["vsn"], "t", "rt", ["mm"], block=5 * DAY)
    return x.select("event_id", F.coalesce("mm", F.lit(0.0)).alias("rain_mm"))


TRUTH = f"""{EVENTS}, tr AS (SELECT event_id AS tid, vsn, t AS tt, value AS t_km FROM ev WHERE name = 'signup'),
fo AS (SELECT event_id AS fid, vsn, t AS ft, value AS f_km FROM ev WHERE name = 'purchase'),
m AS (SELECT tid, fid, f_km, t_km, ft, abs(ft - tt) AS dt FROM tr JOIN fo USING (vsn) WHERE abs(ft - tt) <= {4 * HOUR}),
b AS (SELECT tid, min(dt) AS dt, arg_min(f_km, (dt, ft)) AS f_km FROM m GROUP BY 1),
mt AS (SELECT tid, t_km, dt, f_km FROM tr LEFT JOIN b USING (tid)),
un AS (SELECT fid FROM fo WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.vsn = fo.vsn AND abs(tt - ft) <= {5 * HOUR}))"""


def _truth(spark, sf):
    e = events(spark, sf)
    truth = e.where("name = 'signup'").select(F.col("event_id").alias("tid"), "vsn", F.col("t").alias("tt"),
                                              F.col("value").alias("t_km"))
    found = e.where("name = 'purchase'").select(F.col("event_id").alias("fid"), "vsn", F.col("t").alias("ft"),
                                                F.col("value").alias("f_km"))
    m = pairing.match_truth(truth, found, ["vsn"], truth_t="tt", found_t="ft", tolerance=4 * HOUR,
                            payload=["f_km"], bucket=8 * HOUR)
    u = pairing.unmatched(found, truth, ["vsn"], found_t="ft", truth_t="tt", beyond=5 * HOUR, bucket=10 * HOUR)
    return m, u, found


@query("truth_match", f"WITH {TRUTH} SELECT tid, dt, f_km FROM mt")
def truth_match(spark, sf):
    return _truth(spark, sf)[0].select("tid", "dt", "f_km")


@query("unmatched_detections", f"WITH {TRUTH} SELECT fid FROM un")
def unmatched_detections(spark, sf):
    return _truth(spark, sf)[1].select("fid")


@query("detection_summary", f"""
WITH {TRUTH} SELECT (SELECT count(dt) FROM mt) AS n_hit, (SELECT count(*) FROM mt) AS n_truth,
 (SELECT round(quantile_cont(abs(f_km - t_km), 0.5), 6) FROM mt WHERE dt IS NOT NULL) AS median_range_error,
 (SELECT count(*) FROM un) AS n_unmatched,
 round((SELECT count(*) FROM ev WHERE name = 'error') / ((SELECT sum(value) FROM ev WHERE name = 'click') / 3600.0), 4) AS false_alarms_per_hour
""")
def detection_summary(spark, sf):
    m, u, _ = _truth(spark, sf)
    x = evaluate.evaluation_summary(m, u, _named(spark, sf, "click"), found_km="f_km", truth_km="t_km",
                                    false_alarms=_named(spark, sf, "error"), duration_s="value")
    return x.select("n_hit", "n_truth", r6("median_range_error").alias("median_range_error"), "n_unmatched",
                    F.round("false_alarms_per_hour", 4).alias("false_alarms_per_hour"))


@query("arrivals_per_clip", f"""
WITH {EVENTS}, c AS (SELECT event_id, vsn, t AS lo, t + {12 * HOUR} AS hi, name FROM ev WHERE name IN ('signup', 'click'))
SELECT c.event_id, count(a.t) AS n_inside, CASE WHEN count(a.t) > 0 THEN true WHEN any_value(c.name) = 'click' THEN false END AS positive
FROM c LEFT JOIN ev a ON a.vsn = c.vsn AND a.name = 'purchase' AND a.t BETWEEN lo AND hi GROUP BY 1
""")
def arrivals_per_clip(spark, sf):
    e = events(spark, sf)
    clips = e.where("name in ('signup', 'click')").select(
        "event_id", "vsn", F.col("t").alias("lo"), (F.col("t") + 12 * HOUR).alias("hi"), "name")
    x = pairing.count_inside(clips, e.where("name = 'purchase'").select("vsn", "t"), ["vsn"], lo="lo", hi="hi",
                             t="t", keys=["event_id"], bucket=12 * HOUR)
    x = evaluate.label_clips(x.withColumn("control", F.col("name") == "click"), "n_inside", "control")
    return x.select("event_id", "n_inside", "positive")


# ------------------------------------------------------------------ counters

CLICKS = f"""{EVENTS}, cl AS (SELECT vsn, t, sum(c) OVER (PARTITION BY vsn ORDER BY t) / 100.0::DOUBLE AS acc, name FROM
  (SELECT vsn, t, CAST(round(value * 100) AS BIGINT) AS c, name FROM ev))"""


def _counter(spark, sf):
    """Every event adds its value to its user's gauge (kept in integer hundredths)."""
    e = events(spark, sf).withColumn("c", F.round(F.col("value") * 100).cast("bigint"))
    x = with_carry(with_block(e, "t", 5 * DAY), ["vsn"], {"__c": (F.sum("c"), "sum")})
    from pyspark.sql import Window
    w = key_window(["vsn"], "__block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    acc = (F.sum("c").over(w) + F.coalesce("__c", F.lit(0))) / F.lit(100.0)
    return x.select("vsn", "t", "name", acc.alias("acc"))


def _windows(spark, sf):
    return _named(spark, sf, "purchase").select("event_id", "vsn", (F.col("t") - 12 * HOUR).alias("t0"),
                                                (F.col("t") + 12 * HOUR).alias("t1"))


ENVELOPE = f"""{CLICKS}, h AS (SELECT vsn, (t // {HOUR}) * {HOUR} AS hour, min(acc) AS lo, max(acc) AS hi FROM cl GROUP BY 1, 2),
w AS (SELECT event_id, vsn, t - {12 * HOUR} AS t0, t + {12 * HOUR} AS t1 FROM ev WHERE name = 'purchase')"""


@query("hourly_envelope", f"""
WITH {CLICKS}, g AS (SELECT vsn, name, (t // {HOUR}) * {HOUR} AS hour, min(acc) AS lo, max(acc) AS hi FROM cl WHERE name IN ('signup', 'click') GROUP BY 1, 2, 3),
r AS (SELECT *, CASE name WHEN 'signup' THEN 1 ELSE 2 END AS r, hour // {5 * DAY} AS p FROM g)
SELECT vsn, hour, round(lo, 2) AS lo, round(hi, 2) AS hi, name AS gauge FROM r QUALIFY r = min(r) OVER (PARTITION BY vsn, p)
""")
def hourly_envelope(spark, sf):
    x = counters.hourly_envelope(_counter(spark, sf), ["vsn"], "t", "name", "acc", ["signup", "click"], 5 * DAY)
    return x.select("vsn", "hour", F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"), "gauge")


@query("counter_delta", f"""
WITH {ENVELOPE} SELECT event_id, round(greatest(max(hi) - min(lo), 0), 4) AS mm FROM w LEFT JOIN h ON h.vsn = w.vsn AND hour >= t0 AND hour < t1 GROUP BY 1
""")
def counter_delta(spark, sf):
    c = _counter(spark, sf)
    h = c.groupBy("vsn", (F.floor(F.col("t") / HOUR) * HOUR).cast("bigint").alias("hour")).agg(
        F.min("acc").alias("lo"), F.max("acc").alias("hi"))
    x = counters.counter_delta(h, _windows(spark, sf), ["vsn"], "hour", "t0", "t1", ["event_id"], "mm", bucket=DAY)
    return x.select("event_id", F.round("mm", 4).alias("mm"))


@query("counter_delta_reset", f"""
WITH {EVENTS}, w AS (SELECT event_id, vsn, t - {12 * HOUR} AS t0, t + {12 * HOUR} AS t1 FROM ev WHERE name = 'purchase'),
s AS (SELECT vsn, t, lag(t) OVER (PARTITION BY vsn ORDER BY t) AS pt, greatest(value - lag(value) OVER (PARTITION BY vsn ORDER BY t), 0) AS d FROM ev)
SELECT w.event_id, round(sum(CASE WHEN pt >= t0 THEN d ELSE 0 END), 4) AS mm FROM w LEFT JOIN s ON s.vsn = w.vsn AND s.t >= t0 AND s.t < t1 GROUP BY 1
""")
def counter_delta_reset(spark, sf):
    x = counters.counter_delta_reset(events(spark, sf).select("vsn", "t", "value"), _windows(spark, sf), ["vsn"], "t",
                                     "value", "t0", "t1", ["event_id"], "mm", bucket=DAY, block=5 * DAY)
    return x.select("event_id", F.round("mm", 4).alias("mm"))


# ------------------------------------------------------------------ telemetry

@query("telemetry_series", f"""
WITH {EVENTS} SELECT event_id, vsn, name, value FROM ev WHERE t BETWEEN 1704153600000000 AND 1705363200000000 AND regexp_matches(name, 'view|click') AND k = 7
""")
def telemetry_series(spark, sf):
    x = telemetry.series(events(spark, sf), 1704153600000000, 1705363200000000, "view|click", {"k": 7})
    return x.select("event_id", "vsn", "name", "value")


@query("met_trend", f"""
WITH {EVENTS}, p AS (SELECT vsn, value, row_number() OVER (PARTITION BY vsn ORDER BY t) AS a, row_number() OVER (PARTITION BY vsn ORDER BY t DESC) AS b
  FROM ev WHERE name IN ('view')), q AS (SELECT vsn, count(*) AS n, avg(value) FILTER (WHERE a <= 20) AS fa, avg(value) FILTER (WHERE b <= 20) AS lb FROM p GROUP BY 1)
SELECT e.vsn, round(CASE WHEN any_value(n) > 40 THEN greatest((any_value(fa) - any_value(lb)) / 100.0, 0.0) ELSE 0.0 END, 6) AS pressure_drop,
 coalesce(max(value) FILTER (WHERE name = 'click'), 0.0) AS gust FROM ev e LEFT JOIN q USING (vsn) GROUP BY 1
""")
def met_trend(spark, sf):
    x = telemetry.met_trend(events(spark, sf), ["vsn"], "t", "name", "value", pressure="view", wind="click")
    return x.select("vsn", r6("pressure_drop").alias("pressure_drop"), "gust")


@query("resample_5min", f"""
WITH {EVENTS} SELECT name, (t // {5 * MINUTE}) * {5 * MINUTE} AS bin, round(avg(value), 6) AS mean_value FROM ev GROUP BY 1, 2
""")
def resample_5min(spark, sf):
    x = telemetry.resample_mean(events(spark, sf), ["name"], "t", 5 * MINUTE, "value")
    return x.select("name", "bin", r6("mean_value").alias("mean_value"))


SENSOR_SQL = "CASE WHEN k < 15 THEN 'bme680' WHEN k < 60 THEN 'bme280' WHEN k < 80 THEN NULL ELSE 'other' END"


@query("preferred_sensor", f"""
WITH {EVENTS}, a AS (SELECT event_id, vsn, t FROM ev WHERE name = 'purchase'), r AS (SELECT vsn, t, value, {SENSOR_SQL} AS sensor FROM ev WHERE name = 'view')
SELECT a.event_id, round(coalesce(avg(value) FILTER (WHERE sensor = 'bme680'), avg(value) FILTER (WHERE sensor IS NULL OR sensor <> 'bme280')), 6) AS mean_value
FROM a LEFT JOIN r ON r.vsn = a.vsn AND r.t BETWEEN a.t - {24 * HOUR} AND a.t + {24 * HOUR} GROUP BY 1
""")
def preferred_sensor(spark, sf):
    e = events(spark, sf)
    at = e.where("name = 'purchase'").select("event_id", "vsn", F.col("t").alias("t0"))
    readings = e.where("name = 'view'").select("vsn", "t", "value", F.expr(SENSOR_SQL).alias("sensor"))
    x = telemetry.preferred_sensor_mean(at, readings, keys=["event_id"], half=24 * HOUR, bucket=48 * HOUR)
    return x.select("event_id", r6("mean_value").alias("mean_value"))


@query("trailing_features", f"""
WITH {EVENTS}, st AS (SELECT vsn, unnest(generate_series(lo, hi, {DAY})) AS s FROM (SELECT vsn, (min(t) // {DAY}) * {DAY} AS lo, (max(t) // {DAY}) * {DAY} AS hi FROM ev GROUP BY 1)),
p AS (SELECT event_id, vsn, t, value FROM ev WHERE name = 'view'),
h AS (SELECT st.vsn, s, event_id, t, value FROM st JOIN p ON p.vsn = st.vsn AND t >= s - {DAY} AND t < s),
n AS (SELECT vsn, s, event_id, row_number() OVER (PARTITION BY vsn, s ORDER BY t, event_id) AS r FROM h WHERE value <= 25.0),
f AS (SELECT vsn, s, array_to_string(list(event_id ORDER BY r), ',') AS ids FROM n WHERE r <= 2 GROUP BY 1, 2)
SELECT st.vsn, st.s AS step, count(h.t) AS n_window, coalesce(bool_or(value <= 25.0), false) AS local, min(value) AS nearest_km, coalesce(any_value(ids), '') AS ids
FROM st LEFT JOIN h ON h.vsn = st.vsn AND h.s = st.s LEFT JOIN f ON f.vsn = st.vsn AND f.s = st.s GROUP BY 1, 2
""")
def trailing_features(spark, sf):
    e = events(spark, sf)
    span = e.groupBy("vsn").agg((F.floor(F.min("t") / DAY) * DAY).cast("bigint").alias("a"),
                                (F.floor(F.max("t") / DAY) * DAY).cast("bigint").alias("b"))
    steps = span.select("vsn", F.explode(F.sequence("a", "b", F.lit(DAY))).alias("step"))
    pts = e.where("name = 'view'").select("vsn", "t", F.col("value").alias("dist_km"), F.col("event_id").alias("id"))
    x = telemetry.trailing_features(steps, pts, ["vsn"], step="step", t="t", span=DAY, near_km=25.0, bucket=DAY)
    return x.select("vsn", "step", "n_window", "local", "nearest_km", F.array_join("first_ids", ",").alias("ids"))


@query("feed_gating", f"""
WITH {EVENTS}, d AS (SELECT vsn, t // {DAY} AS day, bool_or(name = 'error') AS elevated, min(CASE WHEN name = 'view' THEN value END) AS cell FROM ev GROUP BY 1, 2)
SELECT vsn, day, elevated, CASE WHEN elevated THEN cell END AS cell_km FROM d
""")
def feed_gating(spark, sf):
    d = events(spark, sf).groupBy("vsn", F.floor(F.col("t") / DAY).alias("day")).agg(
        F.max(F.col("name") == "error").alias("elevated"), F.min(F.when(F.col("name") == "view", F.col("value"))).alias("cell"))
    return d.select("vsn", "day", "elevated", telemetry.gated(F.col("elevated"), F.col("cell")).alias("cell_km"))


@query("measurement_long", f"""
WITH {EVENTS}, m AS (SELECT event_id, 'lightning.flash.candidate' AS name, value, t * 1000 AS timestamp_ns, CAST(k AS VARCHAR) AS meta_k, name AS meta_source FROM ev
 UNION ALL SELECT event_id, 'lightning.flash.luma', k::DOUBLE, t * 1000, CAST(k AS VARCHAR), name FROM ev)
SELECT name, value, timestamp_ns, meta_k, meta_source, event_id FROM m UNION ALL
SELECT 'lightning.flash.frames_checked', count(*)::DOUBLE, NULL, NULL, name, NULL FROM ev GROUP BY name
""")
def measurement_long(spark, sf):
    e = events(spark, sf)
    m = telemetry.to_measurements(
        e, {"lightning.flash.candidate": "value", "lightning.flash.luma": "k"}, F.col("t") * 1000,
        {"k": F.col("k"), "source": F.col("name")}, ["event_id"])
    m = m.select("name", "value", "timestamp_ns", m.meta["k"].alias("meta_k"), m.meta["source"].alias("meta_source"), "event_id")
    counts = telemetry.batch_count(e.withColumnRenamed("name", "meta_source"), "lightning.flash.frames_checked", ["meta_source"])
    return m.unionByName(counts, allowMissingColumns=True)


@query("schema_union", f"""
WITH {EVENTS} SELECT event_id, value, t AS hour FROM ev WHERE name = 'click' UNION ALL SELECT event_id, value, t FROM ev WHERE name = 'view' AND k > 10
""")
def schema_union(spark, sf):
    e = events(spark, sf)
    old = e.where("name = 'click'").select("event_id", "value", F.col("t").alias("timestamp"))
    new = e.where("name = 'view'").select("event_id", "value", F.when(F.col("k") > 10, F.col("t")).alias("hour"))
    return telemetry.drift_union([old, new], "hour", "timestamp")


# ------------------------------------------------------------------ archive questions

@query("first_record", f"""
WITH {EVENTS} SELECT vsn, coalesce(min(t) FILTER (WHERE name = 'restart'), min(t) FILTER (WHERE name = 'signup'), min(t)) AS first_t FROM ev GROUP BY 1
""")
def first_record(spark, sf):
    return cov_plan.first_record(events(spark, sf), ["restart", "signup"])


@query("latest_record", f"""
WITH {EVENTS}, n AS (SELECT c_custkey AS vsn FROM customer), m AS (SELECT max(t) AS now FROM ev),
l AS (SELECT vsn, max(t) AS t, arg_max(name, t) AS name FROM ev, m WHERE t >= now - {14 * DAY} GROUP BY 1)
SELECT vsn, l.t, name, CASE WHEN l.t >= now - {2 * DAY} THEN 'live' WHEN l.t IS NOT NULL THEN 'stale' ELSE 'quiet' END AS tier
FROM n CROSS JOIN m LEFT JOIN l USING (vsn)
""")
def latest_record(spark, sf):
    e = events(spark, sf)
    now = e.agg(F.max("t").alias("m")).scalar()
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("vsn"))
    return cov_plan.latest_record(e, n, now).select("vsn", "t", "name", "tier")


@query("task_universe", f"""
WITH {UPLOADS} SELECT DISTINCT task FROM up
""")
def task_universe(spark, sf):
    return cov_plan.task_universe(uploads(spark, sf), F.lit(True))


@query("node_only_tasks", f"""
WITH {UPLOADS}, v AS (SELECT vsn, task || '-' || (vsn % 7) AS task FROM up), u AS (SELECT DISTINCT task FROM v WHERE vsn % 7 < 5)
SELECT DISTINCT vsn, task FROM v WHERE task NOT IN (SELECT task FROM u)
""")
def node_only_tasks(spark, sf):
    """Tasks carry the model of their node; the fleet list knows five of seven models."""
    up = uploads(spark, sf).withColumn("task", F.concat("task", F.lit("-"), F.col("vsn") % 7))
    x = cov_plan.node_only_tasks(up, F.lit(True), cov_plan.task_universe(up, F.col("vsn") % 7 < 5))
    return x.select("vsn", "task")


@query("archive_census", f"WITH {UPLOADS} SELECT vsn, task, count(*) AS n_files FROM up GROUP BY 1, 2")
def archive_census(spark, sf):
    return cov_plan.archive_census(uploads(spark, sf), ["vsn", "task"])


@query("latest_uploads", f"""
WITH {EVENTS} SELECT vsn, name, event_id, t FROM ev WHERE t >= 1704067200000000 + {10 * DAY}
QUALIFY row_number() OVER (PARTITION BY vsn, name ORDER BY t DESC) <= 3
""")
def latest_uploads(spark, sf):
    e = events(spark, sf).select("vsn", "name", "event_id", "t")
    return cov_plan.latest_uploads(e, ["vsn", "name"], "t", 3, F.lit(1704067200000000 + 10 * DAY))


@query("resume_units", f"""
WITH {EVENTS} SELECT DISTINCT vsn, t // {DAY} AS day FROM ev EXCEPT SELECT vsn, t // {DAY} FROM ev WHERE name = 'error'
""")
def resume_units(spark, sf):
    e = events(spark, sf).withColumn("day", F.floor(F.col("t") / DAY))
    plan = e.select("vsn", "day").distinct()
    return scan.to_do(plan, e.where("name = 'error'"), ["vsn", "day"])


@query("failed_units", f"""
WITH {EVENTS}, l AS (SELECT 'WARN fetch failed unit=' || vsn || '/' || name || '/' || strftime(make_timestamp(t), '%Y-%m') || ' after retries' AS line FROM ev),
p AS (SELECT regexp_extract(line, 'unit=([0-9]+)/([a-z]+)/([0-9-]+)', 1) AS vsn, regexp_extract(line, 'unit=([0-9]+)/([a-z]+)/([0-9-]+)', 2) AS task,
  regexp_extract(line, 'unit=([0-9]+)/([a-z]+)/([0-9-]+)', 3) AS month FROM l)
SELECT DISTINCT vsn, task, month FROM p EXCEPT SELECT CAST(vsn AS VARCHAR), name, strftime(make_timestamp(t), '%Y-%m') FROM ev WHERE k < 5
""")
def q_failed_units(spark, sf):
    e = events(spark, sf).withColumn("m", F.date_format(F.timestamp_micros("t"), "yyyy-MM"))
    lines = e.select(F.concat(F.lit("WARN fetch failed unit="), "vsn", F.lit("/"), "name",
                                                  F.lit("/"), "m", F.lit(" after retries")).alias("value"))
    done = e.where("k < 5").select(F.col("vsn").cast("string").alias("vsn"), F.col("name").alias("task"), F.col("m").alias("month"))
    return failed_units(lines, r"unit=([0-9]+)/([a-z]+)/([0-9-]+)", ["vsn", "task", "month"], done)
