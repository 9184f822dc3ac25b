"""Sessions, greedy groups, spikes, hysteresis events and rank-based samples over events."""

from pyspark.sql import functions as F

from stormlens.operators import detect, sequence as S
from stormlens.operators.blocks import row_numbers
from workload.base import DAY, EVENTS, HOUR, events, query, r6

BLOCK = 5 * DAY


@query("gap_episodes", f"""
WITH {EVENTS}, b AS (SELECT vsn, t, CASE WHEN t - lag(t) OVER (PARTITION BY vsn ORDER BY t) <= {12 * HOUR} THEN 0 ELSE 1 END AS b FROM ev)
SELECT vsn, min(t) AS episode_start, max(t) AS episode_end, count(*) AS n FROM
 (SELECT vsn, t, sum(b) OVER (PARTITION BY vsn ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM b) GROUP BY vsn, g
""")
def gap_episodes(spark, sf):
    return S.episodes(events(spark, sf), ["vsn"], "t", 12 * HOUR, block=3 * DAY)


@query("gap_episodes_fleet", f"""
WITH {EVENTS}, b AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) <= {HOUR // 6} THEN 0 ELSE 1 END AS b FROM ev)
SELECT min(t) AS episode_start, max(t) AS episode_end, count(*) AS n FROM
 (SELECT t, sum(b) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM b) GROUP BY g
""")
def gap_episodes_fleet(spark, sf):
    return S.episodes(events(spark, sf), [], "t", HOUR // 6, block=DAY)


def _greedy_sql(strict: bool, width: int) -> str:
    op = "<" if strict else "<="
    return f"""
WITH RECURSIVE {EVENTS}, o AS (SELECT vsn, t, value, row_number() OVER (PARTITION BY vsn ORDER BY t) AS rn FROM ev),
g(vsn, rn, t, value, s) AS (SELECT vsn, rn, t, value, t FROM o WHERE rn = 1 UNION ALL
 SELECT o.vsn, o.rn, o.t, o.value, CASE WHEN o.t - g.s {op} {width} THEN g.s ELSE o.t END FROM g JOIN o ON o.vsn = g.vsn AND o.rn = g.rn + 1)"""


@query("greedy_groups", _greedy_sql(False, 24 * HOUR) + " SELECT vsn, s AS group_start, count(*) AS n, max(t) AS last_t FROM g GROUP BY 1, 2")
def greedy_groups(spark, sf):
    g = S.greedy_groups(events(spark, sf).select("vsn", "t"), ["vsn"], "t", 24 * HOUR, block=4 * DAY)
    return g.groupBy("vsn", "group_start").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"))


@query("greedy_dedupe", _greedy_sql(True, 18 * HOUR) + " SELECT vsn, s AS t, count(*) AS n_merged, min(value) AS value FROM g GROUP BY 1, 2")
def greedy_dedupe(spark, sf):
    return S.greedy_dedupe(events(spark, sf).select("vsn", "t", "value"), ["vsn"], "t", 18 * HOUR, block=4 * DAY,
                           nearest="value")


def spike_sql(final: str, also: str = "0 AS one", by: str = "vsn") -> str:
    """Spikes of each `by`, of which `also` adds a column to the events."""
    near = ", ".join(f"lag(value, {i}) OVER w AS p{i}, lead(value, {i}) OVER w AS n{i}" for i in (1, 2, 3))
    p = [f"coalesce(p{i}, f)" for i in (1, 2, 3)]
    n = [f"coalesce(n{i}, l)" for i in (1, 2, 3)]
    seven = ", ".join([p[2], p[1], p[0], "value", n[0], n[1], n[2]])
    five = ", ".join([p[1], p[0], "value", n[0], n[1]])
    return f"""
WITH {EVENTS}, e AS (SELECT *, {also} FROM ev), s AS (SELECT event_id, {by}, t, value, {near}, t - lag(t) OVER w AS gp, lead(t) OVER w - t AS gn, count(*) OVER (PARTITION BY {by}) AS n,
  first_value(value) OVER w AS f, last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM e WINDOW w AS (PARTITION BY {by} ORDER BY t)),
d AS (SELECT *, value - CASE WHEN n >= 7 THEN list_sort([{seven}])[4] ELSE list_sort([{five}])[3] END AS d,
  list_aggregate(list_filter([p3, p2, p1, n1, n2, n3], lambda x: x IS NOT NULL), 'median') AS base FROM s WHERE n >= 5),
m AS (SELECT {by}, quantile_cont(d, 0.5) AS med FROM d GROUP BY {by}),
a AS (SELECT {by}, quantile_cont(abs(d - med), 0.5) AS mad FROM d JOIN m USING ({by}) GROUP BY {by}),
h AS (SELECT *, 0.6745 * (d - med) / (mad + 1e-12) AS z FROM d JOIN m USING ({by}) JOIN a USING ({by}) WHERE 0.6745 * (d - med) / (mad + 1e-12) > 4.0 AND d > 8.0)
{final}"""


def _spikes(spark, sf):
    e = events(spark, sf).select("event_id", "vsn", "t", "value")
    return S.robust_spikes(e, ["vsn"], "t", "value", block=BLOCK, sparse_after=3 * HOUR)


@query("spikes_per_node", spike_sql("SELECT vsn, count(*) AS n_spikes, round(max(z), 4) AS max_z FROM h GROUP BY 1"))
def spikes_per_node(spark, sf):
    return _spikes(spark, sf).groupBy("vsn").agg(F.count(F.lit(1)).alias("n_spikes"), F.round(F.max("z"), 4).alias("max_z"))


@query("spike_features", spike_sql(f"""SELECT event_id, round(d, 6) AS rise, round(z, 4) AS z, least(gp, gn) AS min_gap, round(base, 6) AS local_base,
 round(value - base, 6) AS jump, least(gp, gn) > {3 * HOUR} AS sparse, base > 90.0 AS daytime, 0.5::DOUBLE AS sigma_s FROM h WHERE NOT (base > 90.0)"""))
def spike_features(spark, sf):
    x = S.flash_anchors(_spikes(spark, sf))
    return x.select("event_id", r6("rise").alias("rise"), F.round("z", 4).alias("z"), "min_gap",
                    r6("local_base").alias("local_base"), r6("jump").alias("jump"), "sparse", "daytime", "sigma_s")


@query("calm_neighbour", f"""
WITH {EVENTS}, s AS (SELECT event_id, value > 60 AS sp, t, {", ".join(f"lag(value > 60, {i}) OVER w AS ps{i}, lag(t, {i}) OVER w AS pt{i}, lead(value > 60, {i}) OVER w AS ns{i}, lead(t, {i}) OVER w AS nt{i}" for i in (1, 2))}
 FROM ev WINDOW w AS (PARTITION BY vsn ORDER BY t))
SELECT event_id, CASE WHEN NOT ps1 THEN pt1 WHEN NOT ns1 THEN nt1 WHEN NOT ps2 THEN pt2 WHEN NOT ns2 THEN nt2 END AS base_t FROM s WHERE sp
""")
def calm_neighbour(spark, sf):
    e = events(spark, sf).select("event_id", "vsn", "t", (F.col("value") > 60).alias("sp"))
    x = S.calm_neighbour(e, ["vsn"], "t", "sp", block=BLOCK, out="base_t")
    return x.where("sp").select("event_id", "base_t")


ISLANDS = f"""{EVENTS}, fr AS (SELECT vsn, t, value, k, row_number() OVER (PARTITION BY vsn ORDER BY t) AS idx FROM ev),
mk AS (SELECT *, CASE WHEN value >= 60 THEN 1 WHEN value < 30 THEN 0 END AS m FROM fr),
st AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY vsn ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM mk),
op AS (SELECT *, coalesce(m = 1 AND was = 0, false) AS o, coalesce(m = 1 AND was = 0, false) OR was = 1 AS inside FROM st),
sid AS (SELECT *, last_value(CASE WHEN o THEN t END IGNORE NULLS) OVER (PARTITION BY vsn ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM op),
isl AS (SELECT vsn, s AS start, max(t) AS "end", count(*) AS n FROM sid WHERE inside GROUP BY 1, 2),
mg AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY vsn ORDER BY start) < {8 * HOUR} THEN 0 ELSE 1 END AS b FROM isl),
mi AS (SELECT *, sum(b) OVER (PARTITION BY vsn ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM mg),
mev AS (SELECT vsn, min(start) AS start, max("end") AS "end", count(*) AS n_islands FROM mi GROUP BY vsn, g)"""


def _islands(spark, sf):
    return S.hysteresis_islands(events(spark, sf), ["vsn"], "t", "value", on=60.0, off=30.0, block=BLOCK)


def _merged(spark, sf):
    return S.merge_intervals(_islands(spark, sf), ["vsn"], 8 * HOUR, block=BLOCK)


@query("hysteresis_islands", f'WITH {ISLANDS} SELECT vsn, start, "end", n FROM isl')
def hysteresis_islands(spark, sf):
    return _islands(spark, sf)


@query("hysteresis_events", f'WITH {ISLANDS} SELECT vsn, start, "end", n_islands FROM mev')
def hysteresis_events(spark, sf):
    return _merged(spark, sf)


SHAPE = f"""{ISLANDS}, r AS (SELECT e.vsn, e.start, e."end", idx, value, k FROM mev e JOIN fr ON fr.vsn = e.vsn AND t BETWEEN start AND "end"),
pk AS (SELECT vsn, start, count(*) AS n_frames, max(value) AS peak, arg_min(idx, (-value, idx)) AS pi, avg(value) AS mean, sum(k) AS lo, sum(value) AS mi,
  avg(k - value) AS som FROM r GROUP BY 1, 2),
sh AS (SELECT r.vsn, r.start, any_value(r."end") AS "end", any_value(n_frames) AS n_frames, any_value(peak) AS peak, any_value(mean) AS mean,
  any_value(som) AS som, any_value(mi) / (any_value(lo) + any_value(mi) + 1e-9) AS mf, any_value(pi) AS pi, min(idx) FILTER (WHERE value >= peak / 2) AS a,
  max(idx) FILTER (WHERE value >= peak / 2) AS b FROM r JOIN pk ON pk.vsn = r.vsn AND pk.start = r.start GROUP BY 1, 2),
ms AS (SELECT vsn, start, "end", n_frames, n_frames * 0.5 AS duration, peak, mean, greatest((pi - a) * 0.5, 0.5) AS rise, greatest((b - pi) * 0.5, 0.0) AS decay,
  mf AS mid_fraction, som AS sub_over_mid FROM sh)"""


def _shapes(spark, sf):
    e = row_numbers(events(spark, sf), ["vsn"], ["t"], "t", BLOCK, out="idx")
    e = e.select("vsn", "t", "value", F.col("k").cast("double").alias("k"), "idx")
    return S.event_shape(e, _merged(spark, sf), ["vsn"], "t", "value", hop=0.5, block=BLOCK, index="idx",
                         low="k", mid="value", raw_low="k", raw_mid="value")


@query("event_morphology", f"""WITH {SHAPE} SELECT vsn, start, "end", n_frames, duration::DOUBLE AS duration, peak, round(mean, 6) AS mean, rise::DOUBLE AS rise,
 decay::DOUBLE AS decay, round(mid_fraction, 6) AS mid_fraction, round(sub_over_mid, 6) AS sub_over_mid FROM ms""")
def event_morphology(spark, sf):
    return _shapes(spark, sf).select("vsn", "start", "end", "n_frames", "duration", "peak", r6("mean").alias("mean"),
                                     "rise", "decay", r6("mid_fraction").alias("mid_fraction"),
                                     r6("sub_over_mid").alias("sub_over_mid"))


@query("event_gate", f"""WITH {SHAPE}, sc AS (SELECT *, 0.35 * greatest(0, least(1, peak / 15.0)) + 0.25 * greatest(0, least(1, (duration - 0.7) / 4.0))
  + 0.2 * greatest(0, least(1, decay / greatest(rise, 1e-3) / 4.0)) + 0.2 * greatest(0, least(1, mid_fraction / 0.4)) AS score,
  CASE WHEN vsn % 2 = 0 THEN (vsn % 13)::DOUBLE END AS wind, vsn % 3 = 0 AS anchored, CASE WHEN vsn % 3 = 0 THEN (vsn % 9)::DOUBLE END AS miss_km FROM ms)
SELECT vsn, start, round(score, 6) AS score, CASE WHEN duration < CASE WHEN anchored THEN 0.4 ELSE 0.7 END THEN 'too short (raindrop/impulse)'
 WHEN duration > 20 THEN 'too long (stationary noise shift)' WHEN decay / greatest(rise, 1e-3) < CASE WHEN anchored THEN 0.5 ELSE 1.2 END THEN 'no fast-attack/slow-decay shape'
 WHEN mid_fraction < 0.12 THEN 'pure sub-# Hz excess (wind buffeting)' WHEN sub_over_mid > 25 THEN 'sub-band dominates by # dB raw (wind buffeting)'
 WHEN (CASE WHEN wind IS NULL THEN NOT anchored ELSE wind > 8 END) AND sub_over_mid > 12 THEN 'sub-band dominates by # dB raw ' || CASE WHEN wind IS NULL THEN '(wind unknown)' ELSE '(windy)' END
 WHEN anchored AND miss_km > 5 THEN 'range-inconsistent: implied # km vs anchor''s # km (Δ# > # km tol)'
 WHEN score < CASE WHEN anchored THEN 0.3 ELSE 0.55 END THEN 'score # < #' ELSE '' END AS reason FROM sc""")
def event_gate(spark, sf):
    v = F.col("vsn")
    a = v % 3 == 0
    x = _shapes(spark, sf).withColumn("wind", F.when(v % 2 == 0, (v % 13).cast("double"))).withColumn(
        "anchored", a).withColumn("miss_km", F.when(a, (v % 9).cast("double"))).withColumn(
        "anchor_km", F.when(a, F.lit(10.0))).withColumn("implied_range_km", F.col("anchor_km") + F.col("miss_km"))
    g = detect.gate(x, wind="wind")
    return g.select("vsn", "start", r6("score").alias("score"),
                    F.regexp_replace("reject_reason", r"[0-9]+(\.[0-9]+)?", "#").alias("reason"))


@query("node_max_score", f"""WITH {SHAPE}, sc AS (SELECT vsn, 0.35 * greatest(0, least(1, peak / 15.0)) + 0.25 * greatest(0, least(1, (duration - 0.7) / 4.0))
  + 0.2 * greatest(0, least(1, decay / greatest(rise, 1e-3) / 4.0)) + 0.2 * greatest(0, least(1, mid_fraction / 0.4)) AS score FROM ms)
SELECT c_custkey AS vsn, coalesce(round(max(score), 6), 0.0) AS clip_score FROM customer LEFT JOIN sc ON vsn = c_custkey GROUP BY 1""")
def node_max_score(spark, sf):
    from workload.base import table
    clips = table(spark, sf, "customer").select(F.col("c_custkey").alias("vsn"))
    ev = _shapes(spark, sf).withColumn("score", detect.event_score())
    return detect.clip_scores(clips, ev, "vsn").select("vsn", r6("clip_score").alias("clip_score"))


@query("even_subsample", f"""
WITH {EVENTS}, n AS (SELECT event_id, vsn, row_number() OVER (PARTITION BY vsn ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY vsn) AS n FROM ev)
SELECT event_id, vsn FROM n WHERE n <= 20 OR p IN (SELECT i * n // 20 FROM generate_series(0, 19) g(i))
""")
def even_subsample(spark, sf):
    e = events(spark, sf).select("event_id", "vsn", "t")
    return S.even_subsample(e, ["vsn"], ["t"], 20, block_on="t", block=BLOCK).select("event_id", "vsn")


@query("filmstrip", f"""
WITH {EVENTS}, n AS (SELECT event_id, vsn, row_number() OVER (PARTITION BY vsn ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY vsn) AS n FROM ev)
SELECT event_id, vsn FROM n WHERE p % greatest(n // 8, 1) = 0 AND p // greatest(n // 8, 1) < 8
""")
def filmstrip(spark, sf):
    e = events(spark, sf).select("event_id", "vsn", "t")
    return S.filmstrip(e, ["vsn"], ["t"], 8, block_on="t", block=BLOCK).select("event_id", "vsn")


@query("rank_of_row", f"""
WITH {EVENTS}, r AS (SELECT event_id, vsn, value, row_number() OVER (ORDER BY t) AS pos FROM ev) SELECT vsn, min(pos) AS first_pos, max(pos) AS last_pos FROM r WHERE name_ok GROUP BY 1
""".replace("FROM ev) SELECT", ", name = 'error' AS name_ok FROM ev) SELECT"))
def rank_of_row(spark, sf):
    e = events(spark, sf).select("event_id", "vsn", "t", "name")
    x = row_numbers(e, [], ["t"], "t", DAY, out="pos")
    return x.where("name = 'error'").groupBy("vsn").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
