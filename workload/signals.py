"""Array signals, images as pixel arrays, localisation and learning."""

from pyspark.sql import functions as F

from stormlens.functions import geo
from stormlens.operators import evaluate, localize, ml, signal
from stormlens.operators.arrivals import arrival_positions
from stormlens.operators.areas import nearest_k
from workload.base import EVENTS, FIRES, NODES, events, fires, hav, nodes, query, r6, table


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("y"), "label")


EMB = "em AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS y FROM embeddings)"
HOPS = f"""{EMB}, h AS (SELECT vec_id, list_transform(range(0, 16), lambda i: sqrt(list_sum(list_transform(y[i*4+1:i*4+4], lambda v: v*v)) / 4)) AS e FROM em),
db AS (SELECT vec_id, list_transform(e, lambda r: 20 * log10(r + 1e-12)) AS d FROM h)"""


@query("envelope_onset", f"""
WITH {HOPS}, q AS (SELECT vec_id, d, list_sort(d) AS s FROM db), f AS (SELECT vec_id, d, s[4] AS fl FROM q),
hit AS (SELECT vec_id, d, fl, list_min(list_filter(range(0, 14), lambda i: d[i+1] > fl + 4 AND d[i+2] > fl + 4)) AS i FROM f),
bk AS (SELECT vec_id, d, i, list_max(list_filter(range(0, i), lambda j: NOT d[j+1] > fl + 3)) AS j FROM hit)
SELECT vec_id, round(list_max(d), 6) AS peak_db, CASE WHEN i IS NOT NULL THEN round(coalesce(j + 1, 0) * 0.02 + 0.01, 6) END AS onset_s FROM bk
""")
def envelope_onset(spark, sf):
    x = _emb(spark, sf).withColumn("d", signal.envelope_db("y", 4))
    return x.select("vec_id", r6(F.array_max("d")).alias("peak_db"),
                    r6(signal.onset_time("d", 0.02, k_db=4.0, sustain=2)).alias("onset_s"))


@query("peak_over_median", f"""
WITH {HOPS} SELECT vec_id, round(list_max(e) / ((list_sort(e)[8] + list_sort(e)[9]) / 2 + 1e-9), 6) AS ratio FROM h
""")
def peak_over_median(spark, sf):
    return _emb(spark, sf).select("vec_id", r6(signal.peak_over_median("y", 4)).alias("ratio"))


@query("loudest_clips", f"""
WITH {HOPS}, r AS (SELECT vec_id, list_max(e) AS peak, list_max(e) / ((list_sort(e)[8] + list_sort(e)[9]) / 2 + 1e-9) AS ratio FROM h),
o AS (SELECT vec_id, round(CASE WHEN peak > 0.15 THEN ratio ELSE 0 END, 9) AS score FROM r)
SELECT vec_id, score FROM o ORDER BY score DESC, vec_id LIMIT 15
""")
def loudest_clips(spark, sf):
    e = signal.hop_rms("y", 4)
    s = F.when(F.array_max(e) > 0.15, signal.peak_over_median("y", 4)).otherwise(0.0)
    x = _emb(spark, sf).select("vec_id", F.round(s, 9).alias("score"))
    return x.orderBy(F.desc("score"), "vec_id").limit(15)


WHITE = f"""{EMB}, l AS (SELECT vec_id, label, unnest(range(1, 65)) AS b, y FROM em),
sp AS (SELECT vec_id, label, b, b * 3.0 AS f, y[b] * 100 AS db FROM l),
fl AS (SELECT label, b, quantile_cont(db, 0.2) AS fl FROM sp GROUP BY 1, 2),
ex AS (SELECT vec_id, label, f, db, greatest(0, db - fl - 3) AS exc FROM sp JOIN fl USING (label, b))"""


@query("whitened_excess", f"""
WITH {WHITE} SELECT vec_id, label, round(avg(exc) FILTER (WHERE f BETWEEN 15 AND 200), 6) AS exc, round(avg(exc) FILTER (WHERE f BETWEEN 15 AND 60), 6) AS sub,
 round(avg(exc) FILTER (WHERE f BETWEEN 60 AND 200), 6) AS mid, round(avg(db) FILTER (WHERE f BETWEEN 15 AND 60), 6) AS raw_sub,
 round(avg(db) FILTER (WHERE f BETWEEN 60 AND 200), 6) AS raw_mid FROM ex GROUP BY 1, 2
""")
def whitened_excess(spark, sf):
    spec = _emb(spark, sf).select("vec_id", "label", F.posexplode("y").alias("bin", "v")).select(
        "vec_id", "label", "bin", ((F.col("bin") + 1) * 3.0).alias("f"), (F.col("v") * 100).alias("db"))
    x = signal.whitened_excess(spec, ["label"], "vec_id")
    return x.select("vec_id", "label", *[r6(c).alias(c) for c in ("exc", "sub", "mid", "raw_sub", "raw_mid")])


@query("clip_features")
def clip_features(spark, sf):
    clips = _emb(spark, sf).select("vec_id", "y", F.lit(200).alias("sr"))
    x = signal.clip_features(clips, "y", "sr")
    return x.select("vec_id", *[F.round(c, 4).alias(c) for c in ("rms_db", "peak_db", "low_peak_db", "low_ratio", "duration_s")])


PAIRS = f"""{EMB}, fp AS (SELECT a.vec_id, a.y AS a, b.y AS b FROM em a JOIN em b ON b.vec_id = a.vec_id - 1),
px AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, a[i+1] * 1000 AS a, b[i+1] * 1000 AS b FROM (SELECT *, unnest(range(0, 64)) AS i FROM fp))"""


def _pairs(spark, sf):
    e = _emb(spark, sf).select("vec_id", F.transform("y", lambda v: v * 1000).alias("a"))
    return e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@query("sector_mean", f"""
WITH {PAIRS}, s AS (SELECT vec_id, a - b AS d, degrees(atan2(c - 4, -(r - 4))) AS g FROM px),
k AS (SELECT vec_id, floor((CASE WHEN g < 0 THEN g + 360 ELSE g END) / 45)::INT AS s, avg(d) AS m FROM s GROUP BY 1, 2)
SELECT vec_id, arg_max(s, (m, -s)) AS sector, ((arg_max(s, (m, -s)) + 0.5) * 45.0)::DOUBLE AS center_deg, round(max(m), 6) AS mean_diff FROM k GROUP BY 1
""")
def sector_mean(spark, sf):
    x = signal.sector_mean(_pairs(spark, sf), ["vec_id"], "a", "b", 8, 8)
    return x.select("vec_id", "sector", "center_deg", r6("mean_diff").alias("mean_diff"))


@query("tile_change", f"""
WITH {PAIRS}, t AS (SELECT vec_id, (r - 2) // 2 AS tile_r, c // 2 AS tile_c, avg(abs(b - a)) AS m FROM px WHERE r BETWEEN 2 AND 5 GROUP BY 1, 2, 3)
SELECT vec_id, tile_r::INTEGER AS tile_r, tile_c::INTEGER AS tile_c, round(least(m / 255.0, 1.0), 3) AS confidence, round(m, 1) AS mean_abs_diff FROM t WHERE m > 200
""")
def tile_change(spark, sf):
    return signal.tile_change(_pairs(spark, sf), ["vec_id"], "a", "b", 8, 8, band=(0.25, 0.75), threshold=200.0, grid=(2, 4))


@query("frame_luma", f"WITH {EMB} SELECT vec_id, round(list_sum(y) / 64, 6) AS luma FROM em")
def frame_luma(spark, sf):
    return _emb(spark, sf).select("vec_id", r6(signal.mean_luma("y")).alias("luma"))


@query("pooled_embedding", f"""
WITH {EMB}, l AS (SELECT label, unnest(range(0, 64)) AS d, y FROM em), g AS (SELECT label, d, avg(y[d+1]) AS m, max(y[d+1]) AS x FROM l GROUP BY 1, 2)
SELECT label, d::BIGINT AS dim, round(m, 6) AS value FROM g UNION ALL SELECT label, d + 64, round(x, 6) FROM g
""")
def pooled_embedding(spark, sf):
    p = ml.pool_embeddings(table(spark, sf, "embeddings"), ["label"], "embedding")
    x = p.select("label", F.posexplode("features").alias("dim", "v"))
    return x.select("label", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value"))


@query("probe_cv")
def probe_cv(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("pos", (F.col("label") < 3).cast("int"))
    return ml.probe_cv(e, "vec_id", "embedding", "pos").select(
        "vec_id", F.col("label").cast("int").alias("pos"), "fold", F.round("score", 4).alias("score"))


# ------------------------------------------------------------------ evaluation over labels

SCORED = "sc AS (SELECT d.doc_id, (n_chars % 997)::DOUBLE AS s1, (n_chars * 31 % 211)::DOUBLE AS s2, quality = 1 AS pos, 1 + d.doc_id % 4 AS w FROM documents d JOIN labels USING (doc_id))"


def _scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 997).cast("double").alias("s1"),
                                             (F.col("n_chars") * 31 % 211).cast("double").alias("s2"))
    l = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("pos"))
    return d.join(l, "doc_id").withColumn("w", F.lit(1) + F.col("doc_id") % 4)


def _auc_sql(s):
    return f"""(SELECT round((sum(CASE WHEN p.{s} > n.{s} THEN 1.0 WHEN p.{s} = n.{s} THEN 0.5 ELSE 0 END) / count(*))::DOUBLE, 6) FROM sc p JOIN sc n ON p.pos AND NOT n.pos)"""


@query("rank_auc", f"""
WITH {SCORED} SELECT {_auc_sql('s1')} AS auc, (SELECT count(*) FROM sc WHERE pos) AS n_pos, (SELECT count(*) FROM sc WHERE NOT pos) AS n_neg
""")
def rank_auc(spark, sf):
    return evaluate.rank_auc(_scored(spark, sf), "s1", "pos").select(r6("auc").alias("auc"), "n_pos", "n_neg")


def _op_sql(s, allowed):
    return f"""t AS (SELECT coalesce((SELECT s FROM (SELECT {s} AS s, row_number() OVER (ORDER BY {s} DESC) AS r FROM sc WHERE NOT pos) WHERE r = {allowed + 1}),
  (SELECT min({s}) FROM sc WHERE NOT pos)) AS threshold)"""


@query("recall_at_budget", f"""
WITH {SCORED}, {_op_sql('s1', 7)} SELECT any_value(threshold) AS threshold, 7::BIGINT AS allowed, count(*) FILTER (WHERE pos AND s1 > threshold) AS clips_hit,
 count(*) FILTER (WHERE pos) AS clips, CAST(coalesce(sum(w) FILTER (WHERE pos AND s1 > threshold), 0) AS BIGINT) AS arrivals_hit, CAST(sum(w) FILTER (WHERE pos) AS BIGINT) AS arrivals FROM sc, t
""")
def recall_at_budget(spark, sf):
    return evaluate.recall_at_budget(_scored(spark, sf), "s1", "pos", "w", 7.9)


@query("score_comparison", f"""
WITH {SCORED}, {_op_sql('s1', 7)}, u AS ({_op_sql('s2', 7).split(' AS (', 1)[1]}
SELECT 's1' AS score, {_auc_sql('s1')} AS auc, (SELECT threshold FROM t) AS threshold, (SELECT count(*) FROM sc, t WHERE pos AND s1 > threshold) AS clips_hit
UNION ALL SELECT 's2', {_auc_sql('s2')}, (SELECT threshold FROM u), (SELECT count(*) FROM sc, u WHERE pos AND s2 > threshold)
""")
def score_comparison(spark, sf):
    x = evaluate.compare_scores(_scored(spark, sf), ["s1", "s2"], "pos", "w", 7.9)
    return x.select("score", r6("auc").alias("auc"), "threshold", "clips_hit")


# ------------------------------------------------------------------ localisation

def _near_nodes(spark, sf, k):
    """The k nearest nodes of each fire with local coordinates and the exact range."""
    f, n = fires(spark, sf), nodes(spark, sf).select("vsn", "n_lat", "n_lon")
    p = nearest_k(f, n, "fire_id", "vsn", k, left_ll=("f_lat", "f_lon"), right_ll=("n_lat", "n_lon"))
    p = p.withColumnRenamed("rank", "rk").join(n, "vsn").join(f.select("fire_id", "f_lat", "f_lon"), "fire_id")
    x, y = geo.east_m("n_lon", F.lit(35.5), F.lit(-119.3)), geo.north_m("n_lat", F.lit(35.5))
    fx, fy = geo.east_m("f_lon", F.lit(35.5), F.lit(-119.3)), geo.north_m("f_lat", F.lit(35.5))
    return p.select("fire_id", "vsn", "rk", x.alias("x"), y.alias("y"), fx.alias("fx"), fy.alias("fy"),
                    F.hypot(x - fx, y - fy).alias("r"))


@query("multilaterate", f"""
WITH {NODES}, {FIRES} SELECT fire_id, CAST(least(6, (SELECT count(*) FROM nodes)) AS INTEGER) AS n,
 CAST(floor((f_lon + 119.3) * 11132.0 * cos(radians(35.5)) + 0.5) AS BIGINT) AS x_dam, CAST(floor((f_lat - 35.5) * 11054.0 + 0.5) AS BIGINT) AS y_dam FROM fires
""")
def multilaterate(spark, sf):
    n = _near_nodes(spark, sf, 6)
    rows = n.groupBy("fire_id").agg(
        F.max("fx").alias("fx"), F.max("fy").alias("fy"),
        F.array_sort(F.collect_list(F.struct("rk", "x", "y", "r"))).alias("a"))
    anchors = F.transform("a", lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y"), a["r"].alias("r"), F.lit(200.0).alias("s")))
    sol = localize.multilaterate(rows.select("fire_id", "fx", "fy", F.size("a").alias("n"), anchors.alias("anchors")))
    # ranges are exact, so a solution is the fire, or its mirror image where the nodes lie on a line
    every = F.concat(F.array(F.array("x", "y")), "alternates")
    near = F.array_min(F.transform(every, lambda p: F.struct(F.hypot(p[0] - F.col("fx"), p[1] - F.col("fy")).alias("d"), p.alias("p"))))["p"]
    # to tens of metres: on a line of nodes the solution is only that good. Elsewhere it is good to micrometres, and a fire that
    # lies on the edge between two of them is told by its position, not by the solver's last bits
    dam = lambda v: F.floor(F.round(v, 5) / 10 + 0.5)
    return sol.select("fire_id", "n", dam(near[0]).alias("x_dam"), dam(near[1]).alias("y_dam"))


@query("nearest_six_nodes", f"""
WITH {NODES}, {FIRES} SELECT fire_id, vsn, rank, round(d, 6) AS dist_km FROM (SELECT fire_id, vsn, d, row_number() OVER (PARTITION BY fire_id ORDER BY d, vsn) AS rank
 FROM (SELECT fire_id, vsn, {hav('n_lat', 'n_lon', 'f_lat', 'f_lon')} AS d FROM nodes, fires)) WHERE rank <= 6
""")
def nearest_six_nodes(spark, sf):
    x = nearest_k(fires(spark, sf), nodes(spark, sf).select("vsn", "n_lat", "n_lon"), "fire_id", "vsn", 6,
                  left_ll=("f_lat", "f_lon"), right_ll=("n_lat", "n_lon"))
    return x.select("fire_id", "vsn", F.col("rank").cast("bigint").alias("rank"), r6("dist_km").alias("dist_km"))


@query("fuse_strikes")
def fuse_strikes(spark, sf):
    """Views are flashes, purchases thunder; a second becomes a minute."""
    e = events(spark, sf)
    ev = e.where("name in ('view', 'purchase')").select(
        F.when(F.col("name") == "view", "flash").otherwise("thunder").alias("type"), "vsn", F.col("t").alias("time_epoch"),
        F.lit(None).cast("double").alias("implied_range_km"))
    n = nodes(spark, sf).select("vsn", F.col("n_lat").alias("lat"), F.col("n_lon").alias("lon"))
    x = localize.fuse_strikes(ev, n, per_second=60_000_000, block_s=1440.0)
    return x.select("t_strike", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("rms_m", 1).alias("rms_m"),
                    "n_nodes", "quality", F.size("ranges").alias("n_ranges"))


@query("fused_incidents", f"""
WITH RECURSIVE {EVENTS}, {NODES}, o AS (SELECT t, row_number() OVER (ORDER BY t) AS rn FROM ev WHERE name = 'view'),
g(rn, t, s) AS (SELECT rn, t, t FROM o WHERE rn = 1 UNION ALL SELECT o.rn, o.t, CASE WHEN o.t - g.s <= 90000000 THEN g.s ELSE o.t END FROM g JOIN o ON o.rn = g.rn + 1),
st AS (SELECT DISTINCT s FROM g), p AS (SELECT s, vsn, round((t - s) / 60000000.0::DOUBLE * 343.0 / 1000.0, 3) AS km FROM st JOIN ev ON t - s BETWEEN 54000000 AND 5400000000
  WHERE name = 'purchase' AND vsn IN (SELECT vsn FROM nodes))
SELECT s AS t_strike, count(DISTINCT vsn) AS n_nodes, count(DISTINCT (vsn, km)) AS n_candidates FROM p GROUP BY 1
""")
def fused_incidents(spark, sf):
    from stormlens.operators.pairing import flash_thunder_candidates
    from stormlens.operators.sequence import greedy_groups
    e = events(spark, sf)
    st = greedy_groups(e.where("name = 'view'").select("t"), [], "t", 90_000_000, block=1440 * 60_000_000, out="t_strike")
    th = e.where("name = 'purchase'").select("vsn", "t", F.lit(None).cast("double").alias("implied_range_km"))
    p = flash_thunder_candidates(st.select("t_strike").distinct(), th, "t_strike", per_second=60_000_000,
                                 known_nodes=nodes(spark, sf))
    return p.groupBy("t_strike").agg(F.count(F.lit(1)).alias("n_nodes"),
                                     F.sum(F.size("ranges")).cast("bigint").alias("n_candidates"))


@query("tdoa_grid")
def tdoa_grid(spark, sf):
    n = _near_nodes(spark, sf, 6)
    ev = n.groupBy("fire_id").agg(
        F.max("fx").alias("fx"), F.max("fy").alias("fy"),
        F.array_sort(F.collect_list(F.struct("rk", "x", "y", (F.col("r") / 343.0).alias("toa")))).alias("receivers"))
    sol = arrival_positions(ev.where(F.size("receivers") >= 3), ["fire_id", "fx", "fy"])
    err = F.hypot(F.col("x") - F.col("fx"), F.col("y") - F.col("fy"))
    return sol.select("fire_id", (err < 150.0).alias("within_cell"))


@query("ring_board")
def ring_board(spark, sf):
    n = _near_nodes(spark, sf, 3).select(F.col("fire_id").alias("case_id"), "vsn", "rk", "r")
    rings = n.select("case_id", "vsn", F.col("rk").alias("seq"), F.col("r").alias("range_m"), F.lit(120.0).alias("sigma_m"))
    at = nodes(spark, sf).select("vsn", F.col("n_lat").alias("lat"), F.col("n_lon").alias("lon"))
    x = localize.ring_board(rings, at, "case_id")
    return x.select("case_id", F.round("rms_m", 0).alias("rms_m"), "bimodal", "degenerate")
