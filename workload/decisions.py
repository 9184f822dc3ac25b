"""Risk scores, cards, reviews, patrols, redaction, listings."""

from pyspark.sql import functions as F

from stormlens.functions import geo, physics, risk, text as tx
from stormlens.functions.timecols import micros
from stormlens.operators import patrol, redact as rd, review
from stormlens.sources import feeds, media
from workload.base import EVENTS, HOUR, events, nodes, query, r6, table

FACTORS = """fa AS (SELECT o_orderkey AS sid, (floor(o_totalprice)::BIGINT % 700) / 100.0::DOUBLE AS rain, (o_orderkey % 130) / 100.0::DOUBLE - 0.1 AS dry,
 (o_custkey % 100) / 100.0::DOUBLE AS fuel, 1 + o_custkey % 6 AS n_nodes, o_orderstatus <> 'P' AS present, epoch_us(o_orderdate) AS t FROM orders),
rs AS (SELECT *, 35.0 * greatest(0, 1 - rain / 2.5) AS a, 30.0 * least(greatest(dry, 0), 1) AS b, 20.0 * fuel AS c, 15.0 * least(1.0, n_nodes / 4.0::DOUBLE) AS d FROM fa)"""


def _factors(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("sid"), (F.floor("o_totalprice") % 700 / 100.0).alias("rain"),
        (F.col("o_orderkey") % 130 / 100.0 - 0.1).alias("dry"), (F.col("o_custkey") % 100 / 100.0).alias("fuel"),
        (F.lit(1) + F.col("o_custkey") % 6).alias("n_nodes"), (F.col("o_orderstatus") != "P").alias("present"),
        micros("o_orderdate").alias("t"))


@query("ignition_risk", f"""
WITH {FACTORS} SELECT sid, CASE WHEN present THEN round(a + b + c + d, 4) END AS total, CASE WHEN present THEN round(a, 4) END AS part_dry,
 CASE WHEN present THEN rain < 2.5 END AS dry_lightning FROM rs
""")
def ignition_risk(spark, sf):
    f = _factors(spark, sf)
    parts = risk.risk_parts("rain", "dry", "fuel", risk.thunder_confidence("n_nodes"))
    total = parts["dry"] + parts["dryness"] + parts["fuel"] + parts["thunder"]
    s = risk.risk_score("rain", "dry", "fuel", risk.thunder_confidence("n_nodes"), "present")
    p = F.col("present")
    return f.select("sid", F.when(p, F.round(total, 4)).alias("total"), F.when(p, F.round(parts["dry"], 4)).alias("part_dry"),
                    s["dry_lightning"].alias("dry_lightning"))


@query("score_card", f"""
WITH {FACTORS} SELECT sid, CASE sid % 3 WHEN 0 THEN 'demo' WHEN 1 THEN 'live' ELSE 'unknown' END AS provenance,
 CASE sid % 3 WHEN 0 THEN '[DEMO — SYNTHETIC] ' WHEN 1 THEN '' ELSE '[UNVERIFIED SOURCE] ' END AS prefix, rain < 2.5 AS dry_lightning,
 round((a + b + c + d)::VARCHAR::DECIMAL(38, 18), 1)::DOUBLE AS total, round(a::VARCHAR::DECIMAL(38, 18), 1)::DOUBLE AS part_dry, round(d::VARCHAR::DECIMAL(38, 18), 1)::DOUBLE AS part_thunder,
 round(rain, 4) AS rain_mm, 'gauge' AS rain_source, 'unspecified' AS fuel_source, n_nodes || ' nodes fused' AS thunder_source,
 CASE WHEN n_nodes > 1 THEN n_nodes * 50.0::DOUBLE END AS semi_major_m, 3.2::DOUBLE AS range_km, 20 AS revisit_min, 72 AS hours,
 'human review only — no automated dispatch' AS posture FROM rs WHERE present
""")
def score_card(spark, sf):
    f = _factors(spark, sf).where("present")
    s = risk.risk_score("rain", "dry", "fuel", risk.thunder_confidence("n_nodes"))
    strike = F.struct(
        (F.col("t") / 1e6).alias("time_epoch"), F.lit(35.5).alias("lat"), F.lit(-119.2).alias("lon"),
        F.when(F.col("n_nodes") > 1, F.col("n_nodes") * 50.0).alias("semi_major_m"), F.lit(40.0).alias("semi_minor_m"),
        F.lit(1.2).alias("gdop"), F.lit("fix").alias("quality"), "n_nodes",
        F.create_map(F.col("sid").cast("string"), F.lit(3.2)).alias("ranges"))
    factors = F.struct(F.col("rain").alias("rain_mm"), F.col("dry").alias("dryness"), "fuel",
                       risk.thunder_confidence("n_nodes").alias("thunder_conf"))
    sources = F.create_map(F.lit("rain"), F.lit("gauge"), F.lit("thunder"), F.format_string("%d nodes fused", F.col("n_nodes").cast("int")))
    prov = F.when(F.col("sid") % 3 == 0, "demo").when(F.col("sid") % 3 == 1, "live").otherwise("unknown")
    x = f.withColumn("risk", s).withColumn("strike", strike).withColumn("factors", factors).withColumn(
        "sources", sources).withColumn("prov", prov)
    card = risk.risk_card("strike", "risk", "factors", "sources", "prov")
    x = x.select("sid", card.alias("c"))
    return x.select(
        "sid", "c.provenance", F.regexp_extract("c.title", r"^(\[[^\]]*\] )?", 0).alias("prefix"), "c.dry_lightning",
        "c.score.total", F.col("c.score.breakdown.dry").alias("part_dry"), F.col("c.score.breakdown.thunder").alias("part_thunder"),
        F.round("c.score.inputs.rain_mm.value", 4).alias("rain_mm"), F.col("c.score.inputs.rain_mm.source").alias("rain_source"),
        F.col("c.score.inputs.fuel.source").alias("fuel_source"), F.col("c.score.inputs.thunder_conf.source").alias("thunder_source"),
        F.col("c.strike.ellipse_m")[0].alias("semi_major_m"), F.map_values("c.strike.ranges_km")[0].alias("range_km"),
        "c.watch.revisit_min", "c.watch.hours", "c.posture")


@query("alert_rows", f"""
WITH {FACTORS} SELECT sid, CASE sid % 3 WHEN 0 THEN '[DEMO — SYNTHETIC] ' WHEN 1 THEN '' ELSE '[UNVERIFIED SOURCE] ' END || 'Ignition risk '
 || CAST(n_nodes * 10 AS VARCHAR) || '/100 — strike ' || strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S') || 'Z' AS title,
 CASE WHEN rain < 2.5 THEN 'DRY' ELSE 'wet' END AS rain_flag, CASE WHEN n_nodes > 1 THEN '±' || CAST(n_nodes * 50 AS VARCHAR) || ' m' ELSE 'no ellipse' END AS uncertainty,
 CAST(n_nodes AS VARCHAR) || ' node(s)' AS nodes, CASE WHEN n_nodes > 3 THEN CAST(n_nodes - 3 AS VARCHAR) || ' external anchor(s)' ELSE 'single modality only' END AS corroboration FROM fa
""")
def alert_rows(spark, sf):
    f = _factors(spark, sf)
    strike = F.struct((F.col("t") / 1e6).alias("time_epoch"), F.when(F.col("n_nodes") > 1, F.col("n_nodes") * 50.0).alias("semi_major_m"), "n_nodes")
    r = F.struct((F.col("n_nodes") * 10.0).alias("total"), (F.col("rain") < 2.5).alias("dry_lightning"))
    prov = F.when(F.col("sid") % 3 == 0, "demo").when(F.col("sid") % 3 == 1, "live").otherwise("unknown")
    x = f.withColumn("strike", strike).withColumn("risk", r).withColumn("prov", prov).withColumn("n_c", F.col("n_nodes") - 3)
    return x.select("sid", *[c.alias(n) for n, c in risk.alert_row("strike", "risk", "prov", "n_c").items()])


@query("dryness", """
SELECT o_orderkey AS sid, CASE WHEN o_orderkey % 10 > 0 THEN round(1 - (o_custkey % 100) / 100.0::DOUBLE, 3) END AS dryness FROM orders
""")
def dryness(spark, sf):
    w = F.when(F.col("o_orderkey") % 10 > 0, F.col("o_custkey") % 100 / 100.0).otherwise(-999.0)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("sid"), risk.dryness_from_wetness(w).alias("dryness"))


@query("flash_to_bang", f"""
WITH {EVENTS} SELECT event_id, round((343.0 + 0.6 * (k / 3.0 - 20.0)) * (value - 5.0), 6) AS range_m,
 round((343.0 + 0.6 * (k / 3.0 - 20.0)) * sqrt(0.1*0.1 + 0.3*0.3), 6) AS sigma_m, round(value * 100.0 / (343.0 + 0.6 * (k / 3.0 - 20.0)), 6) AS delay_s,
 CASE WHEN value - 5.0 <= 0 THEN 'error' WHEN value - 5.0 > 90 THEN 'warning' ELSE 'ok' END AS verdict FROM ev
""")
def flash_to_bang(spark, sf):
    e = events(spark, sf).withColumn("temp", F.col("k") / 3.0).withColumn("dt", F.col("value") - 5.0)
    return e.select("event_id", r6(physics.bang_range_m("dt", "temp")).alias("range_m"),
                    r6(physics.range_sigma_m(0.1, 0.3, "temp")).alias("sigma_m"),
                    r6(physics.bang_delay_s(F.col("value") * 100.0, "temp")).alias("delay_s"),
                    physics.delay_verdict("dt").alias("verdict"))


@query("pan_angles", f"""
WITH {EVENTS} SELECT event_id, round((value * 3.6 + 350.0) % 360.0, 6) AS pan, round(least(((value * 3.6 - k * 3.6) % 360.0 + 360.0) % 360.0,
 360.0 - ((value * 3.6 - k * 3.6) % 360.0 + 360.0) % 360.0), 6) AS diff FROM ev
""")
def pan_angles(spark, sf):
    e = events(spark, sf).withColumn("b", F.col("value") * 3.6).withColumn("c", F.col("k") * 3.6)
    return e.select("event_id", r6(geo.pan_deg("b", 350.0)).alias("pan"), r6(geo.circular_diff_deg("b", "c")).alias("diff"))


# ------------------------------------------------------------------ review

ACTIONS = """ac AS (SELECT conv_id AS strike_id, turn AS time, CASE role WHEN 'system' THEN 'add_comment' WHEN 'user' THEN CASE WHEN turn = 0 THEN 'confirm_smoke'
  WHEN turn = 2 THEN 'reject_false' ELSE 'keep_watching' END ELSE CASE WHEN length(text) % 3 = 0 THEN 'reject_false' WHEN length(text) % 3 = 1 THEN 'confirm_smoke' ELSE 'unknown_action' END END AS action,
  role AS reviewer, text AS comment FROM conversations),
de AS (SELECT *, CASE action WHEN 'confirm_smoke' THEN 'confirmed_smoke' WHEN 'reject_false' THEN 'false_positive' WHEN 'keep_watching' THEN 'keep_watching'
  WHEN 'add_comment' THEN 'comment_requested' ELSE 'unknown' END AS label FROM ac)"""


def _decisions(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.length("text") % 3
    action = (F.when(F.col("role") == "system", "add_comment")
              .when(F.col("role") == "user", F.when(F.col("turn") == 0, "confirm_smoke").when(F.col("turn") == 2, "reject_false")
                    .otherwise("keep_watching"))
              .otherwise(F.when(n == 0, "reject_false").when(n == 1, "confirm_smoke").otherwise("unknown_action")))
    return review.decisions(c.select(F.col("conv_id").alias("strike_id"), F.col("turn").alias("time"), action.alias("action"),
                                     F.col("role").alias("reviewer"), F.col("text").alias("comment")))


@query("review_decisions", f"WITH {ACTIONS} SELECT strike_id, time, action, label, reviewer FROM de")
def review_decisions(spark, sf):
    return _decisions(spark, sf).select("strike_id", "time", "action", "label", "reviewer")


@query("review_directives", f"""
WITH {ACTIONS} SELECT strike_id, time, CASE label WHEN 'confirmed_smoke' THEN 'prioritize_sector' ELSE 'extend_watch' END AS directive, reviewer FROM de
WHERE label IN ('confirmed_smoke', 'keep_watching')
""")
def review_directives(spark, sf):
    return review.directives(_decisions(spark, sf))


@query("review_labels", f"""
WITH {ACTIONS}, l AS (SELECT strike_id, label FROM de WHERE label IN ('confirmed_smoke', 'false_positive') QUALIFY row_number() OVER
 (PARTITION BY strike_id ORDER BY time DESC, action DESC) = 1)
SELECT strike_id, label, CASE label WHEN 'confirmed_smoke' THEN 1 ELSE 0 END AS target FROM l
""")
def review_labels(spark, sf):
    return review.labelled_examples(_decisions(spark, sf), ["time", "action"])


@query("patrol_result", """
SELECT conv_id AS sector, count(*) AS visited, CAST(sum((length(text) % 4 = 0 OR lower(trim(role)) LIKE 'user%')::INT) AS BIGINT) AS flagged,
 CAST(sum(CASE WHEN length(text) % 4 = 0 OR lower(trim(role)) LIKE 'user%' THEN (length(text) % 4 = 0)::INT ELSE 0 END) AS BIGINT) AS detections FROM conversations GROUP BY 1
""")
def patrol_result(spark, sf):
    c = table(spark, sf, "conversations")
    v = c.select(F.col("conv_id").alias("sector"), (F.length("text") % 4 == 0).cast("bigint").alias("detections"),
                 F.when(F.col("role") == "user", " Plume over ridge").otherwise("clear").alias("caption"))
    return patrol.patrol_result(v, ["sector"], "detections", "caption")


@query("before_after_pairs", """
SELECT conv_id AS sector, turn, length(b) AS before_len, length(text) AS after_len FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL
""")
def before_after_pairs(spark, sf):
    x = patrol.before_after_pairs(table(spark, sf, "conversations"), ["conv_id", "role"], "turn", "text")
    return x.select(F.col("conv_id").alias("sector"), "turn", F.length("before").cast("bigint").alias("before_len"),
                    F.length("after").cast("bigint").alias("after_len"))


# ------------------------------------------------------------------ texts and listings

SECRETS = ["in the", "the", "und die"]


def _redact_sql():
    sql, prev = [], "documents"
    steps = sorted(set(SECRETS), key=lambda v: (-len(v), v))
    sql.append("x0 AS (SELECT doc_id, text AS t, 0::BIGINT AS n_exact FROM documents)")
    for i, s in enumerate(steps, 1):
        sql.append(f"x{i} AS (SELECT doc_id, replace(t, '{s}', '[REDACTED:exact]') AS t, n_exact + CAST((length(t) - length(replace(t, '{s}', ''))) / {len(s)} AS BIGINT) AS n_exact FROM x{i-1})")
    k = len(steps)
    names = []
    for j, (name, rx, group) in enumerate(tx.REDACTION_PATTERNS, k + 1):
        q = rx.replace("'", "''")
        keep = "\\1" if group else ""
        prevs = "".join(f", c{n}" for n in names)
        sql.append(f"x{j} AS (SELECT doc_id, regexp_replace(t, '{q}', '{keep}[REDACTED:{name}]', 'g') AS t, n_exact{prevs}, len(regexp_extract_all(t, '{q}')) AS c{j} FROM x{j-1})")
        names.append(j)
    return ", ".join(sql), k + len(names), names


_RSQL, _LAST, _NAMES = _redact_sql()


@query("redact_text", f"WITH {_RSQL} SELECT doc_id, md5(t) AS text_md5, n_exact, CAST({' + '.join(f'c{n}' for n in _NAMES)} AS BIGINT) AS n_patterns FROM x{_LAST}")
def redact_text(spark, sf):
    x = rd.redact(table(spark, sf, "documents", spread=True).select("doc_id", "text"), "text", SECRETS)
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return x.select("doc_id", F.md5("redacted").alias("text_md5"), x.counts["exact-secret"].alias("n_exact"),
                    (total - x.counts["exact-secret"]).alias("n_patterns"))


@query("redaction_classes", f"""WITH {_RSQL} {' UNION ALL '.join(f"SELECT '{tx.REDACTION_PATTERNS[i][0]}' AS class, CAST(sum(c{n}) AS BIGINT) AS n FROM x{_LAST}" for i, n in enumerate(_NAMES))}
 UNION ALL SELECT 'exact-secret', CAST(sum(n_exact) AS BIGINT) FROM x{_LAST}""")
def redaction_classes(spark, sf):
    x = rd.redact(table(spark, sf, "documents", spread=True).select("doc_id", "text"), "text", SECRETS)
    return rd.class_totals(x)


@query("residual_risk", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no::INTEGER AS line_no, md5(line) AS line_md5 FROM l WHERE regexp_matches(line, '{tx.SUSPICIOUS_LINE}') AND NOT contains(line, '[REDACTED')
""")
def residual_risk(spark, sf):
    x = rd.residual_risk(table(spark, sf, "documents"), ["doc_id"], "text")
    return x.select("doc_id", "line_no", F.md5("line").alias("line_md5"))


@query("url_listing", "SELECT page_id, split_part(url, '/', -1) AS filename FROM pages")
def url_listing(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.upload_name("url").alias("filename"))


MEDIA_SQL = """p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'cache/sampler-' || page_id || '/plugin/node/' ELSE 'W' || page_id || '/' || split_part(url, '/', 3) || '/' END
  || CASE WHEN page_id % 5 = 0 THEN 'note' ELSE CAST(1700000000000000000 + page_id * 1000003 AS VARCHAR) END || CASE page_id % 4 WHEN 0 THEN '-a.FLAC' WHEN 1 THEN '-b.jpg' WHEN 2 THEN '.png' ELSE '.txt' END AS path FROM pages)"""


@query("media_index", f"""
WITH {MEDIA_SQL}, f AS (SELECT path, regexp_extract(path, '[^/]*$') AS fn FROM p), g AS (SELECT *, regexp_extract(fn, '^([0-9]{{16,19}})', 1) AS ns, string_split(path, '/') AS parts FROM f
 WHERE regexp_matches(lower(fn), '\\.(flac|wav|jpg|jpeg|png)$'))
SELECT CAST(ns AS BIGINT) // 1000 AS time_us, CASE WHEN parts[1] = 'cache' THEN '' ELSE parts[1] END AS vsn,
 CASE WHEN parts[1] = 'cache' THEN regexp_replace(parts[2], '-[0-9]+$', '') ELSE parts[2] END AS task, fn AS filename FROM g WHERE ns <> ''
""")
def media_index(spark, sf):
    k = F.col("page_id")
    head = F.when(k % 3 == 0, F.concat(F.lit("cache/sampler-"), k, F.lit("/plugin/node/"))).otherwise(
        F.concat(F.lit("W"), k, F.lit("/"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/")))
    stem = F.when(k % 5 == 0, "note").otherwise((F.lit(1700000000000000000) + k * 1000003).cast("string"))
    ext = F.when(k % 4 == 0, "-a.FLAC").when(k % 4 == 1, "-b.jpg").when(k % 4 == 2, ".png").otherwise(".txt")
    p = table(spark, sf, "pages").select(F.concat(head, stem, ext).alias("path"))
    return media.index_paths(p, "path", "").select("time_us", "vsn", "task", "filename")


@query("feed_inputs", """
SELECT conv_id, min(turn) FILTER (WHERE role = 'assistant') IS NOT NULL AS elevated, CASE WHEN count(*) FILTER (WHERE role = 'assistant') > 0 THEN 'red flag assistant' END AS event,
 min(length(text)) FILTER (WHERE length(text) > 20)::DOUBLE AS nearest_cell_km, count(*) AS strikes FROM conversations GROUP BY 1
""")
def feed_inputs(spark, sf):
    """One conversation stands for one feed response."""
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "assistant", "Red Flag ASSISTANT").otherwise(F.concat("role", F.lit(" note")))
    km = F.when(F.length("text") > 20, F.length("text").cast("double"))
    d = c.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", kind.alias("k")))), lambda s: s["k"]).alias("events"),
        F.collect_list(F.struct(F.struct(km.alias("distanceKM")).alias("ob"),
                                F.lit(None).cast("double").alias("distanceKM"))).alias("response"))
    ev = tx.elevated_event("events")
    return d.select("conv_id", ev.isNotNull().alias("elevated"), ev.alias("event"),
                    feeds.nearest_cell_km("response").alias("nearest_cell_km"), F.size("response").cast("bigint").alias("strikes"))
