"""Streams against their batch twins, readers and writers on small files."""

import json
import random
import os
import struct

import pytest
from pyspark.sql import functions as F

from stormlens import schemas
from stormlens.operators.localize import fuse_strikes
from stormlens.plans import coverage, scan
from stormlens.sources import feeds, media, tables
from stormlens.streaming import clock, frames, fusion, reviews, tiers
from tests.test_science import NODES, storm

HOUR = 3600.0


def inputs(spark, rows):
    base = {"vsn": "W1", "outlook_elevated": False, "nearest_cell_km": None, "regional_strikes": 0, "pressure_drop_hpa_3h": 0.0,
            "gust_ms": 0.0, "local_flash": False, "local_thunder": False, "strikes": []}
    names = [f.split()[0] for f in schemas.TIER_INPUT.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], schemas.TIER_INPUT)


def strike(t, risk=87.0):
    return {"lat": 35.01, "lon": -119.0, "time_epoch": t, "risk": risk}


def tier_path(spark, rows, cfg=tiers.TierConfig()):
    n = spark.createDataFrame([("W1", 35.0, -119.0)], "vsn string, lat double, lon double")
    a = sorted(tiers.tier_batch(inputs(spark, rows), n, cfg).collect(), key=lambda r: r.t)
    return [r.detail.split(":")[0] for r in a if r.kind == "transition"], a


def happy():
    t0 = 1_000_000.0
    return [dict(t=t0, outlook_elevated=True), dict(t=t0 + 600, outlook_elevated=True, nearest_cell_km=60.0),
            dict(t=t0 + 1200, outlook_elevated=True, local_flash=True, strikes=[strike(t0 + 1190)]),
            dict(t=t0 + 1500, local_thunder=True, strikes=[strike(t0 + 1190), strike(t0 + 1490, None)]),
            dict(t=t0 + 1500 + 1801), dict(t=t0 + 1490 + 72 * HOUR), dict(t=t0 + 1491 + 72 * HOUR)]


def test_storm_path(spark):
    path, audit = tier_path(spark, happy())
    assert path == ["IDLE -> OUTLOOK", "OUTLOOK -> APPROACH", "APPROACH -> STORM", "STORM -> AFTERMATH", "AFTERMATH -> IDLE"]
    watch = next(r for r in audit if r.sectors is not None)
    assert len(watch.sectors) == 2 and watch.sectors[0].risk == 87.0 and watch.sectors[1].risk <= 50.0
    assert [r.detail for r in audit if r.kind == "action"][0] == "arm continuous capture"


def test_approach_timeout_and_quiet_exit(spark):
    path, audit = tier_path(spark, [dict(t=0.0, regional_strikes=3), dict(t=4 * HOUR), dict(t=4 * HOUR + 1, outlook_elevated=True)])
    assert path == ["IDLE -> APPROACH", "APPROACH -> OUTLOOK"] and any(r.kind == "guardrail" for r in audit)
    path, _ = tier_path(spark, [dict(t=0.0, pressure_drop_hpa_3h=2.0, gust_ms=10.0), dict(t=60.0, local_flash=True), dict(t=60.0 + 1800)])
    assert path == ["IDLE -> APPROACH", "APPROACH -> STORM", "STORM -> IDLE"]


def test_budget_and_outlook_expiry(spark):
    cfg = tiers.TierConfig(max_continuous_hours_day=1.0)
    rows = [dict(t=0.0, nearest_cell_km=10.0), dict(t=60.0, local_flash=True), dict(t=6.1 * HOUR),
            dict(t=6.2 * HOUR, nearest_cell_km=10.0), dict(t=24.5 * HOUR, nearest_cell_km=10.0)]
    path, audit = tier_path(spark, rows, cfg)
    assert path[:3] == ["IDLE -> APPROACH", "APPROACH -> STORM", "STORM -> IDLE"]
    assert any("NOT arming" in r.detail for r in audit)
    path, _ = tier_path(spark, [dict(t=0.0, outlook_elevated=True), dict(t=24 * HOUR), dict(t=24 * HOUR + 1)])
    assert path == ["IDLE -> OUTLOOK", "OUTLOOK -> IDLE"]


def run(spark, writer, tmp_path):
    writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()


def plain_watch(rows, cfg):
    """(t, kind, detail, tier) of one node's rows, one after the other."""
    tier, since, active, armed, used, day, log, out = "IDLE", 0.0, 0.0, None, 0.0, None, [], []
    names = {n: k for k, n in enumerate(tiers.TIERS)}
    for n, r in enumerate(rows):
        x = {**dict(outlook_elevated=False, nearest_cell_km=None, regional_strikes=0, pressure_drop_hpa_3h=0.0, gust_ms=0.0,
                    local_flash=False, local_thunder=False, strikes=[]), **r}
        t, was, why = x["t"], tier, None
        near = ((x["nearest_cell_km"] is not None and x["nearest_cell_km"] <= cfg.approach_cell_km) or x["regional_strikes"] >= cfg.approach_strikes
                or (x["pressure_drop_hpa_3h"] >= cfg.pressure_drop_hpa_3h and x["gust_ms"] >= cfg.gust_ms))
        here, calm = x["local_flash"] or x["local_thunder"], "OUTLOOK" if x["outlook_elevated"] else "IDLE"
        active = t if near or here else active
        log += [k for k in x["strikes"] if k not in log]
        add = lambda kind, detail: out.append((t, kind, detail, names[tier]))
        off = arm = watch = False
        if tier in ("IDLE", "OUTLOOK"):
            if near:
                to, why, arm = "APPROACH", "storm evidence from idle" if tier == "IDLE" else "approach evidence", True
            elif tier == "IDLE" and x["outlook_elevated"]:
                to, why = "OUTLOOK", "elevated outlook"
            elif tier == "OUTLOOK" and not x["outlook_elevated"] and t - since > cfg.outlook_timeout_hours * 3600:
                to, why = "IDLE", "outlook expired"
        elif tier == "APPROACH":
            if here:
                to, why = "STORM", "first local flash/thunder"
            elif t - active > cfg.approach_timeout_hours * 3600:
                add("guardrail", "approach timed out with no storm")
                to, why, off = calm, "approach timeout auto-revert", True
        elif tier == "STORM":
            overlong, quiet = (t - since) / 3600 >= cfg.max_storm_hours, (t - active) / 60
            if overlong:
                add("guardrail", f"max storm hours ({cfg.max_storm_hours}) reached")
            if overlong or quiet >= cfg.storm_quiet_min:
                off, watch = True, bool(log)
                to, why = ("AFTERMATH", f"storm quiet {quiet:.0f} min; {len(log)} strike(s) logged") if log else (calm, "storm quiet, no localized strikes")
        elif here:
            to, why, arm = "STORM", "renewed local activity", True
        elif t - max(k["time_epoch"] for k in log) > cfg.aftermath_hours * 3600:
            add("action", "stop holdover watch")
            log.clear()
            to, why = calm, "aftermath complete"
        if off and armed is not None:
            used, armed = used + t - armed, None
            add("action", "revert to baseline sampling")
        if why:
            tier, since = to, t
            add("transition", f"{was} -> {to}: {why}")
            if (was, to) == ("APPROACH", "STORM"):
                add("notify", "storm-mode entered")
            if arm and armed is None:
                if day != int(t // 86400):
                    day, used = int(t // 86400), 0.0
                if used < cfg.max_continuous_hours_day * 3600:
                    armed = t
                    add("action", "arm continuous capture")
                else:
                    add("guardrail", "daily continuous-capture budget exhausted; NOT arming")
            if watch:
                near_ones = [k for k in log if 0 <= t - k["time_epoch"] <= 72 * HOUR]
                add("action", f"start holdover watch: {len(near_ones)} sector(s), 72 h")
        if why or n % cfg.heartbeat_every == 0:
            out.append((t, "poll", tier, names[tier]))
    return out


def wild_rows(seed, n):
    """Rows of changing density, from minutes to days apart, with strikes that repeat and come late."""
    rng, t, out, mode = random.Random(seed), 1_000_000.0, [], 0
    for _ in range(n):
        if rng.random() < 0.05:
            mode = rng.randrange(4)
        t += rng.uniform(1, [120, 900, 9000, 30 * HOUR][mode])
        r = dict(t=t, outlook_elevated=rng.random() < 0.3)
        if rng.random() < 0.2:
            r["nearest_cell_km"] = rng.uniform(0, 400)
        if rng.random() < 0.1:
            r["local_flash"] = True
        if rng.random() < 0.1:
            r["regional_strikes"] = rng.randrange(5)
        if rng.random() < 0.06:
            r["strikes"] = [strike(round(t - rng.uniform(0, 50 * HOUR), -3)) for _ in range(rng.randint(1, 2))]
        out.append(r)
    return out


@pytest.mark.parametrize("block_s", [3600.0, 86400.0])
def test_tier_maps_equal_the_plain_machine(spark, block_s):
    cfg = tiers.TierConfig(max_continuous_hours_day=2.0)
    nodes = {f"N{k}": wild_rows(k, 300) for k in range(12)}
    df = inputs(spark, [dict(vsn=v, **r) for v, rs in nodes.items() for r in rs])
    at = spark.createDataFrame([(v, 35.0, -119.0) for v in nodes], "vsn string, lat double, lon double")
    got = {}
    for r in tiers.tier_batch(df.repartition(7), at, cfg, block_s=block_s).collect():
        got.setdefault(r.vsn, []).append((r.t, r.kind, r.detail, r.tier))
    for v, rs in nodes.items():
        assert sorted(got[v]) == sorted(plain_watch(rs, cfg))
    assert {"guardrail", "action", "transition", "poll", "notify"} <= {k for rs in got.values() for _, k, *_ in rs}
    assert tiers.tier_batch(df.limit(0), at, cfg).count() == 0


def test_tier_stream_equals_batch_on_shuffled_micro_batches(spark, tmp_path):
    df = inputs(spark, happy() + [dict(vsn="W2", **r) for r in wild_rows(3, 120)])
    rows = sorted(df.collect(), key=lambda r: r.t)
    random.Random(2).shuffle(rows)
    for i in range(0, len(rows), 50):
        spark.createDataFrame(rows[i:i + 50], df.schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    src = spark.readStream.schema(schemas.TIER_INPUT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    clock.open_clock(spark, str(tmp_path / "clock"), "t")
    at = spark.createDataFrame([(v, 35.0, -119.0) for v in ("W1", "W2")], "vsn string, lat double, lon double")
    # rows come in any order, so nothing may be late
    out = tiers.tier_stream(clock.with_clock(src, str(tmp_path / "clock"), "t", "none"), at, lateness="5000 days", stretch_s=86400.0)
    clock.run_to_end(spark, str(tmp_path / "clock"), lambda: out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(), "t")
    key = lambda d: sorted((r.vsn, r.t, r.kind, r.detail, r.tier, str(r.sectors)) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(tiers.tier_batch(df, at))


def test_fusion_stream_equals_batch(spark, tmp_path):
    strikes = [(35.02, -118.97, 1000.0), (35.06, -119.05, 1400.0), (35.0, -119.0, 1900.0)]
    ev = storm(NODES, strikes) + [("thunder", "W1", 1033.0, None), ("tick", "W1", 9000.0, None)]
    schema = "type string, vsn string, time_epoch double, implied_range_km double"
    lines = [json.dumps(dict(zip(("type", "vsn", "time_epoch", "implied_range_km"), e))) for e in sorted(ev, key=lambda e: e[2])]
    (tmp_path / "in").mkdir()
    for i in range(0, len(lines), 8):
        f = tmp_path / f"in/{i:04d}.json"
        f.write_text("\n\n".join(lines[i:i + 8]) + "\n")
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))   # the source reads files by their time
    nodes = spark.createDataFrame([(v, *p) for v, p in NODES.items()], "vsn string, lat double, lon double")
    got = []
    clock.open_clock(spark, str(tmp_path / "clock"))
    src = clock.with_clock(feeds.event_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger=2).select(*schema_names(schema)), str(tmp_path / "clock"))
    clock.run_to_end(spark, str(tmp_path / "clock"), lambda: fusion.run_fusion(
        src, nodes, lambda s, i: got.extend(s.collect()), str(tmp_path / "ck"), {"availableNow": True}))
    want = fuse_strikes(spark.createDataFrame(ev, schema), nodes).collect()
    key = lambda rows: sorted((round(r.t_strike, 3), r.n_nodes, r.quality, round(r.lat, 4), round(r.lon, 4)) for r in rows)
    assert key(got) == key(want) and len(want) == 3


def schema_names(ddl):
    return [c.split()[0] for c in ddl.split(", ")]


def test_incidents_of_a_disordered_stream_equal_plain_pairing_to_the_last(spark, tmp_path):
    rng = random.Random(1)
    ev = [("r%d" % (k % 2), "flash", None, rng.uniform(0, 900), None) for k in range(150)]
    ev += [("r%d" % (k % 2), "thunder", "v%d" % rng.randint(0, 4), rng.uniform(0, 1000), rng.choice([None, 2.5])) for k in range(150)]
    ev.sort(key=lambda e: e[3] + rng.uniform(0, 20))
    schema = "region string, type string, vsn string, time_epoch double, implied_range_km double"
    for k in range(3):
        spark.createDataFrame(ev[k * 100:(k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    clock.open_clock(spark, str(tmp_path / "clock"))
    src = clock.with_clock(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "clock"))
    x = fusion.incident_stream(src, region="region")
    clock.run_to_end(spark, str(tmp_path / "clock"), lambda: x.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    c, want = fusion.sound_speed_ms(20.0), {}
    for r in ("r0", "r1"):
        last = None
        for f in sorted(e[3] for e in ev if e[:2] == (r, "flash")):
            if last is not None and f - last <= fusion.COINCIDENCE_S:
                continue
            last = f
            for reg, kind, v, t, km in ev:
                if (reg, kind) == (r, "thunder") and fusion.PAIR_MIN_S <= t - f <= fusion.PAIR_MAX_S:
                    want.setdefault((r, f, v), set()).add(round(km if km is not None else (t - f) * c / 1000, 3))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted((*k, sorted(v)) for k, v in want.items())


def test_frame_stream_equals_batch(spark, tmp_path):
    rows = [("W1", 1200 + i * 0.5, 95.0 if i in (100, 250) else 12.0 + (i * 7 % 5) / 10) for i in range(400)] + [("W2", 5000.0, 1.0)]
    df = spark.createDataFrame(rows, schemas.FRAMES)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen, counted = [], []
    clock.open_clock(spark, str(tmp_path / "clock"), "t")
    src = clock.with_clock(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "clock"), "t", "kind")

    def sink(s, c, i):
        seen.extend((r.vsn, r.t) for r in s.collect())
        counted.extend(map(tuple, c.collect()))
    clock.run_to_end(spark, str(tmp_path / "clock"), lambda: frames.run_frames(src, sink, str(tmp_path / "ck"), {"availableNow": True}), "t")
    batch = frames.frame_batches(df)
    assert sorted(seen) == sorted((r.vsn, r.t) for r in frames.batch_spikes(batch).collect()) == [("W1", 1250.0), ("W1", 1325.0)]
    assert sorted(counted) == sorted(map(tuple, frames.batch_counters(batch).collect())) and ("W2", 4980.0, 1) in counted


def test_review_stream_and_dispatch(spark, tmp_path):
    rows = [("s1", "confirm_smoke", "u"), ("s2", "reject_false", "u"), ("s3", "keep_watching", "v")]
    df = spark.createDataFrame(rows, "strike_id string, action string, reviewer string").withColumn("time", F.current_timestamp()).withColumn("comment", F.lit(""))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    reviews.run_reviews(src, str(tmp_path / "dec"), str(tmp_path / "dir"), str(tmp_path / "ck"), {"availableNow": True}).awaitTermination()
    assert spark.read.json(str(tmp_path / "dec")).count() == 3 and spark.read.json(str(tmp_path / "dir")).count() == 2

    class Sink:
        calls, errors = {}, []

        def __getattr__(self, name):
            def call(rows):
                if name == "revert":
                    raise ValueError("down")
                self.calls[name] = rows.count()
            return call
    sink = Sink()
    reviews.dispatch(sink, sink.errors.append)(tiers.tier_batch(inputs(spark, happy())), 0)
    assert sink.calls["arm"] == 1 and sink.calls["start_watch"] == 1 and len(sink.errors) == 1


# ------------------------------------------------------------------ readers and writers

def test_manifest(spark, tmp_path):
    def node(v, caps, phase="Deployed", lat="35.1", name="Microphone X"):
        return {"vsn": v, "phase": phase, "gps_lat": lat, "gps_lon": "-119.2", "address": "Bear  Mt\nRoad",
                "sensors": [{"name": name, "hardware": {"hw_model": "M1", "capabilities": caps}}]}
    f = tmp_path / "m.json"
    f.write_text(json.dumps([node("W2", ["Microphone"]), node("V1", ["Camera"], lat=None, name="Top Camera"), node("X1", ["Camera"]),
                             node("W3", ["GPS"])]))
    got = feeds.node_manifest(spark, str(f)).collect()
    assert [(r.vsn, r.mic, r.cam, r.lat) for r in got] == [("V1", False, True, None), ("W2", True, False, 35.1)]
    by_name = feeds.nodes_by_sensor_name(spark, str(f), (35.0, 36.0, -120.0, -119.0), ["bear mt road"]).collect()
    assert {r.vsn for r in by_name} == {"W2", "X1", "W3"} and feeds.deployed_listening(feeds.node_manifest(spark, str(f)), True).count() == 1


def test_feeds(spark, tmp_path):
    page = {"features": [{"attributes": {"OBJECTID": 7, "FireDiscoveryDateTime": 5000, "FireCause": "Natural", "IncidentSize": 2.5},
                          "geometry": {"x": -119.0, "y": 35.0}}]}
    (tmp_path / "fire.json").write_text(json.dumps(page))
    r = feeds.fire_feed(spark, str(tmp_path / "fire.json"), (34, 36, -120, -118), 1000, 9000).first()
    assert r.OBJECTID == 7 and r.geom_lat == 35.0
    truth = {"node": {"vsn": "W1", "lat": 1.0, "lon": 2.0}, "glm_flashes": [{"time": "2025-07-02T22:00:00Z", "lat": 1.0, "lon": 2.0, "dist_node_km": 31.0}],
             "thunder_arrivals": [{"time": "2025-07-02T22:00:10.5Z", "range_km": 3.0, "snr": 2.0}]}
    (tmp_path / "truth.json").write_text(json.dumps(truth))
    f, a = feeds.ground_truth(spark, str(tmp_path / "truth.json"))
    assert f.first().epoch == 1751493600.0 and a.first().epoch == 1751493610.5 and feeds.near_anchors(f).count() == 0
    body = json.dumps({"response": [{"ob": {"timestamp": 5}}, {"timestamp": 3}, {"ob": {}}]})
    e = feeds.lightning_epochs(spark.createDataFrame([(body,)], "b string"), "b").collect()
    assert sorted(r.epoch for r in e) == [3.0, 5.0]
    g = spark.createDataFrame([(1.0, 2.0, 0.5, "seconds since 2025-07-02 22:00:00.000", None, None, 18)],
                              "lat double, lon double, offset_s double, units string, energy double, quality int, sat int")
    r = feeds.flash_granules(g).first()
    assert r.epoch == 1751493600.5 and r.quality == 0 and r.flash_energy_j != r.flash_energy_j


def bmp(path, b, g, r, side=8):
    row = bytes([b, g, r]) * side
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(row) * side, 0, 0, 54)
                     + struct.pack("<IiiHHIIiiII", 40, side, side, 1, 24, 0, 0, 0, 0, 0, 0) + row * side)


def test_media_and_images(spark, tmp_path):
    for p in ("W1/audio/1700000000000000000-a.flac", "cache/top-12/plug/n/1700000001000000000-b.JPG", "W1/audio/readme.txt", "W1/audio/x.wav"):
        (tmp_path / "m" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / p).write_bytes(b"0")
    got = sorted((r.vsn, r.task, r.time_us) for r in media.media_index(spark, str(tmp_path / "m")).collect())
    assert got == [("", "top", 1700000001000000), ("W1", "audio", 1700000000000000)]
    bmp(tmp_path / "f/123.5.bmp", 10, 20, 30)
    r = media.frame_series(spark, str(tmp_path / "f")).first()
    assert r.luma == pytest.approx(0.114 * 10 + 0.587 * 20 + 0.299 * 30) and (r.mean_b, r.min_g, r.max_r) == (10, 20, 30)
    assert media.frame_index(spark, str(tmp_path / "f"), "top").first().time_epoch == 123.5
    c = spark.createDataFrame([([[1.0, 3.0], [3.0, 5.0]], 2)], "ch array<array<double>>, sr int")
    assert media.clip_table(c, "ch", "sr").first().samples == [2.0, 4.0]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(16, "2024-01-01", 1), (16, "2024-01-02", 2)], "sat int, date string, n int")
    p = str(tmp_path / "shards")
    tables.write_shards(df, p, ["sat", "date"])
    tables.write_shards(df.where("n = 2").withColumn("n", F.lit(9)), p, ["sat", "date"])
    assert sorted(r.n for r in spark.read.parquet(p).collect()) == [1, 9]
    tables.mark_done(df.where("n = 1").select("sat", "date"), str(tmp_path / "done"))
    assert [r.date for r in scan.to_do(df, spark.read.parquet(str(tmp_path / "done")), ["sat", "date"]).collect()] == ["2024-01-02"]
    tables.write_table(df, str(tmp_path), "scan_plan")
    assert tables.read_table(spark, str(tmp_path), "scan_plan").count() == 2
    s = spark.createDataFrame([(1.0, "fix", {"W1": 3.0})], "t_strike double, quality string, ranges map<string,double>")
    n = spark.createDataFrame([("W1", 35.0, -119.0)], "vsn string, lat double, lon double")
    tables.write_documents(tables.strike_documents(s, n), str(tmp_path / "docs"), 4)
    doc = json.loads(spark.read.text(str(tmp_path / "docs/batch=4")).first().value)
    assert doc == {"t_strike": 1.0, "quality": "fix", "ranges": {"W1": 3.0}, "nodes": [{"vsn": "W1", "lat": 35.0, "lon": -119.0}]}


def test_explosion_guard(spark):
    day = 86_400_000_000
    fine = [("W1", "a", day * d, 5) for d in (1, 2)]
    blown = [("W1", "b", day * 2 + i, 1) for i in range(2000)]
    raw = spark.createDataFrame([("W1", "b", day + 5)] * 3 + [("W1", "a", day)], "vsn string, task string, t bigint")
    b = spark.createDataFrame(fine + blown, "vsn string, task string, t bigint, value bigint")
    got = sorted((r.task, r.day, r.n_uploads) for r in coverage.daily_with_guard(b, raw).collect())
    assert got == [("a", 0, 5), ("a", 1, 5), ("b", 1, 3)]


class Kept:
    """State of one key, held in memory, that counts what it is asked."""

    asked = 0

    def __init__(self):
        self.rows = {}

    def _ask(self):
        Kept.asked += 1
        return self.rows

    def exists(self):
        return () in self._ask()

    def get(self):
        return self._ask()[()]

    def update(self, value):
        self._ask()[()] = value

    def containsKey(self, key):
        return key in self._ask()

    def getValue(self, key):
        return self._ask()[key]

    def updateValue(self, key, value):
        self._ask()[key] = value

    def removeKey(self, key):
        del self._ask()[key]


class Expired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_nodes_of_a_share_are_settled_together(spark):
    """A stretch is one timer and a few reads and writes of state however many nodes it has, and gives what the batch job gives."""
    cfg = tiers.TierConfig(max_continuous_hours_day=2.0)
    df = inputs(spark, [dict(vsn=f"N{k}", **r) for k in range(40) for r in wild_rows(100 + k, 60)])
    at = spark.createDataFrame([(f"N{k}", 35.0, -119.0) for k in range(39)], "vsn string, lat double, lon double")
    rows = tiers.prepared(df, cfg).join(at.select("vsn", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")), "vsn", "left").withColumn(
        "ts", F.timestamp_seconds("t")).withColumn("share", F.lit(0)).toPandas().sample(frac=1.0, random_state=1)
    timers, states = [], []

    class Handle:
        def getMapState(self, *_):
            states.append(Kept())
            return states[-1]
        getValueState = getMapState

        def registerTimer(self, ms):
            timers.append(ms)
    p = tiers.TierProcessor(cfg, 86400.0, "string")
    p.init(Handle())
    Kept.asked = 0
    for k in range(0, len(rows), 500):
        assert not list(p.handleInputRows((0,), iter([rows.iloc[k:k + 500]]), None))
    parts = sum(n for (n,) in p.arrived.rows.values())
    assert len(timers) == len(set(timers)) == rows["t"].floordiv(86400).nunique() and Kept.asked <= 4 * parts
    got = [r for ms in sorted(timers) for out in p.handleExpiredTimer((0,), None, Expired(ms)) for r in out.itertuples(index=False)]
    want = tiers.tier_batch(df, at, cfg).collect()
    key = lambda rs: sorted(str((r.vsn, r.t, r.kind, r.detail, r.tier, None if r.sectors is None else [dict(s.asDict() if hasattr(s, "asDict") else s) for s in r.sectors])) for r in rs)
    assert key(got) == key(want)
    assert any(r.sectors is not None and len(r.sectors) > 0 for r in want) and any("stop holdover" in r.detail for r in want)
    struck = int((rows["strikes"].map(len) > 0).sum())
    watches = sum(r.detail.startswith("start holdover") for r in want)
    assert Kept.asked <= 8 * parts + 3 * struck + 60 * watches
