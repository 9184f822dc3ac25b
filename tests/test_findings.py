"""Cases that once failed: small tables written as the given ones, queries beside their SQL."""

import os
from datetime import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import DATA
from tools.check_oracle import TABLES, rows_of


def beside_sql(spark, folder, name, **changed):
    """Rows of a query and of its SQL over the smallest tables, `changed` ones (name=SELECT) in their place."""
    con = duckdb.connect()
    for t in TABLES:
        if t in changed:
            con.execute(f"COPY ({changed[t].format(d=DATA)}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{DATA}/{t}.parquet", f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    return got, rows_of([c[0] for c in cur.description], cur.fetchall())


def test_strike_documents_nodes_of_one_instant(spark, tmp_path):
    """Several nodes that ranged a strike at one instant are all in its document."""
    same = "SELECT * REPLACE (TIMESTAMP '2024-01-02 03:04:05' + INTERVAL (event_id % 40) SECOND AS ts, user_id % 30 AS user_id) FROM '{d}/events.parquet'"
    got, want = beside_sql(spark, tmp_path, "strike_documents", events=same)
    assert got == want and max(int(r[1]) for r in want[0]) > 1


def test_multilaterate_between_two_steps(spark, tmp_path):
    """Fires exactly between two steps of ten metres are rounded as their position is."""
    edge = "SELECT * FROM '/root/testdata/sf0.1/customer.parquet' WHERE c_custkey * 37 % 997 IN (250, 750)"
    orders = "SELECT * FROM '/root/testdata/sf0.1/orders.parquet' WHERE o_custkey * 37 % 997 IN (250, 750)"
    got, want = beside_sql(spark, tmp_path, "multilaterate", customer=edge, orders=orders, supplier="SELECT * FROM '/root/testdata/sf0.1/supplier.parquet'")
    assert got == want and len(want[0]) > 10


def test_copies_in_cells_are_not_broadcast(spark):
    """The side that is copied into cells or buckets is never gathered in the driver, however small it looks."""
    from stormlens.operators.joins import interval_join, radius_join
    p = spark.createDataFrame([(1.0, 2.0, 5)], "lat double, lon double, t long")
    t = spark.createDataFrame([(1.0, 2.0, 0, 9)], "t_lat double, t_lon double, a long, z long")
    for x in (radius_join(p, t, 10.0, time=("t", "a", "z", 2)), interval_join(p, t, [], "t", "a", "z", bucket=2)):
        assert x.count() == 1
        assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()


def test_storm_hits_are_not_shuffled(spark):
    """Hits are counted in the task that finds them; of equal first flashes the one without a satellite, then the smaller counts."""
    from stormlens.plans import census
    day, rows = 20000, []  # a day in October
    t0 = (day - 60) * 86_400_000_000
    for i, sat in enumerate([18, 16, 17, None, 16]):
        rows.append((t0 + 3_600_000_000 * (i // 3), 35.0, -119.0 + 0.01 * i, sat))
    rows.append((day * 86_400_000_000, 35.0, -119.0, 16))
    f = spark.createDataFrame(rows, "t long, lat double, lon double, sat int")
    n = spark.createDataFrame([(1, 35.0, -119.0, 0), (2, 35.05, -119.0, 0), (3, 36.0, -119.0, 0)], "vsn long, n_lat double, n_lon double, first_day long")
    out = census.storm_days(census.storm_hits(f, n, 10.0), with_median=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 2 and "SortAggregate" not in plan and "ObjectHash" not in plan
    assert sorted((r.vsn, r.day, r.n_flashes, r.sat, r.active_hours) for r in out.collect()) == [(1, day - 60, 5, 16, 2), (2, day - 60, 5, 16, 2)]
    tie = f.withColumn("t", f.t - f.t % 86_400_000_000)
    got = census.storm_days(census.storm_hits(tie, n, 10.0), with_median=False).where("vsn = 1").collect()
    assert [r.sat for r in got] == [None]


def test_qualifying_pairs_are_not_shuffled(spark):
    """Pairs are counted per node where they arise: no row of a pair is exchanged by its fire."""
    df = entry.queries()["node_qualification"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "HashAggregate(keys=[vsn" in x and "fire_id" in x.split("]")[0]]


def test_groups_stay_whole_after_a_join_that_is_broadcast_at_run_time(spark):
    """the shuffle by block fell to the join before it, whose partitions were then read map task by map task."""
    from stormlens.operators.blocks import map_sorted_groups
    told = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "5k"}
    was = {k: spark.conf.get(k, None) for k in told}

    def sizes(pdf, cuts):
        return pdf.iloc[[0, *cuts]][["k"]].assign(n=[len(p) for p in np.split(pdf, cuts)])
    try:
        for k, v in told.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 40000, 1, 8).select((F.col("id") % 20).alias("k"), F.xxhash64("id").alias("t"))
        few = spark.range(20).select(F.col("id").alias("k"), F.lit(1).alias("w"))
        got = map_sorted_groups(rows.join(few, "k"), ["k"], ["t"], sizes, "k long, n long").collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(k, 2000) for k in range(20)]


def test_nearest_rows_are_not_shuffled_by_point(spark):
    """F10, F27 to F30: a row was shuffled for each point and cell it met at each level."""
    from stormlens.operators.areas import nearest_k
    at = [(F.col("id") * 37 % 997 / 1000 + 35).alias, (F.col("id") * 91 % 1499 / 1000 - 120).alias]
    left = spark.range(3000).select(F.col("id").alias("p"), at[0]("lat"), at[1]("lon"))
    right = spark.range(1000).select(F.col("id").alias("r"), at[0]("t_lat"), at[1]("t_lon"))
    x = nearest_k(left, right, "p", "r", 3)
    assert "hashpartitioning(p#" not in x._jdf.queryExecution().executedPlan().toString()
    assert x.where("rank = 1 and p < 1000 and p = r").count() == 1000


def test_frames_of_many_nodes_share_state_keys():
    """each node and window was a key of its own, called on its own."""
    from stormlens.streaming.frames import OpenWindow

    class Handle:
        def __init__(self):
            self.rows, self.timers = [], []

        def getListState(self, name, schema):
            return self

        def registerTimer(self, at):
            self.timers.append(at)

        def exists(self):
            return bool(self.rows)

        def appendList(self, rows):
            self.rows += rows

        def get(self):
            return iter(self.rows)

        def clear(self):
            self.rows = []
    held, job = Handle(), OpenWindow(60.0, "bigint")
    job.init(held)
    frames = pd.DataFrame({"vsn": np.arange(25000) % 700, "t": 120.0 + np.arange(25000) % 60, "luma": 1.5})
    list(job.handleInputRows((2, 5), iter([frames]), None))
    out = list(job.handleExpiredTimer((2, 5), None, None))
    got = pd.concat(out, ignore_index=True)
    assert held.timers == [180_000] and not held.rows and len(out) > 1 and set(got["batch_start"]) == {120.0}
    pd.testing.assert_frame_equal(got[["vsn", "t", "luma"]], frames, check_dtype=False)


def test_a_visit_schedule_is_laid_out_once_a_node(spark, tmp_path):
    """every sector was written out as 217 visits before they were counted."""
    from workload import spatial
    seen, real = [], spatial.revisit_schedule
    spatial.revisit_schedule = lambda x, **kw: (seen.append(x), real(x, **kw))[1]
    try:
        one_day = "SELECT * REPLACE (TIMESTAMP '1998-08-01 00:00:00' AS o_orderdate) FROM '{d}/orders.parquet'"
        got, want = beside_sql(spark, tmp_path, "revisit_schedule", orders=one_day)
    finally:
        spatial.revisit_schedule = real
    assert got == want and seen[0].count() == len(want[0])


def test_active_days_are_counted_without_rows_of_days(spark):
    """the days of a month were kept as rows in a second aggregate; a day given twice counts once."""
    from stormlens.plans.coverage import monthly
    rows = [("a", "t", "audio", d, 2) for d in (0, 0, 30, 31, 58, 59)] + [("b", "t", "audio", d, 1) for d in range(19723, 19754)]
    x = monthly(spark.createDataFrame(rows, "vsn string, task string, bucket string, day long, n_uploads long"))
    got = sorted((r.vsn, r.month, r.n_uploads, r.active_days) for r in x.collect())
    assert got == [("a", "1970-01", 6, 2), ("a", "1970-02", 4, 2), ("a", "1970-03", 2, 1), ("b", "2024-01", 31, 31)]
    assert x._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("planar", [False, True])
def test_radius_totals_equal_the_pairs(spark, planar):
    """Totals of points in reach are those of the listed pairs, at the date line, near a pole, for copies and missing places too."""
    from stormlens.operators.joins import radius_join
    from stormlens.operators.reach import radius_totals
    rng = np.random.default_rng(1)
    at = lambda n: [(int(k), "ab"[k % 2], float(a), float(b)) for k, a, b in zip(range(n), rng.uniform(60, 62, n), rng.uniform(-120, -117, n))]
    odd = [(900, "a", 0.1, 179.9), (901, "a", 0.0, -179.9), (902, "b", 89.9, 10.0), (903, "b", 89.8, -150.0), (904, "a", None, 1.0)]
    p = spark.createDataFrame(at(300) * 2 + odd, "p long, g string, lat double, lon double")
    t = spark.createDataFrame(at(80) + odd, "v long, g string, t_lat double, t_lon double").withColumn("r", F.lit(5.0) + F.col("v") % 40)
    listed = radius_join(p, t, "r", on=["g"], cell_km=9.0, planar=planar).groupBy("g", "v").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dist_km").alias("s"), F.min("dist_km").alias("a"), F.max("dist_km").alias("b"))
    want = {(r.g, r.v): (r.n, round(r.s, 6), round(r.a, 6), round(r.b, 6)) for r in listed.collect()}
    got = radius_totals(p, t, ["v"], "r", on=["g"], cell_km=9.0, parts=3, planar=planar).collect()
    assert {(r.g, r.v): (r.n, round(r.sum_km, 6), round(r.min_km, 6), round(r.max_km, 6)) for r in got} == want and len(want) > 60


def test_radius_queries_do_not_list_pairs(spark):
    """No row of a pair is made: rows that are joined, or leave Python, are far fewer than the pairs."""
    from stormlens.operators.reach import radius_totals
    p = spark.range(3000).select((F.lit(10.0) + F.col("id") / 1e5).alias("lat"), F.lit(20.0).alias("lon"))
    t = spark.range(300).select("id", (F.lit(10.0) + F.col("id") / 1e4).alias("t_lat"), F.lit(20.0).alias("t_lon"))
    x = radius_totals(p, t, ["id"], 30.0, cell_km=30.0)
    assert x.agg(F.sum("n")).first()[0] == 900_000
    for name in ("radius_pairs", "scan_hits", "fires_near_estimate", "radius_join_own_radius"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "__ci" not in plan


def test_flash_thunder_pairs_are_not_shuffled(spark):
    """Candidates are whole where they arise; windows over bucket edges, repeated and missing values, and times before the epoch."""
    from stormlens.operators.pairing import flash_thunder_candidates
    rng = np.random.default_rng(3)
    flashes = [(g, float(t)) for g in "ab" for t in rng.integers(-300, 300, 40)] + [("a", 90.0), ("a", 90.0), ("b", 0.0)]
    thunder = [("ab"[k % 2], int(v), float(t), None if k % 3 else 0.5) for k, (v, t) in enumerate(zip(rng.integers(0, 5, 300), rng.uniform(-300, 400, 300)))]
    thunder += [("a", 9, 90.9, None), ("a", 9, 180.0, None), ("b", 9, 90.0, None), ("b", 9, 90.001, None)]
    x = flash_thunder_candidates(spark.createDataFrame(flashes, "g string, st double"),
                                 spark.createDataFrame(thunder, "g string, vsn long, t double, implied_range_km double"), "st", on=["g"])
    want: dict = {}
    from stormlens.functions.physics import sound_speed_ms
    for g, st in set(flashes):
        for h, v, t, km in thunder:
            if g == h and st + 0.9 <= t <= st + 90.0:
                want.setdefault((g, st, v), set()).add(round(km if km is not None else (t - st) * sound_speed_ms(20.0) / 1000, 3))
    got = x.collect()
    assert {(r.g, r.st, r.vsn): r.ranges for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
    after_join = x._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    assert "Exchange" not in after_join and "Aggregate" not in after_join


def test_families_of_maps_are_python_objects_a_few_at_a_time():
    """However many rows a batch holds, only a few of them are taken out of Arrow at once, in order."""
    import pyarrow as pa
    from stormlens.streaming import tiers
    batch = pa.RecordBatch.from_pydict({"vsn": [f"v{k}" for k in range(1000)], "parent": list(range(1000))})
    sizes, seen = [], []
    for kind, rows in tiers._few(iter([batch, batch.slice(0, 0)])):
        sizes.append(len(rows))
        seen += [r["parent"] for r in rows]
        assert kind == pa.string()
    assert max(sizes) <= tiers.FEW and seen == list(range(1000))


def test_coverage_pivot_counts_raw_rows_at_once(spark):
    """One aggregation, by node and day, equal to the pivot of the coverage; a day in the future is left out by both."""
    from stormlens.plans import coverage
    from workload import base
    plan = entry.queries()["coverage_pivot"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    up = base.uploads(spark, DATA)
    limit = int(up.agg(F.max("t")).first()[0] // base.DAY) - 300
    a, b = coverage.pivot_uploads(up, as_of_day=limit), coverage.pivot_days(coverage.coverage(up, as_of_day=limit))
    assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect()) and a.count() < up.count()


def test_multilaterate_on_the_line_of_its_anchors():
    """A position on the line of its anchors is found to a micrometre, one beside it stays beside it."""
    from stormlens.operators import localize
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 2 * np.pi, 400)
    u, v = np.stack([np.cos(a), np.sin(a)], 1), np.stack([-np.sin(a), np.cos(a)], 1)
    at = rng.uniform(-60_000, 60_000, (400, 2))
    anchors = at[:, None] + rng.uniform(-8_000, 8_000, (400, 6))[..., None] * u[:, None]
    for aside in (0.0, 100.0):
        true = at + aside * v
        r = np.hypot(*np.moveaxis(anchors - true[:, None], -1, 0))
        s = localize.solve_batch(anchors, r, np.full((400, 6), 200.0))
        every = [np.array([[x, y], *alt]) for x, y, alt in zip(s["x"], s["y"], s["alternates"])]
        assert max(np.hypot(*(e - t).T).min() for e, t in zip(every, true)) < 1e-6


def test_fire_flashes_leave_as_sessions_not_pairs(spark):
    """Sessions, nearest and counts of dense windows equal a plain version; no (fire, flash) pair is joined, also for repeated fires."""
    from stormlens.functions.timecols import DAY_US, HOUR_US
    from stormlens.operators.gathered import _haversine_km
    from stormlens.plans.events import fire_lightning
    rng = np.random.default_rng(8)
    fl = pd.DataFrame({"t": rng.integers(0, 60, 4000) * DAY_US + rng.integers(0, 4, 4000) * 5 * HOUR_US,
                       "lat": 35 + rng.integers(0, 90, 4000) / 100, "lon": -120 + rng.integers(0, 120, 4000) / 100})
    fi = pd.DataFrame({"fire_id": np.arange(60), "f_lat": 35 + rng.integers(0, 90, 60) / 100, "f_lon": -120 + rng.integers(0, 120, 60) / 100,
                       "discovery": rng.integers(0, 75, 60) * DAY_US})
    fi = pd.concat([fi, fi.iloc[:3].assign(f_lat=35.4)], ignore_index=True)  # ids that occur twice
    x = fire_lightning(spark.createDataFrame(fl), spark.createDataFrame(fi))
    assert "__tb" not in x._jdf.queryExecution().optimizedPlan().toString()
    got = {r.fire_id: r for r in x.collect()}
    for fire, rows in fi.groupby("fire_id"):
        t, km = [], []
        for r in rows.itertuples():
            d = _haversine_km(r.f_lat, r.f_lon, fl.lat.to_numpy(), fl.lon.to_numpy())
            m = (d <= 30.0) & fl.t.between(r.discovery - 10 * DAY_US, r.discovery).to_numpy()
            t += fl.t[m].tolist()
            km += d[m].tolist()
        g = got[fire]
        assert g.n_flashes == len(t)
        if t:
            when = np.sort(t)
            cuts = np.append(0, np.flatnonzero(np.diff(when) > 6 * HOUR_US) + 1)
            assert (g.n_episodes, g.first_t, g.last_end, g.last_n) == (len(cuts), when[0], when[-1], len(when) - cuts[-1])
            assert (g.nearest_km, g.nearest_t) == (pytest.approx(min(km), abs=1e-9), min(z for z, k in zip(t, km) if k < min(km) + 1e-9))
        else:
            assert g.n_episodes == 0 and g.nearest_km is None


def test_storm_days_leave_as_days_not_hits(spark):
    """The census of gathered flashes equals that of hits as rows, with the median, ties of first flashes and flashes without satellite."""
    from stormlens.functions.timecols import DAY_US, HOUR_US
    from stormlens.plans import census
    rng = np.random.default_rng(3)
    f = pd.DataFrame({"t": (9_990 + rng.integers(0, 120, 6000)) * DAY_US + rng.integers(0, 24, 6000) * HOUR_US, "lat": 35 + rng.integers(0, 30, 6000) / 100,
                      "lon": -120 + rng.integers(0, 40, 6000) / 100, "sat": rng.integers(15, 19, 6000)})
    f = spark.createDataFrame(f).withColumn("sat", F.expr("nullif(sat, 15)"))
    n = pd.DataFrame({"vsn": np.arange(40), "n_lat": 35 + rng.integers(0, 30, 40) / 100, "n_lon": -120 + rng.integers(0, 40, 40) / 100,
                      "first_day": rng.integers(9_970, 10_090, 40)})
    n = spark.createDataFrame(n)
    x = census.storm_census(f, n, 10.0)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    want = census.storm_days(census.storm_hits(f, n, 10.0)).select(x.columns)
    key = lambda r: (r.vsn, r.day)
    a, b = sorted(x.collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == len(b) > 500
    for g, w in zip(a, b):
        assert {k: v for k, v in g.asDict().items() if not isinstance(v, float)} == {k: v for k, v in w.asDict().items() if not isinstance(v, float)}
        assert (g.nearest_km, g.median_km, g.storm_hours) == pytest.approx((w.nearest_km, w.median_km, w.storm_hours), abs=1e-9)


def test_nearest_fire_of_a_window_without_pairs(spark):
    """The nearest fire in each window and radius, of equally near ones the least id; no pair is joined."""
    from stormlens.functions.timecols import DAY_US
    from stormlens.operators.gathered import _haversine_km, radius_nearest
    rng = np.random.default_rng(9)
    fires = pd.DataFrame({"fire_id": np.arange(900), "discovery": rng.integers(0, 90, 900) * DAY_US, "f_lat": 35 + rng.integers(0, 20, 900) / 20,
                          "f_lon": -120 + rng.integers(0, 24, 900) / 20})
    days = pd.DataFrame({"vsn": np.repeat(np.arange(20), 10), "day": np.tile(np.arange(10), 20), "last_flash": rng.integers(-5, 95, 200) * DAY_US,
                         "n_lat": np.repeat(35 + rng.integers(0, 20, 20) / 20, 10), "n_lon": np.repeat(-120 + rng.integers(0, 24, 20) / 20, 10)})
    x = radius_nearest(spark.createDataFrame(fires).sort(F.desc("fire_id")), spark.createDataFrame(days), ["vsn", "day"], "fire_id", 35.0,
                       time="discovery", start="last_flash", span=3 * DAY_US, point_ll=("f_lat", "f_lon"), target_ll=("n_lat", "n_lon"))
    assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.vsn, r.day): (r.fire_id, r.discovery, r.dist_km) for r in x.collect()}
    want = {}
    for r in days.itertuples():
        km = _haversine_km(r.n_lat, r.n_lon, fires.f_lat.to_numpy(), fires.f_lon.to_numpy())
        m = np.flatnonzero((km <= 35.0) & fires.discovery.between(r.last_flash, r.last_flash + 3 * DAY_US).to_numpy())
        if len(m):
            k = min(m, key=lambda i: (km[i], i))
            want[r.vsn, r.day] = (k, fires.discovery[k], km[k])
    assert got == want and len(want) > 100


def test_rain_of_windows_without_joining_them(spark):
    """Deltas of several windows of a row at once equal counter_delta; nothing is joined, rows without any reading are left out."""
    from stormlens.operators.counters import counter_delta, counter_deltas
    rng = np.random.default_rng(6)
    trace = pd.DataFrame({"vsn": rng.integers(0, 30, 600), "hour": rng.integers(0, 400, 600)}).drop_duplicates()
    trace["hi"] = trace.groupby("vsn")["hour"].rank() * 2.0
    trace["lo"] = trace["hi"] - 1.5
    rows = pd.DataFrame({"id": np.arange(300), "vsn": rng.integers(0, 35, 300), "a": rng.integers(-20, 420, 300), "c": rng.integers(0, 400, 300)})
    rows["z"], rows["e"] = rows["a"] + rng.integers(0, 40, 300), rows["c"] + 24
    t, r = spark.createDataFrame(trace), spark.createDataFrame(rows)
    x = counter_deltas(t, r, "vsn", "hour", {"one": ("a", "z"), "two": ("c", "e")})
    assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()
    one = {q.id: q.m for q in counter_delta(t, r, ["vsn"], "hour", "a", "z", ["id"], "m", bucket=48).collect()}
    two = {q.id: q.m for q in counter_delta(t, r, ["vsn"], "hour", "c", "e", ["id"], "m", bucket=48).collect()}
    got = {q.id: (q.one, q.two) for q in x.collect()}
    assert got == {k: (one[k], two[k]) for k in one if one[k] is not None or two[k] is not None} and 0 < len(got) < 300


def test_study_pairs_are_given_out_where_they_arise(spark):
    """Pairs with their days' sums equal a plain version, nodes without days too; after a pair has arisen nothing is shuffled."""
    from stormlens.operators.gathered import _haversine_km, window_pairs
    rng = np.random.default_rng(4)
    fires = pd.DataFrame({"fire_id": np.arange(300), "name": [f"f{k}" for k in range(300)], "f_lat": 35 + rng.random(300), "f_lon": -120 + rng.random(300),
                          "day": rng.integers(-30, 130, 300)})
    nodes = pd.DataFrame({"vsn": np.arange(50, 0, -1), "n_lat": 35 + rng.random(50), "n_lon": -120 + rng.random(50)})
    daily = pd.DataFrame({"vsn": rng.integers(1, 45, 900), "day": rng.integers(0, 100, 900), "u": rng.integers(0, 9, 900)}).drop_duplicates(["vsn", "day"])
    x = window_pairs(*map(spark.createDataFrame, (fires, nodes, daily)), 20.0, node="vsn", day="day", span=10, sums=["u"],
                     node_ll=("n_lat", "n_lon"), target_ll=("f_lat", "f_lon"))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]
    want = {}
    for f in fires.itertuples():
        km = _haversine_km(nodes.n_lat.to_numpy(), nodes.n_lon.to_numpy(), f.f_lat, f.f_lon)
        for k in np.flatnonzero(km <= 20.0):
            m = (daily.vsn == nodes.vsn[k]) & daily.day.between(f.day - 10, f.day)
            want[f.fire_id, nodes.vsn[k]] = (f.name, f.day, daily.u[m].sum(), pytest.approx(km[k], abs=1e-9))
    got = {(r.fire_id, r.vsn): (r.name, r.day, r.u, r.dist_km) for r in x.collect()}
    assert got == want and len(want) > 500


def test_scores_read_events_without_keeping_them(spark):
    """Scores of events need their bounds, but the events are not written down for it."""
    from stormlens.plans import study
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "a double")
    kept, study.cut = getattr(study, "cut", None), None  # would be called
    try:
        x = study.minmax_norms(df, {"na": (F.col("a"), False, True)})
        assert [r.na for r in x.collect()] == [1.0, 0.0, 1.0]
    finally:
        if kept is None:
            del study.cut
        else:
            study.cut = kept
