"""Nearest searches through the cell pyramid against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stormlens.operators import pyramid
from stormlens.operators.areas import nearest_area, nearest_k, nearest_point
from tests.conftest import DATA


def haversine(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def flat(a, b, c, d):
    """Cosine at the right row (c, d)."""
    return math.hypot((d - b) * 111320.0 * math.cos(math.radians(c)), (c - a) * 110540.0) / 1000


def sides(spark, left, right):
    return (spark.createDataFrame(left, "p long, lat double, lon double"), spark.createDataFrame(right, "r long, t_lat double, t_lon double"))


def cloud(seed, n, lat=(30, 45), lon=(-125, -100)):
    rng = random.Random(seed)
    return [(k, rng.uniform(*lat), rng.uniform(*lon)) for k in range(n)]


@pytest.mark.parametrize("planar", [False, True])
def test_nearest_k_equals_brute_force(spark, planar):
    rng = random.Random(4)
    # dense and sparse places, copies of one place, and far points
    right = cloud(1, 150) + [(1000 + k, 37 + rng.gauss(0, 0.01), -120 + rng.gauss(0, 0.01)) for k in range(200)] + [(2000 + k, 40.0, -110.0) for k in range(9)]
    left = cloud(2, 60) + [(100, 37.0, -120.0), (101, -60.0, 20.0), (102, 40.0, -110.0), (103, None, 1.0)]
    d = flat if planar else haversine
    want = {}
    for p, a, b in left:
        if a is not None:
            best = sorted((d(a, b, c, e), r) for r, c, e in right)[:4]
            want |= {(p, i + 1): (r, round(x, 6)) for i, (x, r) in enumerate(best)}
    got = nearest_k(*sides(spark, left, right), "p", "r", 4, planar=planar).collect()
    assert {(r.p, r.rank): (r.r, round(r.dist_km, 6)) for r in got} == want


def test_neighbours_across_the_date_line_and_the_pole(spark):
    left = [(1, 0.0, 179.99), (2, 89.9, 0.0)]
    right = [(1, 0.0, 179.0), (2, 0.0, -179.99), (3, 89.9, 180.0), (4, 89.0, 0.0)]
    got = {r.p: r.r for r in nearest_point(*sides(spark, left, right), "p", "r").collect()}
    assert got == {1: 2, 2: 3}


def test_few_rows_and_none(spark):
    left, right = cloud(5, 3), cloud(6, 2)
    assert nearest_k(*sides(spark, left, right), "p", "r", 5).count() == 6
    assert nearest_k(*sides(spark, left, []), "p", "r", 5).count() == 0 and nearest_k(*sides(spark, [], right), "p", "r", 5).count() == 0


def test_a_far_point_meets_few_rows_of_a_dense_side(spark):
    rng = random.Random(7)
    right = [(k, 37 + rng.uniform(-0.5, 0.5), -120 + rng.uniform(-0.5, 0.5)) for k in range(5000)]
    a, b = sides(spark, [(1, -60.0, 20.0), (2, 37.0, -120.0), (3, 38.0, -119.0)], right)
    pairs = pyramid.candidates(a, b, "p", 3, pyramid.sphere(("lat", "lon"), ("t_lat", "t_lon")))
    met = {r.p: r["count"] for r in pairs.groupBy("p").count().collect()}
    assert set(met) == {1, 2, 3} and max(met.values()) < 250


def test_nearest_area_of_long_and_short_edges(spark):
    rng = random.Random(3)
    edges = [(f"a{k}", x, y, x + rng.uniform(-1, 1) * s, y + rng.uniform(-1, 1) * s) for k in range(80)
             for x, y, s in [(rng.uniform(0, 1e5), rng.uniform(0, 1e5), rng.choice([10, 3e4]))]] + [("dot", 5.0, 5.0, 5.0, 5.0)]
    points = [(k, rng.uniform(-2e5, 2e5), rng.uniform(-1e5, 2e5)) for k in range(40)]

    def distance(x, y, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(x - x1 - t * dx, y - y1 - t * dy)
    p = spark.createDataFrame(points, "pid long, x double, y double")
    e = spark.createDataFrame(edges, "area string, x1 double, y1 double, x2 double, y2 double")
    nobody = p.limit(0).select("pid", F.lit("").alias("area"))
    got = {r.pid: (r.nearest_area, round(r.distance_m, 6)) for r in nearest_area(p, e, "pid", "area", inside=nobody).collect()}
    assert got == {k: (best[1], round(best[0], 6)) for k, x, y in points for best in [min((distance(x, y, *z), a) for a, *z in edges)]}


def test_first_in_reach_equal_brute_force_and_list_no_pairs(spark):
    """The first five in reach of each target, with more in reach than one look holds, ties in the first columns and empty targets."""
    from stormlens.operators.reach import radius_first
    rng = np.random.default_rng(4)
    p = [(i, float(a), float(b), float(r), f"s{i}") for i, (a, b, r) in enumerate(zip(
        rng.uniform(35.0, 36.0, 3000), rng.uniform(-120.0, -118.5, 3000), rng.integers(0, 40, 3000)))]
    t = [(j, float(a), float(b)) for j, (a, b) in enumerate(zip(rng.uniform(34.5, 36.5, 300), rng.uniform(-120.5, -118.0, 300)))]
    t += [(300, 10.0, 10.0), (301, None, 1.0), (302, 35.0, -120.0)]
    points = spark.createDataFrame(p, "id long, lat double, lon double, risk double, name string").repartition(5)
    targets = spark.createDataFrame(t, "node long, t_lat double, t_lon double")
    x = radius_first(points, targets, ["node"], 30.0, 5, [F.desc("risk"), F.asc("id")])
    got = {}
    for r in x.collect():
        assert r.name == f"s{r.id}"
        got.setdefault(r.node, []).append((-r.risk, r.id))
    want = {}
    for j, a, b in t:
        near = sorted((-r, i) for i, la, lo, r, _ in p if a is not None and math.hypot(
            (lo - b) * 111320.0 * math.cos(math.radians(a)), (la - a) * 110540.0) / 1000.0 <= 30.0)[:5]
        if near:
            want[j] = near
    assert {j: sorted(v) for j, v in got.items()} == want and len(want) > 100


def test_top_watch_sectors_joins_no_strike_with_its_nodes(spark):
    """No row is a pair of a strike and a node: the joins of the plan are those that make the strikes."""
    plan = entry.queries()["top_watch_sectors"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "__cell" in plan and "__cj" not in plan
