"""Ordered operators against plain loops, on small blocks so that carries are exercised."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormlens.operators import quantiles as Q, sequence as S
from stormlens.operators.blocks import row_numbers, running_last, with_block
from stormlens.operators.joins import asof_backward, box_gate, interval_join, radius_join


def greedy(t, width, strict=False):
    out, start = [], None
    for x in t:
        if start is None or not ((x - start < width) if strict else (x - start <= width)):
            start = x
        out.append(start)
    return out


@pytest.mark.parametrize("width,scale,strict", [(1.5, 1.0, False), (1.5, 0.2, True), (3.0, 5.0, False)])
def test_greedy_groups(spark, width, scale, strict):
    t = np.cumsum(np.random.default_rng(3).exponential(scale, 600))
    df = spark.createDataFrame([("a", float(x)) for x in t] + [("b", float(x) + 0.3) for x in t], ["k", "t"])
    g = S.greedy_groups(df, ["k"], "t", width, block=width * 1.3, strict=strict)
    assert [r.group_start for r in g.where("k = 'a'").orderBy("t").collect()] == greedy(t, width, strict)


def test_greedy_chain_and_dedupe(spark):
    df = spark.createDataFrame([(x, r) for x, r in zip([0.0, 1.0, 1.4, 2.0, 3.0], [5.0, 2.0, None, 9.0, 1.0])],
                               "t double, km double")
    g = S.greedy_groups(df, [], "t", 1.5, block=4.0)
    assert sorted({r.group_start for r in g.collect()}) == [0.0, 2.0]
    d = S.greedy_dedupe(df, [], "t", 1.5, block=4.0, nearest="km").orderBy("t").collect()
    assert [(r.t, r.km) for r in d] == [(0.0, 2.0), (2.0, 1.0)]


def test_gap_equal_to_threshold_stays(spark):
    df = spark.createDataFrame([(0,), (6,), (13,), (19,)], "t bigint")
    e = S.episodes(df, [], "t", 6, block=5).orderBy("episode_start").collect()
    assert [(r.episode_start, r.episode_end, r.n) for r in e] == [(0, 6, 2), (13, 19, 2)]


def reference_spikes(x, z=4.0, jump=8.0):
    n = len(x)
    if n < 5:
        return []
    k = min(7, n if n % 2 else n - 1)
    h = k // 2
    padded = np.concatenate([[x[0]] * h, x, [x[-1]] * h])
    d = x - np.array([np.median(padded[i:i + k]) for i in range(n)])
    m = np.median(d)
    s = 0.6745 * (d - m) / (np.median(np.abs(d - m)) + 1e-12)
    return np.flatnonzero((s > z) & (d > jump)).tolist()


def test_robust_spikes(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for n in (4, 5, 6, 7, 8, 60, 240):
        x = rng.normal(12, 1, n)
        x[n // 2] += 80
        x[0] += 40
        want[n] = reference_spikes(x)
        rows += [(n, i * 0.5, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["k", "t", "v"])
    got = {}
    for r in S.robust_spikes(df, ["k"], "t", "v", block=1.0).collect():
        got.setdefault(r.k, []).append(int(r.t * 2))
    assert {n: sorted(got.get(n, [])) for n in want} == want


def test_flash_fixture(spark):
    """Two spikes at half-second cadence; a ramp gives none; a bright base is daytime; sparse cadence is flagged."""
    rng = np.random.default_rng(11)
    night = rng.normal(12, 1, 240)
    night[100], night[190] = 95, 140
    ramp = np.linspace(10, 120, 80)
    day = rng.normal(150, 1, 60)
    day[30] = 200
    slow = rng.normal(12, 1, 12)
    slow[6] = 90
    rows = ([("night", i * 0.5, float(v)) for i, v in enumerate(night)] + [("ramp", i * 0.5, float(v)) for i, v in enumerate(ramp)]
            + [("day", i * 0.5, float(v)) for i, v in enumerate(day)] + [("slow", i * 300.0, float(v)) for i, v in enumerate(slow)])
    s = S.robust_spikes(spark.createDataFrame(rows, ["vsn", "t", "luma"]), ["vsn"], "t", "luma", block=20.0).collect()
    by = {}
    for r in s:
        by.setdefault(r.vsn, []).append(r)
    assert sorted(r.t for r in by["night"]) == [50.0, 95.0] and not any(r.sparse or r.daytime for r in by["night"])
    assert "ramp" not in by and by["day"][0].daytime and by["slow"][0].sparse
    assert all(abs(r.sigma_s - 0.5) < 1e-9 for r in s)


def hysteresis(x, on, off):
    out, start = [], None
    for i, v in enumerate(x):
        if start is None and v >= on:
            start = i
        elif start is not None and v < off:
            out.append((start, i))
            start = None
    return out + ([(start, len(x) - 1)] if start is not None else [])


def test_hysteresis_merge_and_shape(spark):
    rng, rows, want = np.random.default_rng(7), [], {}
    for k in range(12):
        x = np.abs(np.cumsum(rng.normal(0, 1.5, 200)))
        want[k] = (x, hysteresis(x, 6, 3))
        rows += [(k, i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["k", "t", "v"])
    isl = S.hysteresis_islands(df, ["k"], "t", "v", on=6.0, off=3.0, block=7)
    got = {}
    for r in isl.collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: e for k, (_, e) in want.items() if e}
    merged = S.merge_intervals(isl, ["k"], 3, block=10)
    shapes = {(r.k, r.start): r for r in S.event_shape(df, merged, ["k"], "t", "v", hop=0.5, block=9, index="t").collect()}
    n = 0
    for k, (x, ev) in want.items():
        joined = []
        for a, b in ev:
            if joined and a - joined[-1][1] < 3:
                joined[-1] = (joined[-1][0], b)
            else:
                joined.append((a, b))
        for a, b in joined:
            seg, r = x[a:b + 1], shapes[(k, a)]
            pk = int(seg.argmax())
            above = np.flatnonzero(seg >= seg[pk] / 2)
            assert r.end == b and r.duration == (b - a + 1) * 0.5 and abs(r.peak - seg[pk]) < 1e-12
            assert r.rise == max((pk - above[0]) * 0.5, 0.5) and r.decay == (above[-1] - pk) * 0.5
            n += 1
    assert n == len(shapes)


def test_exact_quantile_with_bracket(spark, monkeypatch):
    """Large groups go through the sketch bracket; the result stays exact, ties included."""
    monkeypatch.setattr(Q, "SMALL_GROUP", 100)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=15000), np.zeros(6000)])
    df = spark.createDataFrame([("hot", float(x)) for x in v] + [("small", float(i)) for i in range(6)], ["k", "v"])
    for q in (0.0, 0.05, 0.2, 0.5, 0.9, 1.0):
        got = {r.k: r.o for r in Q.exact_quantile(df, ["k"], "v", q, "o").collect()}
        assert abs(got["hot"] - np.quantile(v, q)) < 1e-12 and abs(got["small"] - np.quantile(range(6), q)) < 1e-12
        whole = Q.exact_quantile(df.where("k = 'hot'"), [], "v", q, "o").first().o
        assert abs(whole - np.quantile(v, q)) < 1e-12


def test_running_totals(spark):
    v = np.random.default_rng(2).integers(0, 400, 3000)
    df = spark.createDataFrame([(float(x),) for x in v], ["s"])
    t = Q.running_totals(df, "s", {"n": F.count(F.lit(1))}, n_blocks=16).orderBy("s").collect()
    s, c = np.unique(v, return_counts=True)
    assert [r.s for r in t] == s.tolist() and [r.cum_n for r in t] == np.cumsum(c).tolist()


def test_row_numbers_and_running_last(spark):
    t = np.random.default_rng(4).permutation(500)
    df = spark.createDataFrame([(int(x % 2), int(x), None if x % 5 else int(x)) for x in t], "k int, t bigint, v bigint")
    rn = row_numbers(df, ["k"], ["t"], "t", 13, total="n").collect()
    assert all(r.rn == r.t // 2 + 1 and r.n == 250 for r in rn)
    last = running_last(with_block(df, "t", 11), ["k"], ["t"], F.col("v"), "p", include_current=False).collect()
    for r in last:
        earlier = [x for x in range(r.t) if x % 2 == r.k and x % 5 == 0]
        assert r.p == (max(earlier) if earlier else None)


def test_even_subsample_and_filmstrip(spark):
    df = spark.createDataFrame([(k, i) for k, n in ((0, 3), (1, 20), (2, 47)) for i in range(n)], "k int, t bigint")
    got = {}
    for r in S.even_subsample(df, ["k"], ["t"], 20, block_on="t", block=9).collect():
        got.setdefault(r.k, set()).add(r.t)
    assert got == {0: set(range(3)), 1: set(range(20)), 2: {i * 47 // 20 for i in range(20)}}
    strip = S.filmstrip(df, ["k"], ["t"], 8, block_on="t", block=9).where("k = 2").collect()
    assert sorted(r.t for r in strip) == [i * 5 for i in range(8)]


def test_asof_interval_radius(spark):
    left = spark.createDataFrame([(i, float(i)) for i in range(0, 100, 7)], "id bigint, t double")
    right = spark.createDataFrame([(float(i), i) for i in range(3, 90, 11)], "rt double, p bigint")
    for r in asof_backward(left, right, [], "t", "rt", ["p"], block=10.0, tolerance=6.0).collect():
        c = [x for x in range(3, 90, 11) if x <= r.t and r.t - x <= 6]
        assert r.p == (max(c) if c else None)
    iv = spark.createDataFrame([(0, 5.0, 30.0), (1, 28.0, 28.0), (2, 90.0, 200.0)], "iid int, lo double, hi double")
    for salt in (1, 3):
        hit = interval_join(left, iv, [], "t", "lo", "hi", bucket=10.0, salt=salt).collect()
        assert sorted((r.id, r.iid) for r in hit) == sorted(
            (i, j) for i in range(0, 100, 7) for j, a, b in ((0, 5, 30), (1, 28, 28), (2, 90, 200)) if a <= i <= b)
    anti = interval_join(left, iv, [], "t", "lo", "hi", bucket=10.0, how="left_anti").collect()
    assert sorted(r.id for r in anti) == [0, 35, 42, 49, 56, 63, 70, 77, 84]
    p = spark.createDataFrame([(0, 10.0, 179.95), (1, 10.0, -179.95), (2, 89.9, 10.0)], "id int, lat double, lon double")
    t = spark.createDataFrame([(0, 10.0, -179.99), (1, 89.9, -170.0)], "tid int, t_lat double, t_lon double")
    got = sorted((r.id, r.tid) for r in radius_join(p, t, 25.0, salt=2).collect())
    assert got == [(0, 0), (1, 0), (2, 1)]   # across the date line and over the pole


def test_calm_neighbour(spark):
    sp = [False, True, True, False, True, True, True]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sp)], "t bigint, s boolean")
    got = {r.t: r.b for r in S.calm_neighbour(df, [], "t", "s", block=2, out="b").collect()}
    assert [got[i] for i, s in enumerate(sp) if s] == [0, 3, 3, 3, None]


@pytest.mark.parametrize("t_lat, t_lon, p_lat, p_lon, radius", [
    (10.0, 179.95, 10.0, -179.95, 30.0), (10.0, -179.95, 10.0, 179.95, 30.0), (40.0, -120.0, 40.0, -120.0 + 29.99 / (111.1949 * 0.766044443), 30.0),
    (70.0, 20.0, 70.05, 20.0 + 29.0 / (111.1949 * 0.34), 30.0), (89.9, 0.0, 89.9, 180.0, 30.0)])
def test_gate_and_join_give_what_the_join_gives(spark, t_lat, t_lon, p_lat, p_lon, radius):
    points = spark.createDataFrame([(p_lat, p_lon), (0.0, 0.0)], "lat double, lon double")
    targets = spark.createDataFrame([(t_lat, t_lon)], "t_lat double, t_lon double")
    want = radius_join(points, targets, radius).count()
    assert want == 1 and radius_join(box_gate(points, targets, radius), targets, radius).count() == want


@pytest.mark.parametrize("strict", [False, True])
def test_one_unbroken_run_over_many_blocks(spark, strict):
    """Events closer than the width for hundreds of blocks, so every block depends on the one before."""
    rng = np.random.default_rng(5)
    t = np.sort(rng.integers(0, 40_000, 6_000)).tolist()
    df = spark.createDataFrame([("a" if i % 2 else "b", x) for i, x in enumerate(t)], "k string, t bigint")
    want = []
    for k in "ab":
        start = None
        for x in (x for i, x in enumerate(t) if ("a" if i % 2 else "b") == k):
            if start is None or x - start > 37 or strict and x - start == 37:
                start = x
            want.append((k, x, start))
    got = S.greedy_groups(df, ["k"], "t", 37, block=40, strict=strict)
    assert sorted((r.k, r.t, r.group_start) for r in got.collect()) == sorted(want)
