"""Spatial, interval, as-of and nearest joins, all as equi-joins on cells or buckets.

None of these uses a cross join or a forced broadcast: the grid or bucket gives an
equality key, and AQE splits skewed partitions. `salt` spreads one hot cell or bucket over
several tasks up front. The side that is copied into cells or buckets is merged, never
broadcast: Spark's estimate does not know of the copies, so a table that looks small would
be gathered in the driver many times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlens.functions import geo
from stormlens.operators.blocks import BLOCK, key_window, with_carry

from pyspark.sql import Window


def _salted(points: DataFrame, spread: DataFrame, salt: int) -> tuple[DataFrame, DataFrame, list[str]]:
    if salt <= 1:
        return points, spread, []
    s = F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.lit(salt)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
    return points.withColumn("__salt", s), spread.withColumn("__salt", copies), ["__salt"]


def _bucket(col: Column, width) -> Column:
    return F.floor(col / F.lit(width)).cast("bigint")


def _buckets(lo: Column, hi: Column, width) -> Column:
    return F.explode(F.when(hi >= lo, F.sequence(_bucket(lo, width), _bucket(hi, width))))


def _half_widths(tlat: Column, r: Column) -> tuple[Column, Column]:
    """Half height and width in degrees of a box that holds the circle, whichever metric is used: the
    scales of the metrics differ, so it is padded, and it is as wide as the circle is at its poleward edge."""
    pad = 1.01
    half_lat = geo.box_half_lat_deg(r) * pad
    half_lon = F.least(geo.box_half_lon_deg(F.least(F.abs(tlat) + half_lat, F.lit(90.0)), r) * pad,
                       F.lit(180.0))
    return half_lat, half_lon


def radius_join(
    points: DataFrame,
    targets: DataFrame,
    radius,
    *,
    point_ll: tuple[str, str] = ("lat", "lon"),
    target_ll: tuple[str, str] = ("t_lat", "t_lon"),
    on: list[str] | None = None,
    time: tuple[str, str, str, float] | None = None,
    cell_km: float | None = None,
    out: str = "dist_km",
    planar: bool = False,
    salt: int = 1,
) -> DataFrame:
    """Every (point, target) with distance <= radius (inclusive), plus the distance.

    `radius` is kilometres or a column of `targets`. `time = (point time, window start
    column, window end column, bucket width)` makes time part of the join key: use it
    whenever there is a time condition, or a popular place meets itself at all times.
    Column names of the two sides must differ except for `on`.
    """
    on = list(on or [])
    if cell_km is None:
        if isinstance(radius, str):
            raise ValueError("give cell_km when the radius is a column")
        cell_km = float(radius)
    n_cells = max(1, int(360.0 / max(cell_km / geo.BOX_KM_PER_DEG_LAT, 1e-6)))
    size = 360.0 / n_cells
    plat, plon = (F.col(c) for c in point_ll)
    tlat, tlon = (F.col(c) for c in target_ll)
    r = geo._c(radius)
    half_lat, half_lon = _half_widths(tlat, r)
    p = points.withColumn("__ci", _bucket(plat, size)).withColumn(
        "__cj", F.pmod(_bucket(plon, size), F.lit(n_cells)))
    j_lo = _bucket(tlon - half_lon, size)
    j_hi = F.least(_bucket(tlon + half_lon, size), j_lo + n_cells - 1)
    t = targets.withColumn("__ci", _buckets(tlat - half_lat, tlat + half_lat, size)).withColumn(
        "__cj", F.explode(F.transform(F.sequence(j_lo, j_hi), lambda j: F.pmod(j, F.lit(n_cells)))))
    keys = [*on, "__ci", "__cj"]
    if time:
        pt, lo, hi, width = time
        p = p.withColumn("__tb", _bucket(F.col(pt), width))
        t = t.withColumn("__tb", _buckets(F.col(lo), F.col(hi), width))
        keys.append("__tb")
    p, t, extra = _salted(p, t, salt)
    joined = p.join(t.hint("merge"), [*keys, *extra])
    if time:
        joined = joined.where(F.col(pt).between(F.col(lo), F.col(hi)))
    d = (geo.planar_km if planar else geo.haversine_km)(tlat, tlon, plat, plon)
    return (joined.withColumn(out, d).where(F.col(out) <= r)
            .drop("__ci", "__cj", "__tb", "__salt"))


#: Key columns of radius_groups.
CELL = ["__ci", "__cj", "__part"]


def radius_groups(points: DataFrame, targets: DataFrame, radius_km: float, *, part: str, parts: int = 16,
                  point_ll: tuple[str, str] = ("lat", "lon"), target_ll: tuple[str, str] = ("t_lat", "t_lon"),
                  out: str = "dist_km") -> DataFrame:
    """The rows of radius_join for grouping by target and `part`, an integer column of the points.

    The points are copied into the cells around them and a target stays in its own, so all rows of a target and `part`
    arise in one task. Group by CELL too, which both determine, and the pairs are never shuffled.
    """
    n_cells = max(1, int(360.0 / max(radius_km / geo.BOX_KM_PER_DEG_LAT, 1e-6)))
    size = 360.0 / n_cells
    (plat, plon), (tlat, tlon) = ([F.col(c) for c in x] for x in (point_ll, target_ll))
    half_lat, half_lon = _half_widths(plat, F.lit(radius_km))
    j_lo = _bucket(plon - half_lon, size)
    j_hi = F.least(_bucket(plon + half_lon, size), j_lo + n_cells - 1)
    p = points.withColumn("__part", F.pmod(F.col(part), F.lit(parts)).cast("int")).withColumn(
        "__ci", _buckets(plat - half_lat, plat + half_lat, size)).withColumn(
        "__cj", F.explode(F.transform(F.sequence(j_lo, j_hi), lambda j: F.pmod(j, F.lit(n_cells)))))
    t = targets.withColumn("__ci", _bucket(tlat, size)).withColumn("__cj", F.pmod(_bucket(tlon, size), F.lit(n_cells))).withColumn(
        "__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    near = p.join(t.hint("merge"), CELL).withColumn(out, geo.haversine_km(tlat, tlon, plat, plon))
    return near.where(F.col(out) <= radius_km)


def box_gate(points: DataFrame, targets: DataFrame, radius, *,
             point_ll: tuple[str, str] = ("lat", "lon"),
             target_ll: tuple[str, str] = ("t_lat", "t_lon")) -> DataFrame:
    """Keep points inside the padded bounding box of all targets (a candidate filter).

    The box is the one radius_join uses and its longitudes wrap, so gate and join give what the
    join gives. The bounds are one row of four numbers, read as scalar subqueries, so the
    comparison can reach the file scan.
    """
    tlat, tlon = (F.col(c) for c in target_ll)
    hl, ho = _half_widths(tlat, geo._c(radius))
    box = targets.agg(
        F.min(tlat - hl).alias("a"), F.max(tlat + hl).alias("b"),
        F.min(tlon - ho).alias("c"), F.max(tlon + ho).alias("d"))
    lat, lon = (F.col(c) for c in point_ll)
    turns = [(lon >= box.select(F.col("c") + t).scalar()) & (lon <= box.select(F.col("d") + t).scalar()) for t in (-360.0, 0.0, 360.0)]
    return points.where(
        (lat >= box.select("a").scalar()) & (lat <= box.select("b").scalar()) & (turns[0] | turns[1] | turns[2]))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: list[str],
    time: str,
    lo: str,
    hi: str,
    *,
    bucket,
    how: str = "inner",
    closed_end: bool = True,
    condition: Column | None = None,
    salt: int = 1,
) -> DataFrame:
    """Join points to intervals with lo <= time <= hi (or < hi) inside equal `on` keys.

    A point lies in one time bucket, an interval in every bucket it touches, so each match
    is found exactly once and inner, left, left_semi and left_anti are all exact. Choose
    `bucket` near the usual interval length.
    """
    p = points.withColumn("__tb", _bucket(F.col(time), bucket))
    i = intervals.withColumn("__tb", _buckets(F.col(lo), F.col(hi), bucket))
    p, i, extra = _salted(p, i, salt)
    keys = [*on, "__tb", *extra]
    right = i.select(*[F.col(c).alias("__k_" + c) if c in keys else F.col(c) for c in i.columns])
    cond = None
    for k in keys:
        eq = F.col(k) == F.col("__k_" + k)
        cond = eq if cond is None else cond & eq
    upper = F.col(time) <= F.col(hi) if closed_end else F.col(time) < F.col(hi)
    cond = cond & (F.col(time) >= F.col(lo)) & upper
    if condition is not None:
        cond = cond & condition
    return p.join(right.hint("merge"), cond, how).drop("__tb", "__salt", *["__k_" + k for k in keys])


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    payload: list[str],
    *,
    block,
    tolerance=None,
    tiebreak: str | None = None,
) -> DataFrame:
    """For each left row the latest right row at or before it (equal times match).

    Adds `right_time` and `payload`; null when none lies within `tolerance`. Several right
    rows at one instant: the greatest `tiebreak` (else payload) wins.
    """
    order = ["__t", "__side", "__seq"]
    seq = F.col(tiebreak).cast("double") if tiebreak else F.lit(0.0)
    hit = F.struct(F.col(right_time).alias("t"), seq.alias("s"),
                   *[F.col(c).alias(c) for c in payload])
    r = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"),
                     seq.alias("__seq"), hit.alias("__hit"))
    carried_cols = [c for c in left.columns if c not in by]
    l = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"),
                    F.lit(0.0).alias("__seq"), F.struct(*carried_cols).alias("__row"))
    both = r.unionByName(l, allowMissingColumns=True).withColumn(BLOCK, _bucket(F.col("__t"), block))
    both = with_carry(both, by, {"__carry": (F.max("__hit"), "max")})
    w = key_window(by, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # max over structs led by time: the latest, then the tie-break
    both = both.withColumn("__best", F.coalesce(F.max("__hit").over(w), F.col("__carry")))
    found = both.where(F.col("__side") == 1)
    ok = F.col("__best").isNotNull()
    if tolerance is not None:
        ok = ok & (F.col("__t") - F.col("__best.t") <= tolerance)
    return found.select(
        *by, *[F.col("__row." + c).alias(c) for c in carried_cols],
        F.when(ok, F.col("__best.t")).alias(right_time),
        *[F.when(ok, F.col("__best." + c)).alias(c) for c in payload])


def pick_first(df: DataFrame, by: list[str], order: list[str], payload: list[str],
               descending: bool = False) -> DataFrame:
    """Row with the smallest (or greatest) `order` tuple per key, by a partial aggregate."""
    cols = list(dict.fromkeys([*order, *payload]))
    agg = (F.max if descending else F.min)(F.struct(*cols)).alias("__p")
    return df.groupBy(*by).agg(agg).select(*by, "__p.*")
