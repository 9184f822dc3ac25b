"""Exact nearest rows by descending a pyramid of cells.

The right side is counted in cells of a grid whose side shrinks by FAN from level to level. The points of one cell of the last
level go down together, as the box they fill: the box starts with the few cells of the first level and goes on with those that
may hold one of the k nearest rows of any of its points. A cell whose least possible distance exceeds the greatest possible
distance of cells that already hold k rows is left. What a point meets at the end are the rows of a few small cells, however far
away they lie and however dense the rest is. Points are moved once, and nothing is moved once a point and cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlens.functions import geo
from stormlens.session import cut

#: Cells a cell is divided into along each axis, and levels at most.
FAN, MAX_LEVELS = 4, 10
#: Rows a cell of the last level holds on average, were they evenly spread, and at most, as far as MAX_LEVELS can part them.
AIM, MOST = 4, 256
_SLACK = 1e-9


class Space:
    """Coordinates of both sides and bounds on the distance of the points of a box to the rows of another.

    `lower` and `upper` take the edges of both boxes, [(lo, hi), ...]; both are in the same unit and rise with the distance.
    """

    def __init__(self, point: list[Column], right: list[Column], lower: Callable, upper: Callable, reach: Column | None = None):
        self.point, self.right, self.lower, self.upper = point, right, lower, upper
        #: half the size of a row of the right side, 0 for points
        self.reach = F.lit(0.0) if reach is None else reach


def _root(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def box_gap(p: tuple[Column, Column], lo: Column, hi: Column) -> Column:
    return F.greatest(lo - p[1], p[0] - hi, F.lit(0.0))


def box_far(p: tuple[Column, Column], lo: Column, hi: Column) -> Column:
    return F.greatest(p[1] - lo, hi - p[0])


def euclidean(point: list[Column], right: list[Column], reach: Column | None = None) -> Space:
    return Space(point, right, lambda p, box: _root([box_gap(c, *e) for c, e in zip(p, box)]),
                 lambda p, box: _root([box_far(c, *e) for c, e in zip(p, box)]), reach)


def _unit_vector(lat: str, lon: str) -> list[Column]:
    a, o = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]


def sphere(point_ll, right_ll) -> Space:
    """Great circles by chords: cells of space, so neither the date line nor a pole is special."""
    return euclidean(_unit_vector(*point_ll), _unit_vector(*right_ll))


def flat_earth(point_ll, right_ll) -> Space:
    """The planar metric whose cosine is taken at the right row."""
    def of(gap, pick):
        def bound(p, box):
            (la0, la1), _ = box
            c = pick(F.cos(F.radians(la0)), F.cos(F.radians(la1)))
            if pick is F.greatest:
                c = F.when((la0 <= 0) & (la1 >= 0), 1.0).otherwise(c)
            dy, dx = gap(p[0], *box[0]) * geo.M_PER_DEG_LAT, gap(p[1], *box[1]) * geo.M_PER_DEG_LON_EQ * F.greatest(c, F.lit(0.0))
            return _root([dy, dx])
        return bound
    return Space([F.col(c) for c in point_ll], [F.col(c) for c in right_ll], of(box_gap, F.least), of(box_far, F.greatest))


def met(points: DataFrame, right: DataFrame, k: int, space: Space) -> DataFrame:
    """`points` with `__near`: rows of the right side, as structs, among which are the point's k nearest, ties among them too.

    Points without a coordinate are left out. An empty side gives no rows.
    """
    dims = range(len(space.point))
    here, there, mine, finest = ([f"__{x}{d}" for d in dims] for x in "prlc")
    r = right.select(F.struct(*right.columns).alias("__row"), *[c.alias(n) for c, n in zip(space.right, there)],
                     space.reach.alias("__reach")).dropna(subset=there)
    r = cut(r)
    bounds = r.agg(F.count(F.lit(1)), *[f(n) for n in there for f in (F.min, F.max)]).first()
    n, lo, hi = bounds[0], bounds[1::2], bounds[2::2]
    if not n:
        return points.limit(0).withColumn("__near", F.array().cast(T.ArrayType(r.schema["__row"].dataType)))
    side = max(max(b - a for a, b in zip(lo, hi)), 1e-9) * (1 + 1e-6)
    levels = min(MAX_LEVELS, max(1, math.ceil(math.log(max(1.0, n / AIM), FAN * FAN))))

    def cell(of, level):
        return [F.floor((F.col(c) - F.lit(a)) / F.lit(side / FAN ** level)).cast("long") for c, a in zip(of, lo)]
    while True:
        # counts of the last level are one pass over the rows; upper levels are counted from them
        tables = {levels: cut(r.groupBy(*[c.alias(x) for c, x in zip(cell(there, levels), finest)]).agg(
            F.count(F.lit(1)).alias("__n"), F.max("__reach").alias("__far")))}
        if levels == MAX_LEVELS or n <= MOST or tables[levels].agg(F.max("__n")).first()[0] <= MOST:
            break
        levels += 1
    for level in range(levels - 1, 0, -1):
        up = [F.floor(F.col(c) / FAN).cast("long").alias(c) for c in finest]
        tables[level] = cut(tables[level + 1].groupBy(*up).agg(F.sum("__n").alias("__n"), F.max("__far").alias("__far")))
    p = points.select("*", *[c.alias(x) for c, x in zip(space.point, here)]).dropna(subset=here)
    p = p.select("*", *[c.alias(x) for c, x in zip(cell(here, levels), mine)])
    edges = [f"{c}{e}" for c in here for e in "ab"]
    boxes = cut(p.groupBy(*mine).agg(*[f(c).alias(c + e) for c in here for f, e in ((F.min, "a"), (F.max, "b"))]))
    w = Window.partitionBy(*mine)

    def near(x, level):
        """Cells that may hold one of the k nearest rows of a point of the box."""
        size = side / FAN ** level
        pad = _SLACK * side
        box = [(F.lit(a) + F.col(c) * F.lit(size) - pad, F.lit(a) + (F.col(c) + 1) * F.lit(size) + pad) for a, c in zip(lo, finest)]
        at = [(F.col(c + "a"), F.col(c + "b")) for c in here]
        x = x.withColumn("__lower", space.lower(at, box) - F.col("__far")).withColumn("__upper", space.upper(at, box) + F.col("__far"))
        held = F.sum("__n").over(w.orderBy("__upper").rangeBetween(Window.unboundedPreceding, 0))
        x = x.withColumn("__held", held).withColumn("__reached", F.min(F.when(F.col("__held") >= k, F.col("__upper"))).over(w))
        return x.where(F.col("__reached").isNull() | (F.col("__lower") <= F.col("__reached") * (1 + _SLACK) + _SLACK)).drop(
            "__lower", "__upper", "__held", "__reached")

    # at most FAN ** dims cells of the first level: they go into the plan
    top = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in row.asDict().items()]) for row in tables[1].collect()])
    x = boxes.select(*mine, *edges, F.explode(top).alias("__t")).select(*mine, *edges, "__t.*")
    for level in range(1, levels + 1):
        x = near(x, level)
        if level < levels:
            below = tables[level + 1].select(*[F.floor(F.col(c) / FAN).cast("long").alias(f"__u{d}") for d, c in enumerate(finest)],
                                             *[F.col(c).alias(f"__n{d}") for d, c in enumerate(finest)], "__n", "__far")
            on = [F.col(c) == F.col(f"__u{d}") for d, c in enumerate(finest)]
            x = x.drop("__n", "__far").join(below, reduce(lambda a, b: a & b, on)).select(
                *mine, *edges, *[F.col(f"__n{d}").alias(c) for d, c in enumerate(finest)], "__n", "__far")
    rows = r.select("__row", *[c.alias(x) for c, x in zip(cell(there, levels), finest)])
    found = x.select(*mine, *finest).join(rows, finest).groupBy(*mine).agg(F.collect_list("__row").alias("__near"))
    # nothing is shuffled after this join, so a cell with very many points may be split
    return p.join(found.hint("merge"), mine).drop(*here, *mine)


def candidates(points: DataFrame, right: DataFrame, point_id: str, k: int, space: Space) -> DataFrame:
    """(points' columns, right's columns) of pairs that include the k nearest rows of every point with an id; the two sides share no column names."""
    points = points.where(F.col(point_id).isNotNull())
    return met(points, right, k, space).select(*points.columns, F.explode("__near").alias("__row")).select(*points.columns, "__row.*")
