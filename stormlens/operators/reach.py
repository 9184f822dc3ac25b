"""Totals, or the first few, of the points in reach of each target, without listing the pairs.

Rows at one place are one weighted place. Places are dealt into cells and a target is copied into the cells it reaches, as in
`radius_join`; the places of a cell meet its targets tile by tile in arrays, and only one row a target and cell is shuffled
again. The work is the product of the different places and the targets around them, since every distance counts; memory is
that of the places of one cell and part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlens.functions import geo
from stormlens.operators.joins import _bucket, _buckets, _half_widths

#: Distances in one tile of targets and places, and places in it.
TILE, WIDE = 1 << 15, 2048
#: Squared half chords up to here (120 km) take the series of the arcsine, which is exact to the last bits there.
SERIES = 1e-4


class Places:
    """Weighted places and what is asked of those within a radius of targets."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, weight: np.ndarray, planar: bool):
        self.planar, self.weight = planar, weight
        self.at = np.stack([lat, lon]) if planar else _unit(lat, lon)

    def totals(self, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, ...]:
        """(weight, weighted sum of km, least km, greatest km) of the places in reach of each target."""
        if self.planar:
            target = np.stack([lat, lon])
            scale = np.stack([np.full(len(lat), geo.M_PER_DEG_LAT), geo.M_PER_DEG_LON_EQ * np.cos(np.radians(lat))]) / 1000.0
            limit = radius * radius
        else:
            target, scale = _unit(lat, lon), None
            limit = np.where(radius >= 0, np.sin(np.minimum(radius / (2 * geo.EARTH_R_KM), np.pi / 2)) ** 2, -1.0)
        n, total = np.zeros(len(lat)), np.zeros(len(lat))
        least, most = np.full(len(lat), np.inf), np.zeros(len(lat))
        wide = max(1, min(WIDE, len(self.weight)))
        tall = max(1, TILE // wide)
        h_all, f_all = np.empty((tall, wide)), np.empty((tall, wide))
        for a in range(0, len(lat), tall):
            rows = slice(a, a + tall)
            for b in range(0, len(self.weight), wide):
                w = self.weight[b:b + wide]
                size = len(lat[rows]), len(w)
                h, f = h_all[:size[0], :size[1]], f_all[:size[0], :size[1]]
                self._squares(target[:, rows], None if scale is None else scale[:, rows], slice(b, b + wide), h, f)
                low = h.min(axis=1)
                if not (low <= limit[rows]).any():
                    continue
                least[rows] = np.minimum(least[rows], low)
                np.copyto(f, h <= limit[rows, None])
                h *= f
                n[rows] += f @ w
                most[rows] = np.maximum(most[rows], h.max(axis=1))
                total[rows] += self._km(h, f) @ w
        return n, total, self._km(least, np.empty(len(lat))), self._km(most, np.empty(len(lat)))

    def _squares(self, target, scale, cols, h, f) -> None:
        """Into h: squared distance (km) on the plane, squared half chord of the unit sphere otherwise."""
        for k, place in enumerate(self.at):
            out = f if k else h
            np.subtract(place[cols], target[k][:, None], out=out)
            if scale is not None:
                out *= scale[k][:, None]
            out *= out
            if k:
                h += f
        if not self.planar:
            h *= 0.25

    def _km(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Distances of what _squares gives, in place of it; f is scratch."""
        series = not self.planar and h.size and h.max() <= SERIES
        if series:
            np.multiply(h, 15 / 336, out=f)
            for c in (3 / 40, 1 / 6):
                f += c
                f *= h
            f += 1.0
        np.sqrt(h, out=h)
        if self.planar:
            return h
        if series:
            h *= f
        else:
            np.arcsin(np.minimum(h, 1.0, out=h), out=h)
        h *= 2 * geo.EARTH_R_KM
        return h


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)])


def radius_totals(points: DataFrame, targets: DataFrame, keys: list[str], radius, *, cell_km: float,
                  point_ll: tuple[str, str] = ("lat", "lon"), target_ll: tuple[str, str] = ("t_lat", "t_lon"),
                  on: list[str] | None = None, parts: int = 1, planar: bool = False) -> DataFrame:
    """(on, keys, n, sum_km, min_km, max_km) of the points within `radius` of each target; targets without any are left out.

    `radius` (inclusive) is kilometres or a column of `targets`; rows of targets with equal `keys` are one target. `on` columns
    of both sides must be equal. `parts` deals the places of a cell into several tasks.
    """
    on = list(on or [])
    n_cells = max(1, int(360.0 / max(cell_km / geo.BOX_KM_PER_DEG_LAT, 1e-6)))
    size = 360.0 / n_cells
    (plat, plon), (tlat, tlon) = ([F.col(c) for c in x] for x in (point_ll, target_ll))
    at = lambda i, j: (i * n_cells + j).alias("__cell")
    known = lambda *cs: F.expr(" and ".join(f"{c} is not null and not isnan({c})" for c in cs))
    places = points.where(known(*point_ll)).groupBy(*on, plat.alias("__lat"), plon.alias("__lon")).agg(F.count(F.lit(1)).alias("n"))
    places = places.select(
        *on, at(_bucket(F.col("__lat"), size), F.pmod(_bucket(F.col("__lon"), size), F.lit(n_cells))),
        F.pmod(F.xxhash64("__lat", "__lon"), F.lit(parts)).cast("int").alias("__part"), F.lit(0).alias("__side"), "__lat", "__lon",
        F.col("n").cast("double").alias("__w"), *[F.lit(None).cast(targets.schema[k].dataType).alias("__k_" + k) for k in keys])
    half_lat, half_lon = _half_widths(tlat, geo._c(radius))
    j_lo = _bucket(tlon - half_lon, size)
    j_hi = F.least(_bucket(tlon + half_lon, size), j_lo + n_cells - 1)
    spread = targets.where(known(*target_ll)).withColumn("__i", _buckets(tlat - half_lat, tlat + half_lat, size)).withColumn(
        "__j", F.explode(F.transform(F.sequence(j_lo, j_hi), lambda j: F.pmod(j, F.lit(n_cells))))).withColumn(
        "__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread = spread.select(*on, at(F.col("__i"), F.col("__j")), "__part", F.lit(1).alias("__side"), tlat.cast("double").alias("__lat"),
                           tlon.cast("double").alias("__lon"), geo._c(radius).cast("double").alias("__w"), *[F.col(k).alias("__k_" + k) for k in keys])
    group = [*on, "__cell", "__part"]
    # the cost is in the pairs, not the bytes, so the tasks are as many as the session has, whatever their size
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = places.unionByName(spread).repartition(tasks, F.xxhash64(*group)).sortWithinPartitions(*group, "__side")
    shown = [*on, *["__k_" + k for k in keys]]
    schema = T.StructType([*[both.schema[c] for c in shown], *[T.StructField(c, T.DoubleType()) for c in ("n", "sum_km", "min_km", "max_km")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, held, places = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*group, "__side", "__lat", "__lon", "__w"]}
            new = np.zeros(batch.num_rows - 1, bool)
            for c in [*group, "__side"]:
                new |= col[c][1:] != col[c][:-1]
            cuts = [0, *(np.flatnonzero(new) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(col[c][a] for c in group)
                if key != mine:
                    mine, held, places = key, [], None
                x = [col[c][a:b] for c in ("__lat", "__lon", "__w")]
                if col["__side"][a] == 0:
                    held.append(x)
                elif held or places:
                    if places is None:
                        places, held = Places(*(np.concatenate(c) for c in zip(*held)), planar), []
                    got = places.totals(*x)
                    hit = np.flatnonzero(got[0] > 0)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays(
                            [*[batch.column(c).take(pa.array(a + hit)) for c in shown], *[pa.array(g[hit]) for g in got]], schema.names)

    found = both.mapInArrow(run, schema)
    return found.groupBy(*on, *[F.col("__k_" + k).alias(k) for k in keys]).agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("sum_km").alias("sum_km"), F.min("min_km").alias("min_km"), F.max("max_km").alias("max_km"))


#: Points of a cell that the targets still short of theirs are held against at once.
NEXT = 64


def radius_first(points: DataFrame, targets: DataFrame, keys: list[str], radius_km: float, k: int, order: list[Column], *,
                 point_ll: tuple[str, str] = ("lat", "lon"), target_ll: tuple[str, str] = ("t_lat", "t_lon"), parts: int = 16) -> DataFrame:
    """(keys, columns of the points) of the first `k` points by `order` within `radius_km` (planar, inclusive) of each target.

    `order` are columns of the points and should leave no ties. The points of a cell come in that order, and a target leaves as
    soon as it has k, so it meets few points however many are in reach; it gives at most k rows a cell. Targets are dealt into
    `parts`, to each of which the points are copied.
    """
    n_cells = max(1, int(360.0 / max(radius_km / geo.BOX_KM_PER_DEG_LAT, 1e-6)))
    size = 360.0 / n_cells
    (plat, plon), (tlat, tlon) = ([F.col(c) for c in x] for x in (point_ll, target_ll))
    at = lambda i, j: (i * n_cells + j).alias("__cell")
    shown = points.columns
    mine = points.where(plat.isNotNull() & plon.isNotNull()).select(
        *shown, at(_bucket(plat, size), F.pmod(_bucket(plon, size), F.lit(n_cells))), F.lit(0).alias("__side"),
        plat.cast("double").alias("__lat"), plon.cast("double").alias("__lon"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"),
        *[F.lit(None).cast(targets.schema[c].dataType).alias("__k_" + c) for c in keys])
    half_lat, half_lon = _half_widths(tlat, F.lit(radius_km))
    j_lo = _bucket(tlon - half_lon, size)
    j_hi = F.least(_bucket(tlon + half_lon, size), j_lo + n_cells - 1)
    spread = targets.where(tlat.isNotNull() & tlon.isNotNull()).withColumn("__i", _buckets(tlat - half_lat, tlat + half_lat, size)).withColumn(
        "__j", F.explode(F.transform(F.sequence(j_lo, j_hi), lambda j: F.pmod(j, F.lit(n_cells)))))
    spread = spread.select(
        *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in shown], at(F.col("__i"), F.col("__j")), F.lit(1).alias("__side"),
        tlat.cast("double").alias("__lat"), tlon.cast("double").alias("__lon"),
        F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("__part"), *[F.col(c).alias("__k_" + c) for c in keys])
    group = ["__cell", "__part"]
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = mine.unionByName(spread).repartition(tasks, F.xxhash64(*group)).sortWithinPartitions(*group, "__side", *order)
    named = ["__k_" + c for c in keys]
    schema = T.StructType([both.schema[c] for c in [*named, *shown]])

    def firsts(place: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(target, point) of the first k points in reach of each target."""
        open_, missing, out = np.arange(len(lat)), np.full(len(lat), k), []
        wide = geo.M_PER_DEG_LON_EQ * np.cos(np.radians(lat))
        for b in range(0, place.shape[1], NEXT):
            if not len(open_):
                break
            x = (place[1, b:b + NEXT] - lon[open_, None]) * wide[open_, None]
            y = (place[0, b:b + NEXT] - lat[open_, None]) * geo.M_PER_DEG_LAT
            hit = np.sqrt(x * x + y * y) / 1000.0 <= radius_km
            hit &= hit.cumsum(axis=1) <= missing[open_, None]
            t, p = np.nonzero(hit)
            out.append((open_[t], p + b))
            missing[open_] -= hit.sum(axis=1)
            open_ = open_[missing[open_] > 0]
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, place, table = None, [], None, None
        tall = max(1, TILE // NEXT)
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*group, "__side", "__lat", "__lon"]}
            new = np.zeros(batch.num_rows - 1, bool)
            for c in [*group, "__side"]:
                new |= col[c][1:] != col[c][:-1]
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(col[c][a] for c in group)
                if key != cell:
                    cell, held, table = key, [], None
                if col["__side"][a] == 0:
                    held.append((np.stack([col["__lat"][a:b], col["__lon"][a:b]]), batch.slice(a, b - a).select([*shown])))
                elif held:
                    if table is None:
                        place, table = np.concatenate([h[0] for h in held], 1), pa.Table.from_batches([h[1] for h in held]).combine_chunks()
                    for i in range(a, b, tall):
                        z = min(i + tall, b)
                        t, p = firsts(place, col["__lat"][i:z], col["__lon"][i:z])
                        if len(t):
                            got = table.take(pa.array(p)).combine_chunks()
                            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(i + t)) for c in named],
                                                              *[got.column(c).chunk(0) for c in shown]], schema.names)

    found = both.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(named, keys)], *shown)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")
