"""Arrival-time-difference positions: the least misfit over a coarse and then a fine lattice.

The lattices of many events lie behind one another in flat arrays, one entry per cell; a misfit is
one pass per receiver over all cells of all events, and each event's least cell a segment minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of the receivers' extent that the coarse lattice reaches to either side.
REACH = 1.2
#: Cells held at once.
CELLS = 1 << 21


def least_cells(rx: np.ndarray, ry: np.ndarray, toa: np.ndarray, cx: np.ndarray, cy: np.ndarray, span: np.ndarray, step: float, speed: float):
    """(x, y, misfit) per event: the first least cell, in row order, of a square lattice around (cx, cy).

    rx, ry, toa: events x receivers, NaN beyond an event's last receiver.
    """
    side = np.ceil(2 * span / step).astype(np.int64)
    cells = side * side
    bx, by, miss = cx.copy(), cy.copy(), np.full(len(cx), np.inf)
    # consecutive events whose cells fit; a wider lattice stands alone
    first = 0
    while first < len(cx):
        last = first + 1
        total = cells[first]
        while last < len(cx) and total + cells[last] <= CELLS:
            total += cells[last]
            last += 1
        e = np.arange(first, last)[cells[first:last] > 0]
        first = last
        if not len(e):
            continue
        start = np.concatenate([[0], np.cumsum(cells[e])[:-1]])
        own = np.repeat(e, cells[e])
        at = np.arange(len(own)) - np.repeat(start, cells[e])
        gx = (cx - span)[own] + (at % side[own]) * step
        gy = (cy - span)[own] + (at // side[own]) * step
        base = np.hypot(gx - rx[own, 0], gy - ry[own, 0])
        err = np.zeros(len(own))
        for k in range(1, rx.shape[1]):
            late = (np.hypot(gx - rx[own, k], gy - ry[own, k]) - base) / speed - (toa[own, k] - toa[own, 0])
            err += np.where(np.isnan(late), 0.0, late * late)
        low = np.minimum.reduceat(err, start)
        hits = np.flatnonzero(err == np.repeat(low, cells[e]))
        cell = hits[np.searchsorted(hits, start)]
        bx[e], by[e], miss[e] = gx[cell], gy[cell], low
    return bx, by, miss


def arrival_positions(events: DataFrame, key: list[str], receivers: str = "receivers", speed_ms: float = 343.0,
                      coarse_m: float = 1000.0, fine_m: float = 100.0, fine_span_m: float = 3000.0) -> DataFrame:
    """key, x, y, misfit per event row. receivers: array<struct<x, y, toa>>, differences are to the first.

    An event whose receivers stand at one place keeps it, with the misfit of the fine lattice.
    """
    schema = T.StructType([*events.select(*key).schema.fields, *T.StructType.fromDDL("x double, y double, misfit double").fields])
    flat = events.where(F.size(receivers) >= 1).select(*key, *[F.col(receivers)[k].cast("array<double>").alias("__" + k) for k in ("x", "y", "toa")])

    def padded(lists) -> np.ndarray:
        n = max(map(len, lists))
        return np.array([[*v, *[np.nan] * (n - len(v))] for v in lists], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, toa = (padded(pdf["__" + k].to_list()) for k in ("x", "y", "toa"))
            x0, x1, y0, y1 = (f(v, axis=1) for v in (x, y) for f in (np.nanmin, np.nanmax))
            cx, cy, miss = least_cells(x, y, toa, (x0 + x1) / 2, (y0 + y1) / 2, np.maximum(x1 - x0, y1 - y0) * REACH, coarse_m, speed_ms)
            cx, cy, miss = least_cells(x, y, toa, cx, cy, np.full(len(cx), fine_span_m), fine_m, speed_ms)
            yield pdf[key].reset_index(drop=True).assign(x=cx, y=cy, misfit=miss)

    return flat.mapInPandas(run, schema)
