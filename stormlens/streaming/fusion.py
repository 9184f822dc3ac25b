"""Live fusion: flash and thunder streams to strikes.

Rule for late data: an incident is closed once the watermark has passed its first flash by
the pairing window; events older than the watermark are dropped. Up to that point the result
is that of the batch job over the same events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stormlens.functions import geo
from stormlens.functions.physics import sound_speed_ms
from stormlens.operators.localize import COINCIDENCE_S, solve_incidents
from stormlens.operators.pairing import PAIR_MAX_S, PAIR_MIN_S
from stormlens.streaming.tiers import ROCKSDB


#: Seconds of flashes whose groups are settled at once, and of strikes whose thunder is gathered under one key.
SETTLE_S, BLOCK_S = 60.0, 90.0


class FlashGroups(StatefulProcessor):
    """Per region: flash times by stretch of SETTLE_S; emits the first time of each group once its stretch is over.

    Grouping against a group's first flash is sequential, so only times pass through here. A stretch is a map entry of
    its own and is dropped when it is settled.
    """

    def __init__(self, width_s: float):
        self.width = width_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "stretch long", "times array<double>")
        self.last = handle.getValueState("last", "start double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            t = pdf["time_epoch"].to_numpy(float)[(pdf["type"] == "flash").to_numpy()]
            stretch = np.floor(t / SETTLE_S).astype(np.int64)
            for b in np.unique(stretch).tolist():
                have = []
                if self.open.containsKey((b,)):
                    have = list(self.open.getValue((b,))[0])
                else:
                    self.handle.registerTimer(int((b + 1) * SETTLE_S * 1000))
                self.open.updateValue((b,), (have + t[stretch == b].tolist(),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # timers come in order of time, so stretches are settled in order
        end = expiredTimerInfo.getExpiryTimeInMs() / 1000.0
        b = int(round(end / SETTLE_S)) - 1
        last, starts = self.last.get()[0] if self.last.exists() else None, []
        for t in sorted(self.open.getValue((b,))[0]):
            if last is None or t - last > self.width:
                starts.append(t)
                last = t
        self.open.removeKey((b,))
        if last is not None:
            self.last.update((last,))
        if starts:
            # never behind the watermark, or the next operator would take them as late
            at = max(int(end * 1000), timerValues.getCurrentWatermarkInMs() + 1)
            yield pd.DataFrame({"region": pd.Series([key[0]] * len(starts), dtype=object), "t_strike": starts,
                                "at": pd.to_datetime([at] * len(starts), unit="ms")})

    def close(self) -> None:
        pass


class Ranges(StatefulProcessor):
    """Per (region, block of strike times): strikes and the thunder in reach; emits all incidents of the block at its end."""

    def __init__(self, lo_s: float, hi_s: float, temp_c: float):
        self.lo, self.hi, self.c = lo_s, hi_s, sound_speed_ms(temp_c)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.strikes = handle.getListState("strikes", "t double")
        self.thunder = handle.getListState("thunder", "vsn string, t double, km double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not (self.strikes.exists() or self.thunder.exists()):
            self.handle.registerTimer(int(((key[1] + 1) * BLOCK_S + self.hi + SETTLE_S) * 1000) + 1)
        for pdf in rows:
            own = pdf["t_strike"].notna().to_numpy()
            if own.any():
                self.strikes.appendList([(t,) for t in pdf["t_strike"].to_numpy(float)[own].tolist()])
            if not own.all():
                heard = pdf[~own]
                km = [None if k != k else k for k in heard["implied_range_km"].to_numpy(float).tolist()]
                self.thunder.appendList(list(zip(heard["vsn"].tolist(), heard["time_epoch"].to_numpy(float).tolist(), km)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        flashes = np.sort(np.array([t for (t,) in self.strikes.get()], float)) if self.strikes.exists() else np.zeros(0)
        pairs = []
        if len(flashes) and self.thunder.exists():
            for vsn, t, km in self.thunder.get():
                # one unit of slack around the window, then the exact test
                a, b = np.searchsorted(flashes, [t - self.hi - 1, t - self.lo + 1])
                for f in flashes[a:b].tolist():
                    if self.lo <= t - f <= self.hi:
                        pairs.append((f, vsn, round(km if km is not None else (t - f) * self.c / 1000, 3)))
        self.strikes.clear()
        self.thunder.clear()
        ranges: dict = {}
        for f, vsn, km in sorted(set(pairs)):
            ranges.setdefault((f, vsn), []).append(km)
        if ranges:
            yield pd.DataFrame({"region": pd.Series([key[0]] * len(ranges), dtype=object), "t_strike": [f for f, _ in ranges],
                                "vsn": pd.Series([v for _, v in ranges], dtype=object), "ranges": pd.Series(list(ranges.values()), dtype=object)})

    def close(self) -> None:
        pass


def strike_starts(events: DataFrame, width_s: float = COINCIDENCE_S) -> DataFrame:
    """Streaming (region, t_strike, at): first flash of each group; `at` is when it was settled."""
    return events.groupBy("region").transformWithStateInPandas(
        statefulProcessor=FlashGroups(width_s), outputStructType=T.StructType.fromDDL("region string, t_strike double, at timestamp"),
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="at")


def incident_stream(events: DataFrame, *, lateness: str = "30 seconds", region: str | None = None,
                    width_s: float = COINCIDENCE_S, pair_s=(PAIR_MIN_S, PAIR_MAX_S), temp_c: float = 20.0) -> DataFrame:
    """Streaming (region, t_strike, vsn, ranges). events: type, vsn, time_epoch, implied_range_km.

    `region` keeps storms apart; without it the fleet is one region. Only flash times of a region meet under one key; strikes
    and thunder are kept by (region, 90 seconds), so a busy region is spread over many keys. vsn is returned as a string.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    key = F.coalesce(F.col(region).cast("string"), F.lit("")) if region else F.lit("fleet")
    ts = F.timestamp_micros((F.col("time_epoch") * 1e6).cast("bigint"))
    x = events.where(F.col("time_epoch").isNotNull()).select(key.alias("region"), "type", F.col("vsn").cast("string").alias("vsn"), "time_epoch", "implied_range_km", ts.alias("at"))
    x = x.withWatermark("at", lateness)

    def only(kind):
        # other types still advance the watermark: a condition that also names the time is not moved below it
        return x.where(F.col("type").eqNullSafe(kind) == F.col("at").isNotNull())
    starts = strike_starts(only("flash"), width_s)
    block = lambda t: F.floor(t / BLOCK_S).cast("long")
    lo, hi = pair_s
    # strikes come first: the event time of a union is that of its first part
    rows = starts.select("region", block(F.col("t_strike")).alias("block"), "t_strike", F.lit(None).cast("string").alias("vsn"),
                         F.lit(None).cast("double").alias("time_epoch"), F.lit(None).cast("double").alias("implied_range_km"), "at")
    heard = only("thunder").select(
        "region", F.explode(F.sequence(block(F.col("time_epoch") - hi - 1), block(F.col("time_epoch") - lo + 1))).alias("block"),
        F.lit(None).cast("double").alias("t_strike"), "vsn", "time_epoch", "implied_range_km", "at")
    return rows.unionByName(heard).groupBy("region", "block").transformWithStateInPandas(
        statefulProcessor=Ranges(lo, hi, temp_c), outputStructType=T.StructType.fromDDL("region string, t_strike double, vsn string, ranges array<double>"),
        outputMode="Append", timeMode="EventTime")


def locate(incidents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Strikes of closed incidents (a batch, or one micro-batch)."""
    centre = nodes.agg(F.struct(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).alias("c")).scalar()
    at = nodes.select("vsn", geo.east_m("lon", centre["lat"], centre["lon"]).alias("x"),
                      geo.north_m("lat", centre["lat"]).alias("y"))
    inc = incidents.join(at, "vsn").groupBy("region", "t_strike").agg(
        F.array_sort(F.collect_list(F.struct("vsn", "ranges", "x", "y"))).alias("cands"))
    return solve_incidents(inc, ["region", "t_strike"], centre["lat"], centre["lon"])


def run_fusion(events: DataFrame, nodes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
               trigger: dict | None = None, **kw):
    """Start the live job; `sink(strikes, batch_id)` receives each micro-batch's strikes."""
    def solve(batch: DataFrame, batch_id: int) -> None:
        sink(locate(batch, nodes), batch_id)
    return (incident_stream(events, **kw).writeStream.foreachBatch(solve).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start())
