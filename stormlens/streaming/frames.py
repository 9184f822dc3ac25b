"""Frame streams: rows of complete windows, spikes per node and window, and window counters.

A window's frames are kept as state rows under (window, part), where a part is a share of all its frames whatever their node: a
busy node is spread over the parts, many quiet ones share them, and no array of frames is built; all parts of a window come out in
the micro-batch whose watermark passes its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stormlens.operators.sequence import robust_spikes
from stormlens.streaming.tiers import ROCKSDB

#: Keys a window is spread over, and rows of a key that are given out at once.
PARTS, AT_ONCE = 64, 10_000


class OpenWindow(StatefulProcessor):
    """Frames of one part of a window until its end."""

    def __init__(self, seconds: float, vsn_type: str):
        self.seconds, self.vsn_type = seconds, vsn_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", f"vsn {self.vsn_type}, t double, luma double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.frames.exists():
            self.handle.registerTimer(int((key[0] + 1) * self.seconds * 1000))
        for pdf in rows:
            self.frames.appendList(list(zip(pdf["vsn"].tolist(), pdf["t"].to_numpy(float).tolist(), pdf["luma"].to_numpy(float).tolist())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self.frames.get()
        while some := list(islice(kept, AT_ONCE)):
            vsn, t, luma = zip(*some)
            yield pd.DataFrame({"vsn": pd.Series(vsn, dtype=object if self.vsn_type == "string" else None),
                                "batch_start": float(key[0] * self.seconds), "t": pd.Series(t, dtype=float), "luma": pd.Series(luma, dtype=float)})
        self.frames.clear()

    def close(self) -> None:
        pass


def frame_batches(frames: DataFrame, *, seconds: float = 60, lateness: str = "30 seconds", parts: int = PARTS) -> DataFrame:
    """(vsn, batch_start, t, luma): frames with the tumbling window they belong to, given out when it is complete.

    frames: vsn, t (epoch seconds), luma. A table gets the same columns at once. Rows without a node only move the watermark.
    """
    window = F.floor(F.col("t") / F.lit(seconds)).cast("long")
    if not frames.isStreaming:
        return frames.where("vsn is not null").select("vsn", (window * F.lit(float(seconds))).alias("batch_start"), "t", "luma")
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    vsn = frames.schema["vsn"].dataType.simpleString()
    x = frames.select("vsn", "t", "luma", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")).alias("ts")).withWatermark("ts", lateness)
    # the condition names the time, so that it is not moved below the watermark
    x = x.where(F.col("vsn").isNotNull() == F.col("ts").isNotNull())
    x = x.withColumn("window", window).withColumn("part", F.pmod(F.xxhash64("vsn", "t", "luma"), F.lit(parts)))
    return x.groupBy("window", "part").transformWithStateInPandas(
        statefulProcessor=OpenWindow(float(seconds), vsn), outputMode="Append", timeMode="EventTime",
        outputStructType=T.StructType.fromDDL(f"vsn {vsn}, batch_start double, t double, luma double"))


def batch_spikes(batches: DataFrame, *, seconds: float = 60, **kw) -> DataFrame:
    """Spikes of each (node, window), as if the window were a series of its own."""
    return robust_spikes(batches, ["vsn", "batch_start"], "t", "luma", block=float(seconds), **kw)


def batch_counters(batches: DataFrame) -> DataFrame:
    return batches.groupBy("vsn", "batch_start").agg(F.count(F.lit(1)).alias("frames_checked"))


def run_frames(frames: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str,
               trigger: dict | None = None, seconds: float = 60, lateness: str = "30 seconds"):
    """Start the job; `sink(spikes, counters, batch_id)` receives the windows completed by each micro-batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        sink(batch_spikes(batch, seconds=seconds), batch_counters(batch), batch_id)
    return (frame_batches(frames, seconds=seconds, lateness=lateness).writeStream.foreachBatch(handle)
            .outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"})).start())
