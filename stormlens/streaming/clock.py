"""Ending a finite stream: a last clock row moves the watermark past everything, so open windows come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Type of rows that only carry time.
CLOCK = "clock"
#: Epoch seconds after every event (the year 2200; nanosecond times end in 2262).
END_OF_TIME = 7_258_118_400.0


def with_clock(events: DataFrame, folder: str, time: str = "time_epoch", kind: str = "type") -> DataFrame:
    """`events` and the clock rows of `folder`, which must exist; a clock row has its time and kind, other columns null."""
    spark, schema = events.sparkSession, events.schema
    ticks = spark.readStream.schema(f"{time} double").json(folder)
    cols = [F.col(time).cast(f.dataType).alias(f.name) if f.name == time else
            (F.lit(CLOCK) if f.name == kind else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return events.unionByName(ticks.select(*cols))


def open_clock(spark: SparkSession, folder: str, time: str = "time_epoch") -> None:
    """Make `folder` with a first row that moves no watermark."""
    strike_clock(spark, folder, time, 0.0)


def strike_clock(spark: SparkSession, folder: str, time: str = "time_epoch", at: float = END_OF_TIME) -> None:
    spark.range(1).select(F.lit(float(at)).alias(time)).write.mode("append").json(folder)


def run_to_end(spark: SparkSession, folder: str, start: Callable[[], StreamingQuery], time: str = "time_epoch") -> None:
    """Run what is there, strike the clock, and run again from the same checkpoint.

    `start` starts the query with an availableNow trigger and its checkpoint location. Afterwards the stream is
    closed: any further event is late.
    """
    start().awaitTermination()
    strike_clock(spark, folder, time)
    start().awaitTermination()
