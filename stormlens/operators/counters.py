"""Cumulative gauges: hourly envelopes and deltas over windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlens.functions.timecols import HOUR_US
from stormlens.operators.blocks import running_last, with_block
from stormlens.operators.joins import interval_join

# Rain gauges in order of preference.
GAUGE_PRIORITY = ["env.raingauge.total_acc", "wxt.rain.accumulation"]


def hourly_envelope(df: DataFrame, by: list[str], time: str, name: str, value: str,
                    priority: list[str] = GAUGE_PRIORITY, period_us: int = 31 * 24 * HOUR_US,
                    bucket_end: bool = False) -> DataFrame:
    """Hourly (lo, hi) of a cumulative trace; per key and period the first gauge with data wins.

    `time` is integer microseconds. Input labelled with the end of its hour
    (`bucket_end=True`) is shifted back once, here.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(name))
    t = F.col(time) - (HOUR_US if bucket_end else 0)
    x = df.where((rank > 0) & F.col(value).isNotNull())
    hourly = x.groupBy(*by, rank.alias("__r"), F.col(name).alias("gauge"),
                       (F.floor(t / HOUR_US) * HOUR_US).cast("bigint").alias("hour")).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"))
    hourly = hourly.withColumn("__p", F.floor(F.col("hour") / period_us))
    best = hourly.groupBy(*by, "__p").agg(F.min("__r").alias("__r"))
    return hourly.join(best, [*by, "__p", "__r"], "left_semi").select(*by, "hour", "lo", "hi", "gauge")


def counter_delta(trace: DataFrame, windows: DataFrame, by: list[str], hour: str, t0: str, t1: str,
                  keys: list[str], out: str, *, bucket, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """max(hi) - min(lo) over [t0, t1), floored at 0; null where the window has no rows.

    A reset inside the window reads as a large value, as in the original definition; use
    `counter_delta_reset` when the gauge resets.
    """
    hits = interval_join(trace.select(*by, hour, lo, hi),
                         windows.select(*[F.col(c) for c in by],
                                        *[F.col(k).alias("__w_" + k) for k in keys], t0, t1),
                         by, hour, t0, t1, bucket=bucket, closed_end=False)
    d = hits.groupBy(*["__w_" + k for k in keys]).agg(
        F.greatest(F.max(hi) - F.min(lo), F.lit(0.0)).alias(out))
    d = d.select(*[F.col("__w_" + k).alias(k) for k in keys], out)
    return windows.join(d, keys, "left")


def counter_deltas(trace: DataFrame, rows: DataFrame, by: str, hour: str, windows: dict[str, tuple[str, str]], *,
                   lo: str = "lo", hi: str = "hi", shares: int = 256) -> DataFrame:
    """counter_delta over several windows (columns t0, t1) of each row at once; rows whose windows are all empty are left out.

    The nodes are dealt into `shares`, in which rows and trace meet as arrays: no window is a row and nothing is joined back.
    """
    names = [c for c in rows.columns]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in windows]])
    dealt = lambda x: x.where(F.col(by).isNotNull()).withColumn("__share", F.pmod(F.xxhash64(by), F.lit(shares)).cast("int"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        node, at = np.unique(left.column(by).to_numpy(), return_inverse=True)
        times, rank = np.unique(left.column(hour).to_numpy(), return_inverse=True)
        key = at * (len(times) + 1) + rank
        order = np.argsort(key)
        key = key[order]
        ends = [np.append(left.column(c).to_numpy()[order], np.nan) for c in (lo, hi)]
        mine = right.column(by).to_numpy()
        i = np.minimum(np.searchsorted(node, mine), max(len(node) - 1, 0))
        known = node[i] == mine if len(node) else np.zeros(len(mine), bool)
        out = []
        for t0, t1 in windows.values():
            a, b = (np.searchsorted(key, i * (len(times) + 1) + np.searchsorted(times, right.column(c).to_numpy())) for c in (t0, t1))
            some = np.flatnonzero(known & (a < b))
            some = some[np.argsort(a[some], kind="stable")]
            cuts = np.stack([a[some], b[some]], 1).ravel()
            mm = np.full(len(mine), np.nan)
            if len(some):
                mm[some] = np.maximum(np.fmax.reduceat(ends[1], cuts)[::2] - np.fmin.reduceat(ends[0], cuts)[::2], 0.0)
            out.append(mm)
        full = np.flatnonzero(~np.isnan(out).all(axis=0))
        return pa.Table.from_arrays([*right.select(names).take(pa.array(full)).columns, *[pa.array(x[full], mask=np.isnan(x[full])) for x in out]],
                                    schema.names)

    tasks = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r = (dealt(x).repartition(tasks, "__share").groupBy("__share") for x in (trace.select(by, hour, lo, hi), rows))
    return l.cogroup(r).applyInArrow(run, schema)


def counter_delta_reset(series: DataFrame, windows: DataFrame, by: list[str], time: str, value: str,
                        t0: str, t1: str, keys: list[str], out: str, *, bucket, block) -> DataFrame:
    """Sum of the positive steps between consecutive readings inside [t0, t1)."""
    x = with_block(series.select(*by, time, value), time, block)
    x = running_last(x, by, [time], F.struct(F.col(time).alias("t"), F.col(value).alias("v")),
                     "__p", include_current=False)
    step = x.select(*by, time, F.col("__p.t").alias("__pt"),
                    F.greatest(F.col(value) - F.col("__p.v"), F.lit(0.0)).alias("__step"))
    hits = interval_join(step, windows.select(*by, *[F.col(k).alias("__w_" + k) for k in keys], t0, t1),
                         by, time, t0, t1, bucket=bucket, closed_end=False)
    d = hits.groupBy(*["__w_" + k for k in keys]).agg(
        F.sum(F.when(F.col("__pt") >= F.col(t0), F.col("__step")).otherwise(0.0)).alias(out))
    d = d.select(*[F.col("__w_" + k).alias(k) for k in keys], out)
    return windows.join(d, keys, "left")
