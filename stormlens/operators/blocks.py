"""Ordered computations that do not put a whole key into one task.

A key (a node, a clip, the whole fleet) may hold a third of all rows, so a plain
``Window.partitionBy(key)`` is not safe. The operators here window over
(key, block), where a block is a slice of the ordering column, and carry what a row
needs from earlier or later blocks through a table with one row per (key, block).
That table grows with the time span, not with the rows. Key columns must not be null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"
_COMBINE = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def key_window(by: list[str], *more: str):
    cols = [*by, *more]
    return Window.partitionBy(*cols) if cols else Window.partitionBy(F.lit(0))


def block_of(order: str, length) -> Column:
    return F.floor(F.col(order) / F.lit(length)).cast("bigint")


def with_block(df: DataFrame, order: str, length) -> DataFrame:
    return df.withColumn(BLOCK, block_of(order, length))


def with_carry(df: DataFrame, by: list[str], carries: dict[str, tuple[Column, str]],
               block: str = BLOCK) -> DataFrame:
    """Add to each row the combination of an aggregate over all earlier blocks of its key.

    `carries` maps an output name to (aggregate per block, how blocks combine).
    """
    per_block = df.groupBy(*by, block).agg(*[c.alias(n) for n, (c, _) in carries.items()])
    before = key_window(by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *by, block,
        *[_COMBINE[how](F.col(n)).over(before).alias(n) for n, (_, how) in carries.items()],
    )
    return df.join(carried, [*by, block], "left")


def row_numbers(df: DataFrame, by: list[str], order: list[str], block_on: str, length,
                out: str = "rn", total: str | None = None) -> DataFrame:
    """Exact 1-based row number per key; `block_on` is the leading ordering column."""
    x = with_block(df, block_on, length)
    carries = {"__before": (F.count(F.lit(1)), "sum")}
    x = with_carry(x, by, carries)
    w = key_window(by, BLOCK).orderBy(*order)
    x = x.withColumn(out, F.row_number().over(w) + F.coalesce(F.col("__before"), F.lit(0)))
    if total:
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(total))
        x = x.join(counts, by) if by else x.withColumn(total, counts.select(total).scalar())
    return x.drop(BLOCK, "__before")


def running_last(df: DataFrame, by: list[str], order: list[str], value: Column, out: str,
                 block: str = BLOCK, include_current: bool = True) -> DataFrame:
    """Last non-null `value` at or before each row (strictly before, if asked).

    The value must be computable per row before this call. `order` must be unique per
    key, or ties must be meant to be seen in any order.
    """
    x = df.withColumn("__v", value)
    stamped = F.max(F.when(F.col("__v").isNotNull(), F.struct(*order, F.col("__v").alias("__v"))))
    x = with_carry(x, by, {"__carry": (stamped, "last")}, block)
    end = Window.currentRow if include_current else -1
    w = key_window(by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = F.last(F.col("__v"), ignorenulls=True).over(w)
    return x.withColumn(out, F.coalesce(local, F.col("__carry.__v"))).drop("__v", "__carry")


def neighbours(df: DataFrame, by: list[str], order: str, value: str, reach: int,
               block: str = BLOCK) -> DataFrame:
    """Add `__prev` and `__next`, arrays of up to `reach` neighbour structs (order, value),
    nearest first, and per-key `__n`, `__first`, `__last`.
    """
    w = key_window(by, block)
    pair = F.struct(F.col(order).alias("t"), F.col(value).alias("v"))
    asc, desc = w.orderBy(order), w.orderBy(F.col(order).desc())
    ranked = df.select(*by, block, order, value,
                       F.row_number().over(asc).alias("__a"), F.row_number().over(desc).alias("__d"))
    heads = ranked.groupBy(*by, block).agg(
        F.count(F.lit(1)).alias("__m"),
        F.array_sort(F.collect_list(F.when(F.col("__a") <= reach, pair))).alias("__head"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("__d") <= reach, pair)))).alias("__tail"),
    )
    kw = key_window(by)
    seq = kw.orderBy(block)
    empty = F.slice(F.col("__head"), 1, 0)

    def around(col, fn):
        parts = [F.coalesce(fn(F.col(col), i).over(seq), empty) for i in range(1, reach + 1)]
        return F.slice(F.flatten(F.array(*parts)), 1, reach)

    whole = seq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = heads.select(
        *by, block,
        around("__tail", F.lag).alias("__pb"),
        around("__head", F.lead).alias("__nb"),
        F.sum("__m").over(whole).alias("__n"),
        F.first(F.col("__head")[0]["v"]).over(whole).alias("__first"),
        F.last(F.col("__tail")[0]["v"]).over(whole).alias("__last"),
    )
    x = df.join(edges, [*by, block])
    back = F.reverse(F.collect_list(pair).over(asc.rowsBetween(-reach, -1)))
    ahead = F.collect_list(pair).over(asc.rowsBetween(1, reach))
    return (
        x.withColumn("__prev", F.slice(F.concat(back, F.col("__pb")), 1, reach))
        .withColumn("__next", F.slice(F.concat(ahead, F.col("__nb")), 1, reach))
        .drop("__pb", "__nb")
    )


def map_sorted_groups(df: DataFrame, keys: list[str], order: list[str],
                      fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema) -> DataFrame:
    """Run `fn(rows, cuts)` on Arrow batches of whole groups, sorted by `order` inside each.

    `cuts` are the positions where a new group begins (the first group starts at 0). Many
    small groups share one call; only a group that crosses a batch edge is held back, so
    use (key, block) groups, whose size is bounded by the block.
    """
    def run(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            k = pdf[keys]
            cuts = np.flatnonzero((k.iloc[1:].to_numpy() != k.iloc[:-1].to_numpy()).any(axis=1)) + 1
            if held and (held[-1][keys].iloc[-1].to_numpy() != k.iloc[0].to_numpy()).any():
                yield fn(pd.concat(held, ignore_index=True), np.array([], dtype=int))
                held = []
            if not len(cuts):
                held.append(pdf)
                continue
            # the first group may continue the held one, the last may go on in the next batch
            if held:
                held.append(pdf.iloc[:cuts[0]])
                yield fn(pd.concat(held, ignore_index=True), np.array([], dtype=int))
                inner, cuts = pdf.iloc[cuts[0]:cuts[-1]], cuts[1:] - cuts[0]
            else:
                inner = pdf.iloc[:cuts[-1]]
                cuts = cuts.copy()
            if len(inner):
                yield fn(inner.reset_index(drop=True), cuts[:-1])
            held = [pdf.iloc[_last_start(k):]]
        if held:
            yield fn(pd.concat(held, ignore_index=True), np.array([], dtype=int))

    # dealt by a hash of the keys: a shuffle by the keys themselves is left out after a join on them, and what the join
    # reads then may be cut anew (a broadcast found at run time, a skewed partition), which parts a group's rows
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _last_start(k: pd.DataFrame) -> int:
    """Position where the last group of a sorted key frame begins."""
    a = k.to_numpy()
    change = np.flatnonzero((a[1:] != a[:-1]).any(axis=1))
    return int(change[-1]) + 1 if len(change) else 0
