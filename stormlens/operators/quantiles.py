"""Exact order statistics and global running totals without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlens.operators.blocks import key_window
from stormlens.session import cut

ACCURACY = 50_000          # rank error of the sketch is at most n / ACCURACY
MARGIN = 5.0 / ACCURACY    # the bracket is this wide on either side
SMALL_GROUP = 50_000       # groups up to this size skip the bracket


def exact_quantile(df: DataFrame, by: list[str], value: str, q: float, out: str) -> DataFrame:
    """Linear-interpolation quantile per key (numpy's default), exact for any group size.

    A mergeable rank sketch brackets the wanted rank; only rows inside the bracket are
    kept as distinct values, rows outside are just counted. A hot key therefore sends
    about one row in five thousand to the final ranking. Groups up to SMALL_GROUP rows skip
    the sketch.
    """
    data = df.select(*by, F.col(value).cast("double").alias("__v"))
    data = data.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    lo_p, hi_p = max(0.0, q - MARGIN), min(1.0, q + MARGIN)
    count = F.count(F.lit(1)).alias("__n")
    bracket = F.percentile_approx("__v", [lo_p, hi_p], ACCURACY).alias("__b")
    if by:
        large = data.groupBy(*by).agg(count).where(F.col("__n") > SMALL_GROUP).select(*by)
        sketch = data.join(large, by, "left_semi").groupBy(*by).agg(bracket)
        joined = data.join(sketch, by, "left")
    else:
        # one row: broadcasting it is bounded
        one = F.lit(1).alias("__one")
        sketch = data.agg(count, bracket).select(
            F.when(F.col("__n") > SMALL_GROUP, F.col("__b")).alias("__b"), one)
        joined = data.select("*", one).join(F.broadcast(sketch), "__one")
    v, b = F.col("__v"), F.col("__b")
    side = F.when(v < b[0], -1).when(v > b[1], 1).otherwise(0)
    counted = (
        joined.select(*by, side.alias("__s"), F.when(side == 0, v).alias("__x"))
        .groupBy(*by, "__s", "__x").agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__n", F.sum("__c").over(key_window(by)))
    )
    upto = key_window(by).orderBy("__s", "__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("__cum", F.sum("__c").over(upto))
    pos = F.lit(q) * (F.col("__n") - 1)
    r0 = F.floor(pos)
    r1 = F.least(r0 + 1, F.col("__n") - 1)

    def at(r):
        hit = (F.col("__cum") - F.col("__c") <= r) & (r < F.col("__cum"))
        return F.max(F.when(hit, F.col("__x")))

    picked = ranked.groupBy(*by).agg(
        at(r0).alias("__v0"), at(r1).alias("__v1"), F.max(pos - r0).alias("__f"))
    missed = F.col("__v0").isNull() | F.col("__v1").isNull()
    result = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.col("__f")
    # a missed bracket must never pass silently
    return picked.select(
        *by, F.when(missed & F.col("__f").isNotNull(),
                    F.raise_error(F.lit("rank bracket missed")).cast("double"))
        .otherwise(result).alias(out))


def running_totals(df: DataFrame, order: str, totals: dict[str, Column], n_blocks: int = 256
                   ) -> DataFrame:
    """One row per distinct `order` value with each total and its running sum (`cum_<name>`).

    Values are cut into blocks by sketched quantiles; block sums are carried, so no task
    sees more than about one block.
    """
    distinct = df.where(F.col(order).isNotNull()).groupBy(order).agg(
        *[c.alias(n) for n, c in totals.items()])
    distinct = cut(distinct)
    probs = [i / n_blocks for i in range(1, n_blocks)]
    one = F.lit(1).alias("__one")
    splits = distinct.agg(F.percentile_approx(order, probs, 10_000).alias("__splits")).select("__splits", one)
    # one row of n_blocks numbers: broadcasting it is bounded
    with_splits = distinct.select("*", one).join(F.broadcast(splits), "__one")
    blocked = cut(with_splits.select(
        order, *totals, F.size(F.filter("__splits", lambda s: s < F.col(order))).alias("__b")))
    sums = blocked.groupBy("__b").agg(*[F.sum(n).alias("__t_" + n) for n in totals])
    earlier = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("__b", *[
        F.coalesce(F.sum("__t_" + n).over(earlier), F.lit(0)).alias("__t_" + n) for n in totals])
    w = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = blocked.join(carried, "__b")
    return joined.select(
        order, *totals,
        *[(F.sum(n).over(w) + F.col("__t_" + n)).alias("cum_" + n) for n in totals])
