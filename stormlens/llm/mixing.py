"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a source of n rows is n ** TEMPER unless weights are given: small sources gain, large ones lose.
TEMPER, SEED = 0.5, "mix"
#: Sources up to this number are broadcast with their rates; beyond it the join is salted.
BROADCAST_SOURCES, SALTS = 50_000, 32


def poisson_cdf(rate: float) -> tuple[int, list[float]]:
    """(k0, P(X <= k0), P(X <= k0 + 1), ...): the part of the distribution that 52-bit draws can tell apart."""
    if not rate > 0:
        return 0, [1.0]
    spread = 12 * math.sqrt(rate) + 40
    k0 = max(0, int(rate - spread))
    k = np.arange(k0, int(rate + spread) + 1)
    step = np.concatenate([[k0 * math.log(rate) - rate - math.lgamma(k0 + 1)], math.log(rate) - np.log(k[1:])])
    return k0, np.minimum(np.cumsum(np.exp(np.cumsum(step))), 1.0).tolist()


def _cdf(rate: pd.Series) -> pd.DataFrame:
    got = [poisson_cdf(r) for r in rate]
    return pd.DataFrame({"k0": [g[0] for g in got], "cdf": [g[1] for g in got]})


def uniform(seed: str, *cols: str) -> Column:
    """A draw in [0, 1) from 52 bits of the md5 of a seed and the columns; null counts as a word of its own."""
    return F.conv(F.substring(_hash(seed, *cols), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _hash(seed: str, *cols: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict | None = None, temper: float = TEMPER,
                 total: int | None = None) -> tuple[DataFrame, int]:
    """((source, rate), number of sources): mean repetitions that bring each source to its weight of `total` rows.

    `weights` maps sources to positive weights; sources it leaves out get rate 0. Null is a source
    of its own. `total` defaults to the number of rows.
    """
    size = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        size = size.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(float(temper))))
    else:
        given = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], f"__s {docs.schema[source_col].dataType.simpleString()}, __w double")
        size = size.join(given, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s").fillna(0.0, ["__w"])
    rows, weight, sources = size.agg(F.sum("__n"), F.sum("__w"), F.count(F.lit(1))).first()
    goal = float(total if total is not None else rows or 0)
    return size.select("__source", (F.lit(goal) * F.col("__w") / F.lit(weight or 1.0) / F.col("__n")).alias("__rate")), sources


def _repeated(docs: DataFrame, source_col: str, id_col: str, weights: dict | None, temper: float, seed: str, total: int | None) -> DataFrame:
    """(__row, __copies, __copy, __order): rows travel as one struct, so names of their columns cannot clash."""
    rates, sources = source_rates(docs, source_col, weights, temper, total)
    cdf = F.pandas_udf(_cdf, "struct<k0: int, cdf: array<double>>")
    rates = rates.select("__source", cdf("__rate").alias("__p"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(source_col).alias("__of"), F.col(id_col).alias("__id"))
    same = F.col("__of").eqNullSafe(F.col("__source"))
    if sources <= BROADCAST_SOURCES:
        drawn = rows.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = rows.withColumn("__salt_of", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int")).join(
            salted, same & (F.col("__salt_of") == F.col("__salt")))
    drawn = drawn.withColumn("__u", uniform(seed, "__id")).withColumn(
        "__copies", F.col("__p.k0") + F.expr("size(filter(__p.cdf, c -> c <= __u))")).where("__copies > 0")
    copies = drawn.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    copies = copies.withColumn("__order", F.substring(_hash(f"{seed} order", "__id", "__copy"), 1, 16))
    return copies.select("__row", "__copies", "__copy", "__order").repartition("__order").sortWithinPartitions("__order")


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict | None = None,
        temper: float = TEMPER, seed: str = SEED, total: int | None = None) -> DataFrame:
    """`docs` with each row repeated a Poisson number of times, plus __copies, __copy and __order, shuffled globally.

    The number inverts the Poisson distribution, whose mean is the repetition rate of the row's
    source, at a draw hashed from seed and id, so it is the same on every run and in every task. A
    hot source needs no gathering: its rate is one row. Copies are made before the shuffle and
    dealt by a hash of (seed, id, copy); within a partition they lie in the order of __order. Rows
    that repeat an id get equal counts. A null id is drawn as the word null. Columns of `docs` that are
    called like one of the three are replaced; `repeat` keeps them.
    """
    got = _repeated(docs, source_col, id_col, weights, temper, seed, total)
    added = ["__copies", "__copy", "__order"]
    return got.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in added], *added)


def repeat(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict | None = None,
           temper: float = TEMPER, seed: str = SEED, total: int | None = None) -> DataFrame:
    """As `mix`, with just the columns of `docs`."""
    return _repeated(docs, source_col, id_col, weights, temper, seed, total).select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
