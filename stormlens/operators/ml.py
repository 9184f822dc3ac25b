"""Embedding pooling and the linear probe with cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlens.operators.blocks import row_numbers
from stormlens.session import cut


def pool_embeddings(frames: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Per clip the concatenation of mean and max of each dimension over its frames.

    Dimensions are exploded, so that a clip with very many frames is pre-aggregated on the
    map side; what is gathered per clip is one row per dimension.
    """
    x = frames.select(*by, F.posexplode(vector).alias("dim", "v"))
    d = x.groupBy(*by, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"),
                                  F.max(F.col("v").cast("double")).alias("x"))
    g = d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", "m", "x"))).alias("d"))
    return g.select(*by, F.concat(F.transform("d", lambda s: s["m"]),
                                  F.transform("d", lambda s: s["x"])).alias("features"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, block: int = 10_000) -> DataFrame:
    """Deterministic folds: rank within the label by a hash of the key, modulo k."""
    x = df.withColumn("__h", F.xxhash64(key))
    x = row_numbers(x, [label], ["__h", key], "__h", 2**64 // block, out="__rn")
    return x.withColumn("fold", (F.col("__rn") % k).cast("int")).drop("__h", "__rn")


def probe_cv(df: DataFrame, key: str, features: str, label: str, *, k: int = 5, c: float = 1.0,
             max_iter: int = 5000) -> DataFrame:
    """Out-of-fold decision scores of a balanced, L2-regularised logistic regression on
    standardised features (features: array column, label: 0/1)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.select(key, F.col(label).cast("double").alias("label"),
                  array_to_vector(F.transform(features, lambda v: v.cast("double"))).alias("raw"))
    x = cut(stratified_folds(x, key, "label", k))
    out = None
    for fold in range(k):
        train, test = x.where(F.col("fold") != fold), x.where(F.col("fold") == fold)
        n, n1 = train.agg(F.count(F.lit(1)), F.sum("label")).first()
        weight = F.when(F.col("label") == 1.0, n / (2.0 * n1)).otherwise(n / (2.0 * (n - n1)))
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(train)
        # weights sum to n; the second factor turns sample into population deviation
        reg = 1.0 / (c * n) * (n - 1) / n
        lr = LogisticRegression(weightCol="w", regParam=reg, elasticNetParam=0.0, standardization=False,
                                maxIter=max_iter, tol=1e-8)
        model = lr.fit(scaler.transform(train).withColumn("w", weight))
        scored = model.transform(scaler.transform(test)).select(
            key, "label", "fold", vector_to_array("rawPrediction")[1].alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out
