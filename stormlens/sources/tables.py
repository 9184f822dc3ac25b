"""Catalog tables on disk: shards, resumable units, listings and document sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlens.schemas import CATALOG


def write_table(df: DataFrame, root: str, name: str) -> str:
    """Write one catalog table with its registered partitioning."""
    if name not in CATALOG:
        raise KeyError(f"unknown catalog table {name}")
    path, keys = f"{root}/{name}", CATALOG[name]
    w = df.write.mode("overwrite")
    (w.partitionBy(*keys) if keys else w).parquet(path)
    return path


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def balanced(scan: DataFrame) -> DataFrame:
    """Spread a file scan that has fewer splits than there are cores.

    Meant for a few unsplittable files read by costly work. A cluster-size input has more
    splits than cores, and then nothing is added. Only for plain scans.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def write_shards(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the shards (partitions) present in `df`; units without rows write nothing."""
    (df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def mark_done(units: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Note finished units. Each has a folder of its own, replaced when the unit is run again."""
    write_shards(units.withColumn("done", F.lit(True)), path, keys or units.columns)


def upload_listing(telemetry: DataFrame) -> DataFrame:
    """Rows of metric 'upload' with the last path segment of their url as filename."""
    from stormlens.functions.text import upload_name
    return telemetry.where("name = 'upload'").withColumn("filename", upload_name("url"))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def strike_documents(strikes: DataFrame, nodes: DataFrame) -> DataFrame:
    """One JSON document per strike with the positions of the nodes that ranged it."""
    heard = strikes.select("t_strike", F.explode(F.map_keys("ranges")).alias("vsn")).join(
        nodes.select("vsn", "lat", "lon"), "vsn")
    at = heard.groupBy("t_strike").agg(F.array_sort(F.collect_list(F.struct("vsn", "lat", "lon"))).alias("nodes"))
    x = strikes.join(at, "t_strike", "left")
    return x.select(F.to_json(F.struct(*x.columns)).alias("value"))


def write_documents(docs: DataFrame, path: str, batch_id: int | None = None) -> None:
    """JSON lines; a streaming batch replaces its own folder on a retry."""
    docs.write.mode("overwrite").text(path if batch_id is None else f"{path}/batch={batch_id}")
