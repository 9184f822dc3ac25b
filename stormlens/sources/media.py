"""Media indexes from file trees, image sources and clip tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlens.operators.signal import image_stats, mono

# Media file extensions.
MEDIA_EXTENSIONS = ["flac", "wav", "jpg", "jpeg", "png"]


def index_paths(paths: DataFrame, path: str, root: str) -> DataFrame:
    """(time_us, vsn, task, path, filename) of media files named by a nanosecond time.

    Layouts: <vsn>/<task>/... and cache/<job>/..., where the job name without its trailing
    number is the task. Other files are skipped.
    """
    rel = F.col(path) if not root else F.substring(F.col(path), F.lit(len(root.rstrip("/")) + 2), F.length(path))
    x = paths.select(F.col(path).alias("path"), F.split(rel, "/").alias("p"))
    name = F.element_at("p", -1)
    x = x.withColumn("filename", name).withColumn("ns", F.regexp_extract(name, r"^(\d{16,19})", 1))
    ext = F.lower(F.substring_index("filename", ".", -1))
    x = x.where(ext.isin(MEDIA_EXTENSIONS) & F.contains("filename", F.lit(".")) & (F.col("ns") != ""))
    n, cache = F.size("p"), F.col("p")[0] == "cache"
    vsn = F.when(cache, "").otherwise(F.when(n > 1, F.col("p")[0]).otherwise(""))
    task = F.when(cache, F.when(n > 1, F.regexp_replace(F.get("p", F.lit(1)), r"-\d+$", "")).otherwise("?")).otherwise(
        F.when(n > 2, F.get("p", F.lit(1))).otherwise("?"))
    us = F.expr("cast(ns as decimal(20,0)) div 1000")
    return x.select(us.cast("bigint").alias("time_us"), vsn.alias("vsn"), task.alias("task"), "path", "filename")


def media_index(spark: SparkSession, root: str) -> DataFrame:
    """Index of a file tree; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "file:" + root if root.startswith("/") else root
    return index_paths(files.select("path"), "path", base)


def frame_index(spark: SparkSession, root: str, task: str) -> DataFrame:
    """Frames with the epoch seconds of their stem, else the file's modification time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    t = F.coalesce(F.expr("try_cast(s as double)"), F.unix_micros("modificationTime") / 1e6)
    return files.withColumn("s", stem).select("path", t.alias("time_epoch"), F.lit(task).alias("task"))


def frame_series(spark: SparkSession, root: str) -> DataFrame:
    """Luma and channel statistics of an image folder through the image source."""
    return image_stats(spark.read.format("image").option("recursiveFileLookup", "true").load(root))


def clip_table(df: DataFrame, channels: str, sr: str) -> DataFrame:
    """Multi-channel clips as mono `samples`."""
    rest = [c for c in df.columns if c not in (channels, sr)]
    return df.select(*rest, mono(channels).alias("samples"), F.col(sr).alias("sr"))


def case_media(uploads: DataFrame, case_nodes: list[str], task_regex: str, t0: int, t1: int) -> DataFrame:
    """Uploads of a case's nodes and tasks, window inclusive at both ends."""
    return uploads.where(F.col("vsn").isin(case_nodes) & F.col("task").rlike(task_regex) & F.col("t").between(t0, t1))
