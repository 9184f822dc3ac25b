"""Session defaults and the one way lineage is cut."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stormlens", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators rely on (UTC, AQE, skew handling)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # files of checkpoints that nothing refers to any more are removed
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # costly rows (solvers, regexes) make small partitions worth keeping
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which import it by name, whatever folder they start in.

    Also for sessions that were not made here; done once a session.
    """
    if getattr(spark, "_stormlens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.addPyFile(shutil.make_archive(
        os.path.join(folder, "stormlens"), "zip", os.path.dirname(package), os.path.basename(package)))
    spark._stormlens_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and continue from the files.

    Used where a table feeds several later stages (so that it is computed once) and
    in iterative operators (so that lineage does not grow). The files survive the
    loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
