"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on machines that share this file system import the package; elsewhere use --py-files."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Without one, a folder under the warehouse on one machine (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; lineage ends there, so a lost executor takes nothing along."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
