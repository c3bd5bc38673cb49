"""Session helpers: settings the operators rely on, and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are written for."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one run, below the folder the cluster names in spark.checkpoint.dir.

    Only a local-mode session may fall back to a temporary folder; a cluster without the
    setting is an error, because executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="insight-spark-")
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, purpose, uuid.uuid4().hex)


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    Cuts the lineage with one computation and survives the loss of executors.
    """
    path = shared_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

