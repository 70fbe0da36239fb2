"""Tables that are worked out once and read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, spark.checkpoint.dir. Where none is set a local session gets a temporary
    one; on a cluster that is an error, for executors could not read back what others wrote."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="gamelode-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: later plans start at it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
