"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or one in the warehouse where none is set: both are shared by all machines."""
    path = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/timberline-tables"
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame to the shared folder and read it back, which ends its lineage; executors may come and go."""
    path = scratch(df.sparkSession, f"timberline-{name}")
    df.write.option("compression", "zstd").parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._held_at = path
    return held


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise``, once nothing that is still to run reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._held_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
