"""Clouds as streams: operators without statistics of whole clouds run on ``readStream`` unchanged; voxel tables are running
aggregates. Operators that need a cloud's minimum, mean or neighbours are batch operators and refuse a stream in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from timberline.operators.voxel import voxel_table
from timberline.schema import POINT_SCHEMA


def stream_points(spark: SparkSession, directory: str, files_per_trigger: int = 16) -> DataFrame:
    """Points of Parquet files in the point schema, as they arrive in a directory."""
    return spark.readStream.schema(POINT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def stream_voxels(stream: DataFrame, size: float, checkpoint: str, name: str) -> StreamingQuery:
    """Keep the voxel table of all points so far in a memory table; state is one row of sums for each voxel."""
    return voxel_table(stream, size).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
