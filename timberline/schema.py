"""Schemas of points, voxels and trees, and the projection that brings a frame into the point schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _schema(columns: str) -> T.StructType:
    """A schema from names and types, without a session (workers import this module too)."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


POINT_SCHEMA = _schema(
    "cloud_id string, point_id bigint, x double, y double, z double, intensity double, r int, g int, b int, "
    "original_cloud_index double, gps_time double, illuminance double, nx double, ny double, nz double"
)
#: The ten columns of the flat view of a cloud (normals excluded).
FLAT_COLUMNS = ["x", "y", "z", "intensity", "r", "g", "b", "original_cloud_index", "gps_time", "illuminance"]
PADDED = ["intensity", "r", "g", "b", "original_cloud_index", "gps_time", "illuminance"]
TREE_SCHEMA = _schema(
    "cloud_id string, name string, height double, coord_x double, coord_y double, coord_z double, custom_x double, custom_y double, custom_z double, "
    "diameter_ls double, diameter_hls double, lean_deg double, lean_tan double, lean_cos double, status string"
)


def conform(df: DataFrame) -> DataFrame:
    """All columns of the point schema, in order and of its types; absent ones are null, others are dropped."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in POINT_SCHEMA])


def fill_missing(df: DataFrame) -> DataFrame:
    """Nulls in the optional attributes become zero, as every reader leaves them."""
    return df.withColumns({c: F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)) for c in PADDED if c in df.columns})


def flat(df: DataFrame) -> DataFrame:
    """The flat view: ten columns, no normals."""
    return df.select(*FLAT_COLUMNS)


def with_name(df: DataFrame, path: str = "path") -> DataFrame:
    """Add the tree's name: the base name of its path up to the first dot."""
    return df.withColumn("name", F.split(F.element_at(F.split(path, "/"), -1), r"\.")[0])
