"""Projections, filters, set operations and index joins on point frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.columns import pack_rgb, unpack_rgb
from timberline.operators.base import attach

XYZ = ["x", "y", "z"]


def update_field(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace one column, which must exist."""
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.withColumn(name, value)


def add_fields(df: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("cloud_id", "point_id")) -> DataFrame:
    """Join the columns of ``other`` by key; a name that both have is an error."""
    clash = (set(df.columns) & set(other.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return df.join(other, list(keys))


def encode_rgb(df: DataFrame, name: str = "rgb") -> DataFrame:
    return df.withColumn(name, pack_rgb(F.col("r"), F.col("g"), F.col("b")))


def decode_rgb(df: DataFrame, name: str = "rgb") -> DataFrame:
    return df.select("*", *unpack_rgb(F.col(name)))


def height_band(df: DataFrame, height: float = 3.0) -> DataFrame:
    """Points at most ``height`` above the lowest of their cloud, bounds included."""
    return attach(df, "cloud_id", _low=F.min("z")).where(F.col("z").between(F.col("_low"), F.col("_low") + height)).drop("_low")


def intensity_cut(df: DataFrame, least: float = 5000.0) -> DataFrame:
    return df.where(F.col("intensity") >= least)


def slab(df: DataFrame, low: float, high: float) -> DataFrame:
    """Points with z in [low, high) above the lowest of their cloud."""
    return attach(df, "cloud_id", _low=F.min("z")).where((F.col("z") >= F.col("_low") + low) & (F.col("z") < F.col("_low") + high)).drop("_low")


def select_points(df: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows named by ``indices`` (cloud_id, point_id, and rank if a point may come twice), in the order of rank."""
    if "rank" in indices.columns:
        return df.join(indices.select("cloud_id", "point_id", "rank"), ["cloud_id", "point_id"])
    return df.join(indices.select("cloud_id", "point_id"), ["cloud_id", "point_id"], "left_semi")


def unique_points(df: DataFrame, ordered: bool = False) -> DataFrame:
    """One point for each (cloud, x, y, z): the one of the least id, with its attributes. NaN equals NaN and -0 equals 0.

    With ``ordered`` the rows come sorted by cloud, x, y, z."""
    rest = [c for c in df.columns if c not in ("cloud_id", *XYZ)]
    first = F.min(F.struct("point_id", *[c for c in rest if c != "point_id"])).alias("of")
    found = df.groupBy("cloud_id", *XYZ).agg(first).select("cloud_id", *XYZ, "of.*").select(*df.columns)
    return found.orderBy("cloud_id", *XYZ) if ordered else found


def append(df: DataFrame, other: DataFrame) -> DataFrame:
    """All points of both; ids of ``other`` follow the greatest of the same cloud."""
    top = df.groupBy("cloud_id").agg(F.max("point_id").alias("_top"))
    moved = other.join(top, "cloud_id", "left").withColumn("point_id", F.col("point_id") + F.coalesce(F.col("_top") + 1, F.lit(0))).drop("_top")
    return df.unionByName(moved.select(*other.columns), allowMissingColumns=True)


def concatenate(df: DataFrame, other: DataFrame) -> DataFrame:
    """All records of two frames of the same columns."""
    if set(df.columns) != set(other.columns):
        raise ValueError("the columns differ")
    return df.unionByName(other)


def renumber(df: DataFrame) -> DataFrame:
    """Positions 0, 1, ... within each cloud, in the order of point_id; a cloud is sorted in one task, with spilling."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy("cloud_id").orderBy("point_id")) - 1)


def color_frame(df: DataFrame, field: str | None = None) -> DataFrame:
    """Points with colours in [0, 1]: r, g, b over 255, or a grey that spreads a field from its least to its greatest."""
    if field is None:
        return df.select(*df.columns, *[(F.col(c) / 255.0).alias(f"color_{c}") for c in "rgb"])
    wide = attach(df, "cloud_id", _lo=F.min(field), _hi=F.max(field))
    grey = F.coalesce((F.col(field) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    return wide.select(*df.columns, *[grey.alias(f"color_{c}") for c in "rgb"])


def with_center_distance(df: DataFrame) -> DataFrame:
    """Distance of each point to the centre of its cloud's bounding box."""
    wide = attach(df, "cloud_id", **{f"_{e}{c}": f(c) for c in XYZ for e, f in (("lo", F.min), ("hi", F.max))})
    off = [F.col(c) - (F.col(f"_lo{c}") + F.col(f"_hi{c}")) / 2 for c in XYZ]
    return wide.select(*df.columns, F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]).alias("center_distance"))


def circle_frame(trees: DataFrame, vertices: int = 100) -> DataFrame:
    """Vertices of each tree's circle: columns cloud_id, vertex, x, y, z from custom_x, custom_y, custom_z and diameter_ls (cm)."""
    turn = F.col("vertex") * (2 * 3.141592653589793 / vertices)
    radius = F.col("diameter_ls") / 200.0
    held = trees.select("cloud_id", "custom_x", "custom_y", "custom_z", "diameter_ls", F.explode(F.sequence(F.lit(0), F.lit(vertices - 1))).alias("vertex"))
    return held.select("cloud_id", "vertex", (F.col("custom_x") + radius * F.cos(turn)).alias("x"), (F.col("custom_y") + radius * F.sin(turn)).alias("y"), F.col("custom_z").alias("z"))
