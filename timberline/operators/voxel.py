"""Voxel grids: cell assignment, cell tables, lookups and distances between layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.columns import min_max
from timberline.operators.base import attach
from timberline.operators.spatial import knn_join
from timberline.storage import materialise

CELL = ["vx", "vy", "vz"]
KEYS = ["cloud_id", *CELL]
MEANS = ["mean_intensity", "mean_r", "mean_g", "mean_b", "mean_illuminance", "mean_gps_time"]
NORMALS = ["mean_normals_x", "mean_normals_y", "mean_normals_z"]


def voxelize(df: DataFrame, size: float) -> DataFrame:
    """Add the cell of each point: vx, vy, vz as ints."""
    return df.withColumns({v: F.floor(F.col(c) / size).cast("int") for v, c in zip(CELL, "xyz", strict=True)})


def voxel_table(df: DataFrame, size: float) -> DataFrame:
    """One row for each cell that holds points: counts, means, centroid, the most common label (the smallest on ties)."""
    have = set(df.columns)
    mean = lambda c, n: (F.avg(c) if c in have else F.lit(None).cast("double")).alias(n)
    aggs = [F.count("*").alias("num_points"), mean("intensity", "mean_intensity"), *[mean(c, f"mean_{c}") for c in "rgb"], mean("illuminance", "mean_illuminance"), mean("gps_time", "mean_gps_time")]
    aggs += [mean(f"n{c}", f"mean_normals_{c}") for c in "xyz"] + [F.avg(c).alias(f"centroid_{c}") for c in "xyz"]
    label = F.mode(F.col("original_cloud_index").cast("long"), deterministic=True) if "original_cloud_index" in have else F.lit(None).cast("long")
    first = F.min("point_id").alias("first_point")
    return voxelize(df, size).groupBy(*KEYS).agg(*aggs, label.alias("label"), first)


def medoids(df: DataFrame, size: float) -> DataFrame:
    """The point nearest to the centre of its cell, the least id on ties."""
    d = sum(((F.col(c) - (F.col(v) + 0.5) * size) * (F.col(c) - (F.col(v) + 0.5) * size) for v, c in zip(CELL, "xyz", strict=True)), F.lit(0.0))
    of = F.min(F.struct(d.alias("d2"), "point_id", "x", "y", "z")).alias("of")
    return voxelize(df, size).groupBy(*KEYS).agg(of).select(*KEYS, "of.point_id", "of.x", "of.y", "of.z", F.sqrt("of.d2").alias("distance"))


def voxel_centers(voxels: DataFrame, size: float) -> DataFrame:
    return voxels.withColumns({f"center_{c}": (F.col(v) + 0.5) * size for v, c in zip(CELL, "xyz", strict=True)})


def layer_select(voxels: DataFrame, layer: int, dimension: str = "vz") -> DataFrame:
    return voxels.where(F.col(dimension) == layer)


def voxel_at(voxels: DataFrame, i: int, j: int, k: int) -> DataFrame:
    return voxels.where((F.col("vx") == i) & (F.col("vy") == j) & (F.col("vz") == k))


def voxel_by_position(voxels: DataFrame, position: int) -> DataFrame:
    """The voxel met as number ``position`` (from 0) when the points are read in order."""
    place = F.row_number().over(Window.partitionBy("cloud_id").orderBy("first_point", *CELL)) - 1
    return voxels.withColumn("position", place).where(F.col("position") == position)


def voxel_text(voxels: DataFrame) -> DataFrame:
    """A printable form of each voxel."""
    return voxels.withColumn("text", F.format_string("Voxel(grid_index=(%d, %d, %d), points=%d)", *CELL, "num_points"))


def normalized_voxels(voxels: DataFrame) -> DataFrame:
    """Counts and means to [0, 1] over all voxels of a cloud, nulls to 0; distance, normals and label stay."""
    scaled = ["num_points", *MEANS]
    wide = attach(voxels, "cloud_id", **{f"_{e}_{c}": f(c) for c in scaled for e, f in (("lo", F.min), ("hi", F.max))})
    new = {c: min_max(F.col(c).cast("double"), F.col(f"_lo_{c}").cast("double"), F.col(f"_hi_{c}").cast("double")) for c in scaled}
    filled = {c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in [*NORMALS, "distance"] if c in voxels.columns}
    return wide.withColumns(new | filled).select(*voxels.columns)


def distances_to_coordinate(voxels: DataFrame, trees: DataFrame, size: float) -> DataFrame:
    """Distance of each voxel centre of layer 0 to its tree's coordinate at height 0. ``trees``: cloud_id, coord_x, coord_y."""
    at = voxel_centers(layer_select(voxels, 0), size).join(trees.select("cloud_id", "coord_x", "coord_y"), "cloud_id")
    dx, dy = F.col("center_x") - F.col("coord_x"), F.col("center_y") - F.col("coord_y")
    return at.select(*KEYS, F.sqrt(dx * dx + dy * dy + F.col("center_z") * F.col("center_z")).alias("distance"))


def distances_to_previous_layer(voxels: DataFrame, trees: DataFrame, size: float) -> DataFrame:
    """Every voxel with its distance, in voxels, to the nearest trunk voxel (label 0) of the next lower layer that has one.

    Layer 0 is measured to the coordinate; layers below 0, and those above with no trunk voxel under them, stay null. The
    layer below is an as-of join on the distinct layers, a small table; the nearest voxel in it comes from a join on cells
    that grow where nothing is near, so no voxel meets a whole layer."""
    trunk = voxels.where((F.col("label") == 0) & (F.col("vz") >= 0))
    layers = voxels.groupBy("cloud_id", "vz").agg(F.max((F.col("label") == 0).cast("int")).alias("has"))
    below = F.last(F.when((F.col("has") == 1) & (F.col("vz") >= 0), F.col("vz")), ignorenulls=True).over(Window.partitionBy("cloud_id").orderBy("vz").rowsBetween(Window.unboundedPreceding, -1))
    previous = layers.select("cloud_id", "vz", below.alias("previous")).where("vz > 0 and previous is not null")
    layer = lambda z: F.concat_ws("/", F.col("cloud_id").cast("string"), F.col(z).cast("string"))
    place = lambda x, y: F.shiftleft(F.col(x).cast("long"), 32).bitwiseOR(F.col(y).cast("long").bitwiseAND(0xFFFFFFFF))
    flat = [F.col("vx").cast("double").alias("x"), F.col("vy").cast("double").alias("y"), F.lit(0.0).alias("z")]
    upper = materialise(voxels.select(*KEYS).join(previous, ["cloud_id", "vz"]).withColumns({"_layer": layer("previous"), "_id": place("vx", "vy")}), "upper")
    queries = upper.select(F.col("_layer").alias("cloud_id"), F.col("_id").alias("point_id"), *flat).distinct()
    lower = trunk.select(layer("vz").alias("cloud_id"), place("vx", "vy").alias("point_id"), *flat)
    near = knn_join(queries, lower, 1, cell=4.0).select(F.col("cloud_id").alias("_layer"), F.col("query_id").alias("_id"), "d2")
    rise = (F.col("vz") - F.col("previous")).cast("double")
    found = upper.join(near, ["_layer", "_id"]).select(*KEYS, F.sqrt(F.col("d2") + rise * rise).alias("distance"))
    ground = distances_to_coordinate(voxels, trees, size).withColumn("distance", F.col("distance") / size)
    measured = found.unionByName(ground)
    return voxels.drop("distance").join(measured, KEYS, "left")
