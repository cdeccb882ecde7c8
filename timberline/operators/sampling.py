"""Farthest point sampling, shuffles and augmentations. Random draws are hashes of seed and ids, so they don't depend on
partitioning; every transformation also takes its parameters as columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.columns import clip, normal, uniform

XYZ = ["x", "y", "z"]
NORMALS = ["nx", "ny", "nz"]
#: Ranges that a shuffle of clouds is sorted in.
SLICES = 4096


def farthest_indices(xyz: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    """n indices, each the farthest from those before it; ties go to the least index. Beyond the number of points they repeat."""
    left = np.full(len(xyz), 1e10)
    out = np.empty(n, np.int64)
    at = start
    for k in range(n):
        out[k] = at
        step = xyz - xyz[at]
        np.minimum(left, np.einsum("ij,ij->i", step, step), out=left)
        at = int(left.argmax())
        if left[at] == 0:  # every place is taken: the rest is the first point
            out[k + 1 :] = at
            break
    return out


def farthest_points(df: DataFrame, n: int, start: int = 0) -> DataFrame:
    """cloud_id, rank, point_id of n farthest points of each cloud, from the ``start``-th id on. A cloud is one group: tile large scans first."""

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", ignore_index=True)
        own = farthest_indices(pdf[XYZ].to_numpy(float), n, min(start, len(pdf) - 1))
        return pd.DataFrame({"cloud_id": pdf["cloud_id"].iloc[0], "rank": np.arange(n, dtype=np.int32), "point_id": pdf["point_id"].to_numpy()[own]})

    kind = df.schema["cloud_id"].dataType.simpleString()
    return df.select("cloud_id", "point_id", *XYZ).groupBy("cloud_id").applyInPandas(sample, f"cloud_id {kind}, rank int, point_id long")


def sample_fps(df: DataFrame, n: int, start: int = 0) -> DataFrame:
    """The sampled points with all their fields and their rank."""
    return farthest_points(df, n, start).join(df, ["cloud_id", "point_id"])


def shuffle_clouds(clouds: DataFrame, seed: int, draw: Column | None = None) -> DataFrame:
    """Add a random position to each cloud of a one-row-per-cloud frame, whatever the partitioning.

    The draws are dealt into SLICES equal ranges; each is sorted by itself, after the counts of those before it."""
    drawn = clouds.withColumn("_u", uniform(seed, "cloud_id") if draw is None else draw).withColumn("_slice", F.floor(F.col("_u") * SLICES))
    counts = drawn.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = counts.select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # at most SLICES rows
    place = F.row_number().over(Window.partitionBy("_slice").orderBy("_u", "cloud_id")) - 1
    return drawn.join(F.broadcast(before), "_slice").select(*clouds.columns, (F.col("_before") + place).alias("position"))


def shuffle_points(df: DataFrame, seed: int, draw: Callable[[Column], Column] | None = None) -> DataFrame:
    """The same permutation of positions for all clouds: new point ids 0, 1, ... in each. ``draw`` makes the number to sort a position by.

    Positions are longs, so that a draw may multiply them; points that share an id come by their place."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy("cloud_id").orderBy("point_id", "z", "x", "y")).cast("long") - 1)
    order = F.row_number().over(Window.partitionBy("cloud_id").orderBy(uniform(seed, "_k") if draw is None else draw(F.col("_k")), "_k")) - 1
    return ranked.withColumn("point_id", order.cast("long")).drop("_k")


def _turned(df: DataFrame, rows: list[list[Column]], normals: bool) -> DataFrame:
    """Row vectors times a matrix of columns."""
    new = {}
    for names in [XYZ, *([NORMALS] if normals else [])]:
        new |= {names[j]: F.col(names[0]) * rows[0][j] + F.col(names[1]) * rows[1][j] + F.col(names[2]) * rows[2][j] for j in range(3)}
    return df.withColumns(new)


def _angle(angle: Column | float | None, seed: int | None) -> Column:
    if angle is None:
        return uniform(seed or 0, "cloud_id", stream=1) * (2 * np.pi)
    return angle if isinstance(angle, Column) else F.lit(float(angle))


def rotate_y(df: DataFrame, angle: Column | float | None = None, seed: int | None = None, normals: bool = False) -> DataFrame:
    """Turn each cloud about the y axis: x' = x cos - z sin, z' = x sin + z cos; a random angle for each cloud if none is given."""
    a = _angle(angle, seed)
    c, s, o, i = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    return _turned(df, [[c, o, s], [o, i, o], [-s, o, c]], normals)


def rotate_z(df: DataFrame, angle: Column | float | None = None, seed: int | None = None, normals: bool = False) -> DataFrame:
    """Turn each cloud about the z axis: x' = x cos - y sin, y' = x sin + y cos."""
    a = _angle(angle, seed)
    c, s, o, i = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    return _turned(df, [[c, s, o], [-s, c, o], [o, o, i]], normals)


def rotate_perturbation(df: DataFrame, angles: tuple[Column | float, ...] | None = None, seed: int = 0, sigma: float = 0.06, bound: float = 0.18, normals: bool = False) -> DataFrame:
    """Small turns about the three axes, row vectors times Rz Ry Rx; normal angles within bounds for each cloud if none are given."""
    if angles is None:
        angles = tuple(clip(normal(seed, "cloud_id", stream=k) * sigma, bound) for k in range(3))
    (cx, sx), (cy, sy), (cz, sz) = [(F.cos(a), F.sin(a)) for a in (a if isinstance(a, Column) else F.lit(float(a)) for a in angles)]
    o, i = F.lit(0.0), F.lit(1.0)
    rx, ry, rz = [[i, o, o], [o, cx, -sx], [o, sx, cx]], [[cy, o, sy], [o, i, o], [-sy, o, cy]], [[cz, -sz, o], [sz, cz, o], [o, o, i]]
    times = lambda a, b: [[a[r][0] * b[0][c] + a[r][1] * b[1][c] + a[r][2] * b[2][c] for c in range(3)] for r in range(3)]
    return _turned(df, times(times(rz, ry), rx), normals)


def shift(df: DataFrame, offsets: tuple[Column | float, ...] | None = None, seed: int = 0, reach: float = 0.1) -> DataFrame:
    """Move each cloud; by up to ``reach`` on each axis if no offsets are given."""
    if offsets is None:
        offsets = tuple((uniform(seed, "cloud_id", stream=10 + k) * 2 - 1) * reach for k in range(3))
    return df.withColumns({c: F.col(c) + o for c, o in zip(XYZ, offsets, strict=True)})


def scale(df: DataFrame, factor: Column | float | None = None, seed: int = 0, low: float = 0.8, high: float = 1.25) -> DataFrame:
    """Stretch each cloud by one factor."""
    f = uniform(seed, "cloud_id", stream=20) * (high - low) + low if factor is None else factor
    return df.withColumns({c: F.col(c) * f for c in XYZ})


def jitter(df: DataFrame, seed: int = 0, sigma: float = 0.01, bound: float = 0.05, noise: tuple[Column, ...] | None = None) -> DataFrame:
    """Move each point by normal noise within bounds."""
    if bound <= 0:
        raise ValueError("bound must be positive")
    noise = noise or tuple(normal(seed, "cloud_id", "point_id", stream=30 + k) * sigma for k in range(3))
    return df.withColumns({c: F.col(c) + clip(e, bound) for c, e in zip(XYZ, noise, strict=True)})


def dropout(df: DataFrame, ratio: Column | float | None = None, seed: int = 0, most: float = 0.875, draw: Column | None = None) -> DataFrame:
    """Put dropped points where the cloud's first point is; the number of points stays."""
    part = uniform(seed, "cloud_id", stream=40) * most if ratio is None else ratio
    u = uniform(seed, "cloud_id", "point_id", stream=41) if draw is None else draw
    first = df.groupBy("cloud_id").agg(F.min(F.struct("point_id", *XYZ)).alias("_first"))
    wide = df.join(first, "cloud_id")
    return wide.withColumns({c: F.when(u <= part, F.col(f"_first.{c}")).otherwise(F.col(c)) for c in XYZ}).select(*df.columns)


def augment(df: DataFrame, seed: int = 0, angle: Column | float | None = None, ratio: Column | float | None = None, draw: Column | None = None) -> DataFrame:
    """A random turn about z, then dropout of at most a tenth."""
    return dropout(rotate_z(df, angle, seed=seed), ratio, seed=seed, most=0.1, draw=draw)
