"""Shifts and scalings of clouds; every statistic is a partial aggregate joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.columns import min_max, nan_to_zero, ratio
from timberline.operators.base import attach

XYZ = ["x", "y", "z"]
SCALED = ["intensity", "original_cloud_index", "gps_time", "illuminance"]


def shift_to_origin(df: DataFrame) -> DataFrame:
    """Subtract the mean of each axis."""
    wide = attach(df, "cloud_id", **{f"_{c}": F.avg(c) for c in XYZ})
    return wide.withColumns({c: F.col(c) - F.col(f"_{c}") for c in XYZ}).select(*df.columns)


def shift_to_zero(df: DataFrame) -> DataFrame:
    """Subtract the least of each axis."""
    wide = attach(df, "cloud_id", **{f"_{c}": F.min(c) for c in XYZ})
    return wide.withColumns({c: F.col(c) - F.col(f"_{c}") for c in XYZ}).select(*df.columns)


def shift_to_coordinate(df: DataFrame, trees: DataFrame, prefix: str = "coord") -> DataFrame:
    """Subtract each tree's coordinate."""
    wide = df.join(trees.select("cloud_id", *[F.col(f"{prefix}_{c}").alias(f"_{c}") for c in XYZ]), "cloud_id")
    return wide.withColumns({c: F.col(c) - F.col(f"_{c}") for c in XYZ}).select(*df.columns)


def nans_to_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: nan_to_zero(F.col(c)) for c in names})


def normalize_fields(df: DataFrame, per_axis: bool = False) -> DataFrame:
    """Min-max of every field to [0, 1]; x, y, z share one range and r, g, b another, unless ``per_axis``. Constants become 0."""
    groups = [[c] for c in [*XYZ, "r", "g", "b"]] if per_axis else [XYZ, ["r", "g", "b"]]
    groups += [[c] for c in SCALED if c in df.columns]
    names = [c for g in groups for c in g]
    wide = attach(df, "cloud_id", **{f"_{e}_{c}": f(c) for c in names for e, f in (("lo", F.min), ("hi", F.max))})
    new = {}
    for g in groups:
        low = F.least(*[F.col(f"_lo_{c}") for c in g]) if len(g) > 1 else F.col(f"_lo_{g[0]}")
        high = F.greatest(*[F.col(f"_hi_{c}") for c in g]) if len(g) > 1 else F.col(f"_hi_{g[0]}")
        new |= {c: nan_to_zero(min_max(F.col(c).cast("double"), low.cast("double"), high.cast("double"))) for c in g}
    return wide.withColumns(new).select(*df.columns)


def pc_normalize(df: DataFrame) -> DataFrame:
    """Centre by the mean and divide by the greatest radius."""
    centred = shift_to_origin(df)
    radius = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    wide = attach(centred, "cloud_id", _far=F.max(radius))
    return wide.withColumns({c: ratio(F.col(c), F.col("_far")) for c in XYZ}).select(*df.columns)


def minmax_normalize(df: DataFrame) -> DataFrame:
    """Each axis of a cloud to [-1, 1]."""
    wide = attach(df, "cloud_id", **{f"_{e}{c}": f(c) for c in XYZ for e, f in (("lo", F.min), ("hi", F.max))})
    return wide.withColumns({c: ratio((F.col(c) - F.col(f"_lo{c}")) * 2.0, F.col(f"_hi{c}") - F.col(f"_lo{c}")) - 1.0 for c in XYZ}).select(*df.columns)


def tree_normalize(df: DataFrame) -> DataFrame:
    """x and y less their means, z less the middle of its range, all over half the range of z."""
    wide = attach(df, "cloud_id", _x=F.avg("x"), _y=F.avg("y"), _lo=F.min("z"), _hi=F.max("z"))
    half = (F.col("_hi") - F.col("_lo")) / 2.0
    new = {"x": F.col("x") - F.col("_x"), "y": F.col("y") - F.col("_y"), "z": F.col("z") - (F.col("_hi") + F.col("_lo")) / 2.0}
    return wide.withColumns({c: ratio(v, half) for c, v in new.items()}).select(*df.columns)
