"""Tree metrics: trunk isolation, diameters, coordinates, lean, and one inventory row for each tree."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.columns import angle_between
from timberline.operators.base import attach
from timberline.operators.circle import circles
from timberline.operators.clustering import cluster_points
from timberline.operators.points import height_band, intensity_cut
from timberline.operators.spatial import lof_inliers
from timberline.schema import TREE_SCHEMA
from timberline.scoring import geometric_score, score_clusters
from timberline.storage import materialise

WIDEST, LOOSE = 0.65, 2.1


def heights(df: DataFrame) -> DataFrame:
    return df.groupBy("cloud_id").agg((F.max("z") - F.min("z")).alias("height"))


def boxes(df: DataFrame) -> DataFrame:
    return df.groupBy("cloud_id").agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def trunk_slice(df: DataFrame, height: float = 3.0, intensity: float = 5000.0, scorer: Callable[[np.ndarray], float] = geometric_score, min_cluster: int = 10, more_than: int = 100) -> tuple[DataFrame, DataFrame]:
    """Trunk points of each cloud, and (cloud_id, status).

    The lowest ``height`` metres above the intensity cut are clustered; of clusters of more than ``more_than`` points the
    most probable one that is tall enough and starts near the ground is the trunk, without its local outliers. If none
    qualifies the whole slice is taken (``no_candidate``), and without two distinct labels it is left as it is
    (``no_clusters``), as is that of a cloud which can't be clustered (``error``); a cloud without points in the slice has
    status ``no_points``."""
    band = intensity_cut(height_band(df, height), intensity)
    labelled = materialise(cluster_points(band, min_cluster), "clusters")  # the groups run once
    counts = labelled.groupBy("cloud_id").agg(F.min("z").alias("low"), F.count_distinct("cluster").alias("labels"), F.bool_or(F.col("cluster").isNull()).alias("failed"))
    sized = labelled.where("cluster >= 0").groupBy("cloud_id", "cluster").agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax")).where(F.col("n") > more_than)
    scored = score_clusters(labelled.join(sized.select("cloud_id", "cluster"), ["cloud_id", "cluster"], "left_semi"), scorer)
    gated = scored.join(sized, ["cloud_id", "cluster"]).join(counts, "cloud_id").where((F.col("probability") > 0) & (F.col("zmax") - F.col("zmin") > height / 2) & (F.col("zmin") - F.col("low") < 0.25))
    first = gated.withColumn("k", F.row_number().over(Window.partitionBy("cloud_id").orderBy(F.desc("probability"), "cluster"))).where("k = 1").select("cloud_id", F.col("cluster").alias("chosen"))
    status = df.select("cloud_id").distinct().join(counts.select("cloud_id", "labels", "failed"), "cloud_id", "left").join(first, "cloud_id", "left")
    status = status.select("cloud_id", "chosen", F.when(F.col("labels").isNull(), "no_points").when(F.col("failed"), "error").when(F.col("labels") <= 1, "no_clusters").when(F.col("chosen").isNull(), "no_candidate").otherwise("ok").alias("status"))
    status = materialise(status, "status")
    judged = labelled.join(status, "cloud_id")
    early = judged.where("status in ('no_clusters', 'error')").select(*band.columns)
    picked = judged.where("status = 'no_candidate' or (status = 'ok' and cluster = chosen)").select(*band.columns)
    return early.unionByName(lof_inliers(picked)), status.select("cloud_id", "status")


def slab_fits(trunk: DataFrame, method: str, layers: int = 10) -> DataFrame:
    """Circle of each of ``layers`` equal slabs of a trunk; the topmost point lies in none."""
    wide = attach(trunk, "cloud_id", _lo=F.min("z"), _hi=F.max("z"))
    step = (F.col("_hi") - F.col("_lo")) / layers
    layer = F.floor((F.col("z") - F.col("_lo")) / F.nullif(step, F.lit(0.0))).cast("int")
    return circles(wide.withColumn("layer", layer).where(F.col("layer").between(0, layers - 1)), ["cloud_id", "layer"], method)


def breast_fits(trunk: DataFrame, method: str, low: float = 1.3, high: float = 1.4) -> DataFrame:
    wide = attach(trunk, "cloud_id", _lo=F.min("z"))
    return circles(wide.where((F.col("z") >= F.col("_lo") + low) & (F.col("z") < F.col("_lo") + high)), ["cloud_id"], method)


def diameters(trunk: DataFrame, layers: int = 10, koef: float = 1.05, low: float = 1.3, high: float = 1.4, methods: tuple[str, str] = ("ls", "hyper")) -> DataFrame:
    """Breast-height diameters in centimetres by two fits: cloud_id, diameter_ls, diameter_hls, r_median_ls, r_median_hls.

    The radius is the least of the slabs' (0 if one has no circle by either fit), or that of the slab at breast height if
    that is larger by a factor between koef and koef + 0.1. A radius of 0, above 0.65, or above 2.1 times a quarter of the
    trunk's extents gives way to that quarter."""
    slabs = reduce(lambda a, b: a.join(b, ["cloud_id", "layer"], "outer"), [slab_fits(trunk, m, layers).select("cloud_id", "layer", F.col("r").alias(f"r{k}")) for k, m in enumerate(methods)])
    ok = F.col("r0").isNotNull() & F.col("r1").isNotNull()
    least = slabs.groupBy("cloud_id").agg(F.sum(ok.cast("int")).alias("good"), *[F.min(f"r{k}").alias(f"least{k}") for k in (0, 1)], *[F.percentile(F.when(ok, F.col(f"r{k}")).otherwise(0.0), 0.5).alias(f"median{k}") for k in (0, 1)])
    breast = reduce(lambda a, b: a.join(b, "cloud_id", "outer"), [breast_fits(trunk, m, low, high).select("cloud_id", F.col("r").alias(f"b{k}")) for k, m in enumerate(methods)])
    extents = trunk.groupBy("cloud_id").agg((((F.max("x") - F.min("x")) + (F.max("y") - F.min("y"))) / 4.0).alias("quarter"))
    wide = extents.join(least, "cloud_id", "left").join(breast, "cloud_id", "left")
    out = []
    for k, name in enumerate(("ls", "hls")):
        r = F.when(F.coalesce("good", F.lit(0)) == layers, F.col(f"least{k}")).otherwise(0.0)
        b = F.when(F.col("b0").isNotNull() & F.col("b1").isNotNull(), F.col(f"b{k}")).otherwise(0.0)
        r = F.when((b > koef * r) & (b < (koef + 0.1) * r), b).otherwise(r)
        r = F.when((r > WIDEST) | (r > LOOSE * F.col("quarter")) | (r == 0), F.col("quarter")).otherwise(r)
        out += [F.round(200.0 * r, 2).alias(f"diameter_{name}"), F.coalesce(f"median{k}", F.lit(0.0)).alias(f"r_median_{name}")]
    return wide.select("cloud_id", *out)


def coordinates(trunk: DataFrame, low: float = 0.0, high: float = 0.6, error: float = 0.2, method: str = "ls", prefix: str = "coord", exact: bool = False) -> DataFrame:
    """Axis position of each trunk: the circle of [low, low + high) above the ground, or the mean of all below ``high`` if that is farther off than ``error``.

    With ``exact`` the circle window is [low, high). Heights: the middle of ``low`` and ``high``. No circle: nulls."""
    wide = attach(trunk, "cloud_id", _lo=F.min("z"))
    top = high if exact else low + high
    ring = circles(wide.where((F.col("z") >= F.col("_lo") + low) & (F.col("z") < F.col("_lo") + top)), ["cloud_id"], method)
    mass = wide.where(F.col("z") < F.col("_lo") + high).groupBy("cloud_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    base = trunk.groupBy("cloud_id").agg(F.min("z").alias("lo"))
    both = base.join(ring, "cloud_id", "left").join(mass, "cloud_id", "left")
    off = F.sqrt((F.col("xc") - F.col("mx")) * (F.col("xc") - F.col("mx")) + (F.col("yc") - F.col("my")) * (F.col("yc") - F.col("my")))
    pick = lambda c, m: F.when(off > error, F.col(m)).otherwise(F.col(c))
    return both.select("cloud_id", pick("xc", "mx").alias(f"{prefix}_x"), pick("yc", "my").alias(f"{prefix}_y"), F.when(F.col("xc").isNotNull(), F.col("lo") + ((high - low) / 2.0 + low)).alias(f"{prefix}_z"))


def lean(trunk: DataFrame, method: str = "ls", exact: bool = False) -> DataFrame:
    """Both coordinates of each trunk and the angle of the axis through them to the vertical: lean_deg, lean_tan, lean_cos.

    The upper window is [1, 2.6) by default, at a height put at 1.3; ``exact`` takes [1, 1.6)."""
    both = coordinates(trunk, method=method).join(coordinates(trunk, 1.0, 1.6, method=method, prefix="custom", exact=exact), "cloud_id")
    axis = [F.col(f"custom_{c}") - F.col(f"coord_{c}") for c in "xyz"]
    angled = both.withColumn("lean_deg", angle_between(axis, [F.lit(0.0), F.lit(0.0), F.lit(1.0)]))
    return angled.withColumns({"lean_tan": F.tan(F.radians("lean_deg")), "lean_cos": F.cos(F.radians("lean_deg"))})


def inventory(df: DataFrame, names: DataFrame | None = None, method: str = "ls", **trunk_options) -> DataFrame:
    """One row of the tree schema for each cloud. ``names``: cloud_id, name."""
    trunk, status = trunk_slice(df, **trunk_options)
    trunk = materialise(trunk, "trunk")
    rows = heights(df).join(status, "cloud_id").join(diameters(trunk, methods=(method, "hyper")), "cloud_id", "left").join(lean(trunk, method), "cloud_id", "left")
    rows = rows.join(names, "cloud_id", "left") if names is not None else rows.withColumn("name", F.col("cloud_id"))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in TREE_SCHEMA])
