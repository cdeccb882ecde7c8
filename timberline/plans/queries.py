"""Driver queries of the point-cloud operators, each over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline import fixtures, schema
from timberline.functions import columns as fn
from timberline.operators import circle, clustering, normalize, points, sampling, spatial, voxel
from timberline.plans import sql, trees
from timberline.plans.sql import r6, with_views
from timberline.scoring import score_clusters
from timberline.sources import files
from timberline.storage import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ID = ["cloud_id", "point_id"]
XYZ = ["x", "y", "z"]
SIZE = 5.0


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(*names: str | Column) -> list[Column]:
    return [(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) for n in names]


def r6s(names: list[str]) -> str:
    return ", ".join(r6(n, n) for n in names)


def mid(expressions: dict[str, str], stats: str, source: str = "cloud", keep: str = "") -> str:
    """SQL that changes columns by window statistics over each cloud."""
    return with_views(f"select cloud_id, point_id{keep}, {', '.join(r6(e, n) for n, e in expressions.items())} from (select *, {stats} from {source}) a", source)


# projections and filters


@query(with_views(f"select cloud_id, point_id, {r6s(['x', 'y', 'z', 'intensity'])}, r, g, b, {r6s(['original_cloud_index', 'gps_time', 'illuminance'])} from cloud", "cloud"))
def cloud_projection(spark, d):
    c = fixtures.cloud(spark, d)
    return c.select(*ID, *rounded("x", "y", "z", "intensity"), "r", "g", "b", *rounded("original_cloud_index", "gps_time", "illuminance"))


@query(with_views(f"select cloud_id, point_id, {r6('z', 'z')} from (select *, min(z) over (partition by cloud_id) as lo from cloud) a where z <= lo + 3.0e0", "cloud"))
def height_band(spark, d):
    return points.height_band(fixtures.cloud(spark, d), 3.0).select(*ID, *rounded("z"))


@query(with_views(f"select cloud_id, point_id, {r6('intensity', 'intensity')} from cloud where intensity >= 5000.0e0", "cloud"))
def intensity_cut(spark, d):
    return points.intensity_cut(fixtures.cloud(spark, d)).select(*ID, *rounded("intensity"))


@query(with_views(f"select cloud_id, point_id, {r6('z', 'z')} from (select *, min(z) over (partition by cloud_id) as lo from forest) a where z >= lo + 1.3e0 and z < lo + 1.4e0", "forest"))
def half_open_slab(spark, d):
    return points.slab(fixtures.forest(spark, d), 1.3, 1.4).select(*ID, *rounded("z"))


@query(with_views(f"select cloud_id, point_id, {r6s(XYZ)} from cloud where (cloud_id, point_id) in (select cloud_id, point_id from cloud where r < 3)", "cloud"))
def index_cut(spark, d):
    c = fixtures.cloud(spark, d)
    return points.select_points(c, c.where("r < 3").select(*ID)).select(*ID, *rounded(*XYZ))


@query(with_views(f"select cloud_id, point_id, rank, {r6s(XYZ)} from cloud c join (select cloud_id as ci, point_id as pi, unnest([r, r + 1000]) as rank from cloud) i on c.cloud_id = ci and c.point_id = pi", "cloud"))
def index_list(spark, d):
    """An index list that names every point twice."""
    c = fixtures.cloud(spark, d)
    return points.select_points(c, c.select(*ID, F.explode(F.array(F.col("r"), F.col("r") + 1000)).alias("rank"))).select(*ID, "rank", *rounded(*XYZ))


@query(with_views(f"select cloud_id, point_id, {r6('intensity * 2.0e0', 'intensity')} from cloud", "cloud"))
def update_field(spark, d):
    return points.update_field(fixtures.cloud(spark, d), "intensity", F.col("intensity") * 2.0).select(*ID, *rounded("intensity"))


@query(with_views("select c.cloud_id, c.point_id, g + b as extra from cloud c join (select distinct cloud_id, point_id from cloud) o on c.cloud_id = o.cloud_id and c.point_id = o.point_id", "cloud"))
def add_fields(spark, d):
    c = fixtures.cloud(spark, d)
    return points.add_fields(c.select(*ID, "g"), c.groupBy(*ID).agg(F.min("b").alias("other"))).select(*ID, (F.col("g") + F.col("other")).alias("extra"))


@query(with_views(f"select cloud_id, point_id, {r6s(XYZ)}, r from (select cloud_id, min(point_id) over w as point_id, x, y, z, first_value(r) over (w order by point_id) as r, row_number() over (w order by point_id) as k from (select * replace (floor(x) as x, floor(y) as y) from cloud) a window w as (partition by cloud_id, x, y, z)) b where k = 1", "cloud"))
def unique_points(spark, d):
    c = fixtures.cloud(spark, d).withColumns({"x": F.floor("x").cast("double"), "y": F.floor("y").cast("double")})
    return points.unique_points(c).select(*ID, *rounded(*XYZ), "r")


@query(with_views("select cloud_id, point_id, r from cloud union all select c.cloud_id, point_id + top + 1, 255 - r from cloud c join (select cloud_id, max(point_id) as top from cloud group by cloud_id) t on c.cloud_id = t.cloud_id", "cloud"))
def append_clouds(spark, d):
    c = fixtures.cloud(spark, d).select(*ID, "r")
    return points.append(c, c.withColumn("r", 255 - F.col("r")))


@query(with_views("select cloud_id, point_id, r from cloud union all select cloud_id, point_id, r from cloud where r > 100", "cloud"))
def concatenate_records(spark, d):
    c = fixtures.cloud(spark, d).select(*ID, "r")
    return points.concatenate(c, c.where("r > 100"))


@query(with_views(f"select cloud_id, point_id, {r6('case when point_id % 3 = 0 then 0.0e0 else intensity end', 'intensity')}, r, cast(0 as int) as g from cloud", "cloud"))
def fill_missing(spark, d):
    c = fixtures.cloud(spark, d).withColumns({"intensity": F.when(F.col("point_id") % 3 != 0, F.col("intensity")), "g": F.lit(None).cast("int")})
    return schema.fill_missing(schema.conform(c)).select(*ID, *rounded("intensity"), "r", "g")


@query(with_views("select cloud_id, point_id, (r << 16) | (g << 8) | b as rgb from cloud", "cloud"))
def rgb_pack(spark, d):
    return points.encode_rgb(fixtures.cloud(spark, d)).select(*ID, "rgb")


@query(with_views("select cloud_id, point_id, r, g, b from cloud", "cloud"))
def rgb_unpack(spark, d):
    return points.decode_rgb(points.encode_rgb(fixtures.cloud(spark, d)).select(*ID, "rgb")).select(*ID, "r", "g", "b")


@query(with_views(f"select cloud_id, point_id, {r6('coalesce((intensity-lo)/nullif(hi-lo, 0.0e0), 0.0e0)', 'color_r')} from (select *, min(intensity) over (partition by cloud_id) as lo, max(intensity) over (partition by cloud_id) as hi from cloud) a", "cloud"))
def color_frame(spark, d):
    return points.color_frame(fixtures.cloud(spark, d), "intensity").select(*ID, *rounded("color_r"))


@query(mid({"center_distance": "sqrt((x-(xl+xh)/2)*(x-(xl+xh)/2)+(y-(yl+yh)/2)*(y-(yl+yh)/2)+(z-(zl+zh)/2)*(z-(zl+zh)/2))"}, ", ".join(f"{f}({c}) over (partition by cloud_id) as {c}{n}" for c in XYZ for n, f in (("l", "min"), ("h", "max")))))
def center_distance(spark, d):
    return points.with_center_distance(fixtures.cloud(spark, d)).select(*ID, *rounded("center_distance"))


# normalisation

_RANGE = ", ".join(f"{f}({c}) over (partition by cloud_id) as {c}{n}" for c in [*XYZ, "r", "g", "b", "intensity", "original_cloud_index", "gps_time", "illuminance"] for n, f in (("_l", "min"), ("_h", "max"), ("_a", "avg")))


@query(mid({c: f"{c} - {c}_l" for c in XYZ}, _RANGE))
def shift_to_zero(spark, d):
    return normalize.shift_to_zero(fixtures.cloud(spark, d)).select(*ID, *rounded(*XYZ))


@query(mid({c: f"{c} - {c}_a" for c in XYZ}, _RANGE))
def shift_to_origin(spark, d):
    return normalize.shift_to_origin(fixtures.cloud(spark, d)).select(*ID, *rounded(*XYZ))


@query(mid({c: f"{c} - {v}e0" for c, v in zip(XYZ, (1.5, 2.5, 0.5), strict=True)}, "1"))
def shift_to_coordinate(spark, d):
    c = fixtures.cloud(spark, d)
    trees_ = c.groupBy("cloud_id").agg(F.lit(1.5).alias("coord_x"), F.lit(2.5).alias("coord_y"), F.lit(0.5).alias("coord_z"))
    return normalize.shift_to_coordinate(c, trees_).select(*ID, *rounded(*XYZ))


def _scaled(c: str, low: str, high: str) -> str:
    return f"coalesce(({c} - {low})/nullif({high} - {low}, 0), 0.0e0)"


_XYZ_RANGE = ("least(x_l, y_l, z_l)", "greatest(x_h, y_h, z_h)")
_RGB_RANGE = ("cast(least(r_l, g_l, b_l) as double)", "cast(greatest(r_h, g_h, b_h) as double)")


@query(mid({c: _scaled(c, *_XYZ_RANGE) for c in XYZ} | {c: _scaled(c, *_RGB_RANGE) for c in "rgb"} | {c: _scaled(c, f"{c}_l", f"{c}_h") for c in normalize.SCALED}, _RANGE))
def normalize_fields(spark, d):
    return normalize.normalize_fields(fixtures.cloud(spark, d)).select(*ID, *rounded(*XYZ, "r", "g", "b", *normalize.SCALED))


@query(with_views(f"select cloud_id, point_id, {r6('case when point_id % 5 in (0, 1) then 0.0e0 when point_id % 5 = 2 then 1.0e0 else x end', 'x')} from cloud", "cloud"))
def nan_to_zero(spark, d):
    k = F.col("point_id") % 5
    c = fixtures.cloud(spark, d).withColumn("x", F.when(k == 0, float("nan")).when(k == 1, None).when(k == 2, float("inf")).otherwise(F.col("x")))
    fixed = normalize.nans_to_zero(c, ["x"])
    return fixed.withColumn("x", F.when(F.col("x") == fn.GREATEST_DOUBLE, 1.0).otherwise(F.col("x"))).select(*ID, *rounded("x"))


@query(with_views("select cloud_id, point_id, " + ", ".join(r6(f"{c}/far", c) for c in XYZ) + " from (select *, max(sqrt(x*x+y*y+z*z)) over (partition by cloud_id) as far from (select cloud_id, point_id, " + ", ".join(f"{c} - avg({c}) over (partition by cloud_id) as {c}" for c in XYZ) + " from cloud) a) b", "cloud"))
def pc_normalize(spark, d):
    return normalize.pc_normalize(fixtures.cloud(spark, d)).select(*ID, *rounded(*XYZ))


@query(mid({c: f"({c}-{c}_l)*2.0e0/nullif({c}_h-{c}_l, 0.0e0) - 1.0e0" for c in XYZ}, _RANGE))
def minmax_normalize(spark, d):
    return normalize.minmax_normalize(fixtures.cloud(spark, d)).select(*ID, *rounded(*XYZ))


@query(mid({"x": "(x-x_a)/((z_h-z_l)/2.0e0)", "y": "(y-y_a)/((z_h-z_l)/2.0e0)", "z": "(z-(z_h+z_l)/2.0e0)/((z_h-z_l)/2.0e0)"}, _RANGE))
def tree_normalize(spark, d):
    return normalize.tree_normalize(fixtures.cloud(spark, d)).select(*ID, *rounded(*XYZ))


# voxels

CELL = ["cloud_id", "vx", "vy", "vz"]
_CELLS = ", ".join(CELL)
_VALUES = [*voxel.MEANS, *voxel.NORMALS, "centroid_x", "centroid_y", "centroid_z"]


def _voxels(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxel_table(fixtures.cloud(spark, d), SIZE)


@query(with_views(f"select {_CELLS}, num_points, {', '.join(r6(f'{c} * num_points', c.replace('mean', 'total').replace('centroid', 'total')) for c in _VALUES)}, label from vox", "cloud", more=sql.VOXELS))
def voxel_agg(spark, d):
    """Means times counts: these sums of decimal values have no digit beyond the sixth, so the order of summation can't tip a rounding."""
    totals = [(F.round(F.col(c) * F.col("num_points"), 6) + 0.0).alias(c.replace("mean", "total").replace("centroid", "total")) for c in _VALUES]
    return _voxels(spark, d).select(*CELL, "num_points", *totals, "label")


@query(with_views(f"select {_CELLS}, {', '.join(r6(f'coalesce((mean_intensity-min(mean_intensity) over w)/nullif(max(mean_intensity) over w - min(mean_intensity) over w, 0.0e0), 0.0e0)', f'color_{c}') for c in 'rgb')} from vox window w as (partition by cloud_id)", "cloud", more=sql.VOXELS))
def voxel_color_frame(spark, d):
    return points.color_frame(_voxels(spark, d), "mean_intensity").select(*CELL, *rounded("color_r", "color_g", "color_b"))


@query(with_views(f"select {_CELLS}, label from vox", "cloud", more=sql.VOXELS))
def voxel_label_mode(spark, d):
    return _voxels(spark, d).select(*CELL, "label")


@query(with_views(f"select {_CELLS}, {', '.join(r6(f'(v{c}+0.5e0)*5.0e0', f'center_{c}') for c in XYZ)} from vox", "cloud", more=sql.VOXELS))
def voxel_center(spark, d):
    return voxel.voxel_centers(_voxels(spark, d), SIZE).select(*CELL, *rounded(*[f"center_{c}" for c in XYZ]))


@query(with_views(f"select {_CELLS}, point_id, {r6s([*XYZ, 'distance'])} from (select *, row_number() over (partition by {_CELLS} order by d2, point_id) as k, sqrt(d2) as distance from (select *, " + "+".join(f"({c}-(v{c}+0.5e0)*5.0e0)*({c}-(v{c}+0.5e0)*5.0e0)" for c in XYZ) + " as d2 from vox_p) a) b where k = 1", "cloud", more=sql.VOXELS))
def voxel_medoid(spark, d):
    return voxel.medoids(fixtures.cloud(spark, d), SIZE).select(*CELL, "point_id", *rounded(*XYZ, "distance"))


_SCALED_VOX = ["num_points", *voxel.MEANS]


@query(with_views(f"select {_CELLS}, {', '.join(r6(f'coalesce(({c}-min({c}) over w)/cast(nullif(max({c}) over w - min({c}) over w, 0) as double), 0.0e0)', c) for c in _SCALED_VOX)}, label from vox window w as (partition by cloud_id)", "cloud", more=sql.VOXELS))
def voxel_normalized(spark, d):
    return voxel.normalized_voxels(_voxels(spark, d)).select(*CELL, *rounded(*_SCALED_VOX), "label")


@query(with_views(f"select {_CELLS}, num_points from vox where vz = 1", "cloud", more=sql.VOXELS))
def layer_select(spark, d):
    return voxel.layer_select(_voxels(spark, d), 1).select(*CELL, "num_points")


@query(with_views(f"select {_CELLS}, num_points from vox where vx = 3 and vy = 3 and vz = 1", "cloud", more=sql.VOXELS))
def voxel_lookup(spark, d):
    return voxel.voxel_at(_voxels(spark, d), 3, 3, 1).select(*CELL, "num_points")


@query(with_views(f"select {_CELLS}, num_points from (select *, row_number() over (partition by cloud_id order by first_point, vx, vy, vz) as k from vox) a where k = 8", "cloud", more=sql.VOXELS))
def voxel_by_position(spark, d):
    return voxel.voxel_by_position(_voxels(spark, d), 7).select(*CELL, "num_points")


@query(with_views(f"select {_CELLS}, 'Voxel(grid_index=(' || vx || ', ' || vy || ', ' || vz || '), points=' || num_points || ')' as text from vox", "cloud", more=sql.VOXELS))
def voxel_text(spark, d):
    return voxel.voxel_text(_voxels(spark, d)).select(*CELL, "text")


def _axis(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.cloud(spark, d).groupBy("cloud_id").agg(F.lit(20.0).alias("coord_x"), F.lit(22.0).alias("coord_y"))


_GROUND = "ground as (select cloud_id, vx, vy, vz, sqrt(((vx+0.5e0)*5.0e0-20.0e0)*((vx+0.5e0)*5.0e0-20.0e0) + ((vy+0.5e0)*5.0e0-22.0e0)*((vy+0.5e0)*5.0e0-22.0e0) + 6.25e0) as distance from vox where vz = 0)"


@query(with_views(f"select {_CELLS}, {r6('distance', 'distance')} from ground", "cloud", more=f"{sql.VOXELS}, {_GROUND}"))
def distance_to_coordinate(spark, d):
    return voxel.distances_to_coordinate(_voxels(spark, d), _axis(spark, d), SIZE).select(*CELL, *rounded("distance"))


_PREVIOUS = f"""prev as (select a.cloud_id, a.vz, max(t.vz) as pz from (select distinct cloud_id, vz from vox) a join (select distinct cloud_id, vz from vox where label = 0 and vz >= 0) t on a.cloud_id = t.cloud_id and t.vz < a.vz where a.vz > 0 group by a.cloud_id, a.vz),
near as (select v.cloud_id, v.vx, v.vy, v.vz, sqrt(min((v.vx-t.vx)*(v.vx-t.vx)+(v.vy-t.vy)*(v.vy-t.vy)+(v.vz-t.vz)*(v.vz-t.vz))) as distance from vox v join prev p on v.cloud_id = p.cloud_id and v.vz = p.vz join vox t on t.cloud_id = v.cloud_id and t.vz = p.pz and t.label = 0 group by all),
measured as (select * from near union all select {_CELLS}, distance/5.0e0 from ground)"""


@query(with_views(f"select v.cloud_id, v.vx, v.vy, v.vz, {r6('m.distance', 'distance')} from vox v left join measured m on v.cloud_id = m.cloud_id and v.vx = m.vx and v.vy = m.vy and v.vz = m.vz", "cloud", more=f"{sql.VOXELS}, {_GROUND}, {_PREVIOUS}"))
def distance_prev_layer(spark, d):
    return voxel.distances_to_previous_layer(_voxels(spark, d), _axis(spark, d), SIZE).select(*CELL, *rounded("distance"))


# trees


@query(with_views(f"select cloud_id, {r6('max(z)-min(z)', 'height')} from forest group by cloud_id", "forest"))
def tree_height(spark, d):
    return trees.heights(fixtures.forest(spark, d)).select("cloud_id", *rounded("height"))


@query(with_views(f"select cloud_id, {', '.join(r6(f'{f}({c})', f'{c}_{f}') for c in XYZ for f in ('min', 'max'))} from forest group by cloud_id", "forest"))
def tree_bbox(spark, d):
    return trees.boxes(fixtures.forest(spark, d)).select("cloud_id", *rounded(*[f"{c}_{f}" for c in XYZ for f in ("min", "max")]))


def _trunk(spark: SparkSession, d: str) -> DataFrame:
    """The trunk by height and intensity alone."""
    return points.intensity_cut(points.height_band(fixtures.forest(spark, d)))


_D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"

_LOF = """edges as (select cloud_id, query_id, point_id, sqrt(d2) as d from near where k <= 20), kd as (select cloud_id, query_id, max(d) as kd from edges group by all),
lrd as (select e.cloud_id, e.query_id, 1.0e0/(avg(greatest(d, kd.kd)) + 1e-10) as lrd from edges e join kd on e.cloud_id = kd.cloud_id and e.point_id = kd.query_id group by all),
lof as (select e.cloud_id, e.query_id as point_id, avg(o.lrd)/min(s.lrd) as lof from edges e join lrd o on e.cloud_id = o.cloud_id and e.point_id = o.query_id join lrd s on e.cloud_id = s.cloud_id and e.query_id = s.query_id group by e.cloud_id, e.query_id)"""

_BREAST = "breast as (select t.* from trunk t join (select cloud_id, min(z) as lo from trunk group by cloud_id) l on t.cloud_id = l.cloud_id where z >= lo + 1.3e0 and z < lo + 1.4e0)"
_CIRCLE = f"select cloud_id, n, {r6s(['xc', 'yc', 'r'])} from fit"


@query(with_views(_CIRCLE, "forest", more=f"{sql.TRUNK}, {_BREAST}, {sql.kasa('fit', 'breast', 'cloud_id')}"))
def circle_kasa(spark, d):
    return trees.breast_fits(_trunk(spark, d), "kasa").select("cloud_id", "n", *rounded("xc", "yc", "r"))


@query(with_views(_CIRCLE, "forest", more=f"{sql.TRUNK}, {_BREAST}, {sql.hyper('fit', 'breast', 'cloud_id')}"))
def circle_hyper(spark, d):
    return trees.breast_fits(_trunk(spark, d), "hyper").select("cloud_id", "n", *rounded("xc", "yc", "r"))


@query(with_views(_CIRCLE, "forest", more=f"{sql.TRUNK}, {_BREAST}, {sql.geometric('fit', 'breast', 'cloud_id')}"))
def circle_geometric(spark, d):
    return trees.breast_fits(_trunk(spark, d), "ls").select("cloud_id", "n", *rounded("xc", "yc", "r"))


_SLABS = f"""slabs as (select t.*, cast(floor((z-lo)/nullif((hi-lo)/10, 0.0e0)) as int) as layer from trunk t join (select cloud_id, min(z) as lo, max(z) as hi from trunk group by cloud_id) l on t.cloud_id = l.cloud_id),
inner_slabs as (select * from slabs where layer between 0 and 9), {sql.kasa("slab_fit", "inner_slabs", "cloud_id, layer")}, {_BREAST}, {sql.kasa("fit", "breast", "cloud_id")},
least as (select cloud_id, case when count(r) = 10 then min(r) else 0.0e0 end as r0 from slab_fit group by cloud_id),
extents as (select cloud_id, ((max(x)-min(x))+(max(y)-min(y)))/4.0e0 as q from trunk group by cloud_id),
chosen as (select e.cloud_id, q, r0, coalesce(f.r, 0.0e0) as b from extents e left join least l on e.cloud_id = l.cloud_id left join fit f on e.cloud_id = f.cloud_id),
raised as (select cloud_id, q, case when b > 1.05e0*r0 and b < (1.05e0+0.1e0)*r0 then b else r0 end as r from chosen),
dbh as (select cloud_id, round(200.0e0*(case when r > 0.65e0 or r > 2.1e0*q or r = 0 then q else r end), 2) + 0.0e0 as diameter_ls from raised)"""


@query(with_views("select cloud_id, diameter_ls, diameter_ls as diameter_hls from dbh", "forest", more=f"{sql.TRUNK}, {_SLABS}"))
def tree_dbh(spark, d):
    found = trees.diameters(_trunk(spark, d), methods=("kasa", "kasa"))
    return found.select("cloud_id", *[(F.col(c) + 0.0).alias(c) for c in ("diameter_ls", "diameter_hls")])


def _two_fits(trunk: str = "trunk") -> str:
    """CTE dbh2: diameters and median radii by the geometric and the hyper fit."""
    sides = []
    for k, name in enumerate(("ls", "hls")):
        r = f"(case when good = 10 then least{k} else 0.0e0 end)"
        sides.append((name, k, r))
    raised = ", ".join(f"case when b{k} > 1.05e0*{r} and b{k} < (1.05e0+0.1e0)*{r} then b{k} else {r} end as r{k}, median{k}" for _, k, r in sides)
    ends = ", ".join(f"round(200.0e0*(case when r{k} > 0.65e0 or r{k} > 2.1e0*q or r{k} = 0 then q else r{k} end), 2) + 0.0e0 as diameter_{n}, {r6(f'median{k}', f'r_median_{n}')}" for n, k, _ in sides)
    return f"""span2 as (select cloud_id, min(z) as lo, max(z) as hi, ((max(x)-min(x))+(max(y)-min(y)))/4.0e0 as q from {trunk} group by cloud_id),
slabs2 as (select * from (select t.*, cast(floor((z-lo)/nullif((hi-lo)/10, 0.0e0)) as int) as layer from {trunk} t join span2 l on t.cloud_id = l.cloud_id) a where layer between 0 and 9),
breast2 as (select t.* from {trunk} t join span2 l on t.cloud_id = l.cloud_id where z >= lo + 1.3e0 and z < lo + 1.4e0),
{sql.geometric("sg", "slabs2", "cloud_id, layer")}, {sql.hyper("sh", "slabs2", "cloud_id, layer")}, {sql.geometric("bg", "breast2", "cloud_id")}, {sql.hyper("bh", "breast2", "cloud_id")},
both2 as (select g.cloud_id, g.r as r0, h.r as r1, (g.r is not null and h.r is not null) as ok from sg g join sh h on g.cloud_id = h.cloud_id and g.layer = h.layer),
least2 as (select cloud_id, count(*) filter (ok) as good, min(r0) as least0, min(r1) as least1, quantile_cont(case when ok then r0 else 0.0e0 end, 0.5) as median0, quantile_cont(case when ok then r1 else 0.0e0 end, 0.5) as median1 from both2 group by cloud_id),
chosen2 as (select s.cloud_id, q, coalesce(good, 0) as good, coalesce(least0, 0.0e0) as least0, coalesce(least1, 0.0e0) as least1, coalesce(median0, 0.0e0) as median0, coalesce(median1, 0.0e0) as median1, case when g.r is not null and h.r is not null then g.r else 0.0e0 end as b0, case when g.r is not null and h.r is not null then h.r else 0.0e0 end as b1
 from span2 s left join least2 l on s.cloud_id = l.cloud_id left join bg g on s.cloud_id = g.cloud_id left join bh h on s.cloud_id = h.cloud_id),
dbh2 as (select cloud_id, {ends} from (select cloud_id, q, {raised} from chosen2) a)"""


@query(with_views("select * from dbh2", "forest", more=f"{sql.TRUNK}, {_two_fits()}"))
def tree_dbh_two_fits(spark, d):
    found = trees.diameters(_trunk(spark, d))
    return found.select("cloud_id", *[(F.col(c) + 0.0).alias(c) for c in ("diameter_ls", "diameter_hls")], *rounded("r_median_ls", "r_median_hls"))


@query(with_views(f"select cloud_id, {r6('cx', 'coord_x')}, {r6('cy', 'coord_y')}, {r6('cz', 'coord_z')} from base_at", "forest", more=f"{sql.TRUNK}, {sql.coordinate('base_at', 0.0, 0.6, 0.6)}"))
def tree_coordinate(spark, d):
    return trees.coordinates(_trunk(spark, d), method="kasa").select("cloud_id", *rounded("coord_x", "coord_y", "coord_z"))


def _lean_sql(top: float) -> str:
    deg = "degrees(acos(greatest(-1.0e0, least(1.0e0, (u.cz-a.cz)/sqrt((u.cx-a.cx)*(u.cx-a.cx)+(u.cy-a.cy)*(u.cy-a.cy)+(u.cz-a.cz)*(u.cz-a.cz))))))"
    body = f"select cloud_id, {r6('deg', 'lean_deg')}, {r6('tan(radians(deg))', 'lean_tan')}, {r6('cos(radians(deg))', 'lean_cos')} from (select a.cloud_id, {deg} as deg from base_at a join top_at u on a.cloud_id = u.cloud_id) b"
    return with_views(body, "forest", more=f"{sql.TRUNK}, {sql.coordinate('base_at', 0.0, 0.6, 0.6)}, {sql.coordinate('top_at', 1.0, 1.6, top)}")


@query(_lean_sql(2.6))
def tree_lean(spark, d):
    return trees.lean(_trunk(spark, d), "kasa").select("cloud_id", *rounded("lean_deg", "lean_tan", "lean_cos"))


@query(_lean_sql(1.6))
def tree_lean_exact(spark, d):
    return trees.lean(_trunk(spark, d), "kasa", exact=True).select("cloud_id", *rounded("lean_deg", "lean_tan", "lean_cos"))


@query(with_views(f"select cloud_id, cast(i as int) as vertex, {r6('10.0e0*k + 0.2e0*cos(i*2*pi()/100)', 'x')}, {r6('5.0e0*k + 0.2e0*sin(i*2*pi()/100)', 'y')}, {r6('1.3e0', 'z')} from (select distinct cloud_id, cast(substr(cloud_id, 2) as int) as k from forest) a cross join range(100) s(i)", "forest"))
def circle_frame(spark, d):
    k = F.substring("cloud_id", 2, 9).cast("int")
    rows = fixtures.forest(spark, d).select("cloud_id").distinct().select("cloud_id", (k * 10.0).alias("custom_x"), (k * 5.0).alias("custom_y"), F.lit(1.3).alias("custom_z"), F.lit(40.0).alias("diameter_ls"))
    return points.circle_frame(rows).select("cloud_id", "vertex", *rounded(*XYZ))


@query(with_views("select 'all' as cloud_id, t.point_id, k as cluster from trunk t join (select cloud_id, dense_rank() over (order by min(point_id)) - 1 as k from trunk group by cloud_id) c on t.cloud_id = c.cloud_id", "forest", more=sql.TRUNK))
def hdbscan_labels(spark, d):
    """The trunks of all trees as one cloud: each is a cluster of its own, numbered by its least point."""
    return clustering.cluster_points(_trunk(spark, d).withColumn("cloud_id", F.lit("all"))).select(*ID, "cluster")


@query()
def trunk_score(spark, d):
    return score_clusters(_trunk(spark, d).withColumn("cluster", F.lit(0).cast("long")))


_STEM = f"""trunk0 as (select g.* from grove g join (select cloud_id, min(z) as lo from grove group by cloud_id) l on g.cloud_id = l.cloud_id where z <= lo + 3.0e0 and intensity >= 5000.0e0 and original_cloud_index = 0),
stem_pairs as (select a.cloud_id, a.point_id as query_id, b.point_id, {_D2} as d2 from trunk0 a join trunk0 b on a.cloud_id = b.cloud_id and a.point_id <> b.point_id and abs(a.z - b.z) < 0.5e0),
near as (select *, row_number() over (partition by cloud_id, query_id order by d2, point_id) as k from stem_pairs where d2 < 0.25e0), {_LOF},
trunk as (select t.* from trunk0 t join lof l on t.point_id = l.point_id and t.cloud_id = l.cloud_id join (select cloud_id, quantile_cont(-lof, 0.1) as q from lof group by cloud_id) b on t.cloud_id = b.cloud_id where -lof >= q)"""


@query(with_views(f"select cloud_id, point_id, {r6s(XYZ)} from trunk", "grove", more=_STEM))
def trunk_slice(spark, d):
    """In the grove the trunk is the taller of two clusters; the SQL finds its outliers among neighbours within half a metre, of which every point has more than enough."""
    return trees.trunk_slice(fixtures.grove(spark, d))[0].select(*ID, *rounded(*XYZ))


_INVENTORY = f"""{_STEM}, {_two_fits()}, {sql.coordinate("base_at", 0.0, 0.6, 0.6, sql.geometric)}, {sql.coordinate("top_at", 1.0, 1.6, 2.6, sql.geometric)},
leans as (select a.cloud_id, a.cx, a.cy, a.cz, u.cx as ux, u.cy as uy, u.cz as uz, degrees(acos(greatest(-1.0e0, least(1.0e0, (u.cz-a.cz)/sqrt((u.cx-a.cx)*(u.cx-a.cx)+(u.cy-a.cy)*(u.cy-a.cy)+(u.cz-a.cz)*(u.cz-a.cz)))))) as deg from base_at a join top_at u on a.cloud_id = u.cloud_id)"""
_TREE_COLUMNS = {"coord_x": "cx", "coord_y": "cy", "coord_z": "cz", "custom_x": "ux", "custom_y": "uy", "custom_z": "uz", "lean_deg": "deg", "lean_tan": "tan(radians(deg))", "lean_cos": "cos(radians(deg))"}


@query(with_views(f"select l.cloud_id, l.cloud_id as name, {r6('height', 'height')}, {', '.join(r6(e, c) for c, e in _TREE_COLUMNS.items())}, diameter_ls, diameter_hls, 'ok' as status from leans l join dbh2 d on l.cloud_id = d.cloud_id join (select cloud_id, max(z) - min(z) as height from grove group by cloud_id) h on l.cloud_id = h.cloud_id", "grove", more=_INVENTORY))
def tree_inventory(spark, d):
    found = trees.inventory(fixtures.grove(spark, d))
    return found.select("cloud_id", "name", *rounded("height", *_TREE_COLUMNS), *[(F.col(c) + 0.0).alias(c) for c in ("diameter_ls", "diameter_hls")], "status")


# distance joins, on the first three dimensions of the vectors

_PAIRS = f"pairs as (select a.cloud_id, a.point_id as query_id, b.point_id, {_D2} as d2 from vectors a join vectors b on a.cloud_id = b.cloud_id)"
EDGE = ["cloud_id", "query_id", "point_id"]


@query(with_views(f"select cloud_id, query_id, point_id, {r6('d2', 'd2')} from pairs", "vectors", more=_PAIRS))
def pairwise_distance(spark, d):
    v = fixtures.vectors(spark, d)
    return spatial.pairwise_distance(v, v).select(*EDGE, *rounded("d2"))


@query(with_views(f"select cloud_id, query_id, point_id, {r6('d2', 'd2')} from pairs where d2 <= 0.1e0*0.1e0", "vectors", more=_PAIRS))
def radius_join(spark, d):
    v = fixtures.vectors(spark, d)
    return spatial.radius_join(v, v, 0.1).select(*EDGE, *rounded("d2"))


@query(with_views("select cloud_id, query_id, cast(s.i as int) as rank, coalesce(ids[s.i+1], ids[1]) as point_id from (select cloud_id, query_id, list(point_id order by point_id) as ids from pairs where d2 <= 0.1e0*0.1e0 group by all) a cross join range(8) s(i)", "vectors", more=_PAIRS))
def ball_query(spark, d):
    v = fixtures.vectors(spark, d)
    return spatial.ball_query(v, v, 0.1, 8).select("cloud_id", "query_id", "rank", "point_id")


_KNN = "near as (select *, row_number() over (partition by cloud_id, query_id order by d2, point_id) as k from pairs where query_id <> point_id)"


@query(with_views(f"select cloud_id, query_id, point_id, cast(k-1 as int) as rank, {r6('d2', 'd2')} from near where k <= 5", "vectors", more=f"{_PAIRS}, {_KNN}"))
def knn(spark, d):
    v = fixtures.vectors(spark, d)
    return spatial.knn_join(v, v, 5, include_self=False).select(*EDGE, F.col("rank").cast("int").alias("rank"), *rounded("d2"))


_OTHER = _PAIRS.replace("from vectors a", "from others a")


@query(with_views(f"select n.cloud_id, n.query_id, {r6('sum(v.z/(d2+1e-8))/sum(1/(d2+1e-8))', 'z')} from near n join vectors v on v.point_id = n.point_id where k <= 3 group by n.cloud_id, n.query_id", "vectors", "others", more=f"{_OTHER}, {_KNN.replace('query_id <> point_id', 'true')}"))
def knn3_interpolate(spark, d):
    """z of the vectors (dimensions 1 to 3) at the places that dimensions 4 to 6 of all of them give."""
    return spatial.interpolate(fixtures.vectors(spark, d, 4), fixtures.vectors(spark, d), ["z"]).select("cloud_id", "query_id", *rounded("z"))


@query(with_views(f"select cloud_id, point_id, {r6('lof', 'lof')} from lof", "vectors", more=f"{_PAIRS}, {_KNN}, {_LOF}"))
def lof_scores(spark, d):
    return spatial.local_outlier_factors(fixtures.vectors(spark, d)).select(*ID, *rounded("lof"))


@query(with_views("select l.cloud_id, point_id from lof l join (select cloud_id, quantile_cont(-lof, 0.1) as q from lof group by cloud_id) b on l.cloud_id = b.cloud_id where -lof >= q", "vectors", more=f"{_PAIRS}, {_KNN}, {_LOF}"))
def lof_inliers(spark, d):
    return spatial.lof_inliers(fixtures.vectors(spark, d)).select(*ID)


_MOMENTS = """closest as (select *, row_number() over (partition by query_id order by d2, point_id) as k from pairs where d2 <= 0.2e0*0.2e0),
moments as (select query_id, count(*) as n, covar_pop(v.x, v.x) as xx, covar_pop(v.x, v.y) as xy, covar_pop(v.x, v.z) as xz, covar_pop(v.y, v.y) as yy, covar_pop(v.y, v.z) as yz, covar_pop(v.z, v.z) as zz from closest c join vectors v on v.point_id = c.point_id where k <= 30 group by query_id),
parts as (select *, (xx+yy+zz)/3 as q, xy*xy+xz*xz+yz*yz as off from moments),
sizes as (select *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*off)/6) as p from parts),
turns as (select *, ((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz)) / nullif(2*p*p*p, 0.0e0) as h from sizes),
least_root as (select query_id, n, greatest(q + 2*p*cos(acos(greatest(-1.0e0, least(1.0e0, coalesce(h, 0.0e0))))/3 + 2*pi()/3), 0.0e0) as root from turns)"""


@query(with_views(f"select 'v' as cloud_id, query_id as point_id, n, true as unit, true as up, {r6('case when n < 3 then 0.0e0 else root end', 'spread')} from least_root", "vectors", more=f"{_PAIRS}, {_MOMENTS}"))
def normals_pca(spark, d):
    """How far the neighbours of each point spread along its normal: the least root of their covariances, which SQL has in closed form."""
    v = fixtures.vectors(spark, d)
    normals = spatial.estimate_normals(v, radius=0.2).select("cloud_id", "point_id", "nx", "ny", "nz")
    near = spatial.nearest_in_reach(v, v, 0.2, 30).select("cloud_id", "query_id", *XYZ)
    along = near.join(normals.withColumnRenamed("point_id", "query_id"), ["cloud_id", "query_id"]).withColumn("t", F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz"))
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    found = along.groupBy("cloud_id", F.col("query_id").alias("point_id")).agg(F.count("*").alias("n"), F.bool_and(F.abs(size - 1) < 1e-9).alias("unit"), F.bool_and(F.col("nz") >= 0).alias("up"), F.var_pop("t").alias("t"))
    return found.select(*ID, "n", "unit", "up", (F.round(F.when(F.col("n") < 3, 0.0).otherwise(F.col("t")), 6) + 0.0).alias("spread"))


_PRIM = """core as (select cloud_id, query_id, sqrt(max(d2)) as core from near where k <= 10 group by all),
prim(step, cloud_id, point_id, x, y, z, core, best, inside, of, total) as (
 select 0, v.cloud_id, point_id, x, y, z, core, cast('infinity' as double), point_id = min(point_id) over (), min(point_id) over (), 0.0e0 from vectors v join core c on c.query_id = point_id
 union all
 select step + 1, cloud_id, point_id, x, y, z, core, best, inside or point_id = nxt, nxt, total + reach from (
  select *, first_value(point_id) over w as nxt, first_value(best) over w as reach from (
   select p.step, p.cloud_id, p.point_id, p.x, p.y, p.z, p.core, least(p.best, greatest(sqrt((p.x-o.x)*(p.x-o.x)+(p.y-o.y)*(p.y-o.y)+(p.z-o.z)*(p.z-o.z)), p.core, o.core)) as best, p.inside, p.total
   from prim p join prim o on o.point_id = p.of) a
  window w as (order by case when inside then 1 else 0 end, best, point_id)) b where step < (select count(*) - 1 from vectors))"""


@query(with_views(f"select cloud_id, count(*) as points, {r6('sum(core)', 'core_sum')}, {r6('max(total)', 'tree_sum')} from prim where step = (select max(step) from prim) group by cloud_id", "vectors", more=f"{_PAIRS}, {_KNN}, {_PRIM}").replace("with ", "with recursive ", 1))
def hdbscan_tree(spark, d):
    return clustering.reachability(fixtures.vectors(spark, d)).select("cloud_id", "points", *rounded("core_sum", "tree_sum"))


# sampling and augmentation, with explicit parameters where SQL checks them


_FARTHEST = """fps(rank, point_id, x, y, z, far, of) as (
 select 0, point_id, x, y, z, cast(1e10 as double), min(point_id) over () from vectors
 union all
 select rank + 1, point_id, x, y, z, far, first_value(point_id) over (order by far desc, point_id) from (
  select p.rank, p.point_id, p.x, p.y, p.z, least(p.far, (p.x-o.x)*(p.x-o.x)+(p.y-o.y)*(p.y-o.y)+(p.z-o.z)*(p.z-o.z)) as far from fps p join fps o on o.point_id = p.of) a where rank < 127)"""


@query(with_views("select 'v' as cloud_id, cast(rank as int) as rank, of as point_id from fps group by all", "vectors", more=_FARTHEST).replace("with ", "with recursive ", 1))
def fps_sample(spark, d):
    return sampling.farthest_points(fixtures.vectors(spark, d), 128)


@query(with_views(f"select 'v' as cloud_id, cast(f.rank as int) as rank, f.of as point_id, {', '.join(r6(f'v.{c}', c) for c in XYZ)} from (select rank, of from fps group by all) f join vectors v on v.point_id = f.of", "vectors", more=_FARTHEST).replace("with ", "with recursive ", 1))
def fps_cloud(spark, d):
    return sampling.sample_fps(fixtures.vectors(spark, d), 128).select("cloud_id", "rank", "point_id", *rounded(*XYZ))


@query(with_views(f"select cloud_id, row_number() over (partition by cloud_id order by (k*7919) % 104729, k) - 1 as point_id, {r6s(XYZ)} from (select *, row_number() over (partition by cloud_id order by point_id, z) - 1 as k from cloud) a", "cloud"))
def shuffled_points(spark, d):
    return sampling.shuffle_points(fixtures.cloud(spark, d), 7, lambda k: (k * 7919) % 104729).select(*ID, *rounded(*XYZ))


@query("select cast(s_suppkey as varchar) as cloud_id, row_number() over (order by (s_suppkey*7919) % 104729, cast(s_suppkey as varchar)) - 1 as position from supplier")
def shuffled_clouds(spark, d):
    clouds = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("cloud_id"))
    return sampling.shuffle_clouds(clouds, 7, ((F.col("cloud_id").cast("long") * 7919) % 104729) / 104729.0).select("cloud_id", F.col("position").cast("long").alias("position"))


def _turn(rows: dict[str, str]) -> str:
    return with_views(f"select cloud_id, point_id, {', '.join(r6(e, n) for n, e in rows.items())} from cloud", "cloud")


_C, _S = f"cos({math.pi / 5!r})", f"sin({math.pi / 5!r})"


@query(_turn({"x": f"x*{_C}-z*{_S}", "y": "y", "z": f"x*{_S}+z*{_C}"}))
def rotate_y(spark, d):
    return sampling.rotate_y(fixtures.cloud(spark, d), math.pi / 5).select(*ID, *rounded(*XYZ))


@query(_turn({"x": f"x*{_C}-y*{_S}", "y": f"x*{_S}+y*{_C}", "z": "z"}))
def rotate_z(spark, d):
    return sampling.rotate_z(fixtures.cloud(spark, d), math.pi / 5).select(*ID, *rounded(*XYZ))


@query(_turn({"x": f"x*{_C}-z*{_S}", "y": "y", "z": f"x*{_S}+z*{_C}", "nx": f"nx*{_C}-nz*{_S}", "ny": "ny", "nz": f"nx*{_S}+nz*{_C}"}))
def rotate_y_normals(spark, d):
    return sampling.rotate_y(fixtures.cloud(spark, d), math.pi / 5, normals=True).select(*ID, *rounded(*XYZ, "nx", "ny", "nz"))


def _euler() -> dict[str, str]:
    (cx, sx), (cy, sy), (cz, sz) = [(math.cos(a), math.sin(a)) for a in (0.1, -0.05, 0.15)]
    rx, ry, rz = [[1, 0, 0], [0, cx, -sx], [0, sx, cx]], [[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]], [[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]
    times = lambda a, b: [[sum(a[r][k] * b[k][c] for k in range(3)) for c in range(3)] for r in range(3)]
    m = times(times(rz, ry), rx)
    return {c: "+".join(f"{s}*({m[k][j]!r})" for k, s in enumerate(XYZ)) for j, c in enumerate(XYZ)}


@query(_turn(_euler()))
def rotate_perturbation(spark, d):
    return sampling.rotate_perturbation(fixtures.cloud(spark, d), (0.1, -0.05, 0.15)).select(*ID, *rounded(*XYZ))


@query(_turn(_euler() | {"n" + c: re.sub(r"\b([xyz])\*", r"n\1*", e) for c, e in _euler().items()}))
def rotate_perturbation_normals(spark, d):
    return sampling.rotate_perturbation(fixtures.cloud(spark, d), (0.1, -0.05, 0.15), normals=True).select(*ID, *rounded(*XYZ, "nx", "ny", "nz"))


@query(_turn({"x": "x+0.05e0", "y": "y-0.02e0", "z": "z+0.1e0"}))
def shift_cloud(spark, d):
    return sampling.shift(fixtures.cloud(spark, d), (0.05, -0.02, 0.1)).select(*ID, *rounded(*XYZ))


@query(_turn({c: f"{c}*1.2e0" for c in XYZ}))
def scale_cloud(spark, d):
    return sampling.scale(fixtures.cloud(spark, d), 1.2).select(*ID, *rounded(*XYZ))


@query(_turn({c: f"{c} + greatest(least(illuminance/50.0e0 - 0.08e0, 0.05e0), -0.05e0)" for c in XYZ}))
def jitter_cloud(spark, d):
    noise = F.col("illuminance") / 50.0 - 0.08
    return sampling.jitter(fixtures.cloud(spark, d), noise=(noise, noise, noise)).select(*ID, *rounded(*XYZ))


@query(with_views("select cloud_id, point_id, " + ", ".join(r6(f"case when intensity/10000.0e0 <= 0.3e0 then first_value({c}) over (partition by cloud_id order by point_id) else {c} end", c) for c in XYZ) + " from cloud", "cloud"))
def dropout_cloud(spark, d):
    return sampling.dropout(fixtures.cloud(spark, d), 0.3, draw=F.col("intensity") / 10000.0).select(*ID, *rounded(*XYZ))


@query(with_views("select cloud_id, point_id, " + ", ".join(r6(f"case when intensity/10000.0e0 <= 0.1e0 then first_value({c}) over (partition by cloud_id order by point_id) else {c} end", c) for c in XYZ) + f" from (select cloud_id, point_id, intensity, x*{_C}-y*{_S} as x, x*{_S}+y*{_C} as y, z from cloud) a", "cloud"))
def augmented(spark, d):
    return sampling.augment(fixtures.cloud(spark, d), 3, math.pi / 5, 0.1, F.col("intensity") / 10000.0).select(*ID, *rounded(*XYZ))


# files


def _round_trip(kind: str, **options) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = fixtures.cloud(spark, d)
        to = scratch(spark, f"clouds-{kind}")
        files.write_clouds(c, to, kind, **options)  # by point_id and place
        back = files.read_cloud(spark, f"{to}/*.{kind}")
        return back.select("cloud_id", *[(F.round(F.col(v), 6) + 0.0).alias(v) for v in XYZ], F.round("intensity", 0).cast("long").alias("intensity"), "r", "g", "b", F.round("illuminance", 2).alias("illuminance"))

    return run


def _stored(kind: str) -> str:
    """PCD files hold single precision."""
    as_kept = (lambda c: f"cast(cast({c} as real) as double)") if kind == "pcd" else (lambda c: c)
    return with_views(f"select cloud_id, {', '.join(f'round({as_kept(c)}, 6) + 0.0e0 as {c}' for c in XYZ)}, cast(round(intensity, 0) as bigint) as intensity, r, g, b, round(illuminance, 2) as illuminance from cloud", "cloud")


for _name, _kind, _options in (("csv", "csv", {}), ("txt", "txt", {}), ("las", "las", {"scale": 1e-6}), ("pcd_ascii", "pcd", {"data": "ascii"}), ("pcd_binary", "pcd", {"data": "binary"}), ("pcd_lzf", "pcd", {"data": "binary_compressed"})):
    QUERIES[f"io_roundtrip_{_name}"] = _round_trip(_kind, **_options)
    ORACLES[f"io_roundtrip_{_name}"] = _stored(_kind)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Height and breast-height diameter of each tree."""
    f = fixtures.forest(spark, d)
    found = trees.diameters(_trunk(spark, d), methods=("kasa", "hyper")).join(trees.heights(f), "cloud_id")
    return found.select("cloud_id", "diameter_ls", "diameter_hls", *rounded("height"))
