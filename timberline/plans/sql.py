"""Pieces of DuckDB SQL that the reference queries share."""

from __future__ import annotations

from collections.abc import Callable

from timberline.fixtures import CLOUD_SQL, forest_sql, grove_sql, vectors_sql


def with_views(body: str, *views: str, more: str = "") -> str:
    known = {"cloud": CLOUD_SQL, "forest": forest_sql(), "grove": grove_sql(), "vectors": vectors_sql(1, "list_extract"), "others": vectors_sql(4, "list_extract")}
    parts = [f"{v} as ({known[v]})" for v in views]
    return f"with {', '.join(parts)}{', ' + more if more else ''} {body}"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0e0 as {name}"


def moments(name: str, source: str, keys: str) -> str:
    """CTEs ``name``_m with count, means and central moments of each group."""
    on = " and ".join(f"s.{k} = m.{k}" for k in keys.split(", "))
    own = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""{name}_a as (select {keys}, avg(x) as mx, avg(y) as my from {source} group by {keys}),
{name}_u as (select {own}, mx, my, x - mx as u, y - my as v, (x-mx)*(x-mx) + (y-my)*(y-my) as w from {source} s join {name}_a m on {on}),
{name}_m as (select {keys}, count(*) as n, min(mx) as mx, min(my) as my, avg(u*u) as xx, avg(v*v) as yy, avg(u*v) as xy, avg(u*w) as xz, avg(v*w) as yz, avg(w*w) as zz from {name}_u group by {keys})"""


def finish(name: str, source: str, keys: str, t: str) -> str:
    flat = "n < 3 or abs(xx*yy - xy*xy) <= 1e-14 * (xx+yy) * (xx+yy)"
    return f"""{name}_t as (select *, case when {flat} then null else {t} end as tt from {source}),
{name}_d as (select *, 2.0e0*((xx-tt)*(yy-tt) - xy*xy) as dd from {name}_t),
{name}_c as (select *, (xz*(yy-tt) - yz*xy)/nullif(dd, 0.0e0) as uc, (yz*(xx-tt) - xz*xy)/nullif(dd, 0.0e0) as vc from {name}_d),
{name} as (select {keys}, n, mx + uc as xc, my + vc as yc, case when uc*uc + vc*vc + xx + yy - 2.0e0*tt > 0 then sqrt(uc*uc + vc*vc + xx + yy - 2.0e0*tt) end as r from {name}_c)"""


def kasa(name: str, source: str, keys: str) -> str:
    return f"{moments(name, source, keys)}, {finish(name, f'{name}_m', keys, '0.0e0')}"


def hyper(name: str, source: str, keys: str, steps: int = 20) -> str:
    """The Newton steps are unrolled, one CTE each."""
    parts = [moments(name, source, keys)]
    parts.append(f"{name}_h as (select *, xx+yy as mz, xx*yy-xy*xy as cov, zz-(xx+yy)*(xx+yy) as vz from {name}_m)")
    parts.append(
        f"{name}_n0 as (select *, xz*(xz*yy-yz*xy)+yz*(yz*xx-xz*xy)-vz*cov as a0, vz*mz+4.0e0*cov*mz-xz*xz-yz*yz as a1, 4.0e0*cov-3.0e0*mz*mz-zz as a2, 0.0e0 as newton from {name}_h)"
    )
    for k in range(steps):
        move = "newton - coalesce((a0+newton*(a1+newton*(a2+4.0e0*newton*newton)))/nullif(a1+newton*(2.0e0*a2+16.0e0*newton*newton), 0.0e0), 0.0e0)"
        parts.append(f"{name}_n{k + 1} as (select * exclude (newton), {move} as newton from {name}_n{k})")
    return ", ".join(parts) + ", " + finish(name, f"{name}_n{steps}", keys, "newton")


def geometric(name: str, source: str, keys: str, steps: int = 12) -> str:
    """The geometric fit: Gauss-Newton steps on the centre from the linear fit, unrolled; the radius is the mean distance."""
    ks = keys.split(", ")
    on = " and ".join(f"s.{k} = p.{k}" for k in ks)
    own = ", ".join(f"s.{k}" for k in ks)
    parts = [kasa(f"{name}_k", source, keys), f"{name}_p0 as (select {keys}, n, xc as a, yc as b from {name}_k)"]
    for k in range(steps):
        parts.append(f"{name}_d{k} as (select {own}, p.n, a, b, sqrt((x-a)*(x-a)+(y-b)*(y-b)) as d, (a-x)/sqrt((x-a)*(x-a)+(y-b)*(y-b)) as u, (b-y)/sqrt((x-a)*(x-a)+(y-b)*(y-b)) as v from {source} s join {name}_p{k} p on {on} where a is not null)")
        parts.append(f"{name}_m{k} as (select {keys}, min(n) as n, min(a) as a, min(b) as b, covar_pop(u, u) as uu, covar_pop(u, v) as uv, covar_pop(v, v) as vv, covar_pop(u, d) as ud, covar_pop(v, d) as vd from {name}_d{k} group by {keys})")
        parts.append(f"{name}_p{k + 1} as (select {keys}, n, a - (vv*ud - uv*vd)/nullif(uu*vv - uv*uv, 0.0e0) as a, b - (uu*vd - uv*ud)/nullif(uu*vv - uv*uv, 0.0e0) as b from {name}_m{k})")
    last = f"{name}_e as (select {own}, min(a) as xc, min(b) as yc, avg(sqrt((x-a)*(x-a)+(y-b)*(y-b))) as r from {source} s join {name}_p{steps} p on {on} group by {own})"
    joined = " and ".join(f"k.{k} = e.{k}" for k in ks)
    return ", ".join(parts) + f", {last}, {name} as (select {', '.join(f'k.{k}' for k in ks)}, k.n, e.xc, e.yc, e.r from {name}_k k left join {name}_e e on {joined})"


TRUNK = "trunk as (select f.* from forest f join (select cloud_id, min(z) as lo from forest group by cloud_id) l on f.cloud_id = l.cloud_id where z <= lo + 3.0e0 and intensity >= 5000.0e0)"


def coordinate(name: str, low: float, high: float, top: float, fit: Callable[[str, str, str], str] = kasa) -> str:
    """CTE ``name``: cloud_id, cx, cy, cz of the trunks by the linear fit, or another one."""
    return f"""{name}_w as (select t.*, lo from trunk t join (select cloud_id, min(z) as lo from trunk group by cloud_id) l on t.cloud_id = l.cloud_id),
{name}_r as (select * from {name}_w where z >= lo + {low}e0 and z < lo + {top}e0), {fit(f"{name}_k", f"{name}_r", "cloud_id")},
{name}_b as (select cloud_id, avg(x) as bx, avg(y) as by_, min(lo) as lo from {name}_w where z < lo + {high}e0 group by cloud_id),
{name} as (select b.cloud_id, case when sqrt((xc-bx)*(xc-bx)+(yc-by_)*(yc-by_)) > 0.2e0 then bx else xc end as cx, case when sqrt((xc-bx)*(xc-bx)+(yc-by_)*(yc-by_)) > 0.2e0 then by_ else yc end as cy, lo + ({high}e0-{low}e0)/2.0e0 + {low}e0 as cz from {name}_b b join {name}_k k on b.cloud_id = k.cloud_id)"""


VOXELS = """vox_p as (select *, cast(floor(x/5.0e0) as int) as vx, cast(floor(y/5.0e0) as int) as vy, cast(floor(z/5.0e0) as int) as vz from cloud),
vox_l as (select cloud_id, vx, vy, vz, label, row_number() over (partition by cloud_id, vx, vy, vz order by n desc, label) as k from (select cloud_id, vx, vy, vz, cast(original_cloud_index as bigint) as label, count(*) as n from vox_p group by all) a),
vox as (select p.cloud_id, p.vx, p.vy, p.vz, count(*) as num_points, avg(intensity) as mean_intensity, avg(r) as mean_r, avg(g) as mean_g, avg(b) as mean_b, avg(illuminance) as mean_illuminance, avg(gps_time) as mean_gps_time,
 avg(nx) as mean_normals_x, avg(ny) as mean_normals_y, avg(nz) as mean_normals_z, avg(x) as centroid_x, avg(y) as centroid_y, avg(z) as centroid_z, min(l.label) as label, min(point_id) as first_point
 from vox_p p join (select * from vox_l where k = 1) l on p.cloud_id = l.cloud_id and p.vx = l.vx and p.vy = l.vy and p.vz = l.vz group by p.cloud_id, p.vx, p.vy, p.vz)"""
