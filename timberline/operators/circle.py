"""Circle fits of groups of points in the x, y plane.

``kasa`` and ``hyper`` are closed aggregates: means, then central moments, then a projection (for the hyper fit, Newton steps
on one scalar). ``ls`` is the geometric least-squares fit, whose steps need the points themselves: groups are sorted into
tasks and fitted many at a time. A group of fewer than three points, or of points on a line, has no circle: r is null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.columns import ratio
from timberline.operators.base import attach, begins

NEWTON_STEPS = 20
FLAT = 1e-14


def moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, means and central moments of each group, with w = u**2 + v**2 of the centred coordinates."""
    wide = attach(df, keys, mx=F.avg("x"), my=F.avg("y"))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    w = u * u + v * v
    named = {"xx": u * u, "yy": v * v, "xy": u * v, "xz": u * w, "yz": v * w, "zz": w * w}
    return wide.groupBy(*keys).agg(F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), *[F.avg(e).alias(f"m{k}") for k, e in named.items()])


def _finish(found: DataFrame, keys: list[str], t: Column) -> DataFrame:
    xx, yy, xy, xz, yz = (F.col(f"m{k}") for k in ("xx", "yy", "xy", "xz", "yz"))
    mz = xx + yy
    flat = (F.col("n") < 3) | (F.abs(xx * yy - xy * xy) <= FLAT * mz * mz)
    with_t = found.withColumn("t", F.when(flat, F.lit(None).cast("double")).otherwise(t))
    det = (xx - F.col("t")) * (yy - F.col("t")) - xy * xy
    uc, vc = ratio(xz * (yy - F.col("t")) - yz * xy, 2.0 * det), ratio(yz * (xx - F.col("t")) - xz * xy, 2.0 * det)
    centred = with_t.withColumns({"uc": uc, "vc": vc})
    r2 = F.col("uc") * F.col("uc") + F.col("vc") * F.col("vc") + mz - 2.0 * F.col("t")
    return centred.select(*keys, "n", (F.col("mx") + F.col("uc")).alias("xc"), (F.col("my") + F.col("vc")).alias("yc"), F.when(r2 > 0, F.sqrt(r2)).alias("r"))


def kasa(df: DataFrame, keys: list[str]) -> DataFrame:
    """Linear least squares on the circle's equation: keys, n, xc, yc, r."""
    return _finish(moments(df, keys), keys, F.lit(0.0))


def hyper(df: DataFrame, keys: list[str]) -> DataFrame:
    """The hyper-accurate algebraic fit (Al-Sharadqah and Chernov 2009): keys, n, xc, yc, r."""
    found = moments(df, keys)
    xx, yy, xy, xz, yz, zz = (F.col(f"m{k}") for k in ("xx", "yy", "xy", "xz", "yz", "zz"))
    mz = xx + yy
    cov, vz = xx * yy - xy * xy, zz - mz * mz
    a2 = 4.0 * cov - 3.0 * mz * mz - zz
    a1 = vz * mz + 4.0 * cov * mz - xz * xz - yz * yz
    a0 = xz * (xz * yy - yz * xy) + yz * (yz * xx - xz * xy) - vz * cov
    held = found.withColumns({"a0": a0, "a1": a1, "a2": a2})
    a0, a1, a2 = F.col("a0"), F.col("a1"), F.col("a2")
    step = lambda t, _: t - F.coalesce((a0 + t * (a1 + t * (a2 + 4.0 * t * t))) / F.nullif(a1 + t * (2.0 * a2 + 16.0 * t * t), F.lit(0.0)), F.lit(0.0))
    return _finish(held, keys, F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step))


def geometric_circles(x: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 60) -> np.ndarray:
    """Rows xc, yc, r that minimise the squared distances to a circle, by Levenberg and Marquardt from the linear fit, for all groups at once.

    ``first`` holds the first place of each group. A group without a circle has nan."""
    size = np.diff(np.append(first, len(x)))
    sums = lambda v: np.add.reduceat(v, first, axis=0)
    mx, my = sums(x) / size, sums(y) / size
    of = np.repeat(np.arange(len(first)), size)
    u, v = x - mx[of], y - my[of]
    w = u * u + v * v
    uu, uv, vv, uw, vw, ww = (sums(c) for c in (u * u, u * v, v * v, u * w, v * w, w))
    det = uu * vv - uv * uv
    good = (size >= 3) & (np.abs(det) > FLAT * (uu + vv) ** 2)
    safe_det = np.where(good, det, 1.0)
    a, b = (uw * vv - vw * uv) / safe_det / 2, (vw * uu - uw * uv) / safe_det / 2
    p = np.column_stack((a, b, np.sqrt(a * a + b * b + ww / size)))
    p[~good] = np.nan

    def distances(p: np.ndarray) -> np.ndarray:
        return np.hypot(u - p[of, 0], v - p[of, 1])

    with np.errstate(invalid="ignore"):
        d = distances(p)
        now, damp, open_ = sums((d - p[of, 2]) ** 2), np.full(len(first), 1e-4), good.copy()
        for _ in range(steps):
            if not open_.any():
                break
            safe, e = np.maximum(d, 1e-300), d - p[of, 2]
            J = np.column_stack(((p[of, 0] - u) / safe, (p[of, 1] - v) / safe, -np.ones(len(u))))
            H, g = sums(J[:, :, None] * J[:, None, :]), sums(J * e[:, None])
            H[~open_] = 0.0
            move = np.linalg.solve(H + damp[:, None, None] * np.eye(3), -np.where(open_[:, None], g, 0.0)[:, :, None])[:, :, 0]
            to = p + move
            reached = distances(to)
            new = sums((reached - to[of, 2]) ** 2)
            better = open_ & (new <= now)
            p[better], now[better] = to[better], new[better]
            d = np.where(better[of], reached, d)
            damp = np.where(better, damp / 10, damp * 10)
            open_ &= ~(better & (np.abs(move).max(1) < 1e-12)) & (damp <= 1e12)
    return np.column_stack((p[:, 0] + mx, p[:, 1] + my, np.abs(p[:, 2])))


def geometric_circle(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float] | None:
    """The fit of one group."""
    found = geometric_circles(x, y, np.zeros(1, int))[0] if len(x) else np.full(3, np.nan)
    return None if np.isnan(found).any() else (float(found[0]), float(found[1]), float(found[2]))


#: Points that are fitted together, at least; a group is never divided.
TOGETHER = 1 << 15


def least_squares(df: DataFrame, keys: list[str]) -> DataFrame:
    """The geometric fit of each group: keys, n, xc, yc, r."""
    names = [next(f for f in df.schema if f.name == k) for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names)
    dealt = df.select(*keys, "x", "y").repartition(*keys).sortWithinPartitions(*keys)

    def fit(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        """The circles of all groups but the last one, which may go on, and what is left of the rows."""
        rows = pa.concat_batches(held)
        first = np.flatnonzero(begins(rows, len(keys)))
        end = len(rows) if last else first[-1]
        first, rest = first[first < end], [rows.slice(end)]
        if not len(first):
            return None, rest
        x, y = (np.asarray(rows.column(len(keys) + k)[:end]).astype(float) for k in (0, 1))
        found = geometric_circles(x, y, first)
        own = rows.take(pa.array(first))
        circle = [pa.array(c, mask=np.isnan(c)) for c in found.T]
        return pa.RecordBatch.from_arrays([*own.columns[: len(keys)], pa.array(np.diff(np.append(first, end))), *circle], [*keys, "n", "xc", "yc", "r"]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = bound = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= max(TOGETHER, 2 * bound):  # a group that goes on is looked at again when there is twice as much of it
                out, held = fit(held, False)
                size = bound = sum(b.num_rows for b in held)
                if out is not None:
                    yield out
        if size:
            yield fit(held, True)[0]

    return dealt.mapInArrow(run, f"{schema}, n long, xc double, yc double, r double")


FITS = {"kasa": kasa, "hyper": hyper, "ls": least_squares}


def circles(df: DataFrame, keys: list[str], method: str) -> DataFrame:
    return FITS[method](df, keys)
