"""Column expressions: colours, angles, hashed uniforms, guarded arithmetic."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GREATEST_DOUBLE = 1.7976931348623157e308


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """Three bytes in one integer; readers and writers of PCD files take its bits as a float."""
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def unpack_rgb(packed: Column) -> list[Column]:
    return [F.shiftright(packed, s).bitwiseAND(255).alias(n) for s, n in ((16, "r"), (8, "g"), (0, "b"))]


def nan_to_zero(c: Column) -> Column:
    """NaN and null become 0, infinities the greatest finite double."""
    v = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.least(v, F.lit(GREATEST_DOUBLE)), F.lit(-GREATEST_DOUBLE))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (ANSI division would raise)."""
    return a / F.nullif(b, F.lit(0.0))


def min_max(c: Column, low: Column, high: Column) -> Column:
    """(c - low) / (high - low), 0 for a constant."""
    return F.coalesce(ratio(c - low, high - low), F.lit(0.0))


def square_distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda s, d: s + d, [(x - y) * (x - y) for x, y in zip(a, b, strict=True)])


def length(v: list[Column]) -> Column:
    return F.sqrt(reduce(lambda s, d: s + d, [c * c for c in v]))


def angle_between(v: list[Column], w: list[Column]) -> Column:
    """Degrees between two vectors, null if one has no length."""
    dot = reduce(lambda s, d: s + d, [a * b for a, b in zip(v, w, strict=True)])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(dot, length(v) * length(w))))))


def uniform(seed: int, *keys: str, stream: int = 0) -> Column:
    """A number in [0, 1) that depends on seed, stream and keys only, not on partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *keys), 11) / float(1 << 53)


def normal(seed: int, *keys: str, stream: int = 0) -> Column:
    """A standard normal number from two uniforms (Box and Muller)."""
    u, v = uniform(seed, *keys, stream=2 * stream + 1001), uniform(seed, *keys, stream=2 * stream + 1002)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def clip(c: Column, bound: float) -> Column:
    return F.greatest(F.least(c, F.lit(bound)), F.lit(-bound))
