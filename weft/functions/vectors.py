"""Column expressions on vectors, angles and hashed random numbers."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: str, b: str, dims: int) -> Column:
    """Written out over the dimensions, so that it stays inside generated code."""
    parts = [(F.get(a, F.lit(k)) - F.get(b, F.lit(k))) for k in range(dims)]
    return reduce(lambda x, y: x + y, [p * p for p in parts])


def distance(a: str, b: str, dims: int) -> Column:
    return F.sqrt(squared_distance(a, b, dims))


def dot(a: str, b: str, dims: int) -> Column:
    return reduce(lambda x, y: x + y, [F.get(a, F.lit(k)) * F.get(b, F.lit(k)) for k in range(dims)])


def norm(a: str, dims: int) -> Column:
    return F.sqrt(dot(a, a, dims))


def cosine(a: str, b: str, dims: int) -> Column:
    """Clipped to [-1, 1]; norms count as 1e-12 at least."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b, dims) / (F.greatest(norm(a, dims), F.lit(1e-12)) * F.greatest(norm(b, dims), F.lit(1e-12)))))


def angle(a: str, b: str) -> Column:
    """Direction from a to b in [0, 2 pi)."""
    raw = F.atan2(F.get(b, F.lit(1)) - F.get(a, F.lit(1)), F.get(b, F.lit(0)) - F.get(a, F.lit(0)))
    return F.when(raw < 0, raw + 2 * pi).otherwise(raw)


def cone(direction: Column, k: int) -> Column:
    """Which of k equal cones holds a direction."""
    return F.least(F.lit(k - 1), F.floor(direction / (2 * pi / k))).cast("int")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(seed:key:...), alike in every engine and order."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(seed: int, a: Column, b: Column) -> Column:
    """A standard normal number from two hashed draws for (a, b)."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, a, b))) * F.cos(2 * pi * uniform(seed, a, b, F.lit("turn")))


def crossing(p1: tuple, p2: tuple, p3: tuple, p4: tuple, eps: float = 1e-10) -> Column:
    """Whether segments p1-p2 and p3-p4 cross properly; touching doesn't count."""
    def side(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def apart(x, y):
        return ((x > eps) & (y < -eps)) | ((x < -eps) & (y > eps))

    return apart(side(p3, p4, p1), side(p3, p4, p2)) & apart(side(p1, p2, p3), side(p1, p2, p4))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside a polygon: a ray to the right crosses its sides an odd number of times."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]]):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inside = inside != crosses
    return inside
