"""Pairs of points: all of them, nearest ones, those within a radius, and those that no third point parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance, squared_distance
from ..sources.tables import Points
from .regions import empty_in_plane, finite
from .scratch import cut


def two(points: Points, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The points as sources (src, fa, ...) and as targets (dst, fb, ...)."""
    keep = [*points.keys]
    a = points.frame.select(*keep, F.col("id").alias("src"), F.col("features").alias("fa"), *(F.col(c).alias(f"{c}_a") for c in extra))
    b = points.frame.select(*(F.col(k).alias(f"{k}_b") for k in keep), F.col("id").alias("dst"), F.col("features").alias("fb"), *(F.col(c).alias(f"{c}_b") for c in extra))
    return a, b


def pairs(points: Points, ordered: bool = False, extra: tuple[str, ...] = (), within: float | None = None) -> DataFrame:
    """keys, src, dst, dist (and fa, fb): src < dst, or both orders. within: only so far apart, found by a grid in two or three dimensions."""
    a, b = two(points, extra)
    on = F.col("src") != F.col("dst") if ordered else F.col("src") < F.col("dst")
    for k in points.keys:
        on = on & (F.col(k) == F.col(f"{k}_b"))
    dist = distance("fa", "fb", points.dims)
    if within is not None and within > 0 and points.dims <= 3:
        # cells as wide as the radius: partners are in the same or a neighbouring cell
        cell = lambda f: [F.floor(F.get(f, F.lit(k)) / within) for k in range(points.dims)]
        a = a.withColumn("cell", F.array(*cell("fa")))
        shifts = [[]]
        for _ in range(points.dims):
            shifts = [[*s, d] for s in shifts for d in (-1, 0, 1)]
        b = b.withColumn("cell_b", F.explode(F.array(*(F.array(*(c + d for c, d in zip(cell("fb"), s))) for s in shifts))))
        on = on & (F.col("cell") == F.col("cell_b"))
    out = a.join(b, on).withColumn("dist", dist).drop(*(f"{k}_b" for k in points.keys), "cell", "cell_b")
    return out if within is None else out.filter(F.col("dist") <= within)


def nearest(points: Points, k: int, grid_from: int = 50_000) -> DataFrame:
    """keys, src, dst, dist, rank: the k nearest of each point; the smaller id goes first among equals.

    All pairs are ranked where that is all one can do; from `grid_from` points on, in up to three dimensions, a grid finds the same."""
    if points.dims <= 3 and points.frame.limit(grid_from).count() == grid_from:
        return _nearest_by_grid(points, k)
    w = Window.partitionBy(*points.keys, "src").orderBy("dist", "dst")
    out = pairs(points, ordered=True).select(*points.keys, "src", "dst", "dist")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest_by_grid(points: Points, k: int) -> DataFrame:
    """Points with k others within a cell's width have their k nearest in the 3^dims cells around; the
    rest tries again with cells twice as wide, until a cell is as wide as the whole set."""
    keys, dims = points.keys, points.dims
    box = points.frame.agg(F.count("*").alias("n"), *(F.min(F.get("features", F.lit(d))).alias(f"lo{d}") for d in range(dims)), *(F.max(F.get("features", F.lit(d))).alias(f"hi{d}") for d in range(dims))).first()
    extent = [max(box[f"hi{d}"] - box[f"lo{d}"], 1e-12) for d in range(dims)]
    volume = 1.0
    for e in extent:
        volume *= e
    width, left, found = (volume / box["n"] * (k + 1)) ** (1 / dims), points, None
    while True:
        wide = width >= max(extent)
        near = _around(left, points, width, wide)
        rank = F.row_number().over(Window.partitionBy(*keys, "src").orderBy("dist", "dst"))
        best = cut(near.withColumn("rank", rank).filter(F.col("rank") <= k))
        settled = best.filter(F.col("rank") == k).select(*keys, "src")
        part = best if wide else best.join(settled, [*keys, "src"], "left_semi")
        found = part if found is None else found.unionByName(part)
        if wide:
            return found
        rest = cut(left.frame.join(settled.withColumnRenamed("src", "id"), [*keys, "id"], "left_anti"))
        if not rest.limit(1).count():
            return found
        left, width = Points(rest, dims, keys), 2 * width


def _around(left: Points, points: Points, width: float, wide: bool) -> DataFrame:
    """Ordered pairs from `left` to `points` that are no further apart than width (all, if wide)."""
    keys, dims = points.keys, points.dims
    a, b = two(left)[0], two(points)[1]
    on = F.col("src") != F.col("dst")
    for c in keys:
        on = on & (F.col(c) == F.col(f"{c}_b"))
    if not wide:
        cell = lambda f: [F.floor(F.get(f, F.lit(d)) / width) for d in range(dims)]
        shifts = [[]]
        for _ in range(dims):
            shifts = [[*s, d] for s in shifts for d in (-1, 0, 1)]
        a = a.withColumn("cell", F.explode(F.array(*(F.array(*(c + d for c, d in zip(cell("fa"), s))) for s in shifts))))
        b = b.withColumn("cell_b", F.array(*cell("fb")))
        on = on & (F.col("cell") == F.col("cell_b"))
    out = a.join(b, on).select(*keys, "src", "dst", distance("fa", "fb", dims).alias("dist"))
    return out if wide else out.filter(F.col("dist") <= width)


def undirected(edges: DataFrame, keys: tuple[str, ...], *more: str) -> DataFrame:
    """Each edge once, src < dst; of an edge proposed by both ends the smaller end's columns stay."""
    first = edges.select(*keys, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.struct("src", *more).alias("x"))
    best = first.groupBy(*keys, "lo", "hi").agg(F.min("x").alias("x"))
    return best.select(*keys, F.col("lo").alias("src"), F.col("hi").alias("dst"), *(F.col(f"x.{c}").alias(c) for c in more))


def check_k(points: Points, k: int) -> None:
    """ValueError where k isn't less than a layout's number of points."""
    row = points.frame.groupBy(*points.keys).count().agg(F.min("count").alias("n")).first()
    if k < 1 or not row["n"] or k >= row["n"]:
        raise ValueError(f"k={k} must be at least 1 and less than the number of points")


def empty_region(points: Points, inside, candidates: DataFrame | None = None, near: int = 8, ball: bool = False) -> DataFrame:
    """Pairs for which no third point lies inside their region. inside(a, b, c): from the squared
    distances a = |ik|^2, b = |jk|^2 and c = |ij|^2, whether k does.

    ball: the region holds the diametral ball, and no point further from an end than the other end is. In the plane such pairs
    are found near by, without all pairs.

    Most pairs are parted by one of the few points nearest to an end, so these are tried first, row by
    row; what is left is held against all points by an anti-join."""
    dims = points.dims
    if ball and dims == 2 and candidates is None and finite(points):
        return empty_in_plane(points, inside)
    around = nearest(points, near).join(points.frame.select(*points.keys, F.col("id").alias("dst"), "features"), [*points.keys, "dst"])
    around = around.groupBy(*points.keys, F.col("src").alias("id")).agg(F.collect_list(F.struct(F.col("dst").alias("id"), "features")).alias("near"))  # `near` points each
    known = Points(points.frame.join(around, [*points.keys, "id"]), dims, points.keys)
    both = candidates if candidates is not None else pairs(known, extra=("near",))
    both = both.withColumn("c", squared_distance("fa", "fb", dims))

    def square(f: str, k: Column) -> Column:
        total = None
        for d in range(dims):
            x = F.get(f, F.lit(d)) - F.get(k, F.lit(d))
            total = x * x if total is None else total + x * x
        return total

    def parted(k: Column) -> Column:
        return (k["id"] != F.col("src")) & (k["id"] != F.col("dst")) & inside(square("fa", k["features"]), square("fb", k["features"]), F.col("c"))

    def any_parts(side: str) -> Column:
        if dims > 3:
            return F.exists(side, parted)
        out = F.lit(False)  # written out, so that it stays inside generated code
        for j in range(near):
            out = out | F.coalesce(parted(F.get(side, F.lit(j))), F.lit(False))
        return out

    left = both.filter(~any_parts("near_a")).filter(~any_parts("near_b")).drop("near_a", "near_b")
    third = points.frame.select(*(F.col(k).alias(f"{k}_k") for k in points.keys), F.col("id").alias("k"), F.col("features").alias("fk"))
    on = (F.col("k") != F.col("src")) & (F.col("k") != F.col("dst")) & inside(squared_distance("fa", "fk", dims), squared_distance("fb", "fk", dims), F.col("c"))
    for k in points.keys:
        on = on & (F.col(k) == F.col(f"{k}_k"))
    return left.join(third, on, "left_anti").select(*points.keys, "src", "dst", F.col("dist").alias("weight"))
