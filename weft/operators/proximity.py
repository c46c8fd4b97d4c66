"""Proximity graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import all_pairs, plain
from ..plans.pairs import check_k, empty_region, nearest, pairs, undirected
from ..sources.tables import Points


def complete(points: Points, weighted: bool = True) -> DataFrame:
    """All pairs. In the plane they come cell by cell (plans/blocks.py), which takes less room when written."""
    if plain(points):
        out = all_pairs(points)
        return out if weighted else out.withColumn("weight", F.lit(None).cast("double"))
    return pairs(points).select(*points.keys, "src", "dst", (F.col("dist") if weighted else F.lit(None).cast("double")).alias("weight"))


def symmetric_knn(points: Points, k: int = 5) -> DataFrame:
    """Edges where either end is among the other's k nearest."""
    check_k(points, k)
    return undirected(nearest(points, k).withColumn("weight", F.col("dist")), points.keys, "weight")


def mutual_knn(points: Points, k: int = 5) -> DataFrame:
    """Edges where both ends are among each other's k nearest: those that are proposed twice."""
    check_k(points, k)
    both = nearest(points, k).groupBy(*points.keys, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.count("*").alias("n"), F.min("dist").alias("weight"))
    return both.filter("n = 2").select(*points.keys, F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight")


def epsilon(points: Points, epsilon: float = 1.2) -> DataFrame:
    """Edges of length epsilon at most."""
    return pairs(points, within=epsilon).select(*points.keys, "src", "dst", F.col("dist").alias("weight"))


def beta_skeleton(points: Points, beta: float = 1.5) -> DataFrame:
    """Edges whose lune (beta >= 1), or lens (beta < 1, in the plane), holds no third point."""
    if beta <= 0:
        raise ValueError("beta must be positive")
    h = beta / 2
    if beta >= 1:
        return empty_region(points, lambda a, b, c: ((1 - h) * a + h * b < h * c) & (h * a + (1 - h) * b < h * c), ball=beta <= 2).filter("weight >= 1e-15")
    # a point sees the edge under an angle of more than pi - asin(beta) inside the lens of two circles of diameter |ij| / beta
    return empty_region(points, lambda a, b, c: (a + b < c) & ((c - a - b) * (c - a - b) > 4 * (1 - beta * beta) * a * b)).filter("weight >= 1e-15")


def gabriel(points: Points) -> DataFrame:
    """Edges whose diametral ball holds no third point."""
    return empty_region(points, lambda a, b, c: a + b < c, ball=True)


def rng(points: Points) -> DataFrame:
    """Relative neighbourhood graph: no third point nearer to both ends than they are to each other."""
    return empty_region(points, lambda a, b, c: (a < c) & (b < c), ball=True)


def influence(points: Points) -> DataFrame:
    """Edges shorter than the sum of both ends' nearest-neighbour distances."""
    radius = nearest(points, 1).select(*points.keys, F.col("src").alias("id"), F.col("dist").alias("radius"))
    known = Points(points.frame.join(radius, [*points.keys, "id"]), points.dims, points.keys)
    return pairs(known, extra=("radius",)).filter("dist < radius_a + radius_b").select(*points.keys, "src", "dst", F.col("dist").alias("weight"))
