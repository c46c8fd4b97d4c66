"""Visibility graphs of series and among obstacles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import crossing
from ..plans.blocks import MOST, all_pairs, plain
from ..plans.pairs import pairs
from ..sources.tables import Points, drawn_obstacles


def _ahead(series: DataFrame) -> DataFrame:
    a = series.select("layout", F.col("seq").alias("i"), F.col("id").alias("src"), F.col("t").alias("ta"), F.col("v").alias("va"))
    b = series.select("layout", F.col("seq").alias("j"), F.col("id").alias("dst"), F.col("t").alias("tb"), F.col("v").alias("vb"))
    return a.join(b, "layout").filter("i < j")


def _edges(seen: DataFrame, directed: bool, original: bool) -> DataFrame:
    src, dst = (F.col("src"), F.col("dst")) if original else (F.col("i").cast("long"), F.col("j").cast("long"))
    low, high = (src, dst) if directed else (F.least(src, dst), F.greatest(src, dst))
    return seen.select("layout", low.alias("src"), high.alias("dst"), F.abs(F.col("tb") - F.col("ta")).alias("weight"), (F.col("j") - F.col("i")).alias("time_gap"))


def natural_visibility(series: DataFrame, directed: bool = False, use_original_indices: bool = True) -> DataFrame:
    """Events that see each other over all between: the slope to the later one is above all slopes before."""
    between = Window.partitionBy("layout", "i").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    sloped = _ahead(series).withColumn("slope", F.when(F.col("tb") - F.col("ta") >= 1e-15, (F.col("vb") - F.col("va")) / (F.col("tb") - F.col("ta"))))
    seen = sloped.withColumn("highest", F.max("slope").over(between)).filter((F.col("j") == F.col("i") + 1) | (F.col("slope") > F.col("highest")))
    return _edges(seen, directed, use_original_indices)


def horizontal_visibility(series: DataFrame, directed: bool = False, use_original_indices: bool = True) -> DataFrame:
    """Events that both are above all between."""
    between = Window.partitionBy("layout", "i").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    seen = _ahead(series).withColumn("highest", F.max("vb").over(between)).filter((F.col("j") == F.col("i") + 1) | (F.col("highest") < F.least("va", "vb")))
    return _edges(seen, directed, use_original_indices)


def geometric_visibility(points: Points, segments: DataFrame | None = None) -> DataFrame:
    """Pairs whose line crosses none of the obstacles' edges (x1, y1, x2, y2); drawn_obstacles(), if none are given.

    In the plane, behind 64 edges or fewer, pairs come cell by cell (plans/blocks.py), which takes less room when written."""
    segments = drawn_obstacles(points) if segments is None else segments
    walls = [tuple(w) for w in segments.select("x1", "y1", "x2", "y2").limit(65).collect()]
    if len(walls) <= 64 and plain(points) and all(isinstance(v, (int, float)) and abs(v) <= MOST for w in walls for v in w):
        return all_pairs(points, lambda x: _unparted(x, walls))
    at = lambda f: (F.get(f, F.lit(0)), F.get(f, F.lit(1)))
    blocked = crossing(at("fa"), at("fb"), (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
    return pairs(points).join(F.broadcast(segments) if _few(segments) else segments, blocked, "left_anti").select(*points.keys, "src", "dst", F.col("dist").alias("weight"))


def _unparted(x: np.ndarray, walls: list[tuple], eps: float = 1e-10):
    """A function of (i, j): whether none of 64 walls or fewer crosses the line between, as crossing() has it. Each point has a bit for each wall whose
    one or other side it is on; only walls with the ends on different sides are looked at."""
    left, right = np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
    for k, (x1, y1, x2, y2) in enumerate(walls):
        side = (x2 - x1) * (x[:, 1] - y1) - (y2 - y1) * (x[:, 0] - x1)
        left |= (side > eps).astype(np.uint64) << np.uint64(k)
        right |= (side < -eps).astype(np.uint64) << np.uint64(k)

    def stays(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        between = (left[i] & right[j]) | (right[i] & left[j])
        out = between == 0
        rest = np.nonzero(~out)[0]
        out[rest] = True
        for k, (x1, y1, x2, y2) in enumerate(walls):
            own = rest[(between[rest] >> np.uint64(k)) & np.uint64(1) == 1]
            if len(own):
                a, b = x[i[own]], x[j[own]]
                dx, dy = b[:, 0] - a[:, 0], b[:, 1] - a[:, 1]
                one, two = dx * (y1 - a[:, 1]) - dy * (x1 - a[:, 0]), dx * (y2 - a[:, 1]) - dy * (x2 - a[:, 0])
                out[own[((one > eps) & (two < -eps)) | ((one < -eps) & (two > eps))]] = False
                rest = rest[out[rest]]
        return out

    return stays


def _few(segments: DataFrame, most: int = 100_000) -> bool:
    return segments.limit(most + 1).count() <= most
