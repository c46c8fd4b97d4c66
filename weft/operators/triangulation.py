"""Delaunay triangulation, Urquhart graph and constrained triangulation, one task for each layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layouts import each_layout
from ..sources.tables import Points


def triangles(x: np.ndarray) -> np.ndarray:
    """Delaunay triangles by insertion: those whose circle holds the new point give way to a fan around it."""
    n = len(x)
    if n < 3:
        raise ValueError("a triangulation needs three points")
    middle, size = x.mean(0), np.ptp(x, axis=0).max() or 1.0
    far = middle + size * 1e4 * np.array([[-3.0, -3.0], [3.0, -3.0], [0.0, 3.0]])
    p = np.concatenate([x, far])

    def circles(t: np.ndarray):
        a, b, c = (p[t[:, k]] - middle for k in range(3))
        d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
        sa, sb, sc = (a**2).sum(1), (b**2).sum(1), (c**2).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            o = np.stack([(sa * (b[:, 1] - c[:, 1]) + sb * (c[:, 1] - a[:, 1]) + sc * (a[:, 1] - b[:, 1])) / d, (sa * (c[:, 0] - b[:, 0]) + sb * (a[:, 0] - c[:, 0]) + sc * (b[:, 0] - a[:, 0])) / d], 1)
        return o, ((a - o) ** 2).sum(1)

    t = np.array([[n, n + 1, n + 2]])
    o, r = circles(t)
    for i in range(n):
        hit = ((p[i] - middle - o) ** 2).sum(1) < r * (1 - 1e-14)
        edges = np.sort(np.concatenate([t[hit][:, [0, 1]], t[hit][:, [1, 2]], t[hit][:, [2, 0]]]), axis=1)
        edges, times = np.unique(edges, axis=0, return_counts=True)
        fan = np.column_stack([edges[times == 1], np.full((times == 1).sum(), i)])
        fo, fr = circles(fan)
        t, o, r = np.concatenate([t[~hit], fan]), np.concatenate([o[~hit], fo]), np.concatenate([r[~hit], fr])
    return np.sort(t[(t < n).all(1)], axis=1)


def _edges(t: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [0, 2]]]), axis=0)


def _weighted(x: np.ndarray, edges) -> list[tuple[int, int, float]]:
    return [(int(a), int(b), float(np.sqrt(((x[a] - x[b]) ** 2).sum()))) for a, b in edges]


def delaunay(points: Points) -> DataFrame:
    """Edges of the Delaunay triangulation (plane)."""
    return each_layout(points.checked(3), lambda x, ids: _weighted(x, _edges(triangles(x))))


def urquhart(points: Points) -> DataFrame:
    """Delaunay edges without the longest of each triangle."""
    def build(x, ids):
        t = triangles(x)
        sides = t[:, [[0, 1], [1, 2], [0, 2]]]
        length = np.sqrt(((x[sides[:, :, 0]] - x[sides[:, :, 1]]) ** 2).sum(-1))
        gone = {tuple(s[k]) for s, k in zip(sides.tolist(), length.argmax(1))} if len(t) else set()
        gone = {tuple(e) for e in gone}
        return _weighted(x, [e for e in _edges(t).tolist() if tuple(e) not in gone])

    return each_layout(points.checked(3), build)


def hull(x: np.ndarray) -> list[int]:
    """The corners of a convex hull in the plane, one after the other; points along a side are none."""
    def half(row: list[int]) -> list[int]:
        out: list[int] = []
        for i in row:
            while len(out) > 1:
                (ax, ay), (bx, by) = x[out[-1]] - x[out[-2]], x[i] - x[out[-2]]
                if ax * by - ay * bx > 0:
                    break
                out.pop()
            out.append(i)
        return out[:-1]

    order = np.lexsort((x[:, 1], x[:, 0])).tolist()
    return half(order) + half(order[::-1])


def default_constraints(points: Points) -> DataFrame:
    """(keys, src, dst): the two shortest pairs between each two labels of a layout, and the sides of each label's convex
    hull; the closest pair in layouts that have neither."""
    from pyspark.sql import Window

    from ..plans.pairs import pairs

    keys = [*points.keys]

    def sides(pdf):
        pdf = pdf.sort_values("id", kind="stable")
        ids, corners = pdf["id"].to_numpy(), hull(np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1)[:, :2])
        ends = [sorted((ids[a], ids[b])) for a, b in zip(corners, [*corners[1:], *corners[:1]])] if len(corners) > 2 else []
        return pd.DataFrame({c: [pdf[c].iloc[0]] * len(ends) for c in keys} | {"src": [a for a, _ in ends], "dst": [b for _, b in ends]})

    across = pairs(points, extra=("label",)).filter("label_a <> label_b")
    w = Window.partitionBy(*keys, F.least("label_a", "label_b"), F.greatest("label_a", "label_b")).orderBy("dist", "src", "dst")
    bridges = across.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select(*keys, "src", "dst")
    kinds = [f"{c} {points.frame.schema[c].dataType.simpleString()}" for c in keys]
    hulls = points.frame.select(*keys, "label", F.col("id").cast("long").alias("id"), "features").groupBy(*keys, "label").applyInPandas(sides, ", ".join([*kinds, "src long, dst long"]))
    found = bridges.unionByName(hulls).distinct()
    if keys:
        bare = points.frame.join(found.select(*keys).distinct(), keys, "left_anti")
    elif found.limit(1).count():
        return found
    else:
        bare = points.frame
    closest = pairs(Points(bare, points.dims, points.keys)).groupBy(*keys).agg(F.min(F.struct("dist", "src", "dst")).alias("x"))
    return found.unionByName(closest.filter("x is not null").select(*keys, "x.src", "x.dst"))


def constrained_delaunay(points: Points, constraints: DataFrame | None = None) -> DataFrame:
    """Delaunay edges and the constraints' (keys, src, dst; default_constraints(), if none are given), flagged."""
    constraints = default_constraints(points) if constraints is None else constraints
    ends = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    asked = constraints.select(*points.keys, *ends).distinct().withColumn("constrained", F.lit(True))
    place = lambda end, name: points.frame.select(*points.keys, F.col("id").alias(end), F.col("features").alias(name))
    from ..functions.vectors import distance

    known = asked.join(place("src", "fa"), [*points.keys, "src"]).join(place("dst", "fb"), [*points.keys, "dst"]).select(*points.keys, "src", "dst", distance("fa", "fb", points.dims).alias("weight"), "constrained")
    both = delaunay(points).withColumn("constrained", F.lit(False)).unionByName(known)
    return both.groupBy(*points.keys, "src", "dst").agg(F.min("weight").alias("weight"), F.bool_or("constrained").alias("constrained"))
