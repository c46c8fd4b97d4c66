"""Shortest paths on a graph's edges, and how much longer they are than straight lines."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..plans.layouts import by_layout
from ..plans.regions import finite
from ..plans.scratch import cut
from ..sources.tables import Points


def shortest_paths(edges: DataFrame, sources: DataFrame, keys: tuple[str, ...] = (), directed: bool = False) -> DataFrame:
    """(keys, source, node, dist) of all nodes that the sources (keys, id) reach over edges (keys, src, dst, weight), weights not negative.

    All sources go on together, turn by turn: from what became nearer, along its edges; a turn's result is a written table. There
    are as many turns as the path with the most edges has, and rows for the nodes that are reached only."""
    moves = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("to"), "weight")
    if not directed:
        moves = moves.unionByName(edges.select(*keys, F.col("dst").alias("node"), F.col("src").alias("to"), "weight"))
    moves = cut(moves.groupBy(*keys, "node", "to").agg(F.min("weight").alias("weight")))
    place = [*keys, "source", "node"]
    found = cut(sources.select(*keys, F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("dist")).distinct())
    fresh = found
    while True:
        ahead = fresh.join(moves, [*keys, "node"]).groupBy(*keys, "source", F.col("to").alias("node")).agg(F.min(F.col("dist") + F.col("weight")).alias("near"))
        fresh = cut(ahead.join(found, place, "left").filter("dist is null or near < dist").select(*place, F.col("near").alias("dist")))
        if not fresh.limit(1).count():
            return found
        found = cut(found.join(fresh.select(*place), place, "left_anti").unionByName(fresh))


def eliminated(n: int, edges) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Nodes 0 to n - 1 in an order of elimination, each with its later neighbours and their weights, where the neighbours of an eliminated
    node are linked with each other: each shortest path is then as long as one that goes up in this order and down again."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w < near[a].get(b, np.inf):
            near[a][b] = near[b][a] = w
    heap, gone, out = [(len(x), v) for v, x in enumerate(near)], [False] * n, []
    heapify(heap)
    while heap:
        size, v = heappop(heap)
        if gone[v] or size != len(near[v]):
            continue
        gone[v], own = True, list(near[v].items())
        for k, (a, w) in enumerate(own):
            row = near[a]
            del row[v]
            for b, x in own[k + 1 :]:
                if w + x < row.get(b, np.inf):
                    row[b] = near[b][a] = w + x
        for a, _ in own:
            heappush(heap, (len(near[a]), a))
        out.append((v, np.array([a for a, _ in own], int), np.array([w for _, w in own], float)))
        near[v] = {}
    return out


def distances_from(n: int, order: list, sources: np.ndarray) -> np.ndarray:
    """(nodes, sources): lengths of shortest paths, up the order and down again."""
    d = np.full((n, len(sources)), np.inf)
    d[sources, np.arange(len(sources))] = 0
    for v, up, w in order:
        if len(up):
            d[up] = np.minimum(d[up], d[v] + w[:, None])
    for v, up, w in reversed(order):
        if len(up):
            d[v] = np.minimum(d[v], (d[up] + w[:, None]).min(0))
    return d


def _stretch_by_layout(points: Points, edges: DataFrame, block: int = 512) -> DataFrame:
    """stretch, for many layouts of sparse edges: a task holds a layout's edges, and distances from `block` points at a time."""
    kind, dims = points.frame.schema["layout"].dataType.simpleString(), points.dims

    def run(key, own, links):
        ids, x = own["id"].to_numpy(), np.array(own["features"].tolist(), float).reshape(len(own), dims)
        nodes = np.unique(np.concatenate([ids, links["src"].to_numpy(), links["dst"].to_numpy()]).astype(np.int64))
        a, b = (np.searchsorted(nodes, links[c].to_numpy()).tolist() for c in ("src", "dst"))
        order, at, worst = eliminated(len(nodes), zip(a, b, links["weight"].tolist())), np.searchsorted(nodes, ids), None
        for s in range(0, len(ids), block):
            d = distances_from(len(nodes), order, at[s : s + block])[at].T
            straight = np.sqrt(sum((x[s : s + block, k][:, None] - x[:, k][None]) ** 2 for k in range(dims)))
            far = (straight > 1e-15) & (ids[s : s + block][:, None] < ids[None])
            if far.any():
                worst = max(worst or 1.0, float((d[far] / straight[far]).max()))
        return pd.DataFrame({"layout": [key[0]], "stretch": [worst]}) if worst is not None else pd.DataFrame({"layout": [], "stretch": []})

    grouped = by_layout(points.frame.select("layout", "id", "features")).groupBy("layout")
    return grouped.cogroup(by_layout(edges.select("layout", "src", "dst", "weight")).groupBy("layout")).applyInPandas(run, f"layout {kind}, stretch double")


def stretch(points: Points, edges: DataFrame) -> DataFrame:
    """For each layout the largest ratio of path to distance over all pairs of points that aren't in one place, 1 at least; infinite
    where some pair has no path. Rows grow with the square of the points, as the measure is over all pairs."""
    if points.keys and finite(points):
        edges = cut(edges.select(*points.keys, "src", "dst", "weight"))
        if edges.count() <= 20 * points.frame.count():
            return _stretch_by_layout(points, edges)
    keys = [*points.keys]
    paths = shortest_paths(edges, points.frame.select(*keys, "id"), points.keys)
    a = points.frame.select(*keys, F.col("id").alias("source"), F.col("features").alias("fa"))
    b = points.frame.select(*(F.col(k).alias(f"{k}_b") for k in keys), F.col("id").alias("node"), F.col("features").alias("fb"))
    on = F.col("source") < F.col("node")
    for k in keys:
        on = on & (F.col(k) == F.col(f"{k}_b"))
    pairs = a.join(b, on).select(*keys, "source", "node", distance("fa", "fb", points.dims).alias("straight")).filter("straight > 1e-15")
    ratio = F.coalesce(F.col("dist") / F.col("straight"), F.lit(float("inf")))
    worst = pairs.join(paths, [*keys, "source", "node"], "left").groupBy(*keys).agg(F.max(ratio).alias("worst"))
    return worst.select(*keys, F.greatest(F.coalesce("worst", F.lit(1.0)), F.lit(1.0)).alias("stretch"))


def is_spanner(points: Points, edges: DataFrame, t: float) -> DataFrame:
    """For each layout whether no path is more than t times as long as the straight line (a rounding error aside)."""
    return stretch(points, edges).select(*points.keys, (F.col("stretch") <= t + 1e-9).alias("is_spanner"))
