"""Spanning trees: Boruvka's rounds as plans, on edges that can be in the tree; random trees in a task for each layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normal
from ..plans.layouts import by_layout, each_layout
from ..plans.noisy_trees import overlay
from ..plans.pairs import pairs
from ..plans.regions import empty_in_plane, finite
from ..plans.scratch import components, cut
from ..sources.tables import Points
from .proximity import rng


def _kruskal(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The forest of a number of edges that one task may hold: by weight, then ends, those that close no ring."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, top, kept = pdf.sort_values(["weight", "src", "dst"], kind="stable"), {}, []
        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
            while (x := top.setdefault(a, a)) != a:
                top[a] = a = top[x]
            while (x := top.setdefault(b, b)) != b:
                top[b] = b = top[x]
            kept.append(a != b)
            top[a] = b
        return pdf[np.array(kept, bool)]

    group = keys or ("all",)
    frame = edges if keys else edges.withColumn("all", F.lit(0))
    return frame.groupBy(*group).applyInPandas(run, frame.schema).select(*keys, "src", "dst", "weight")


def minimum_forest(edges: DataFrame, keys: tuple[str, ...] = (), in_one_task: int = 500_000) -> DataFrame:
    """Minimum spanning forest of edges (keys, src, dst, weight) in rounds: each component's lightest
    outgoing edge (then smallest ends) joins it to another. The number of rounds is at most log2 of the nodes.
    Up to `in_one_task` edges in all are sorted in a task for each layout, with the same result."""
    edges = cut(edges.select(*keys, "src", "dst", "weight"))
    if edges.count() <= in_one_task:
        return _kruskal(edges, keys)
    node = lambda c: F.concat_ws(":", *keys, F.format_string("%020d", c)) if keys else F.col(c)
    edges = edges.select(*keys, "src", "dst", "weight", node("src").alias("a"), node("dst").alias("b"))
    tree, left = None, edges.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    while left.limit(1).count():
        out = left.select(F.col("ca").alias("c"), F.struct("weight", "a", "b").alias("e")).unionByName(left.select(F.col("cb").alias("c"), F.struct("weight", "a", "b").alias("e")))
        best = out.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        chosen = cut(left.join(best.select("a", "b"), ["a", "b"]).select(*keys, "src", "dst", "weight", "ca", "cb"))
        tree = chosen.drop("ca", "cb") if tree is None else tree.unionByName(chosen.drop("ca", "cb"))
        label = components(chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        for end in ("ca", "cb"):
            left = left.join(label.select(F.col("node").alias(end), F.col("label").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = cut(left.filter("ca <> cb"))
    return tree if tree is not None else edges.select(*keys, "src", "dst", "weight")


def _can_be_in_tree(points: Points) -> DataFrame:
    """keys, src, dst, weight of pairs that hold the minimum spanning tree whose equal weights are taken by their ends: in the plane
    those without a third place nearer to both ends, as the longest side of a triangle is in no tree; else all pairs."""
    if points.dims == 2 and finite(points):
        return empty_in_plane(points, lambda a, b, c: (np.sqrt(a) < np.sqrt(c)) & (np.sqrt(b) < np.sqrt(c)), one=True)
    return pairs(points).select(*points.keys, "src", "dst", F.col("dist").alias("weight"))


def emst(points: Points) -> DataFrame:
    """Minimum spanning tree of the relative neighbourhood graph, which holds one of all pairs."""
    return minimum_forest(_can_be_in_tree(points) if points.dims == 2 else rng(points), points.keys)


def mst_boruvka(points: Points) -> DataFrame:
    """Minimum spanning tree of all pairs; equal weights are taken by their ends."""
    return minimum_forest(_can_be_in_tree(points), points.keys)


def mst_kruskal(points: Points) -> DataFrame:
    """The same tree as mst_boruvka where weights differ."""
    return mst_boruvka(points)


def mst_prim(points: Points, start_vertex: int = 0) -> DataFrame:
    """The same tree as mst_boruvka where weights differ, from whatever vertex it would start."""
    return emst(points)


def k_mst_overlay(points: Points, k: int = 3, penalty: float = 2.0, noise_scale: float = 0.1, seed: int = 55) -> DataFrame:
    """The union of k trees. From the second on, an edge costs more by `penalty` for each tree that has it, and by normal
    noise of hashed draws: `noise_scale` of the layout's mean distance (of ordered pairs, a point with itself included),
    halved in variance, as that of both directions is averaged."""
    keys = [*points.keys]
    if k == 1:
        return mst_boruvka(points)
    if penalty >= 0 and finite(points):
        return _overlay_by_layout(points, k, penalty, noise_scale, seed)
    base = cut(pairs(points).select(*keys, "src", "dst", F.col("dist").alias("base")))
    if noise_scale and k > 1:
        n = (1 + F.sqrt(1 + 8 * F.count("*"))) / 2
        means = base.groupBy(*keys).agg((2 * F.sum("base") / (n * n)).alias("mean"))
        base = cut(base.join(means, keys) if keys else base.crossJoin(F.broadcast(means)))  # a row, where there is one layout
    used = None
    for turn in range(k):
        if used is None:
            edges = base.withColumn("weight", F.col("base"))
        else:
            edges = base.join(used, [*keys, "src", "dst"], "left").withColumn("weight", F.col("base") * (1 + penalty * F.coalesce("n", F.lit(0))))
            if noise_scale:
                drawn = normal(seed + turn, F.col("src"), F.col("dst"))
                edges = edges.withColumn("weight", F.greatest(F.col("weight") + noise_scale * F.col("mean") * drawn / 2**0.5, F.lit(1e-12)))
        fresh = minimum_forest(edges.select(*keys, "src", "dst", "weight"), points.keys).select(*keys, "src", "dst", F.lit(1).alias("n"))
        used = fresh if used is None else used.unionByName(fresh).groupBy(*keys, "src", "dst").agg(F.sum("n").alias("n"))
        used = cut(used)
    return used.join(base, [*keys, "src", "dst"]).select(*keys, "src", "dst", F.col("base").alias("weight"))


def _overlay_by_layout(points: Points, k: int, penalty: float, noise_scale: float, seed: int) -> DataFrame:
    """k_mst_overlay in a task for each layout, which draws only pairs that can be in a tree."""
    frame, first = points.frame, mst_boruvka(points)
    if not points.keys:
        frame, first = frame.withColumn("layout", F.lit(0)), first.withColumn("layout", F.lit(0))
    kind, dims = frame.schema["layout"].dataType.simpleString(), points.dims

    def run(key, own, tree):
        own = own.sort_values("id", kind="stable")
        ids, x = own["id"].to_numpy(np.int64), np.array(own["features"].tolist(), float).reshape(len(own), dims)
        ends = (np.searchsorted(ids, tree[c].to_numpy()).tolist() for c in ("src", "dst"))
        a, b = np.array([*overlay(ids, x, [*zip(*ends)], k, penalty, noise_scale, seed)], int).reshape(-1, 2).T
        total = sum((x[a, d] - x[b, d]) * (x[a, d] - x[b, d]) for d in range(dims))
        return pd.DataFrame({"layout": [key[0]] * len(a), "src": ids[a], "dst": ids[b], "weight": np.sqrt(total)})

    grouped = by_layout(frame.select("layout", "id", "features")).groupBy("layout")
    out = grouped.cogroup(by_layout(first.select("layout", "src", "dst")).groupBy("layout")).applyInPandas(run, f"layout {kind}, src long, dst long, weight double")
    return out if points.keys else out.drop("layout")


def random_spanning(points: Points, seed: int = 49, use_weights: bool = False) -> DataFrame:
    """A random tree by loop-erased walks to the tree so far, from the first point."""
    def build(x, ids):
        n, draw = len(ids), np.random.default_rng(seed)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        w = 1 / np.maximum(d, 1e-12) if use_weights else np.ones((n, n))
        np.fill_diagonal(w, 0)
        steps = np.cumsum(w / w.sum(1, keepdims=True), axis=1) if n > 1 else w
        inside, after, out = {0}, {}, []
        for v in range(1, n):
            u = v
            while u not in inside:
                after[u] = min(int(np.searchsorted(steps[u], draw.random(), side="right")), n - 1)
                u = after[u]
            u = v
            while u not in inside:
                inside.add(u)
                out.append((min(u, after[u]), max(u, after[u]), float(d[u, after[u]])))
                u = after[u]
        return out

    return each_layout(points, build)
