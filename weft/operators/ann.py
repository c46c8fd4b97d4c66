"""Approximate nearest neighbours. Hash tables, trees and NN-descent are plans; navigable graphs grow in a task for each layout."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance, uniform
from ..plans.layouts import each_layout
from ..plans.pairs import check_k, undirected
from ..plans.scratch import cut
from ..sources.tables import Points


def planes(tables: int, bits: int, dims: int, seed: int) -> np.ndarray:
    """Normals of hyperplanes through the origin, [table][bit][component]."""
    return np.random.default_rng(seed).standard_normal((tables, bits, dims))


def closest_candidates(points: Points, candidates: DataFrame, k: int) -> DataFrame:
    """Of candidate pairs (keys, src, dst), each point's k closest, as undirected edges."""
    place = lambda end, name: points.frame.select(*points.keys, F.col("id").alias(end), F.col("features").alias(name))
    known = candidates.join(place("src", "fa"), [*points.keys, "src"]).join(place("dst", "fb"), [*points.keys, "dst"]).select(*points.keys, "src", "dst", distance("fa", "fb", points.dims).alias("weight"))
    both = known.unionByName(known.select(*points.keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    rank = F.row_number().over(Window.partitionBy(*points.keys, "src").orderBy("weight", "dst"))
    return undirected(both.withColumn("rank", rank).filter(F.col("rank") <= k), points.keys, "weight")


def lsh(points: Points, normals: np.ndarray, k: int = 5, seed: int = 247) -> DataFrame:
    """Candidates share all signs of a table; a point without candidates gets the k points with the smallest draws."""
    check_k(points, k)
    keys = points.keys

    tables, bits, dims = normals.shape
    powers = 1 << np.arange(bits)

    def run(frames):  # signs of all tables by one product of matrices for each batch
        for pdf in frames:
            x = np.array(pdf["features"].tolist(), float).reshape(len(pdf), dims)
            signs = (x @ normals.reshape(-1, dims).T >= 0).reshape(len(pdf), tables, bits)
            yield pdf[[*keys, "id"]].assign(codes=((signs * powers).sum(2)).tolist())

    kinds = "".join(f"{c} {points.frame.schema[c].dataType.simpleString()}, " for c in keys)
    coded = points.frame.select(*keys, "id", "features").mapInPandas(run, f"{kinds}id long, codes array<long>")
    coded = coded.select(*keys, "id", F.posexplode("codes").alias("table", "code"))
    a, b = coded.withColumnRenamed("id", "src"), coded.withColumnRenamed("id", "dst")
    met = cut(a.join(b, [*keys, "table", "code"]).filter("src < dst").select(*keys, "src", "dst").distinct())
    linked = met.select(*keys, F.col("src").alias("id")).unionByName(met.select(*keys, F.col("dst").alias("id"))).distinct()
    alone = points.frame.select(*keys, "id").join(linked, [*keys, "id"], "left_anti").withColumnRenamed("id", "src")
    others = points.frame.select(*(F.col(c).alias(f"{c}_b") for c in keys), F.col("id").alias("dst"))
    on = F.col("src") != F.col("dst")
    for c in keys:
        on = on & (F.col(c) == F.col(f"{c}_b"))
    draw = Window.partitionBy(*keys, "src").orderBy(uniform(seed, F.col("src"), F.col("dst")), "dst")
    extra = alone.join(others, on).withColumn("rank", F.row_number().over(draw)).filter(F.col("rank") <= k)
    extra = extra.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return closest_candidates(points, met.unionByName(extra).distinct(), k)


def rp_forest(points: Points, k: int = 5, n_trees: int = 10, leaf_size: int = 5, seed: int = 246) -> DataFrame:
    """Candidates share a leaf of a tree that splits at medians along drawn directions, level by level for all trees."""
    check_k(points, k)
    keys, dims = points.keys, points.dims
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))
    now = cut(points.frame.select(*keys, "id", "features", trees.alias("tree"), F.lit("r").alias("node")))
    leaves = None
    while True:
        size = Window.partitionBy(*keys, "tree", "node")
        sized = now.withColumn("n", F.count("*").over(size))
        done = cut(sized.filter(F.col("n") <= leaf_size).select(*keys, "id", "tree", "node"))
        leaves = done if leaves is None else leaves.unionByName(done)
        left = sized.filter(F.col("n") > leaf_size).drop("n")
        if not left.limit(1).count():
            break
        # a normal draw for each component of each node's direction
        way = lambda d: F.sqrt(-2 * F.log(uniform(seed, F.col("tree"), F.col("node"), F.lit(d), F.lit(0)) + 1e-12)) * F.cos(6.283185307179586 * uniform(seed, F.col("tree"), F.col("node"), F.lit(d), F.lit(1)))
        directions = left.select(*keys, "tree", "node").distinct().withColumn("way", F.array(*(way(d) for d in range(dims))))
        along = None
        for d in range(dims):
            part = F.get("features", F.lit(d)) * F.get("way", F.lit(d))
            along = part if along is None else along + part
        cast = cut(left.join(directions, [*keys, "tree", "node"]).withColumn("along", along).drop("way"))
        middle = cast.groupBy(*keys, "tree", "node").agg(F.percentile("along", F.lit(0.5)).alias("middle"), F.max("along").alias("most"), F.min("along").alias("least"))
        parted = cast.join(middle, [*keys, "tree", "node"])
        stuck = F.col("middle") >= F.col("most")  # no point on the right
        leaves = leaves.unionByName(parted.filter(stuck).select(*keys, "id", "tree", "node"))
        now = cut(parted.filter(~stuck).select(*keys, "id", "features", "tree", F.concat("node", F.when(F.col("along") <= F.col("middle"), "l").otherwise("r")).alias("node")))
    a, b = leaves.withColumnRenamed("id", "src"), leaves.withColumnRenamed("id", "dst")
    met = a.join(b, [*keys, "tree", "node"]).filter("src < dst").select(*keys, "src", "dst").distinct()
    return closest_candidates(points, met, k)


def nn_descent(points: Points, k: int = 5, max_iterations: int = 20, delta: float = 0.001, rho: float = 1.0, seed: int = 245) -> DataFrame:
    """Each round, a point's neighbours' neighbours (either way) become candidates, of which a drawn part `rho` is tried, and the k closest stay."""
    check_k(points, k)
    keys = points.keys
    place = lambda end, name: points.frame.select(*keys, F.col("id").alias(end), F.col("features").alias(name))
    # begin: k partners for each point, neighbours in k drawn orders
    orders = points.frame.select(*keys, "id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("o"))
    line = Window.partitionBy(*keys, "o").orderBy(uniform(seed, F.col("o"), F.col("id")), "id")
    drawn = orders.withColumn("next", F.coalesce(F.lead("id").over(line), F.first("id").over(line.rowsBetween(Window.unboundedPreceding, 0)))).filter("id <> next")
    near = drawn.select(*keys, F.col("id").alias("src"), F.col("next").alias("dst")).distinct()
    near = near.join(place("src", "fa"), [*keys, "src"]).join(place("dst", "fb"), [*keys, "dst"]).select(*keys, "src", "dst", distance("fa", "fb", points.dims).alias("weight"))
    near = cut(near)
    total = near.count()
    best = Window.partitionBy(*keys, "src").orderBy("weight", "dst")
    for turn in range(max_iterations):
        both = near.select(*keys, "src", "dst").unionByName(near.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        met = both.withColumnRenamed("dst", "mid").join(both.select(*keys, F.col("src").alias("mid"), "dst"), [*keys, "mid"]).filter("src <> dst").select(*keys, "src", "dst").distinct()
        if rho < 1:
            met = met.filter(uniform(seed + 1 + turn, F.col("src"), F.col("dst")) < rho)
        fresh = met.join(near.select(*keys, "src", "dst"), [*keys, "src", "dst"], "left_anti")
        fresh = fresh.join(place("src", "fa"), [*keys, "src"]).join(place("dst", "fb"), [*keys, "dst"]).select(*keys, "src", "dst", distance("fa", "fb", points.dims).alias("weight"), F.lit(1).alias("new"))
        after = near.withColumn("new", F.lit(0)).unionByName(fresh).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")
        after = cut(after)
        changed = after.filter("new = 1").count()
        near = after.drop("new")
        if changed <= delta * total:
            break
    return undirected(near, keys, "weight")


def beam(start: list[int], links, x: np.ndarray, query: np.ndarray, width: int) -> list[tuple[float, int]]:
    """Best-first search with a beam: up to `width` nearest points reached, by distance."""
    far = lambda v: float(np.sqrt(((x[v] - query) ** 2).sum()))
    seen = set(start)
    found = sorted((far(v), v) for v in seen)[:width]
    queue = list(found)
    heapq.heapify(queue)
    while queue:
        d, v = heapq.heappop(queue)
        if len(found) >= width and d > found[-1][0]:
            break
        for w in sorted(links[v]):
            if w not in seen:
                seen.add(w)
                e = far(w)
                if len(found) < width or e < found[-1][0]:
                    found = sorted([*found, (e, w)])[:width]
                    heapq.heappush(queue, (e, w))
    return found


def _export(x: np.ndarray, links) -> list[tuple[int, int, float]]:
    edges = {(min(v, w), max(v, w)) for v, own in enumerate(links) for w in own if v != w}
    return [(a, b, float(np.sqrt(((x[a] - x[b]) ** 2).sum()))) for a, b in sorted(edges)]


def nsw(points: Points, f: int = 5, ef_construction: int = 16, seed: int = 242) -> DataFrame:
    """Points in a drawn order; each links to the f nearest that a beam search finds."""
    def build(x, ids):
        order = np.random.default_rng(seed).permutation(len(ids)).tolist()
        links: list[set[int]] = [set() for _ in ids]
        first = order[: f + 1]
        for v in first:
            links[v] |= set(first) - {v}
        for v in order[f + 1 :]:
            for _, w in beam([order[0]], links, x, x[v], max(f, ef_construction))[:f]:
                links[v].add(w)
                links[w].add(v)
        return _export(x, links)

    return each_layout(points, build)


def hnsw(points: Points, M: int = 5, M0: int | None = None, ef_construction: int = 32, mL: float | None = None, seed: int = 243) -> DataFrame:  # noqa: N803
    """Layers of navigable graphs: edges of all layers, with the layers of each. The entry is the highest point inserted so far."""
    top_degree, scale = M0 or 2 * M, mL if mL is not None else 1 / np.log(M)

    def build(x, ids):
        rng = np.random.default_rng(seed)
        levels = np.floor(-np.log(1 - rng.random(len(ids))) * scale).astype(int)
        layers: list[list[set[int]]] = [[set() for _ in ids] for _ in range(int(levels.max(initial=0)) + 1)]
        entry = None
        for v in rng.permutation(len(ids)).tolist():
            if entry is None:
                entry = v
                continue
            at = [entry]
            for layer in range(int(levels[entry]), int(levels[v]), -1):
                at = [beam(at, layers[layer], x, x[v], 1)[0][1]]
            for layer in range(min(int(levels[v]), int(levels[entry])), -1, -1):
                most = M if layer else top_degree
                found = beam(at, layers[layer], x, x[v], max(ef_construction, most))
                for _, w in found[:most]:
                    layers[layer][v].add(w)
                    layers[layer][w].add(v)
                    if len(layers[layer][w]) > most:
                        near = sorted(layers[layer][w], key=lambda u: (float(((x[u] - x[w]) ** 2).sum()), u))  # noqa: B023
                        for u in near[most:]:
                            layers[layer][w].discard(u)
                            layers[layer][u].discard(w)
                at = [w for _, w in found]
            if levels[v] > levels[entry]:
                entry = v
        held: dict[tuple[int, int], list[int]] = {}
        for layer, links in enumerate(layers):
            for a, b, _ in _export(x, links):
                held.setdefault((a, b), []).append(layer)
        return [(a, b, float(np.sqrt(((x[a] - x[b]) ** 2).sum())), own) for (a, b), own in sorted(held.items())]

    return each_layout(points, build, "weight double, layers array<int>")


def robust_prune(v: int, candidates, x: np.ndarray, alpha: float, degree: int) -> list[int]:
    """Nearest first; one that is kept rules out those that it is alpha times nearer to than v is."""
    far = lambda a, b: float(np.sqrt(((x[a] - x[b]) ** 2).sum()))
    kept: list[int] = []
    for c in sorted(set(candidates) - {v}, key=lambda c: (far(v, c), c)):
        if len(kept) == degree:
            break
        if all(alpha * far(p, c) > far(v, c) for p in kept):
            kept.append(c)
    return kept


def vamana(points: Points, R: int = 5, alpha: float = 1.2, L: int = 20, n_passes: int = 2, seed: int = 244) -> DataFrame:  # noqa: N803
    """A random graph, linked both ways, refined by searches from the middle point and robust pruning. All links of either end are edges."""
    def build(x, ids):
        n, rng = len(ids), np.random.default_rng(seed)
        links = [set(rng.choice(n - 1, min(R, n - 1), replace=False).tolist()) for _ in range(n)]
        links = [{w + (w >= v) for w in own} for v, own in enumerate(links)]
        for v, w in [(v, w) for v, own in enumerate(links) for w in own]:
            links[w].add(v)
        start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        for turn in range(n_passes):
            a = alpha if turn == 0 else 1.2 * alpha
            for v in rng.permutation(n).tolist():
                links[v] = set(robust_prune(v, {w for _, w in beam([start], links, x, x[v], L)} | links[v], x, a, R))
                for w in list(links[v]):
                    links[w].add(v)
                    if len(links[w]) > R:
                        links[w] = set(robust_prune(w, links[w], x, a, R))
        return _export(x, links)

    return each_layout(points, build)


def recall(approximate: DataFrame, exact: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean share of exact neighbours (keys, src, dst) that are edges at either end."""
    both = approximate.select(*keys, "src", "dst").unionByName(approximate.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return exact.join(both.withColumn("hit", F.lit(1.0)), [*keys, "src", "dst"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
