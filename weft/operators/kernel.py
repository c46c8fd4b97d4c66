"""Kernel and similarity graphs: weight is a similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine as cosine_of
from ..functions.vectors import dot
from ..plans import blocks
from ..plans.pairs import check_k, nearest, pairs
from ..plans.percentiles import percentile
from ..plans.scratch import cut
from ..sources.tables import Points


def _kept(frame: DataFrame, points: Points, similarity: Column, threshold: float, positive: bool = True) -> DataFrame:
    out = frame.withColumn("weight", similarity).filter(F.col("weight") >= threshold)
    return (out.filter("weight > 0") if positive else out).select(*points.keys, "src", "dst", "weight")


def gaussian_rbf(points: Points, sigma: float | None = None, threshold: float = 0.1) -> DataFrame:
    """exp(-d^2 / 2 sigma^2); sigma is the layout's median distance unless given. In the plane pairs come cell by cell (plans/blocks.py), which
    takes less room when written."""
    if sigma is not None and sigma <= 0:
        raise ValueError("sigma must be positive")
    if blocks.plain(points):
        middles = {} if sigma is not None else blocks.medians(points)
        if middles is not None:

            def weigh(layout, d):
                s = sigma if sigma is not None else middles[layout]
                with np.errstate(divide="ignore", invalid="ignore"):
                    w = np.exp(-(d * d) / np.float64(2 * s * s))
                good = (w >= threshold) & (w > 0)
                return w, good | np.isnan(w) if 2 * s * s == 0 else good  # copies where the median is 0: NaN, as in SQL

            return blocks.all_pairs(points, weigh=weigh, grid=(64, 4))
    all_pairs = pairs(points).drop("fa", "fb")
    if sigma is not None:
        return _kept(all_pairs.withColumn("sigma", F.lit(float(sigma))), points, F.exp(-(F.col("dist") * F.col("dist")) / (2 * F.col("sigma") * F.col("sigma"))), threshold)
    middle = percentile(all_pairs, points.keys, "dist", 0.5).withColumnRenamed("value", "sigma")
    joined = all_pairs.join(F.broadcast(middle), [*points.keys]) if points.keys else all_pairs.crossJoin(F.broadcast(middle))  # one row
    return _kept(joined, points, F.exp(-(F.col("dist") * F.col("dist")) / (2 * F.col("sigma") * F.col("sigma"))), threshold)


def cosine(points: Points, threshold: float = 0.8, weighted: bool = True) -> DataFrame:
    out = _kept(pairs(points), points, cosine_of("fa", "fb", points.dims), threshold, positive=False)
    return out if weighted else out.withColumn("weight", F.lit(None).cast("double"))


def similarity(measure: str, dims: int, sigma: float = 1.0, degree: int = 3, coef0: float | None = None, alpha: float = 0.1) -> Column:
    """One of six measures of a pair with fa, fb and dist."""
    d = F.col("dist")
    if measure == "gaussian":
        return F.exp(-(d * d) / (2 * sigma * sigma))
    if measure == "cosine":
        return cosine_of("fa", "fb", dims)
    if measure == "polynomial":
        power = lambda a, b: F.pow(dot(a, b, dims) + (1.0 if coef0 is None else coef0), F.lit(float(degree)))
        side = lambda a: F.greatest(F.sqrt(power(a, a)), F.lit(1e-12))
        return power("fa", "fb") / (side("fa") * side("fb"))
    if measure == "laplacian":
        return F.exp(-d / sigma)
    if measure == "sigmoid":
        return (F.tanh(alpha * dot("fa", "fb", dims) + (coef0 or 0.0)) + 1) / 2
    if measure == "inverse_distance":
        return 1 / (1 + d)
    raise ValueError(f"unknown measure {measure}")


def thresholded(points: Points, measure: str = "laplacian", threshold: float = 0.3, **params) -> DataFrame:
    return _kept(pairs(points), points, similarity(measure, points.dims, **params), threshold)


def adaptive_bandwidth(points: Points, k_bandwidth: int = 7, threshold: float = 0.05, sparsify_knn: int = 0) -> DataFrame:
    """exp(-d^2 / 2 s_i s_j), s the distance of the k-th nearest; then, if asked for, only what is among either end's best."""
    check_k(points, k_bandwidth)
    width = nearest(points, k_bandwidth).filter(F.col("rank") == k_bandwidth).select(*points.keys, F.col("src").alias("id"), F.greatest("dist", F.lit(1e-10)).alias("width"))
    known = Points(points.frame.join(width, [*points.keys, "id"]), points.dims, points.keys)
    similar = pairs(known, extra=("width",)).drop("fa", "fb")
    weight = F.exp(-(F.col("dist") * F.col("dist")) / (2 * F.col("width_a") * F.col("width_b")))
    if sparsify_knn:
        similar = knn_sparsify(similar.withColumn("weight", weight).select(*points.keys, "src", "dst", "weight"), points.keys, sparsify_knn)
        return similar.filter(F.col("weight") >= threshold)
    return _kept(similar, points, weight, threshold)


def knn_sparsify(similar: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """Pairs that are positive and among the k most similar of either end."""
    both = similar.unionByName(similar.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    best = both.filter("weight > 0").withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "src").orderBy(F.desc("weight"), "dst"))).filter(F.col("rank") <= k)
    return best.groupBy(*keys, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.max("weight").alias("weight")).select(*keys, F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight")


def jaccard_of_sets(members: DataFrame, keys: tuple[str, ...], threshold: float, most: int = 1024, digits: int | None = None) -> DataFrame:
    """Jaccard similarity of sets given as rows (keys, id, item). Equal sets are one class: classes are held against each other by an
    equi-join on items and counts, and a pair of classes stands for all pairs of their ids, which come in lists of `most` at most.
    digits: similarities are rounded to so many, once for a pair of classes."""
    members = members.select(*keys, "id", "item").filter("id is not null and item is not null").distinct()
    sets = cut(members.groupBy(*keys, "id").agg(F.sort_array(F.collect_set("item")).alias("items")))  # the items of one id
    numbered = sets.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 + sets.count() // 65_536)))  # no task gathers a large class alone
    own = cut(numbered.groupBy(*keys, "items", "place").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    classes = own.groupBy(*keys, "items").agg(F.min(F.element_at("ids", 1)).alias("class"))
    items = cut(classes.select(*keys, "class", F.size("items").alias("n"), F.explode("items").alias("item")))
    step = F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / most).cast("int"))
    lists = own.join(classes, [*keys, "items"]).select(*keys, "class", "ids", F.explode(step).alias("k")).select(*keys, "class", F.slice("ids", F.col("k") * most + 1, F.lit(most)).alias("ids"))
    lists = cut(lists)
    a = items.select(*keys, "item", F.col("class").alias("one"), F.col("n").alias("n_a"))
    b = items.select(*keys, "item", F.col("class").alias("other"), F.col("n").alias("n_b"))
    met = a.join(b, [*keys, "item"]).filter("one < other").groupBy(*keys, "one", "other", "n_a", "n_b").agg(F.count("*").alias("both"))
    met = met.select(*keys, "one", "other", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("weight")).filter(F.col("weight") >= threshold)
    met = met if digits is None else met.withColumn("weight", F.round("weight", digits))
    equal = classes.filter(F.lit(1.0) >= threshold).select(*keys, F.col("class").alias("one"), F.col("class").alias("other"), F.lit(1.0).alias("weight"))
    x = lists.select(*keys, F.col("class").alias("one"), F.col("ids").alias("left"))
    y = lists.select(*keys, F.col("class").alias("other"), F.col("ids").alias("right"))
    blocks = met.unionByName(equal).join(x, [*keys, "one"]).join(y, [*keys, "other"])
    blocks = blocks.repartition(4 * members.sparkSession.sparkContext.defaultParallelism)
    met = blocks.select(*keys, "one", "other", "weight", "right", F.explode("left").alias("l")).select(*keys, "one", "other", "weight", "l", F.explode("right").alias("r"))
    return met.filter("one < other or l < r").select(*keys, F.least("l", "r").alias("src"), F.greatest("l", "r").alias("dst"), "weight")


def jaccard(points: Points, method: str = "spatial_bin", threshold: float = 0.3, n_bins: int = 8, radius: float = 1.5, k: int = 5, thresholds: tuple[float, ...] = (), digits: int | None = None) -> DataFrame:
    """Sets of grid cells within `radius` of a point in the unit grid, of its k nearest, or, for given thresholds, of components above each.
    digits: of the similarities by spatial_bin, all if None."""
    if method == "neighbor_fingerprint":
        check_k(points, k)
        return jaccard_of_sets(nearest(points, k).select(*points.keys, F.col("src").alias("id"), F.col("dst").alias("item")), points.keys, threshold)
    if method == "spatial_bin":
        x, y = F.get("features", F.lit(0)), F.get("features", F.lit(1))
        box = points.frame.groupBy(*points.keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
        known = points.frame.join(F.broadcast(box), [*points.keys]) if points.keys else points.frame.crossJoin(F.broadcast(box))  # one row
        scale = lambda v, lo, hi: (v - F.col(lo)) / F.when(F.col(hi) - F.col(lo) < 1e-10, 1.0).otherwise(F.col(hi) - F.col(lo)) * (n_bins - 1)
        px, py = scale(x, "x0", "x1"), scale(y, "y0", "y1")
        cells = F.array(*(F.lit(i) for i in range(n_bins * n_bins)))
        known = known.select(*points.keys, "id", px.alias("px"), py.alias("py")).withColumn("item", F.explode(cells))
        bx, by = F.floor(F.col("item") / n_bins), F.col("item") % n_bins
        inside = F.sqrt((F.col("px") - bx) * (F.col("px") - bx) + (F.col("py") - by) * (F.col("py") - by)) <= radius
        return jaccard_of_sets(known.filter(inside), points.keys, threshold, digits=digits)
    if method == "multi_threshold":
        if not thresholds:
            raise ValueError("multi_threshold needs its thresholds")
        one = None
        for t in thresholds:  # what a threshold doesn't link counts as 0
            sets = points.frame.select(*points.keys, "id", F.posexplode("features").alias("item", "x")).filter(F.col("x") > t)
            part = jaccard_of_sets(sets, points.keys, 0.0)
            one = part if one is None else one.unionByName(part)
        mean = one.groupBy(*points.keys, "src", "dst").agg((F.sum("weight") / len(thresholds)).alias("weight"))
        return mean.filter(F.col("weight") >= threshold)
    raise ValueError(f"unknown method {method}")


def similarity_stats(similar: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median, population deviation, least, most, share of zeros and number of others of a similarity table."""
    middle = percentile(similar, keys, "weight", 0.5).withColumnRenamed("value", "median")
    rest = similar.groupBy(*keys).agg(F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("std"), F.min("weight").alias("min"), F.max("weight").alias("max"), (F.count_if(F.abs("weight") < 1e-12) / F.count("*")).alias("sparsity"), F.count_if(F.abs("weight") >= 1e-12).alias("nnz"))
    joined = rest.join(F.broadcast(middle), [*keys]) if keys else rest.crossJoin(F.broadcast(middle))  # one row
    return joined.select(*keys, "mean", "median", "std", "min", "max", "sparsity", "nnz")
