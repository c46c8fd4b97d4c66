"""Statistical dependence: edges between variables, from observations (one row, one array)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance  # noqa: F401
from ..plans.pairs import nearest, pairs, undirected
from ..plans.percentiles import percentile as exact_percentile
from ..plans.regions import finite, on_slices
from ..plans.scratch import cut
from ..sources.tables import Points


def moments(observations: DataFrame, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, means and centred cross products of arrays `values`: each task sends one matrix of width^2."""
    def run(frames):
        n, s, c = 0, np.zeros(width), np.zeros((width, width))
        for pdf in frames:
            x = np.array(pdf["values"].tolist(), float).reshape(len(pdf), width)
            if len(x):
                mean, total = x.mean(0), n + len(x)
                shift = mean - (s / n if n else mean)
                c += (x - mean).T @ (x - mean) + np.outer(shift, shift) * n * len(x) / total
                s, n = s + x.sum(0), total
        yield pd.DataFrame({"n": [float(n)], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    n, s, c = 0.0, np.zeros(width), np.zeros((width, width))
    parts = observations.select("values").mapInPandas(run, "n double, s array<double>, c array<double>")
    while parts.rdd.getNumPartitions() > 64:  # many tasks' matrices are added up on the executors first
        parts = parts.coalesce(64)
    for row in parts.toLocalIterator():
        if row["n"]:
            m, t, k = row["n"], np.array(row["s"]), np.array(row["c"]).reshape(width, width)
            shift = t / m - (s / n if n else t / m)
            c += k + np.outer(shift, shift) * n * m / (n + m)
            s, n = s + t, n + m
    return n, (s / n if n else s), c


def _edges(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, f"src long, dst long, {columns}")


def covariance(n: float, c: np.ndarray, method: str = "empirical", shrinkage: float = 0.1) -> np.ndarray:
    s = c / max(1.0, n - 1)
    if method == "shrinkage":
        s = (1 - shrinkage) * s + shrinkage * np.trace(s) / len(s) * np.eye(len(s))
    return s


def correlation(observations: DataFrame, width: int, threshold: float = 0.5, use_absolute: bool = True) -> DataFrame:
    n, _, c = moments(observations, width)
    scale = np.maximum(np.sqrt(np.diag(c)), 1e-12)
    r = np.clip(c / np.outer(scale, scale), -1, 1)
    rows = [(i, j, abs(float(r[i, j])), float(r[i, j]), 1 if r[i, j] > 0 else -1) for i in range(width) for j in range(i + 1, width) if (abs(r[i, j]) if use_absolute else r[i, j]) >= threshold]
    return _edges(observations.sparkSession, rows, "weight double, correlation double, sign int")


def partial_correlation(observations: DataFrame, width: int, threshold: float = 0.15, regularization: float = 0.01) -> DataFrame:
    n, _, c = moments(observations, width)
    return _partial(observations.sparkSession, np.linalg.inv(covariance(n, c) + regularization * np.eye(width)), threshold)


def _partial(spark: SparkSession, theta: np.ndarray, threshold: float) -> DataFrame:
    scale = np.sqrt(np.maximum(np.diag(theta), 1e-12))
    p = -theta / np.outer(scale, scale)
    rows = [(i, j, abs(float(p[i, j])), float(p[i, j]), 1 if p[i, j] > 0 else -1) for i in range(len(p)) for j in range(i + 1, len(p)) if abs(p[i, j]) >= threshold]
    return _edges(spark, rows, "weight double, partial_correlation double, sign int")


def graphical_lasso(s: np.ndarray, alpha: float, max_iter: int, tol: float) -> np.ndarray:
    """Precision matrix by block coordinate descent on the penalised likelihood."""
    p = len(s)
    w = s + alpha * np.eye(p)
    beta = np.zeros((p, p))
    for _ in range(max_iter):
        before = w.copy()
        for j in range(p):
            rest = np.arange(p) != j
            v, target, b = w[np.ix_(rest, rest)], s[rest, j], beta[rest, j].copy()
            for _ in range(100):
                moved = 0.0
                for k in range(p - 1):
                    r = target[k] - v[k] @ b + v[k, k] * b[k]
                    new = np.sign(r) * max(abs(r) - alpha, 0) / max(v[k, k], 1e-12)
                    moved = max(moved, abs(new - b[k]))
                    b[k] = new
                if moved < 1e-6:
                    break
            beta[rest, j] = b
            w[rest, j] = w[j, rest] = v @ b
        if np.abs(w - before).mean() < tol:
            break
    return np.linalg.inv(w + 1e-6 * np.eye(p))


def glasso(observations: DataFrame, width: int, alpha: float = 0.1, max_iter: int = 200, tol: float = 1e-4, truncate: float = 0.5) -> DataFrame:
    """Edges of the graphical lasso's precision matrix; entries below truncate * alpha count as none."""
    n, _, c = moments(observations, width)
    theta = graphical_lasso(covariance(n, c), alpha, max_iter, tol)
    off = ~np.eye(width, dtype=bool)
    theta[off & (np.abs(theta) < alpha * truncate)] = 0
    rows = [(i, j, abs(float(theta[i, j])), float(theta[i, j]), float(-theta[i, j] / np.sqrt(theta[i, i] * theta[j, j]))) for i in range(width) for j in range(i + 1, width) if abs(theta[i, j]) > 1e-8]
    return _edges(observations.sparkSession, rows, "weight double, precision_value double, partial_correlation double")


def mutual_information(observations: DataFrame, width: int, threshold: float = 0.1, n_bins: int = 20, estimator: str = "ksg", ksg_k: int = 5) -> DataFrame:
    """Pairs of variables whose mutual information (nats) reaches the threshold. observations: id, values."""
    if estimator == "ksg":
        return _ksg(observations, width, threshold, ksg_k)
    if estimator != "histogram":
        raise ValueError(f"unknown estimator {estimator}")
    value = [F.get("values", F.lit(k)) for k in range(width)]
    span = observations.agg(*(F.min(v).alias(f"lo{k}") for k, v in enumerate(value)), *(F.max(v).alias(f"hi{k}") for k, v in enumerate(value)), F.count("*").alias("n")).first()
    if not span["n"]:
        return observations.sparkSession.createDataFrame([], "src long, dst long, weight double, mutual_information double")
    n = float(span["n"])
    bins = F.array(*(F.least(F.lit(n_bins - 1), F.floor((v - span[f"lo{k}"]) / (span[f"hi{k}"] - span[f"lo{k}"]) * n_bins)) if span[f"hi{k}"] > span[f"lo{k}"] else F.lit(0).cast("long") for k, v in enumerate(value)))
    binned = observations.select(bins.alias("bins"))
    cells = binned.select("bins", F.posexplode("bins").alias("src", "x")).select("src", "x", F.posexplode("bins").alias("dst", "y")).filter("src < dst")
    joint = cells.groupBy("src", "dst", "x", "y").agg(F.count("*").alias("both"))
    one = binned.select(F.posexplode("bins").alias("v", "b")).groupBy("v", "b").agg(F.count("*").alias("n"))  # width * n_bins rows
    joint = joint.join(F.broadcast(one.withColumnsRenamed({"v": "src", "b": "x", "n": "nx"})), ["src", "x"]).join(F.broadcast(one.withColumnsRenamed({"v": "dst", "b": "y", "n": "ny"})), ["dst", "y"])
    mi = F.greatest(F.lit(0.0), F.sum(F.col("both") / n * F.log(F.col("both") * n / (F.col("nx") * F.col("ny")))))
    return joint.groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(mi.alias("weight")).filter(F.col("weight") >= threshold).withColumn("mutual_information", F.col("weight"))


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to 6 and the asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (low := x < 6).any():
        out -= np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


@np.errstate(invalid="ignore")  # padding stands at infinity
def kth_nearest(x: np.ndarray, y: np.ndarray, k: int, leaf: int = 24) -> np.ndarray:
    """Each point's Chebyshev distance to its k-th nearest other point, in the plane.

    A tree of equal halves, by x and y in turn. A leaf's own points bound each distance; only leaves within
    that bound are looked at besides."""
    n, leaf = len(x), max(leaf, 2 * k + 2)
    depth = max(0, int(np.ceil(np.log2(n / leaf))))
    pad = -n % (1 << depth)
    at = np.stack([np.concatenate([c, np.full(pad, np.inf)]) for c in (x, y)])
    order = np.arange(n + pad)[None]
    boxes = []
    for level in range(depth + 1):
        if level:
            half = order.shape[1] // 2
            order = np.take_along_axis(order, np.argpartition(at[level % 2][order], half, axis=1), 1).reshape(-1, half)
        inside = at[:, order]
        boxes.append((inside.min(2), np.where(np.isinf(inside), -np.inf, inside).max(2)))  # padding lies in no box
    px, py = at[0][order], at[1][order]
    near = np.partition(np.maximum(np.abs(px[:, :, None] - px[:, None]), np.abs(py[:, :, None] - py[:, None])), k, axis=2)[:, :, : k + 1]
    eps = near[:, :, k]
    open_ = (order < n) & (eps > 0)
    (x0, x1), (y0, y1) = ((np.where(open_, c - eps, np.inf).min(1), np.where(open_, c + eps, -np.inf).max(1)) for c in (px, py))
    a = np.flatnonzero(open_.any(1))  # leaves with points that aren't settled, and nodes that may have nearer ones
    b = np.zeros_like(a)
    slack = 1e-12 * (np.abs(x).max() + np.abs(y).max())  # for the rounding of sums
    for level in range(depth + 1):
        if level:
            a, b = np.repeat(a, 2), np.stack([2 * b, 2 * b + 1], 1).ravel()
        (bx0, by0), (bx1, by1) = boxes[level]
        met = (bx0[b] <= x1[a] + slack) & (bx1[b] >= x0[a] - slack) & (by0[b] <= y1[a] + slack) & (by1[b] >= y0[a] - slack)
        a, b = a[met], b[met]
    a, b = a[a != b], b[a != b]
    size = order.shape[1]
    best, flat = near.reshape(-1, k + 1), (px.ravel(), py.ravel())
    (bx0, by0), (bx1, by1) = boxes[depth]
    gap = lambda c, lo, hi: np.maximum(np.maximum(lo[b][:, None] - c[a], c[a] - hi[b][:, None]), 0)
    pair, spot = np.nonzero(open_[a] & (np.maximum(gap(px, bx0, bx1), gap(py, by0, by1)) <= eps[a] + slack))
    point, other = a[pair] * size + spot, b[pair]
    by_point = np.argsort(point, kind="stable")
    point, other = point[by_point], other[by_point]
    turn = np.arange(len(point)) - np.searchsorted(point, point)
    by_turn = np.argsort(turn, kind="stable")
    ends = np.cumsum(np.bincount(turn)) if len(turn) else []
    for first, last in zip([0, *ends], ends):  # each point's first leaf, second leaf, ...
        for low in range(first, last, 100_000):
            some = by_turn[low : min(last, low + 100_000)]
            i, j = point[some], other[some]
            far = np.maximum(np.abs(flat[0][i][:, None] - px[j]), np.abs(flat[1][i][:, None] - py[j]))
            best[i] = np.partition(np.concatenate([best[i], far], 1), k, axis=1)[:, : k + 1]
    out = np.empty(n + pad)
    out[order.ravel()] = best.max(1)
    return out[:n]


def within(ordered: np.ndarray, x: np.ndarray, eps: np.ndarray) -> np.ndarray:
    """How many of the ordered values differ from x by eps at most, as the subtraction rounds."""
    n = len(ordered)
    low, high = np.searchsorted(ordered, x - eps), np.searchsorted(ordered, x + eps, "right")
    while (more := (low > 0) & (x - ordered[np.maximum(low - 1, 0)] <= eps)).any():
        low = np.where(more, np.searchsorted(ordered, ordered[np.maximum(low - 1, 0)]), low)
    while (less := (low < n) & (x - ordered[np.minimum(low, n - 1)] > eps)).any():
        low = np.where(less, np.searchsorted(ordered, ordered[np.minimum(low, n - 1)], "right"), low)
    while (more := (high < n) & (ordered[np.minimum(high, n - 1)] - x <= eps)).any():
        high = np.where(more, np.searchsorted(ordered, ordered[np.minimum(high, n - 1)], "right"), high)
    while (less := (high > 0) & (ordered[np.maximum(high - 1, 0)] - x > eps)).any():
        high = np.where(less, np.searchsorted(ordered, ordered[np.maximum(high - 1, 0)]), high)
    return high - low


def ksg(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """Kraskov's estimate with closed balls of the k-th Chebyshev distance, over observations that have both values."""
    both = np.isfinite(x) & np.isfinite(y)
    x, y = x[both], y[both]
    if (n := len(x)) <= k:
        return 0.0
    eps = kth_nearest(x, y, k)
    nx, ny = within(np.sort(x), x, eps) - 1, within(np.sort(y), y, eps) - 1
    fine = (nx > 0) & (ny > 0)
    total = float((digamma(nx[fine]) + digamma(ny[fine])).sum())
    return max(0.0, float(digamma(np.array(float(k))) - total / max(1, int(fine.sum())) + digamma(np.array(float(n)))))


def _ksg(observations: DataFrame, width: int, threshold: float, k: int, block: int = 8) -> DataFrame:
    """One task for each pair of blocks of variables, which needs its columns whole."""
    blocks = [range(low, min(width, low + block)) for low in range(0, width, block)]
    both = [(p, q) for i, p in enumerate(blocks) for q in blocks[i:]]
    columns = [[*p] if p == q else [*p, *q] for p, q in both]

    def deal(frames):
        for pdf in frames:
            x = np.array(pdf["values"].tolist(), float).reshape(len(pdf), width)
            for number, own in enumerate(columns):
                yield pd.DataFrame({"number": [number], "x": [x[:, own].ravel()]})

    def run(key, pdf):
        (p, q), own = both[key[0]], columns[key[0]]
        x = dict(zip(own, np.concatenate(pdf["x"].tolist()).reshape(-1, len(own)).T.copy()))
        found = [(i, j, ksg(x[i], x[j], k)) for i in p for j in q if i < j]
        return pd.DataFrame(found, columns=["src", "dst", "weight"])

    dealt = observations.select("values").mapInPandas(deal, "number int, x array<double>")
    found = dealt.groupBy("number").applyInPandas(run, "src long, dst long, weight double")
    return found.filter(F.col("weight") >= threshold).withColumn("mutual_information", F.col("weight"))


def _within_percentile(points: Points, p: float) -> DataFrame:
    """Pairs within either end's percentile of distances. A task has its part's distances to all points of the layout row by row
    and keeps none: first for the percentiles of each point, then for the pairs."""

    def distances(x, i, start=0):
        total = 0.0
        for d in range(x.shape[1]):
            y = x[i, d] - x[start:, d]
            total = total + y * y
        return np.sqrt(total)

    def at(row: np.ndarray) -> float:
        place = p * (len(row) - 1)
        lo, hi = int(np.floor(place)), int(np.ceil(place))
        row = np.partition(row, (lo, hi))
        return row[lo] if lo == hi or row[lo] == row[hi] else (hi - place) * row[lo] + (place - lo) * row[hi]

    def limits(ids, x, part, parts):
        rows = np.arange(part, len(ids), parts)
        alone, whole = np.empty(len(rows)), np.empty(len(rows))
        for k, i in enumerate(rows):
            own = distances(x, i)
            own = own[ids != ids[i]]
            alone[k], whole[k] = at(own) if len(own) else -1.0, at(np.append(own, 0.0))
        yield ids[rows], ids[rows], alone, whole

    found = cut(on_slices(points, limits, "alone double, whole double", rows=512).withColumnRenamed("src", "id").drop("dst"))
    features = F.concat("features", F.array("alone", "whole"))
    known = Points(points.frame.join(found, [*points.keys, "id"]).withColumn("features", features), points.dims + 2, points.keys)

    def near(ids, x, part, parts):
        x, alone, whole = x[:, :-2], x[:, -2], x[:, -1]
        a, b, w, n = [], [], [], 0
        for i in range(part, len(ids), parts):
            start = int(np.searchsorted(ids, ids[i], side="right"))
            d = distances(x, i, start)
            hit = np.nonzero((d <= alone[i]) | (d <= whole[start:]))[0]
            a.append(np.full(len(hit), ids[i]))
            b.append(ids[start + hit])
            w.append(d[hit])
            n += len(hit)
            if n >= 1 << 19:
                yield np.concatenate(a), np.concatenate(b), np.concatenate(w)
                a, b, w, n = [], [], [], 0
        if n:
            yield np.concatenate(a), np.concatenate(b), np.concatenate(w)

    return on_slices(known, near, "weight double", rows=512)


def expansion(points: Points, method: str = "diffusion", percentile: float = 20, k_initial: int = 5, diffusion_steps: int = 3, diffusion_threshold: float = 0.01) -> DataFrame:
    """percentile: pairs within either end's percentile of distances (the later end counts its own 0).
    diffusion: affinity of random walks on the symmetric nearest-neighbour graph with Gaussian weights."""
    keys = points.keys
    if method == "percentile":
        p = percentile / 100
        if points.dims and finite(points):
            return _within_percentile(points, p)
        out = cut(pairs(points, ordered=True).select(*keys, "src", "dst", "dist"))
        own = out.groupBy(*keys, F.col("src").alias("id")).agg(F.percentile("dist", F.lit(p)).alias("alone"))
        with_self = out.select(*keys, "src", "dist").unionByName(points.frame.select(*keys, F.col("id").alias("src"), F.lit(0.0).alias("dist")))
        both = with_self.groupBy(*keys, F.col("src").alias("id")).agg(F.percentile("dist", F.lit(p)).alias("whole"))
        joined = out.filter("src < dst").join(own.withColumnRenamed("id", "src"), [*keys, "src"]).join(both.withColumnRenamed("id", "dst"), [*keys, "dst"])
        return joined.filter("dist <= alone or dist <= whole").select(*keys, "src", "dst", F.col("dist").alias("weight"))
    if method != "diffusion":
        raise ValueError(f"unknown method {method}")
    middle = exact_percentile(pairs(points).filter("dist > 0").select(*keys, "dist"), keys, "dist", 0.5).withColumnRenamed("value", "sigma")
    linked = undirected(nearest(points, k_initial, grid_from=5_000).withColumn("weight", F.col("dist")), keys, "weight")
    linked = linked.join(F.broadcast(middle), [*keys]) if keys else linked.crossJoin(F.broadcast(middle))  # one row
    linked = linked.withColumn("w", F.exp(-(F.col("weight") * F.col("weight")) / (2 * F.col("sigma") * F.col("sigma"))))
    both = linked.select(*keys, "src", "dst", "w").unionByName(linked.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    step = cut(both.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "src"))).select(*keys, "src", "dst", "p"))
    walk = step
    for _ in range(diffusion_steps - 1):
        walk = walk.withColumnRenamed("dst", "mid").join(step.select(*keys, F.col("src").alias("mid"), "dst", F.col("p").alias("q")), [*keys, "mid"]).groupBy(*keys, "src", "dst").agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    pair = walk.filter("src <> dst").groupBy(*keys, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg((F.sum("p") / 2).alias("weight"))
    return pair.filter(F.col("weight") >= diffusion_threshold).select(*keys, F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight", F.col("weight").alias("diffusion_affinity"))
