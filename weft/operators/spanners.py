"""Geometric spanners. Yao and Theta are plans; greedy and well-separated pairs run in a task for each layout."""

from __future__ import annotations

from heapq import heappop, heappush
from math import cos, hypot, pi, sin

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import angle, cone
from ..plans.layouts import each_layout
from ..plans.pairs import pairs, undirected
from ..plans.regions import places
from ..sources.tables import Points


def _cones(points: Points, k: int) -> DataFrame:
    if k < 2:
        raise ValueError("k must be at least 2")
    return pairs(points, ordered=True).withColumn("cone", cone(angle("fa", "fb"), k))


def yao(points: Points, k: int = 6) -> DataFrame:
    """The nearest point in each of a point's k cones."""
    best = F.row_number().over(Window.partitionBy(*points.keys, "src", "cone").orderBy("dist", "dst"))
    return undirected(_cones(points, k).drop("fa", "fb").withColumn("rank", best).filter("rank = 1").withColumn("weight", F.col("dist")), points.keys, "weight", "cone")


def theta(points: Points, k: int = 6) -> DataFrame:
    """The point with the shortest projection on the bisector in each of a point's k cones."""
    dx, dy = (F.get("fb", F.lit(d)) - F.get("fa", F.lit(d)) for d in (0, 1))
    ways = [((2 * c + 1) * pi / k) for c in range(k)]
    cx, cy = (F.get(F.array(*(F.lit(f(w)) for w in ways)), F.col("cone")) for f in (cos, sin))
    known = _cones(points, k).withColumn("projection_distance", dx * cx + dy * cy).filter("projection_distance > 0").drop("fa", "fb")
    best = F.row_number().over(Window.partitionBy(*points.keys, "src", "cone").orderBy("projection_distance", "dst"))
    return undirected(known.withColumn("rank", best).filter("rank = 1").withColumn("weight", F.col("dist")), points.keys, "weight", "projection_distance", "cone")


def distances(x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def greedy(x: np.ndarray, t: float) -> list[tuple[int, int, float]]:
    """Pairs by length; a pair becomes an edge if the paths so far are longer than t times its length."""
    d, n = distances(x), len(x)
    path = np.full((n, n), np.inf)
    np.fill_diagonal(path, 0)
    i, j = np.triu_indices(n, 1)
    out = []
    for e in np.argsort(d[i, j], kind="stable"):
        a, b = int(i[e]), int(j[e])
        if path[a, b] > t * d[a, b]:
            out.append((a, b, float(d[a, b])))
            path = np.minimum(path, np.minimum(path[:, [a]] + d[a, b] + path[[b]], path[:, [b]] + d[a, b] + path[[a]]))
    return out


class _Growing:
    """A graph in the plane that gets edges one by one."""

    def __init__(self, x: np.ndarray):
        self.at, self.near, self.edges = x.tolist(), [[] for _ in x], []

    def add(self, a: int, b: int, w: float) -> None:
        self.near[a].append((b, w))
        self.near[b].append((a, w))
        self.edges.append((a, b, w))

    def reaches(self, a: int, b: int, most: float) -> bool:
        """Whether a path is no longer than `most`: straight lines to the end tell where it can go, nearest first."""
        x, y = self.at[b]
        bound, done, best, heap = most * (1 + 1e-12), set(), {a: 0.0}, [(0.0, 0.0, a)]
        while heap:
            _, g, v = heappop(heap)
            if v in done:
                continue
            done.add(v)
            for u, w in self.near[v]:
                far = g + w
                if u == b:
                    if far <= most:
                        return True
                elif far < best.get(u, bound):
                    own = self.at[u]
                    least = far + hypot(own[0] - x, own[1] - y)
                    if least <= bound:
                        best[u] = far
                        heappush(heap, (least, far, u))
        return False

    def around(self, own: np.ndarray, hops: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of `own`, other node, length of a path) over so many edges, by rows."""
        n = len(self.near)
        a, b = np.array([e[:2] for e in self.edges], int).reshape(-1, 2).T
        w, start, end = np.array([e[2] for e in self.edges]), np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(start, kind="stable")
        end, long, begin = end[order], np.concatenate([w, w])[order], np.searchsorted(start[order], np.arange(n + 1))
        rows, at, p, found = np.arange(len(own)), own, np.zeros(len(own)), []
        for _ in range(hops):
            size = begin[at + 1] - begin[at]
            e = np.arange(size.sum()) + np.repeat(begin[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            rows, at, p = np.repeat(rows, size), end[e], np.repeat(p, size) + long[e]
            order = np.lexsort((p, at, rows))
            rows, at, p = rows[order], at[order], p[order]
            first = np.ones(len(rows), bool)
            first[1:] = (rows[1:] != rows[:-1]) | (at[1:] != at[:-1])
            first &= at != own[rows]
            rows, at, p = rows[first], at[first], p[first]
            found.append((rows, at, p))
        rows, at, p = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(rows, kind="stable")
        return rows[order], at[order], p[order]


SECTORS = 48


def _settled_from(x: np.ndarray, graph: _Growing, own: np.ndarray, t: float) -> np.ndarray:
    """For nodes `own` and each sector around them the length from which on its pairs need no edge: over a path p to a node w, r - p / t or
    less from the pair's other end, which is as near to w as to need no look, since all shorter pairs have their paths."""
    out, middle, wide = np.full((len(own), SECTORS), np.inf), 2 * pi * (np.arange(SECTORS) + 0.5) / SECTORS, pi / SECTORS + 1e-9
    for s in range(0, len(own) if graph.edges else 0, 1024):
        some = own[s : s + 1024]
        rows, at, p = graph.around(some)
        v = x[at] - x[some[rows]]
        line = np.hypot(v[:, 0], v[:, 1])
        good = line * (1 - 1e-6) > p / t
        rows, v, line, p = rows[good], v[good], line[good], p[good] / t
        if not len(rows):
            continue
        off = np.abs(np.arctan2(v[:, 1], v[:, 0])[:, None] % (2 * pi) - middle)
        gain = line[:, None] * np.cos(np.minimum(pi, np.minimum(off, 2 * pi - off) + wide)) - p[:, None]
        with np.errstate(divide="ignore"):
            length = np.where(gain > 1e-6 * line[:, None], ((line - p) * (line + p))[:, None] / (2 * gain), np.inf)
        first = np.nonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))[0]
        out[s + rows[first]] = np.minimum.reduceat(length, first, axis=0) * (1 + 1e-9)
    return out


def _open_pairs(x: np.ndarray, own: np.ndarray, settled: np.ndarray, low: float, high: float):
    """Pairs of `own` longer than low and up to high that neither end settles: (length, i, j) with i < j."""
    order = np.argsort(x[own, 0], kind="stable")
    own, settled = own[order], settled[order]
    at, found, s = x[own], [], 0
    while s < len(own):
        last = np.searchsorted(at[:, 0], at[min(s + 255, len(own) - 1), 0] + high * (1 + 1e-9), side="right")
        e = min(s + max(1, min(256, 1_000_000 // max(1, last - s))), len(own))
        v = at[None, s:last] - at[s:e, None]
        d = np.sqrt(v[:, :, 0] * v[:, :, 0] + v[:, :, 1] * v[:, :, 1])
        a, b = np.nonzero((d > low) & (d <= high) & (np.arange(s, last)[None] > np.arange(s, e)[:, None]))
        d, way = d[a, b], np.arctan2(v[a, b, 1], v[a, b, 0])
        a, b = a + s, b + s
        there, back = (np.floor(w % (2 * pi) / (2 * pi / SECTORS)).astype(int) % SECTORS for w in (way, way + pi))
        free = (d < settled[a, there]) & (d < settled[b, back])
        found.append((d[free], np.minimum(own[a[free]], own[b[free]]), np.maximum(own[a[free]], own[b[free]])))
        s = e
    return tuple(np.concatenate(c) for c in zip(*found))


def greedy_in_plane(x: np.ndarray, t: float) -> list[tuple[int, int, float]]:
    """The edges of greedy(), without a table of paths. Copies of a place are linked to their first, which stands for them. Lengths are taken in steps: before
    each, paths over few edges settle most of the longer pairs by where they point; only the others are looked at one by one."""
    usable = np.nonzero(np.isfinite(x).all(1))[0]
    _, rows, begin = places(x[usable])
    first = usable[rows[begin[:-1]]]
    out = [(int(f), int(usable[c]), 0.0) for f, s, e in zip(first, begin, begin[1:]) for c in rows[s + 1 : e]]
    first = np.sort(first)
    x, n = x[first], len(first)
    whole = float(np.hypot(*np.ptp(x, axis=0))) * (1 + 1e-9) if n else 0.0
    graph, own, low, high = _Growing(x), np.arange(n), -1.0, whole / max(1, n)
    while len(own) > 1:
        settled = _settled_from(x, graph, own, t)
        still = (settled > low).any(1)
        own, settled = own[still], settled[still]
        if len(own) < 2:
            break
        d, i, j = _open_pairs(x, own, settled, low, high)
        order = np.lexsort((j, i, d))
        for w, a, b in zip(d[order].tolist(), i[order].tolist(), j[order].tolist()):
            if not graph.reaches(a, b, t * w):
                graph.add(a, b, w)
        if high >= whole:
            break
        low, high = high, min(whole, high * (1.25 if len(d) * 10 > n else 2))
    return out + [(int(first[a]), int(first[b]), w) for a, b, w in graph.edges]


def greedy_spanner(points: Points, t: float = 2.0) -> DataFrame:
    """Pairs by length, then ids; a pair becomes an edge if the paths so far are longer than t times its length."""
    if t < 1:
        raise ValueError("t must be at least 1")
    build = greedy_in_plane if points.dims == 2 else greedy
    return each_layout(points, lambda x, ids: build(x, t))


def t_spanner(points: Points, t: float = 2.0) -> DataFrame:
    """The same rule as greedy_spanner."""
    return greedy_spanner(points, t)


def well_separated(x: np.ndarray, s: float) -> list[tuple[int, int, float]]:
    """An edge between the first points of each well-separated pair of a fair split tree."""
    boxes: list[tuple] = []  # (points, low, high, left, right)

    def split(own: np.ndarray) -> int:
        low, high, me = x[own].min(0), x[own].max(0), len(boxes)
        boxes.append((own, low, high, -1, -1))
        axis = int(np.argmax(high - low))
        if len(own) > 1:
            left = own[x[own, axis] <= (low[axis] + high[axis]) / 2]
            right = own[x[own, axis] > (low[axis] + high[axis]) / 2]
            if not len(left) or not len(right):
                left, right = own[: len(own) // 2], own[len(own) // 2 :]
            boxes[me] = (own, low, high, split(left), split(right))
        return me

    split(np.arange(len(x)))
    size = lambda k: float(np.linalg.norm(boxes[k][2] - boxes[k][1]))
    out = {}
    rest = [(b[3], b[4]) for b in boxes if b[3] >= 0]
    while rest:
        a, b = rest.pop()
        gap = float(np.linalg.norm(np.maximum(0, np.maximum(boxes[a][1] - boxes[b][2], boxes[b][1] - boxes[a][2]))))
        if gap >= s * max(size(a), size(b)) or boxes[a][3] < 0 and boxes[b][3] < 0:
            i, j = sorted((int(boxes[a][0][0]), int(boxes[b][0][0])))
            out[i, j] = float(np.linalg.norm(x[i] - x[j]))
        else:
            if boxes[a][3] < 0 or boxes[b][3] >= 0 and size(b) > size(a):
                a, b = b, a
            rest += [(boxes[a][3], b), (boxes[a][4], b)]
    return [(i, j, w) for (i, j), w in out.items()]


def wspd_spanner(points: Points, s: float = 4.0) -> DataFrame:
    if s <= 0:
        raise ValueError("s must be positive")
    return each_layout(points, lambda x, ids: well_separated(x, s))


def stretch(n: int, edges: list[tuple[int, int, float]], d: np.ndarray) -> float:
    """The longest path between two points by their distance; infinite where there is none."""
    path = np.full((n, n), np.inf)
    np.fill_diagonal(path, 0)
    for a, b, w in edges:
        path[a, b] = path[b, a] = min(path[a, b], w)
    for k in range(n):
        path = np.minimum(path, path[:, [k]] + path[[k]])
    far = d > 1e-15
    return float(max(1.0, (path[far] / d[far]).max(initial=1.0)))
