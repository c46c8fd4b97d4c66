"""Random graph models. Independent draws are hashed, alike in every engine; growth models run in a task for each layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import Draws
from ..functions.programs import drawn_below
from ..functions.vectors import uniform
from ..plans.layouts import each_layout
from ..plans.pairs import pairs
from ..plans.regions import on_slices, sliced
from ..sources.tables import Points
from .proximity import epsilon

PROGRAM, HITS = 50_000_000, 20_000_000  # pairs from which on a program draws, and how many draws below the bounds a task may hold


def _unweighted(points: Points, frame: DataFrame) -> DataFrame:
    return frame.select(*points.keys, "src", "dst")


def _drawn(points: Points, seed: int, extra: tuple[str, ...] = ()) -> DataFrame:
    return pairs(points, extra=extra).drop("fa", "fb", "dist").withColumn("u", uniform(seed, F.col("src"), F.col("dst")))


def _drawn_below(points: Points, seed: int, chances) -> DataFrame:
    """Pairs whose draw, that of _drawn, is below their chance. chances(features of all rows) gives, for a row: the most that its pairs can have, and
    a function that gives the chances with other rows. Draws are made over arrays, in a task for each part of a layout's rows."""

    def work(ids, x, part, parts):
        draws, (most, chance) = Draws(ids, block=65_536), chances(x)
        a, b, n = [], [], 0
        for i in range(part, len(ids), parts):
            bound, start = most(i), int(np.searchsorted(ids, ids[i], side="right"))
            if bound <= 0 or start == len(ids):
                continue
            limit = min(int(np.ceil(bound * 4294967296.0)), 1 << 32)
            for rows, u in draws(b"%d:%d:" % (seed, ids[i]), start):
                hit = np.nonzero(u < limit)[0] if limit < 1 << 32 else np.arange(len(u))
                if len(hit):
                    hit = hit[u[hit] / 4294967296.0 < chance(i, rows[hit])]
                    b.append(ids[rows[hit]])
                    a.append(np.full(len(hit), ids[i]))
                    n += len(hit)
            if n >= 1 << 19:
                yield np.concatenate(a), np.concatenate(b)
                a, b, n = [], [], 0
        if n:
            yield np.concatenate(a), np.concatenate(b)

    return on_slices(points, work, "", rows=256).select(*points.keys, "src", "dst")


def _drawn_below_by_program(points: Points, seed: int, chances) -> DataFrame:
    """_drawn_below, of one layout and rare pairs: draws are made in the JVM (functions/programs.py), chances are held against those below the bounds."""

    def bounded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                most, _ = chances(np.frombuffer(row["features"], float).reshape(-1, 1))
                own = range(row["part"], len(row["ids"]) // 8, row["parts"])
                limits = np.array([min(int(np.ceil(max(most(i), 0.0) * 4294967296.0)), 1 << 32) for i in own], np.int64)
                yield pa.RecordBatch.from_pylist([{**row, "limits": limits.tobytes()}], schema=pa.schema([*batch.schema, ("limits", pa.binary())]))

    def chosen(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, (_, chance) = np.frombuffer(row["ids"], np.int64), chances(np.frombuffer(row["features"], float).reshape(-1, 1))
                i, j, u = np.frombuffer(row["hits"], np.uint32).reshape(-1, 3).T
                own = u / 4294967296.0 < chance(i, j)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[own]]), pa.array(ids[j[own]])], names=["src", "dst"])

    packed = sliced(points, rows=256).mapInArrow(bounded, "layout int, part int, parts int, ids binary, features binary, limits binary")
    drawn = packed.select("ids", "features", drawn_below(packed.sparkSession, "ids", "part", "parts", "limits", seed).alias("hits"))
    return drawn.mapInArrow(chosen, "src long, dst long")


def _bare(points: Points, feature=None) -> Points:
    """Points without what their draws don't depend on; rows without id are in no pair."""
    value = F.lit(0.0) if feature is None else feature
    return Points(points.frame.filter("id is not null").select(*points.keys, F.col("id").cast("long").alias("id"), F.array(value.cast("double")).alias("features")), 1, points.keys)


def erdos_renyi_gnp(points: Points, p: float = 0.15, seed: int = 142) -> DataFrame:
    return _drawn_below(_bare(points), seed, lambda x: (lambda i: p, lambda i, j: p))


def erdos_renyi_gnm(points: Points, m: int = 60, seed: int = 143) -> DataFrame:
    """The m pairs with the smallest draws."""
    drawn = _drawn(points, seed)
    if not points.keys:
        return drawn.orderBy("u", "src", "dst").limit(m).select("src", "dst")
    rank = F.row_number().over(Window.partitionBy(*points.keys).orderBy("u", "src", "dst"))
    return _unweighted(points, drawn.withColumn("rank", rank).filter(F.col("rank") <= m))


def random_geometric(points: Points, r: float = 1.0) -> DataFrame:
    return epsilon(points, r)


def sbm(points: Points, p_within: float = 0.4, p_between: float = 0.05, seed: int = 147) -> DataFrame:
    """Pairs with a chance that depends on whether their labels are equal."""
    chance = F.when(F.col("label_a") == F.col("label_b"), p_within).otherwise(p_between)
    return _unweighted(points, _drawn(points, seed, ("label",)).filter(F.col("u") < chance))


def chung_lu(degrees: DataFrame, seed: int = 149) -> DataFrame:
    """Pairs with chance min(w_i w_j / S, 1) for expected degrees w (columns id, degree); scaled down where the largest is above sqrt(S)."""
    total = degrees.agg(F.sum("degree").cast("double").alias("s"), F.max("degree").cast("double").alias("top"), F.count_if((F.col("degree") > 0) & F.col("id").isNotNull()).alias("n")).first()
    s, top = total["s"], total["top"]
    if not s:
        return degrees.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    scale = (s**0.5) / top if top * top > s else 1.0
    known = degrees.filter("degree > 0").withColumn("w", F.col("degree") * scale)

    def chances(x):
        w = x[:, 0]
        top = w.max() if len(w) else 0.0
        return lambda i: min(w[i] * top / (s * scale), 1.0), lambda i, j: np.minimum(w[i] * w[j] / (s * scale), 1.0)

    many = total["n"] ** 2 > 2 * PROGRAM and total["n"] * top * scale < HITS * degrees.sparkSession.sparkContext.defaultParallelism
    draw = _drawn_below_by_program if many and len(str(seed)) <= 13 else _drawn_below
    return draw(_bare(Points(known, 1), F.col("w")), seed, chances)


def configuration(degrees: DataFrame, seed: int = 148, remove_self_loops: bool = True, remove_multi_edges: bool = True) -> DataFrame:
    """Stubs in the order of their draws, paired two by two. An odd sum loses its last stub.

    Ranks are made without one task for all stubs: draws are cut into 4096 ranges, and a range's first rank comes from the counts."""
    stubs = degrees.filter("degree > 0").select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("degree"))).alias("k"))
    stubs = stubs.withColumn("u", uniform(seed, F.col("id"), F.col("k"))).withColumn("range", F.floor(F.col("u") * 4096))
    counts = stubs.groupBy("range").agg(F.count("*").alias("n"))
    first = counts.select("range", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("n")).alias("first"))
    ranked = stubs.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("u", "id", "k"))).join(F.broadcast(first), "range")
    ranked = ranked.select("id", (F.col("first") + F.col("rank") - 1).alias("rank"))
    two = ranked.groupBy(F.floor(F.col("rank") / 2).alias("pair")).agg(F.min("id").alias("src"), F.max("id").alias("dst"), F.count("*").alias("n")).filter("n = 2")
    two = two.select("src", "dst")
    two = two.filter("src <> dst") if remove_self_loops else two
    return two.distinct() if remove_multi_edges else two


def kronecker(points: Points, initiator=((0.9, 0.5), (0.5, 0.3)), iterations: int | None = None, seed: int = 150) -> DataFrame:
    """Pairs with the mean of a Kronecker power's two entries as chance; rows beyond the power have 0.05."""
    k = len(initiator)
    n = points.frame.count()
    t = iterations if iterations is not None else max(1, next(e for e in range(64) if k**e >= n))
    if not points.keys:
        place = np.array(initiator, float)

        def chances(x):
            rows, within = np.arange(len(x)), np.arange(len(x)) < k**t
            digits = [(rows // k**d) % k for d in range(t)]
            long = 1.0, 1.0
            for d in range(t):
                long = long[0] * place.max(1)[digits[d]], long[1] * place.max(0)[digits[d]]
            most = np.maximum((long[0] + long[1]) / 2, 0.0 if within.all() else 0.05) * np.ones(len(x))

            def chance(i, j):
                there, back = 1.0, 1.0
                for d in range(t):
                    there, back = there * place[digits[d][i], digits[d][j]], back * place[digits[d][j], digits[d][i]]
                both = np.where(within[i] & within[j], there, 0.05) + np.where(within[i] & within[j], back, 0.05)
                return np.minimum(1.0, both / 2)

            return lambda i: min(most[i] * (1 + 1e-12), 1.0), chance

        return _drawn_below(_bare(points), seed, chances)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")) - 1  # over all layouts
    known = Points(points.frame.withColumn("number", number), points.dims, points.keys)
    table = F.array(*(F.lit(float(x)) for row in initiator for x in row))

    def entry(a: str, b: str):
        out = None
        for d in range(t):
            digit = lambda c: F.floor(F.col(c) / k**d) % k  # noqa: B023, E731
            x = F.get(table, (digit(a) * k + digit(b)).cast("int"))
            out = x if out is None else out * x
        return F.when((F.col(a) < k**t) & (F.col(b) < k**t), out).otherwise(0.05)

    drawn = _drawn(known, seed, ("number",))
    return _unweighted(points, drawn.filter(F.col("u") < F.least(F.lit(1.0), (entry("number_a", "number_b") + entry("number_b", "number_a")) / 2)))


def watts_strogatz(points: Points, k: int = 4, p: float = 0.3, seed: int = 144) -> DataFrame:
    """A ring lattice whose edges move, each with chance p, to an end that isn't linked yet."""
    if k % 2 or k < 2:
        raise ValueError("k must be even and at least 2")

    def build(x, ids):
        n, rng = len(ids), np.random.default_rng(seed)
        linked = {(min(i, (i + s) % n), max(i, (i + s) % n)) for s in range(1, k // 2 + 1) for i in range(n) if n > 1}
        linked = {e for e in linked if e[0] != e[1]}
        for s in range(1, k // 2 + 1):
            for i in range(n):
                old = (min(i, (i + s) % n), max(i, (i + s) % n))
                if old in linked and rng.random() < p:
                    free = [v for v in range(n) if v != i and (min(i, v), max(i, v)) not in linked]
                    if free:
                        v = free[rng.integers(len(free))]
                        linked.remove(old)
                        linked.add((min(i, v), max(i, v)))
        return sorted(linked)

    return each_layout(points, build, "")


def _proportional(rng, weights: np.ndarray, m: int, tries: int) -> list[int]:
    """Up to m different picks in proportion to weights, in so many draws."""
    out: list[int] = []
    total = weights.sum()
    for _ in range(tries):
        if len(out) == min(m, int((weights > 0).sum())) or total <= 0:
            break
        pick = int(np.searchsorted(np.cumsum(weights), rng.random() * total, side="right"))
        if pick < len(weights) and pick not in out:
            out.append(pick)
    return out


def barabasi_albert(points: Points, m: int = 2, seed: int = 145, triads: float = 0.0) -> DataFrame:
    """A clique of m + 1, then each new node links to m others in proportion to their degrees; with chance `triads` to a neighbour of the last one instead."""
    if m < 1:
        raise ValueError("m must be at least 1")

    def build(x, ids):
        n, rng = len(ids), np.random.default_rng(seed)
        begin = min(m + 1, n)
        near: list[set[int]] = [set() for _ in range(n)]
        for i in range(begin):
            near[i] = set(range(begin)) - {i}
        for v in range(begin, n):
            last = None
            while len(near[v]) < m:
                pick = None
                if last is not None and rng.random() < triads:
                    free = sorted(near[last] - near[v] - {v})
                    pick = free[rng.integers(len(free))] if free else None
                if pick is None:
                    weights = np.array([0 if u in near[v] else len(near[u]) for u in range(v)], float)
                    got = _proportional(rng, weights, 1, 20 * m)
                    if not got:
                        break
                    pick = got[0]
                near[v].add(pick)
                near[pick].add(v)
                last = pick
        return [(i, j) for i in range(n) for j in sorted(near[i]) if i < j]

    return each_layout(points, build, "")


def holme_kim(points: Points, m: int = 2, p: float = 0.5, seed: int = 153) -> DataFrame:
    return barabasi_albert(points, m, seed, triads=p)


def price(points: Points, m: int = 3, a: float = 1.0, seed: int = 152) -> DataFrame:
    """Directed: each new node cites m earlier ones in proportion to their citations plus a."""
    def build(x, ids):
        n, rng = len(ids), np.random.default_rng(seed)
        cited, out = np.zeros(n), []
        for v in range(1, n):
            for u in _proportional(rng, cited[:v] + a, m, 20 * m):
                out.append((v, u))
                cited[u] += 1
        return out

    return each_layout(points, build, "")


def forest_fire(points: Points, p_forward: float = 0.35, p_backward: float = 0.2, seed: int = 151) -> DataFrame:
    """Each new node links to an ambassador and burns on from there, through geometric numbers of neighbours."""
    def build(x, ids):
        n, rng = len(ids), np.random.default_rng(seed)
        near: list[set[int]] = [set() for _ in range(n)]
        for v in range(1, n):
            first = int(rng.integers(v))
            burned, queue = {first}, [first]
            while queue:
                u = queue.pop(0)
                for p in (p_forward, p_backward):
                    free = sorted(near[u] - burned)
                    count = min(int(rng.geometric(1 - p)) - 1, len(free)) if 0 < p < 1 else 0
                    for w in rng.choice(free, count, replace=False) if count else ():
                        burned.add(int(w))
                        queue.append(int(w))
            for u in burned:
                near[v].add(u)
                near[u].add(v)
        return [(i, j) for i in range(n) for j in sorted(near[i]) if i < j]

    return each_layout(points, build, "")


def random_regular(points: Points, d: int = 3, seed: int = 154, max_retries: int = 100) -> DataFrame:
    """A simple graph in which all nodes have degree d: stubs are paired at random, and pairs that make loops or repeat are exchanged with others."""
    def build(x, ids):
        n, rng = len(ids), np.random.default_rng(seed)
        if d >= n or n * d % 2:
            raise ValueError("d must be less than the number of points, and their product even")
        for _ in range(max_retries):
            stubs = rng.permutation(np.repeat(np.arange(n), d)).reshape(-1, 2)
            for _ in range(50 * len(stubs)):
                seen, bad = set(), []
                for e, (i, j) in enumerate(map(sorted, stubs.tolist())):
                    if i == j or (i, j) in seen:
                        bad.append(e)
                    seen.add((i, j))
                if not bad:
                    return sorted(seen)
                e, f = bad[0], int(rng.integers(len(stubs)))
                stubs[e, 1], stubs[f, 1] = stubs[f, 1], stubs[e, 1]
        raise ValueError("no regular graph was found")

    return each_layout(points, build, "")
