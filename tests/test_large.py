"""Queries that must not make all pairs, or all at once: against plain forms, ties and copies included."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from weft.operators import data_driven, kernel, paths, proximity, random_models, spanners, spanning, visibility
from weft.plans import blocks, noisy_trees
from weft.plans import pairs as pairs_module
from weft.plans.percentiles import percentile
from weft.sources.tables import Points


def cloud(spark, seed, keyed=False):
    """Points with copies of one place, a row at equal distances, and one far off."""
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(size=(90, 2)), np.repeat([[0.25, 0.5]], 6, 0), np.stack([np.arange(8.0), np.full(8, 3.0)], 1), [[40.0, -30.0]]])
    ids = r.permutation(len(x)) + 7
    rows = [(int(i) % 2, int(i), row.tolist(), int(i) % 3) for i, row in zip(ids, x)]
    frame = spark.createDataFrame(rows, "layout int, id long, features array<double>, label int")
    return rows, Points(frame if keyed else frame.drop("layout"), 2, ("layout",) if keyed else ())


def no_pairs(*_, **__):
    raise AssertionError("all pairs were asked for")


def groups(rows, keyed):
    for layout in (0, 1) if keyed else (None,):
        own = sorted((i, x) for at, i, x, _ in rows if layout in (None, at))
        yield layout, [i for i, _ in own], np.array([x for _, x in own])


REGIONS = {
    "gabriel": (proximity.gabriel, lambda a, b, c: a + b < c),
    "rng": (proximity.rng, lambda a, b, c: np.maximum(a, b) < c),
    "beta_skeleton": (proximity.beta_skeleton, lambda a, b, c: (0.25 * a + 0.75 * b < 0.75 * c) & (0.75 * a + 0.25 * b < 0.75 * c)),
}


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("name", REGIONS)
def test_regions_without_pairs(spark, monkeypatch, name, keyed):
    build, inside = REGIONS[name]
    rows, points = cloud(spark, 3, keyed)
    expected = set()
    for layout, ids, x in groups(rows, keyed):
        s = ((x[:, None] - x[None]) ** 2).sum(-1)
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                hit = inside(s[i], s[j], s[i, j])
                hit[[i, j]] = False
                if not hit.any() and (name != "beta_skeleton" or s[i, j] > 0):
                    expected.add((layout, ids[i], ids[j], round(float(np.sqrt(s[i, j])), 9)))
    monkeypatch.setattr(pairs_module, "pairs", no_pairs)
    found = [(r["layout"] if keyed else None, r["src"], r["dst"], round(r["weight"], 9)) for r in build(points).collect()]
    assert set(found) == expected and len(found) == len(expected)


TREES = {f.__name__: f for f in (spanning.emst, spanning.mst_prim, spanning.mst_boruvka, spanning.mst_kruskal)} | {"k_mst_overlay_one": lambda p: spanning.k_mst_overlay(p, 1)}


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("name", TREES)
def test_trees_without_pairs(spark, monkeypatch, name, keyed):
    rows, points = cloud(spark, 4, keyed)
    expected = set()
    for layout, ids, x in groups(rows, keyed):
        d, top = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), list(range(len(x)))
        for w, i, j in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
            if top[i] != top[j]:
                top = [top[i] if t == top[j] else t for t in top]
                expected.add((layout, ids[i], ids[j], round(float(w), 9)))
    monkeypatch.setattr(pairs_module, "pairs", no_pairs)
    monkeypatch.setattr(spanning, "pairs", no_pairs)
    found = [(r["layout"] if keyed else None, r["src"], r["dst"], round(r["weight"], 9)) for r in TREES[name](points).collect()]
    assert set(found) == expected and len(found) == len(expected)


@pytest.mark.parametrize("p", [0.0, 0.2, 0.5, 0.77, 1.0])
def test_percentile_by_counts(spark, p):
    r = np.random.default_rng(6)
    values = [(0, float(v)) for v in r.normal(size=700)] + [(1, 2.5)] * 400 + [(1, float(v)) for v in r.integers(0, 9, 90)] + [(2, 1.0), (3, None), (2, None)]
    frame = spark.createDataFrame(values, "layout int, x double")
    expected = {r["layout"]: r["v"] for r in frame.groupBy("layout").agg(F.percentile("x", F.lit(p)).alias("v")).collect()}
    found = {r["layout"]: r["value"] for r in percentile(frame, ("layout",), "x", p, bins=16, few=12).collect()}
    assert {k: v for k, v in found.items()} == expected
    assert percentile(frame, (), "x", p, bins=16, few=12).first()[0] == frame.agg(F.percentile("x", F.lit(p))).first()[0]
    assert percentile(frame.limit(0), (), "x", p).first()[0] is None


def no_percentile(*_, **__):
    raise AssertionError("a percentile in one task was asked for")


MEDIANS = {
    "expansion_diffusion": lambda p: data_driven.expansion(p, "diffusion"),
    "gaussian_rbf": lambda p: kernel.gaussian_rbf(p),
    "similarity_stats": lambda p: kernel.similarity_stats(kernel.thresholded(p, "laplacian", 0.0), p.keys),
}


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("name", MEDIANS)
def test_medians_by_counts(spark, monkeypatch, name, keyed):
    rows, points = cloud(spark, 5, keyed)
    monkeypatch.setattr(F, "percentile", no_percentile)
    found = MEDIANS[name](points).collect()
    for layout, _, x in groups(rows, keyed):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(len(x), 1)]
        own = [r for r in found if not keyed or r["layout"] == layout]
        if name == "gaussian_rbf":
            w = np.exp(-(d**2) / (2 * np.median(d) ** 2))
            assert len(own) == (w >= 0.1).sum() and abs(sum(r["weight"] for r in own) - w[w >= 0.1].sum()) < 1e-6
        elif name == "similarity_stats":
            assert abs(own[0]["median"] - np.median(np.exp(-d))) < 1e-12
        else:
            assert own


def draw(seed, a, b):
    return int(hashlib.md5(f"{seed}:{a}:{b}".encode()).hexdigest()[:8], 16) / 2**32


def kron(n, i, j):
    table, t, there, back = ((0.9, 0.5), (0.5, 0.3)), max(1, (n - 1).bit_length()), 1.0, 1.0
    for d in range(t):
        there, back = there * table[i >> d & 1][j >> d & 1], back * table[j >> d & 1][i >> d & 1]
    return (there + back) / 2


MODELS = {
    "chung_lu": (149, lambda p: random_models.chung_lu(p.frame.select("id", (F.col("id") % 11).alias("degree"))), lambda n, ids, i, j: min(1.0, (ids[i] % 11) * (ids[j] % 11) / sum(k % 11 for k in ids))),
    "kronecker": (150, lambda p: random_models.kronecker(p), lambda n, ids, i, j: kron(n, i, j)),
    "erdos_renyi_gnp": (142, lambda p: random_models.erdos_renyi_gnp(p, 0.15), lambda n, ids, i, j: 0.15),
}


@pytest.mark.parametrize("name", MODELS)
def test_draws_over_arrays(spark, monkeypatch, name):
    seed, build, chance = MODELS[name]
    rows, points = cloud(spark, 6)
    ids = sorted(i for _, i, _, _ in rows)
    monkeypatch.setattr(random_models, "uniform", no_pairs)
    found = [(r["src"], r["dst"]) for r in build(points).collect()]
    assert sorted(found) == [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b and draw(seed, a, b) < chance(len(ids), ids, i, j)]


JACCARD = {
    "spatial_bin": lambda rows, points: kernel.jaccard(points, "spatial_bin", 0.3),
    "suppliers": lambda rows, points: kernel.jaccard_of_sets(points.frame.select("id", F.explode(F.array(*(F.when(F.col("id") % 7 != k, F.concat(F.lit("type "), F.lit(str(k)))) for k in range(7)))).alias("item")), (), 0.3, most=5),
}


@pytest.mark.parametrize("name", JACCARD)
def test_jaccard_by_classes(spark, name):
    rows, points = cloud(spark, 7)
    _, ids, x = next(groups(rows, False))
    if name == "suppliers":
        sets = [{k for k in range(7) if i % 7 != k} for i in ids]
    else:
        p = (x - x.min(0)) / np.ptp(x, axis=0) * 7
        sets = [{c for c in range(64) if np.sqrt((a - c // 8) * (a - c // 8) + (b - c % 8) * (b - c % 8)) <= 1.5} for a, b in p]
    w = lambda a, b: len(a & b) / len(a | b) if a and b else 0
    expected = {(ids[i], ids[j], w(sets[i], sets[j])) for i in range(len(ids)) for j in range(i + 1, len(ids)) if w(sets[i], sets[j]) >= 0.3}
    frame = JACCARD[name](rows, points)
    found = [(r["src"], r["dst"], r["weight"]) for r in frame.collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert "explode(right" in frame._jdf.queryExecution().toString()  # pairs are listed, not counted item by item


@pytest.mark.parametrize("keyed", [False, True])
def test_percentiles_row_by_row(spark, monkeypatch, keyed):
    rows, points = cloud(spark, 8, keyed)
    expected = set()
    for layout, ids, x in groups(rows, keyed):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        alone = [np.percentile(np.delete(row, i), 20) for i, row in enumerate(d)]
        whole = np.percentile(d, 20, axis=1)
        expected |= {(layout, ids[i], ids[j]) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= alone[i] + 1e-12 or d[i, j] <= whole[j] + 1e-12}
    monkeypatch.setattr(data_driven, "pairs", no_pairs)
    found = [(r["layout"] if keyed else None, r["src"], r["dst"]) for r in data_driven.expansion(points, "percentile").collect()]
    assert set(found) == expected and len(found) == len(expected)


@pytest.mark.parametrize("k", [1, 5])
def test_stretch_without_turns(spark, monkeypatch, k):
    rows, points = cloud(spark, 9, True)
    edges = proximity.symmetric_knn(points, k)
    found, expected = edges.collect(), {}
    for layout, ids, x in groups(rows, True):
        at, d = {i: n for n, i in enumerate(ids)}, np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        expected[layout] = spanners.stretch(len(ids), [(at[r["src"]], at[r["dst"]], r["weight"]) for r in found if r["layout"] == layout], d)
    monkeypatch.setattr(paths, "shortest_paths", no_pairs)
    got = {r["layout"]: r["stretch"] for r in paths.stretch(points, edges).collect()}
    assert got == pytest.approx(expected, rel=1e-12)
    assert {r["layout"]: r["is_spanner"] for r in paths.is_spanner(points, edges, 2.0).collect()} == {i: v <= 2.0 + 1e-9 for i, v in expected.items()}


@pytest.mark.parametrize("t", [1.2, 2.0])
@pytest.mark.parametrize("name", ["greedy_spanner", "t_spanner"])
def test_spanners_without_table_of_paths(spark, monkeypatch, name, t):
    rows, points = cloud(spark, 10, True)
    expected = set()
    for layout, ids, x in groups(rows, True):
        expected |= {(layout, ids[i], ids[j], w) for i, j, w in spanners.greedy(x, t)}
    monkeypatch.setattr(spanners, "greedy", no_pairs)
    frame = getattr(spanners, name)(points, t)
    found = [(r["layout"], r["src"], r["dst"], r["weight"]) for r in frame.collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert frame.rdd.getNumPartitions() > 1  # small rows, but long work: layouts aren't put into one task


@pytest.mark.parametrize("name", ["copies", "far apart", "lattice", "line", "not finite", "long tails"])
def test_greedy_in_plane(name):
    r = np.random.default_rng(11)
    x = {
        "copies": np.repeat(r.normal(size=(30, 2)), 4, 0)[r.permutation(120)],
        "far apart": np.concatenate([r.normal(size=(50, 2)), r.normal(size=(50, 2)) * 0.1 + [30, 5]]),
        "lattice": np.stack(np.meshgrid(np.arange(9.0), np.arange(9.0)), -1).reshape(-1, 2),
        "line": np.stack([r.random(60), np.zeros(60)], 1),
        "not finite": np.concatenate([r.normal(size=(40, 2)), [[np.nan, 1.0], [np.inf, 0.0]]]),
        "long tails": r.standard_cauchy((120, 2)),
    }[name]
    for t in (1.0, 1.5, 2.0, 4.0):
        with np.errstate(invalid="ignore"):
            assert sorted(spanners.greedy_in_plane(x, t)) == sorted(spanners.greedy(x, t))


@pytest.mark.parametrize("k, penalty, noise", [(3, 2.0, 0.1), (4, 0.5, 0.004), (2, 2.0, 1.0), (3, 2.0, 0.0)])
@pytest.mark.parametrize("keyed", [False, True])
def test_overlay_without_pairs(spark, monkeypatch, keyed, k, penalty, noise):
    rows, points = cloud(spark, 12, keyed)
    expected = set()
    for layout, ids, x in groups(rows, keyed):
        d, n, times = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), len(x), {}
        for turn in range(k):
            weighed = []
            for i in range(n):
                for j in range(i + 1, n):
                    w = d[i, j] * (1 + penalty * times.get((i, j), 0))
                    if turn and noise:
                        u, v = (draw(55 + turn, ids[i], end) for end in (ids[j], f"{ids[j]}:turn"))
                        w = max(w + noise * d.mean() * np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v) / 2**0.5, 1e-12)
                    weighed.append((w, i, j))
            top = list(range(n))
            for _, i, j in sorted(weighed):
                if top[i] != top[j]:
                    top = [top[i] if t == top[j] else t for t in top]
                    times[i, j] = times.get((i, j), 0) + 1
        expected |= {(layout, ids[i], ids[j], round(float(d[i, j]), 9)) for i, j in times}
    monkeypatch.setattr(pairs_module, "pairs", no_pairs)
    monkeypatch.setattr(spanning, "pairs", no_pairs)
    found = [(r["layout"] if keyed else None, r["src"], r["dst"], round(r["weight"], 9)) for r in spanning.k_mst_overlay(points, k, penalty, noise).collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_noisy_tree_in_blocks():
    """Small buffers and blocks find the same tree."""
    r = np.random.default_rng(13)
    x, ids = r.normal(size=(150, 2)), np.sort(r.choice(10**12, 150, replace=False)) - 5 * 10**11
    for noise in (0.0, 0.01, 0.5):
        pairs = noisy_trees._Noisy(ids, x, {(0, 1): 1, (3, 9): 2}, 2.0, noise, 56)
        a, b = np.triu_indices(150, 1)
        a, b, w = pairs.upto(a, b, np.sqrt(((x[a] - x[b]) ** 2).sum(1)), np.inf)
        top, expected = list(range(150)), set()
        for _, i, j in sorted(zip(w.tolist(), a.tolist(), b.tolist())):
            if top[i] != top[j]:
                top = [top[i] if t == top[j] else t for t in top]
                expected.add((i, j))
        for at_once in (10, 10**6):
            assert {(i, j) for i, j, _ in noisy_trees.noisy_tree(pairs, 150, at_once)} == expected


def test_jaccard_rounds_classes(spark, small):
    """Similarities are rounded for pairs of classes, before they are listed for all their ids."""
    from weft.catalog import QUERIES

    plan = QUERIES["jaccard_spatial_bin"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan and plan.index("Generate explode(right") < plan.index("round(")


def test_stretch_deals_layouts(spark):
    """Few rows, but long work: layouts aren't put into one task."""
    rows, points = cloud(spark, 9, True)
    assert paths.stretch(points, proximity.symmetric_knn(points, 5)).rdd.getNumPartitions() > 1


@pytest.mark.parametrize("keyed", [False, True])
def test_complete_by_cells(spark, monkeypatch, keyed):
    rows, points = cloud(spark, 13, keyed)
    expected = set()
    for layout, ids, x in groups(rows, keyed):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        expected |= {(layout, ids[i], ids[j], d[i, j]) for i in range(len(x)) for j in range(i + 1, len(x))}
    monkeypatch.setattr(proximity, "pairs", no_pairs)
    found = [(r["layout"] if keyed else None, r["src"], r["dst"], r["weight"]) for r in proximity.complete(points).collect()]
    assert set(found) == expected and len(found) == len(expected)


@pytest.mark.parametrize("odd", ["null", "NaN", "infinite", "ids twice", "none"])
def test_complete_of_odd_points(spark, odd):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (5, [0.0, 1.0])]
    rows += {"null": [(None, [1.0, 1.0]), (9, None)], "NaN": [(9, [float("nan"), 0.0])], "infinite": [(9, [float("inf"), 0.0])], "ids twice": [(2, [3.0, 0.0])], "none": []}[odd]
    points = Points(spark.createDataFrame([] if odd == "none" else rows, "id long, features array<double>"), 2)
    expected = pairs_module.pairs(points).select("src", "dst", F.col("dist").alias("weight"))
    assert sorted(map(str, proximity.complete(points).collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("kind", ["spread", "far off", "copies"])
def test_blocks_hold_each_pair_once(kind):
    x = np.random.default_rng(14).normal(size=(3000, 2))
    if kind == "far off":
        x[7] = 1e9
    if kind == "copies":
        x[:2500] = 0.5
    seen, lengths = np.zeros((3000, 3000), np.int8), []
    for part in range(40):
        got = list(blocks.chunks(x, part, 40))
        for i, j, d in got:
            assert (i < j).all() and np.array_equal(d, np.sqrt((x[i, 0] - x[j, 0]) ** 2 + (x[i, 1] - x[j, 1]) ** 2))
            seen[i, j] += 1
        lengths.append(np.concatenate([d for _, _, d in got]))
    assert np.array_equal(seen, np.triu(np.ones((3000, 3000), np.int8), 1))
    assert max(map(len, lengths)) < 2 * 3000 * 2999 / 2 / 40  # no part has much more than its share
    if kind == "spread":  # lengths of a part are near each other
        assert np.median([np.ptp(d) for d in lengths]) < 0.3 * max(d.max() for d in lengths)


@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_visibility_by_cells(spark, monkeypatch, keyed, many):
    rows, points = cloud(spark, 15, keyed)
    walls = [(*a, *b) for a, b in np.random.default_rng(16).normal(size=(64 if many else 5, 2, 2)).tolist()]
    walls[1:3] = [(0.5, 3.0, 2.5, 3.0), (3.0, 2.0, 3.0, 4.0)]  # along the row, and through one of its points
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    apart = lambda v, w: v > 1e-10 and w < -1e-10 or v < -1e-10 and w > 1e-10
    expected = set()
    for layout, ids, x in groups(rows, keyed):
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                a, b = x[i], x[j]
                if not any(apart(side(w[:2], w[2:], a), side(w[:2], w[2:], b)) and apart(side(a, b, w[:2]), side(a, b, w[2:])) for w in walls):
                    expected.add((layout, ids[i], ids[j], float(np.sqrt(((a - b) ** 2).sum()))))
    segments = spark.createDataFrame(walls, "x1 double, y1 double, x2 double, y2 double")
    more = spark.createDataFrame(walls * (65 // len(walls) + 1), segments.schema)  # too many edges for bits
    slow = {(r["layout"] if keyed else None, r["src"], r["dst"], r["weight"]) for r in visibility.geometric_visibility(points, more).collect()}
    monkeypatch.setattr(visibility, "pairs", no_pairs)
    found = [(r["layout"] if keyed else None, r["src"], r["dst"], r["weight"]) for r in visibility.geometric_visibility(points, segments).collect()]
    assert set(found) == expected == slow and len(found) == len(expected)


@pytest.mark.parametrize("keyed", [False, True])
def test_gaussian_by_cells(spark, monkeypatch, keyed):
    """No join of all pairs, with a median that is narrowed down in few bins; ids twice are no pair."""
    rows, _ = cloud(spark, 21)
    rows += [(rows[0][0], rows[0][1], [9.0, 9.0], 0)]
    frame = spark.createDataFrame(rows, "layout int, id long, features array<double>, label int")
    points = Points(frame if keyed else frame.drop("layout"), 2, ("layout",) if keyed else ())
    monkeypatch.setattr(kernel, "pairs", no_pairs)
    monkeypatch.setattr(blocks, "BINS", 8)
    monkeypatch.setattr(blocks, "FEW", 5)
    found = sorted((r["layout"] if keyed else None, r["src"], r["dst"], round(r["weight"], 9)) for r in kernel.gaussian_rbf(points).collect())
    expected = []
    for layout, ids, x in groups(rows, keyed):
        i, j = np.triu_indices(len(x), 1)
        own = np.array(ids)[i] != np.array(ids)[j]
        d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
        w = np.exp(-(d**2) / (2 * np.median(d[own]) ** 2))
        expected += [(layout, ids[a], ids[b], round(float(v), 9)) for a, b, v, o in zip(i, j, w, own) if o and v >= 0.1]
    assert found == sorted(expected, key=lambda r: (r[0] or 0, *r[1:]))


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_medians_of_lengths(spark, monkeypatch, n):
    """Two lengths in the middle that lie far apart, many equal ones, and layouts without pairs."""
    monkeypatch.setattr(blocks, "FEW", 2)
    x = [[0.0, 0.0]] * (n // 2) + [[1e6 * (k % 2), 0.0] for k in range(n - n // 2)]
    points = Points(spark.createDataFrame([(k, v) for k, v in enumerate(x)], "id long, features array<double>"), 2)
    d = [abs(x[i][0] - x[j][0]) for i in range(n) for j in range(i)]
    assert blocks.medians(points) == ({0: float(np.median(d))} if d else {})
    if n == 3:  # a median of 0 leaves copies, whose weight is NaN, as in SQL
        assert [(r["src"], r["dst"]) for r in kernel.gaussian_rbf(Points(points.frame.withColumn("features", F.array(F.lit(1.0), F.lit(1.0))), 2)).filter("isnan(weight)").orderBy("src", "dst").collect()] == [(0, 1), (0, 2), (1, 2)]


@pytest.mark.parametrize("seed", [149, -7])
def test_draws_by_program(spark, monkeypatch, seed):
    """The program draws as md5 does: ids of all lengths, below 0, twice and null, and more than a turn of its loops."""
    r = np.random.default_rng(31)
    ids = [-5, -12, 0, 3, 9, 10, 99, 100, 12345, 10**18, -(10**18), 2**63 - 1, -(2**63), *range(500, 2700)]
    degree = {i: int(d) for i, d in zip(ids, r.zipf(2.5, len(ids)).clip(0, 60))}
    rows = [*degree.items(), (None, 4), (99, degree[99]), (77, 0)]
    degrees = spark.createDataFrame(rows, "id long, degree long")
    monkeypatch.setattr(random_models, "PROGRAM", 0)
    monkeypatch.setattr(random_models, "Draws", no_pairs)
    found = sorted((r["src"], r["dst"]) for r in random_models.chung_lu(degrees, seed).collect())
    s, top = float(sum(d for _, d in rows)), max(degree.values())
    scale = s**0.5 / top if top * top > s else 1.0
    known = sorted((i, d * scale) for i, d in rows if i is not None and d > 0)
    expected = []
    for n, (a, v) in enumerate(known):
        expected += [(a, b) for b, w in known[n + 1 :] if a < b and draw(seed, a, b) < min(1.0, v * w / (s * scale))]
    assert found == sorted(expected) and len(found) > 500
