"""Graph operators on the canonical 30 points, their containments, and invariants of drawn models."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from weft.catalog import QUERIES
from weft.operators import ann, data_driven, kernel, misc, paths, proximity, random_models, spanners, spanning, triangulation, visibility
from weft.plans.pairs import nearest, pairs
from weft.sources import tables


@pytest.fixture(scope="module")
def points(spark):
    p = tables.two_cluster_layout(spark)
    frame = p.frame.withColumn("layout", F.lit(0)).repartition(4).cache()
    return tables.Points(frame, 2), tables.Points(frame, 2, ("layout",))


@pytest.fixture(scope="module")
def xy(points):
    return np.array([r["features"] for r in points[0].frame.orderBy("id").collect()])


def edges(frame):
    return {(r["src"], r["dst"]) for r in frame.collect()}


GOLDEN = {
    "complete": (lambda p: proximity.complete(p), 435), "epsilon": (lambda p: proximity.epsilon(p, 1.2), 157), "symmetric_knn": (lambda p: proximity.symmetric_knn(p, 5), 97),
    "mutual_knn": (lambda p: proximity.mutual_knn(p, 5), 53), "gabriel": (lambda p: proximity.gabriel(p), 41), "rng": (lambda p: proximity.rng(p), 31),
    "beta_skeleton": (lambda p: proximity.beta_skeleton(p, 1.5), 35), "influence": (lambda p: proximity.influence(p), 59), "random_geometric": (lambda p: random_models.random_geometric(p, 1.0), 116),
    "disk": (lambda p: misc.disk(p, 0.5), 116), "delaunay": (lambda p: triangulation.delaunay(p), 81), "urquhart": (lambda p: triangulation.urquhart(p), 31),
    "cosine": (lambda p: kernel.cosine(p), 213), "thresholded": (lambda p: kernel.thresholded(p), 159), "gaussian_rbf": (lambda p: kernel.gaussian_rbf(p), 322),
    "adaptive_bandwidth": (lambda p: kernel.adaptive_bandwidth(p), 237), "expansion_percentile": (lambda p: data_driven.expansion(p, "percentile"), 110), "expansion_diffusion": (lambda p: data_driven.expansion(p), 189),
    "yao": (lambda p: spanners.yao(p), 98), "theta": (lambda p: spanners.theta(p), 99), "greedy_spanner": (lambda p: spanners.greedy_spanner(p, 2.0), 34), "emst": (lambda p: spanning.emst(p), 29), "mst_boruvka": (lambda p: spanning.mst_boruvka(p), 29),
}


@pytest.mark.parametrize("keyed", [0, 1])
@pytest.mark.parametrize("name", GOLDEN)
def test_canonical_counts(points, name, keyed):
    build, n = GOLDEN[name]
    rows = build(points[keyed]).collect()
    assert len(rows) == n and len({(r["src"], r["dst"]) for r in rows}) == n and all(r["src"] < r["dst"] for r in rows)


def test_containments(points):
    p = points[0]
    tree, rng, gabriel, delaunay, urquhart = (edges(f(p)) for f in (spanning.emst, proximity.rng, proximity.gabriel, triangulation.delaunay, triangulation.urquhart))
    assert tree <= rng <= gabriel <= delaunay and tree <= urquhart <= delaunay
    assert edges(proximity.beta_skeleton(p, 1.0)) == gabriel and edges(proximity.beta_skeleton(p, 2.0)) == rng
    assert edges(proximity.mutual_knn(p)) <= edges(proximity.symmetric_knn(p)) == edges(misc.balltree_neighbor(p)) == edges(misc.kdtree_neighbor(p))
    assert gabriel <= edges(proximity.beta_skeleton(p, 0.8))
    assert tree <= edges(spanners.greedy_spanner(p))


def test_lens_by_circles(points, xy):
    for beta in (0.5, 0.9):
        expected = set()
        for i in range(30):
            for j in range(i + 1, 30):
                d = np.linalg.norm(xy[i] - xy[j])
                side = np.array([-(xy[j] - xy[i])[1], (xy[j] - xy[i])[0]]) / d * d / 2 * np.sqrt(1 / beta**2 - 1)
                middle, r = (xy[i] + xy[j]) / 2, d / (2 * beta)
                inside = [(np.linalg.norm(xy[k] - middle - side) < r) and (np.linalg.norm(xy[k] - middle + side) < r) for k in range(30) if k not in (i, j)]
                if not any(inside):
                    expected.add((i, j))
        assert edges(proximity.beta_skeleton(points[0], beta)) == expected


def test_trees_weigh_the_same(points):
    sums = [f(points[0]).agg(F.sum("weight")).first()[0] for f in (spanning.mst_prim, spanning.mst_kruskal, spanning.mst_boruvka, spanning.emst)]
    assert all(abs(s - 12.07601606) < 1e-7 for s in sums)
    overlay = edges(spanning.k_mst_overlay(points[0], 2))
    assert edges(spanning.emst(points[0])) <= overlay and len(overlay) <= 58
    assert len(edges(spanning.k_mst_overlay(points[0], 2, noise_scale=0.1))) >= 29


def is_tree(found, n):
    top = list(range(n))
    for a, b in found:
        while top[a] != a:
            a = top[a]
        while top[b] != b:
            b = top[b]
        if a == b:
            return False
        top[b] = a
    return len(found) == n - 1


def test_random_trees(points):
    for weights in (False, True):
        assert is_tree(edges(spanning.random_spanning(points[0], use_weights=weights)), 30)


def test_stretch(points, xy):
    d = spanners.distances(xy)
    greedy = [(r["src"], r["dst"], r["weight"]) for r in spanners.greedy_spanner(points[0], 2.0).collect()]
    assert abs(spanners.stretch(30, greedy, d) - 1.936832) < 1e-6
    pairs_ = [(r["src"], r["dst"], r["weight"]) for r in spanners.wspd_spanner(points[0], 4.0).collect()]
    assert spanners.stretch(30, pairs_, d) < 4
    assert len(pairs_) <= 435


def test_paths_and_spanners(spark, points, xy):
    p = points[0]
    greedy = spanners.greedy_spanner(p, 2.0)
    assert abs(paths.stretch(p, greedy).first()["stretch"] - 1.936832) < 1e-6
    assert paths.is_spanner(p, greedy, 2.0).first()[0] and not paths.is_spanner(p, greedy, 1.5).first()[0]
    assert paths.stretch(p, greedy.limit(3)).first()["stretch"] == float("inf") and abs(paths.stretch(p, proximity.complete(p)).first()["stretch"] - 1) < 1e-9
    found = {r["node"]: r["dist"] for r in paths.shortest_paths(greedy, p.frame.filter("id = 4")).collect()}
    d = np.full((30, 30), np.inf)
    for r in greedy.collect():
        d[r["src"], r["dst"]] = d[r["dst"], r["src"]] = r["weight"]
    np.fill_diagonal(d, 0)
    for k in range(30):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    assert set(found) == set(range(30)) and all(abs(found[v] - d[4, v]) < 1e-9 for v in range(30))
    assert {r["node"] for r in paths.shortest_paths(greedy.limit(0), p.frame.filter("id = 4")).collect()} == {4}


def test_forest_by_rounds_and_in_one_task(points):
    for p in points:
        all_pairs = proximity.complete(p)
        assert edges(spanning.minimum_forest(all_pairs, p.keys)) == edges(spanning.minimum_forest(all_pairs, p.keys, in_one_task=0))


def test_points_and_drawn_degrees(spark, points):
    p = points[0]
    assert tuple(p.counts().first()) == (30, 2) and p.cluster(0).frame.count() == 10 and set(p.plane().columns) == {"id", "x", "y", "label"}
    drawn = [r["degree"] for r in tables.zipf_degrees(spark, 200).collect()]
    assert len(drawn) == 200 and sum(drawn) % 2 == 0 and min(drawn) >= 1 and random_models.configuration(tables.zipf_degrees(spark, 200)).count() > 50
    assert random_models.chung_lu(tables.lognormal_weights(spark, 100)).count() > 50


def test_drawn_models(points):
    p, keyed = points
    assert len(edges(random_models.erdos_renyi_gnm(p, 60))) == 60 == len(edges(random_models.erdos_renyi_gnm(keyed, 60)))
    assert edges(random_models.erdos_renyi_gnp(p, 0.0)) == set() and len(edges(random_models.erdos_renyi_gnp(p, 1.0))) == 435
    assert abs(len(edges(random_models.erdos_renyi_gnp(p, 0.5))) - 217) < 60
    within = edges(random_models.sbm(p, 1.0, 0.0))
    assert len(within) == 45 + 190
    lattice = edges(random_models.watts_strogatz(p, 4, 0.0))
    assert len(lattice) == 60 and len(edges(random_models.watts_strogatz(p, 4, 0.5))) == 60
    with pytest.raises(ValueError):
        random_models.watts_strogatz(p, 3)
    assert len(edges(random_models.barabasi_albert(p, 2))) == 3 + 27 * 2 == len(edges(random_models.holme_kim(p, 2)))
    degree = Counter(v for e in edges(random_models.random_regular(p, 3)) for v in e)
    assert set(degree.values()) == {3} and len(degree) == 30
    cites = Counter(a for a, _ in edges(random_models.price(p, 3)))
    assert all(cites[v] == min(v, 3) for v in range(1, 30))
    fire = edges(random_models.forest_fire(p))
    assert {b for _, b in fire} >= set(range(1, 30))
    assert 0 < len(edges(random_models.kronecker(p))) < 435


def test_degree_models(spark):
    degrees = spark.createDataFrame([(i, i % 5) for i in range(200)], "id long, degree long")
    found = edges(random_models.configuration(degrees))
    degree = Counter(v for e in found for v in e)
    assert all(degree[i] <= i % 5 for i in range(200)) and 150 <= len(found) <= 200
    raw = random_models.configuration(degrees, remove_self_loops=False, remove_multi_edges=False)
    assert raw.count() == 200
    assert 120 < len(edges(random_models.chung_lu(degrees))) < 290
    assert random_models.chung_lu(degrees.limit(0)).count() == 0


@pytest.mark.parametrize("build", [ann.nsw, ann.hnsw, ann.vamana, ann.nn_descent, ann.rp_forest])
def test_recall(points, build):
    p = points[1]
    exact = nearest(p, 5).select("layout", "src", "dst")
    assert ann.recall(build(p), exact, p.keys).first()[0] > 0.7


def test_lsh_recall(points):
    p = points[1]
    found = ann.lsh(p, ann.planes(10, 4, 2, 1), 5)
    assert ann.recall(found, nearest(p, 5).select("layout", "src", "dst"), p.keys).first()[0] > 0.5
    alone = ann.lsh(points[0], ann.planes(1, 40, 2, 1), 2)
    assert {v for e in edges(alone) for v in e} == set(range(30))


def test_visibility(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=40).round(1)  # ties
    series = spark.createDataFrame([(u, i, float(i * 1.5), float(v[i + 20 * u])) for u in (0, 1) for i in range(20)], "layout int, id long, t double, v double").withColumn("seq", F.col("id").cast("int"))
    nvg, hvg = set(), set()
    for u in (0, 1):
        w = v[20 * u : 20 * u + 20]
        for i in range(20):
            for j in range(i + 1, 20):
                if all(w[k] < w[j] + (w[i] - w[j]) * (j - k) / (j - i) - 1e-12 for k in range(i + 1, j)):
                    nvg.add((u, i, j))
                if all(w[k] < min(w[i], w[j]) for k in range(i + 1, j)):
                    hvg.add((u, i, j))
    got = [{(r["layout"], r["src"], r["dst"]) for r in f(series).collect()} for f in (visibility.natural_visibility, visibility.horizontal_visibility)]
    assert got[1] == hvg and got[0] >= hvg and len(got[0] ^ nvg) <= 4  # sight lines through a point depend on rounding


def test_dependence(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    x[:, 1] = x[:, 0] + 0.5 * x[:, 1]
    x[:, 3] = x[:, 2] ** 2
    obs = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, values array<double>").repartition(5)
    n, mean, c = data_driven.moments(obs, 4)
    assert n == 3000 and np.allclose(mean, x.mean(0)) and np.allclose(c / 2999, np.cov(x.T))
    assert edges(data_driven.correlation(obs, 4, 0.5)) == {(0, 1)} == edges(data_driven.partial_correlation(obs, 4, 0.3)) == edges(data_driven.glasso(obs, 4, 0.2))
    for estimator in ("histogram", "ksg"):
        assert edges(data_driven.mutual_information(obs, 4, 0.3, estimator=estimator)) == {(0, 1), (2, 3)}
    assert np.allclose(data_driven.digamma(np.array([1.0, 5.0, 40.0])), [-0.5772156649, 1.5061176685, 3.6763273745])
    assert data_driven.mutual_information(obs.limit(0), 4).count() == 0


def test_ksg_against_all_pairs():
    rng = np.random.default_rng(4)
    for trial in range(30):
        n, k = int(rng.integers(6, 400)), int(rng.integers(1, 6))
        x, y = rng.normal(size=(2, n))
        if trial % 3 == 1:
            x, y = np.round(x, 1), np.round(x + y, 1)
        if trial % 3 == 2:
            x[n // 2 :], y[n // 2 :] = x[0], y[0]
        dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
        eps = np.sort(np.maximum(dx, dy), axis=1)[:, k, None]
        assert (data_driven.kth_nearest(x, y, k) == eps[:, 0]).all()
        assert (data_driven.within(np.sort(x), x, eps[:, 0]) == (dx <= eps).sum(1)).all()


def test_queries_use_all_components(spark, small):
    edges = QUERIES["mutual_information_ksg"](spark, small).collect()
    assert {(r["src"], r["dst"]) for r in edges} == {(i, j) for i in range(64) for j in range(i + 1, 64)}
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    first, second = (np.array([x[i][v] for i in sorted(x)]) for v in (9, 63))
    assert {round(r["weight"], 6) for r in edges if (r["src"], r["dst"]) == (9, 63)} == {round(data_driven.ksg(first, second, 5), 6)}
    for r in QUERIES["rp_forest"](spark, small).collect():
        assert abs(r["weight"] - np.linalg.norm(x[r["src"]] - x[r["dst"]])) < 2e-6


def test_kernels(points):
    p = points[0]
    for measure, t in (("gaussian", 0.3), ("cosine", 0.3), ("polynomial", 0.3), ("laplacian", 0.3), ("sigmoid", 0.3), ("inverse_distance", 0.3)):
        assert edges(kernel.thresholded(p, measure, t + 0.2)) <= edges(kernel.thresholded(p, measure, t))
    with pytest.raises(ValueError):
        kernel.thresholded(p, "other")
    assert edges(kernel.adaptive_bandwidth(p, sparsify_knn=3)) <= edges(kernel.adaptive_bandwidth(p))
    for method in ("spatial_bin", "neighbor_fingerprint"):
        assert edges(kernel.jaccard(p, method, 0.5)) <= edges(kernel.jaccard(p, method, 0.3))
    assert kernel.jaccard(p, "multi_threshold", 0.3, thresholds=(-1.0, 0.0, 1.0)).count() > 0
    row = kernel.similarity_stats(proximity.complete(p)).first()
    assert row["nnz"] == 435 and row["sparsity"] == 0


def test_constraints(points, xy):
    for p in points:
        both = triangulation.constrained_delaunay(p)
        asked = edges(both.filter("constrained"))
        across, within = {e for e in asked if (e[0] < 10) != (e[1] < 10)}, {e for e in asked if (e[0] < 10) == (e[1] < 10)}
        assert len(across) == 2 and edges(triangulation.delaunay(points[0])) <= edges(both)
        # a side of a hull: all other points of the label lie on one hand of it
        wanted = set()
        for ids in (range(10), range(10, 30)):
            for a in ids:
                for b in ids:
                    (dx, dy), rest = xy[b] - xy[a], xy[[i for i in ids if i not in (a, b)]] - xy[a]
                    if a < b and abs(np.sign(dx * rest[:, 1] - dy * rest[:, 0]).sum()) == len(rest):
                        wanted.add((a, b))
        assert within == wanted


def test_constraints_of_few_points(spark):
    frame = spark.createDataFrame([(0, 5, [0.0, 0.0], 0), (0, 6, [1.0, 0.0], 0), (1, 7, [0.0, 0.0], 0), (1, 8, [2.0, 2.0], 0), (1, 9, [1.0, 1.0], 0)], "layout int, id long, features array<double>, label int")
    found = triangulation.default_constraints(tables.Points(frame, 2, ("layout",)))
    assert {tuple(r) for r in found.collect()} == {(0, 5, 6), (1, 7, 9)}
    assert edges(triangulation.default_constraints(tables.Points(frame.filter("layout = 1"), 2))) == {(7, 9)}
    assert triangulation.default_constraints(tables.Points(frame.limit(0), 2)).count() == 0


def test_drawn_obstacles(points, xy):
    sides = tables.drawn_obstacles(points[0]).collect()
    assert len(sides) == 16 and len({r["obstacle"] for r in sides}) == 4
    assert all(0.3 - 1e-9 <= np.hypot(r["x1"] - r["x2"], r["y1"] - r["y2"]) <= 0.6 + 1e-9 for r in sides)
    assert min(r["x1"] for r in sides) >= xy[:, 0].min() - 0.4 and len(tables.drawn_obstacles(points[0], 2, n_vertices=5).collect()) == 10
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    cross = lambda a, b, c, d: side(c, d, a) * side(c, d, b) < 0 and side(a, b, c) * side(a, b, d) < 0
    wanted = {(a, b) for a in range(30) for b in range(a + 1, 30) if not any(cross(xy[a], xy[b], (r["x1"], r["y1"]), (r["x2"], r["y2"])) for r in sides)}
    assert edges(visibility.geometric_visibility(points[0])) == wanted


def test_drawn_observations(points, xy):
    drawn = tables.spatial_observations(points[0], 4000)
    x = np.array([r["values"] for r in drawn.orderBy("id").collect()])
    wanted = np.exp(-((xy[:, None] - xy[None]) ** 2).sum(-1) / 2) + 0.01 * np.eye(30)
    assert x.shape == (4000, 30) and np.abs(np.cov(x.T) - wanted).max() < 0.12
    again = np.array([r["values"] for r in tables.spatial_observations(points[0], 4000).repartition(3).orderBy("id").collect()])
    assert (x == again).all()
    for kind, bent in {"square": {0: np.square, 2: np.square}, "abs": {0: np.abs, 3: np.abs}, "sin": {0: lambda v: np.sin(np.pi * v)}, "mixed": {0: np.square, 1: np.abs, 2: lambda v: np.sin(np.pi * v), 4: np.square}}.items():
        y = np.array([r["values"] for r in tables.nonlinear_observations(drawn, kind).orderBy("id").collect()])
        for k in range(6):
            every = {"square": 2, "abs": 3, "sin": 2, "mixed": 4}[kind]
            f = bent.get(k % every)
            assert np.allclose(y[:, k], f(x[:, k]) if f else x[:, k])
    with pytest.raises(ValueError):
        tables.spatial_observations(points[0], most_points=29)


def test_overlay_noise(points):
    plain, noisy = (edges(spanning.k_mst_overlay(points[1], 3, noise_scale=s)) for s in (0.0, 0.1))
    assert len(plain) > 29 and len(noisy) > 29 and edges(spanning.emst(points[0])) <= plain & noisy
    assert noisy == edges(spanning.k_mst_overlay(points[0], 3))  # one layout, with or without a key


def test_sampled_descent(points):
    whole, part = ann.nn_descent(points[0], 4), ann.nn_descent(points[0], 4, rho=0.5)
    assert edges(whole) == edges(ann.nn_descent(points[0], 4, rho=1.0))
    assert part.count() >= 30 and part.agg(F.sum("weight")).first()[0] >= whole.agg(F.min("weight")).first()[0]


def test_overlaps(points, xy):
    circles = misc.intersection(points[0], "circle")
    rectangles = misc.intersection(points[0], "rectangle")
    assert circles.filter("overlap < 0").count() == 0 and rectangles.filter("overlap_area < 0").count() == 0 and circles.count() and rectangles.count()
    with pytest.raises(ValueError):
        misc.intersection(points[0], "star")


def test_obstacles(spark, points):
    wall = spark.createDataFrame([(0.0, -10.0, 0.0, 10.0)], "x1 double, y1 double, x2 double, y2 double")
    seen = edges(visibility.geometric_visibility(points[0], wall))
    label = {r["id"]: r["label"] for r in points[0].frame.collect()}
    assert all(label[a] == label[b] for a, b in seen) and len(seen) == 45 + 190


def test_errors(spark, points):
    p = points[0]
    for bad in (lambda: proximity.symmetric_knn(p, 30), lambda: proximity.beta_skeleton(p, 0), lambda: spanners.greedy_spanner(p, 0.5), lambda: spanners.yao(p, 1), lambda: spanners.wspd_spanner(p, 0), lambda: kernel.gaussian_rbf(p, 0.0), lambda: data_driven.expansion(p, "x"), lambda: misc.disk(p, mode="x")):
        with pytest.raises(ValueError):
            bad()
    for rows in ([(0, [0.0, 0.0], 0)], [(0, [0.0, float("nan")], 0), (1, [0.0, 0.0], 0)], [(0, [0.0, None], 0), (1, [1.0, 2.0], 0)]):
        with pytest.raises(ValueError):
            tables.Points(spark.createDataFrame(rows, "id long, features array<double>, label int"), 2).checked()


def test_grid_finds_what_pairs_find(spark):
    rng = np.random.default_rng(8)
    for dims in (1, 2, 3):
        frame = spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(rng.normal(size=(120, dims)))], "id long, features array<double>, label int")
        p = tables.Points(frame, dims)
        assert edges(pairs(p, within=0.3)) == edges(pairs(p).filter("dist <= 0.3"))
