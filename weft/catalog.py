"""All queries of the graph operators over whole tables, by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .functions.vectors import in_polygon
from .operators import ann, data_driven, kernel, misc, paths, proximity, random_models, spanners, spanning, triangulation, visibility
from .registry import get_operator
from .sources import tables

# Parameters that a query and its SQL share.
EPS, R, K, CONES, GNM = 0.02, 0.02, 5, 6, 60
LSH = ann.planes(10, 8, 64, 247)
OBSTACLES = [(-0.05, -0.05, 0.05, -0.02), (0.05, -0.02, 0.02, 0.06), (0.02, 0.06, -0.05, -0.05), (0.1, 0.0, 0.14, 0.05), (0.14, 0.05, 0.1, 0.09), (0.1, 0.09, 0.1, 0.0)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(frame: DataFrame) -> DataFrame:
    """Doubles to six decimals."""
    return frame.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes))


def lengths_rounded(frame: DataFrame) -> DataFrame:
    """Lengths and similarities to six decimals as SQL rounds them, halves up: without decimals in between, for billions of rows."""
    y = F.col("weight") * 1e6
    return frame.withColumn("weight", F.when(y - F.rint(y) == 0.5, F.rint(y) + 1).otherwise(F.rint(y)) / 1e6)


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, finish: Callable[[DataFrame], DataFrame] = rounded) -> None:
    QUERIES[name] = lambda spark, folder: finish(run(spark, folder))
    if sql:
        ORACLES[name] = sql


def plane(spark: SparkSession, folder: str) -> tables.Points:
    return tables.embedding_points(spark, folder, 2)


def plane_by_label(spark: SparkSession, folder: str) -> tables.Points:
    return tables.embedding_points(spark, folder, 2, by_label=True)


def whole(spark: SparkSession, folder: str) -> tables.Points:
    return tables.embedding_points(spark, folder, 64)


# Common table expressions of the SQL: points of the plane, of the plane by label, and in all dimensions; pairs; nearest ones.
PTS = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"
PTSL = "pts AS (SELECT CAST(label AS INTEGER) AS layout, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
PTS64 = "pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"
D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"
PAIRS = f"pairs AS (SELECT a.id AS src, b.id AS dst, sqrt({D2}) AS dist, {D2} AS c, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, a.label AS la, b.label AS lb FROM pts a JOIN pts b ON a.id < b.id)"
DPAIRS = f"dpairs AS (SELECT a.id AS src, b.id AS dst, sqrt({D2}) AS dist, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM pts a JOIN pts b ON a.id <> b.id)"
PAIRSL = f"pairs AS (SELECT a.layout, a.id AS src, b.id AS dst, sqrt({D2}) AS dist FROM pts a JOIN pts b ON a.layout = b.layout AND a.id < b.id)"
DPAIRS64 = "dpairs AS (SELECT a.id AS src, b.id AS dst, list_distance(a.f, b.f) AS dist FROM pts a JOIN pts b ON a.id <> b.id)"
KNN = "knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM dpairs) WHERE rank <= {k})"
U = "(CAST(('0x' || substr(md5('{seed}:' || src || ':' || dst), 1, 8)) AS BIGINT) / 4294967296.0)"
PI = "3.141592653589793"


def knn(k: int, base: str = f"{PTS}, {DPAIRS}") -> str:
    return f"{base}, {KNN.format(k=k)}"


W = "round(dist, 6) AS weight"

query("complete", lambda s, d: proximity.complete(plane(s, d)), f"WITH {PTS}, {PAIRS} SELECT src, dst, {W} FROM pairs", lengths_rounded)
query("symmetric_knn", lambda s, d: proximity.symmetric_knn(whole(s, d), K), f"WITH {knn(K, f'{PTS64}, {DPAIRS64}')} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(min(dist), 6) AS weight FROM knn GROUP BY 1, 2")
query("mutual_knn", lambda s, d: proximity.mutual_knn(whole(s, d), K), f"WITH {knn(K, f'{PTS64}, {DPAIRS64}')} SELECT a.src, a.dst, round(a.dist, 6) AS weight FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
query("epsilon", lambda s, d: proximity.epsilon(plane(s, d), EPS), f"WITH {PTS}, {PAIRS} SELECT src, dst, {W} FROM pairs WHERE dist <= {EPS}")
_A, _B = "((k.x-xa)*(k.x-xa)+(k.y-ya)*(k.y-ya))", "((k.x-xb)*(k.x-xb)+(k.y-yb)*(k.y-yb))"
_EMPTY = f"WITH {PTS}, {PAIRS} SELECT src, dst, {W} FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pts k WHERE k.id <> p.src AND k.id <> p.dst AND {{test}})"
query("gabriel", lambda s, d: proximity.gabriel(plane(s, d)), _EMPTY.format(test=f"{_A} + {_B} < c"))
query("rng", lambda s, d: proximity.rng(plane(s, d)), _EMPTY.format(test=f"greatest({_A}, {_B}) < c"))
query("beta_skeleton", lambda s, d: proximity.beta_skeleton(plane(s, d), 1.5), _EMPTY.format(test=f"(1-0.75e0)*{_A} + 0.75e0*{_B} < 0.75e0*c AND 0.75e0*{_A} + (1-0.75e0)*{_B} < 0.75e0*c"))
query("influence", lambda s, d: proximity.influence(plane(s, d)), f"WITH {PTS}, {PAIRS}, {DPAIRS}, r AS (SELECT src AS id, min(dist) AS r FROM dpairs GROUP BY 1) SELECT src, dst, {W} FROM pairs JOIN r a ON a.id = src JOIN r b ON b.id = dst WHERE dist < a.r + b.r")

_TRI = f"""WITH {PTSL}, tri AS (SELECT a.layout, a.id AS a, b.id AS b, c.id AS c, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, c.x AS cx, c.y AS cy,
  2*((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)) AS d, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) AS bb, (c.x-a.x)*(c.x-a.x)+(c.y-a.y)*(c.y-a.y) AS cc
  FROM pts a JOIN pts b ON a.layout = b.layout AND a.id < b.id JOIN pts c ON c.layout = b.layout AND b.id < c.id),
circle AS (SELECT *, ((cy-ya)*bb-(yb-ya)*cc)/d AS ux, ((xb-xa)*cc-(cx-xa)*bb)/d AS uy FROM tri WHERE d <> 0),
kept AS MATERIALIZED (SELECT layout, a, b, c, sqrt((xa-xb)*(xa-xb)+(ya-yb)*(ya-yb)) AS ab, sqrt((xb-cx)*(xb-cx)+(yb-cy)*(yb-cy)) AS bc, sqrt((xa-cx)*(xa-cx)+(ya-cy)*(ya-cy)) AS ac FROM circle t
  WHERE NOT EXISTS (SELECT 1 FROM pts k WHERE k.layout = t.layout AND k.id NOT IN (t.a, t.b, t.c) AND (k.x-xa-ux)*(k.x-xa-ux)+(k.y-ya-uy)*(k.y-ya-uy) < ux*ux+uy*uy)),
sides AS (SELECT layout, a AS src, b AS dst, ab AS dist, ab >= greatest(bc, ac) AS longest FROM kept UNION ALL SELECT layout, b, c, bc, bc > ab AND bc >= ac FROM kept UNION ALL SELECT layout, a, c, ac, ac > greatest(ab, bc) FROM kept)"""
query("delaunay", lambda s, d: triangulation.delaunay(plane_by_label(s, d)), f"{_TRI} SELECT layout, src, dst, round(min(dist), 6) AS weight FROM sides GROUP BY ALL")
ORACLES["delaunay"] = f"{_TRI} SELECT layout, src, dst, round(min(dist), 6) AS weight FROM sides GROUP BY layout, src, dst"
query("urquhart", lambda s, d: triangulation.urquhart(plane_by_label(s, d)), f"{_TRI} SELECT layout, src, dst, round(min(dist), 6) AS weight FROM sides GROUP BY layout, src, dst HAVING NOT bool_or(longest)")


def _first_last(spark: SparkSession, folder: str) -> DataFrame:
    return plane_by_label(spark, folder).frame.groupBy("layout").agg(F.min("id").alias("src"), F.max("id").alias("dst"))


query("constrained_delaunay", lambda s, d: triangulation.constrained_delaunay(plane_by_label(s, d), _first_last(s, d)),
      f"{_TRI}, ends AS (SELECT layout, min(id) AS src, max(id) AS dst FROM pts GROUP BY 1), asked AS (SELECT e.layout, e.src, e.dst, sqrt({D2}) AS dist FROM ends e JOIN pts a ON a.id = e.src JOIN pts b ON b.id = e.dst) SELECT layout, src, dst, round(min(dist), 6) AS weight, bool_or(c) AS constrained FROM (SELECT layout, src, dst, dist, false AS c FROM sides UNION ALL SELECT layout, src, dst, dist, true FROM asked) GROUP BY layout, src, dst")

_BOTH = "m0 AS MATERIALIZED (SELECT layout, src AS i, dst AS j, dist AS m FROM pairs UNION ALL SELECT layout, dst, src, dist FROM pairs)"
_CLOSED = ", ".join(f"m{k + 1} AS MATERIALIZED (SELECT layout, i, j, min(m) AS m FROM (SELECT * FROM m{k} UNION ALL SELECT a.layout, a.i, b.j, greatest(a.m, b.m) FROM m{k} a JOIN m{k} b ON a.layout = b.layout AND a.j = b.i AND a.i <> b.j) GROUP BY layout, i, j)" for k in range(6))
_MST = f"WITH {PTSL}, {PAIRSL}, {_BOTH}, {_CLOSED} SELECT p.layout, src, dst, {W} FROM pairs p JOIN m6 ON m6.layout = p.layout AND i = src AND j = dst WHERE dist <= m"
for _name in ("mst_prim", "mst_kruskal", "mst_boruvka", "emst"):
    query(_name, lambda s, d, f=getattr(spanning, _name): f(plane_by_label(s, d)), _MST)
query("k_mst_overlay", lambda s, d: spanning.k_mst_overlay(plane_by_label(s, d)))
_NEAR = f"near_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layout, src ORDER BY dist, dst) AS r FROM (SELECT layout, src, dst, dist FROM pairs UNION ALL SELECT layout, dst, src, dist FROM pairs)) WHERE r <= {K}), m0 AS MATERIALIZED (SELECT layout, i, j, min(m) AS m FROM (SELECT layout, src AS i, dst AS j, dist AS m FROM near_ UNION ALL SELECT layout, dst, src, dist FROM near_) GROUP BY layout, i, j)"
_SUMMED = ", ".join(f"m{k + 1} AS MATERIALIZED (SELECT layout, i, j, min(m) AS m FROM (SELECT * FROM m{k} UNION ALL SELECT a.layout, a.i, b.j, a.m + b.m FROM m{k} a JOIN m{k} b ON a.layout = b.layout AND a.j = b.i AND a.i <> b.j) GROUP BY layout, i, j)" for k in range(6))


def _near_edges(spark: SparkSession, folder: str) -> tuple[tables.Points, DataFrame]:
    points = plane_by_label(spark, folder)
    return points, proximity.symmetric_knn(points, K)


def _paths_from_first(spark: SparkSession, folder: str) -> DataFrame:
    points, edges = _near_edges(spark, folder)
    return paths.shortest_paths(edges, points.frame.groupBy("layout").agg(F.min("id").alias("id")), points.keys)


query("shortest_paths", _paths_from_first, f"WITH {PTSL}, {PAIRSL}, {_NEAR}, {_SUMMED}, first AS (SELECT layout, min(id) AS id FROM pts GROUP BY layout) SELECT m6.layout, i AS source, j AS node, round(m, 6) AS dist FROM m6 JOIN first f ON f.layout = m6.layout AND f.id = i UNION ALL SELECT layout, id, id, 0.0 FROM first")
_STRETCH = f"WITH {PTSL}, {PAIRSL}, {_NEAR}, {_SUMMED}, worst AS (SELECT p.layout, greatest(1.0e0, max(coalesce(m / dist, CAST('infinity' AS DOUBLE)))) AS s FROM pairs p LEFT JOIN m6 ON m6.layout = p.layout AND i = src AND j = dst WHERE dist > 1e-15 GROUP BY p.layout)"
query("stretch", lambda s, d: paths.stretch(*_near_edges(s, d)), f"{_STRETCH} SELECT layout, round(s, 6) AS stretch FROM worst")
query("is_spanner", lambda s, d: paths.is_spanner(*_near_edges(s, d), 2.0), f"{_STRETCH} SELECT layout, s <= 2.0e0 + 1e-9 AS is_spanner FROM worst")
POLYGON = [(-0.1, -0.1), (0.12, -0.05), (0.02, 0.01), (0.1, 0.14), (-0.06, 0.1)]
_RAY = [f"(CASE WHEN (({y1}e0 > y) <> ({y2}e0 > y)) AND x < ({x2}e0 - ({x1}e0)) * (y - ({y1}e0)) / ({y2}e0 - ({y1}e0)) + ({x1}e0) THEN 1 ELSE 0 END)" for (x1, y1), (x2, y2) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]])]
query("in_polygon", lambda s, d: plane(s, d).plane().select("id", in_polygon(F.col("x"), F.col("y"), POLYGON).alias("inside")), f"WITH {PTS} SELECT id, ({' + '.join(_RAY)}) % 2 = 1 AS inside FROM pts")
query("layout_counts", lambda s, d: plane(s, d).counts(), "SELECT count(*) AS n_points, count(DISTINCT label) AS n_clusters FROM embeddings")
query("k_mst_overlay_one", lambda s, d: spanning.k_mst_overlay(plane_by_label(s, d), 1), ORACLES["emst"])
query("random_spanning", lambda s, d: spanning.random_spanning(plane_by_label(s, d)))

query("erdos_renyi_gnp", lambda s, d: random_models.erdos_renyi_gnp(plane(s, d), 0.15, 142), f"WITH {PTS}, {PAIRS} SELECT src, dst FROM pairs WHERE {U.format(seed=142)} < 0.15e0")
query("erdos_renyi_gnm", lambda s, d: random_models.erdos_renyi_gnm(plane(s, d), GNM, 143), f"WITH {PTS}, {PAIRS} SELECT src, dst FROM pairs ORDER BY {U.format(seed=143)}, src, dst LIMIT {GNM}")
query("sbm", lambda s, d: random_models.sbm(plane(s, d)), f"WITH {PTS}, {PAIRS} SELECT src, dst FROM pairs WHERE {U.format(seed=147)} < CASE WHEN la = lb THEN 0.4e0 ELSE 0.05e0 END")
query("random_geometric", lambda s, d: random_models.random_geometric(plane(s, d), R), f"WITH {PTS}, {PAIRS} SELECT src, dst, {W} FROM pairs WHERE dist <= {R}")
_DEG = "deg AS (SELECT c_custkey AS id, coalesce(n, 0) AS degree FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"
query("chung_lu", lambda s, d: random_models.chung_lu(tables.order_degrees(s, d)),
      f"WITH {_DEG}, t AS (SELECT CAST(sum(degree) AS DOUBLE) AS s, CAST(max(degree) AS DOUBLE) AS top FROM deg), f AS (SELECT s, CASE WHEN top*top > s THEN sqrt(s)/top ELSE 1.0e0 END AS k FROM t), w AS (SELECT id, degree*k AS w, s*k AS s FROM deg, f WHERE degree > 0), p AS (SELECT a.id AS src, b.id AS dst, a.w*b.w/a.s AS p FROM w a JOIN w b ON a.id < b.id) SELECT src, dst FROM p WHERE {U.format(seed=149)} < least(p, 1.0e0)")
query("configuration", lambda s, d: random_models.configuration(tables.order_degrees(s, d)),
      f"WITH {_DEG}, stubs AS (SELECT id, unnest(range(1, degree + 1)) AS k FROM deg), r AS (SELECT id, row_number() OVER (ORDER BY CAST(('0x' || substr(md5('148:' || id || ':' || k), 1, 8)) AS BIGINT), id, k) - 1 AS r FROM stubs) SELECT DISTINCT min(id) AS src, max(id) AS dst FROM r GROUP BY r // 2 HAVING count(*) = 2 AND min(id) <> max(id)")
_KRON_P = "list_product(list_transform(range(0, t), lambda e: [0.9e0, 0.5e0, 0.5e0, 0.3e0][1 + ((i // CAST(2**e AS BIGINT)) % 2) * 2 + ((j // CAST(2**e AS BIGINT)) % 2)]))"
query("kronecker", lambda s, d: random_models.kronecker(plane(s, d)),
      f"WITH n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT vec_id AS id FROM embeddings)), t AS (SELECT CAST(ceil(log2(count(*))) AS BIGINT) AS t FROM n), p AS (SELECT a.id AS src, b.id AS dst, a.n AS i, b.n AS j, t FROM n a JOIN n b ON a.id < b.id CROSS JOIN t), q AS (SELECT src, dst, {_KRON_P} AS p FROM p) SELECT src, dst FROM q WHERE {U.format(seed=150)} < p")
query("watts_strogatz", lambda s, d: random_models.watts_strogatz(plane_by_label(s, d)))
query("ring_lattice", lambda s, d: random_models.watts_strogatz(plane_by_label(s, d), k=4, p=0.0),
      f"WITH {PTSL}, n AS (SELECT layout, id, row_number() OVER (PARTITION BY layout ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY layout) AS n FROM pts) SELECT DISTINCT a.layout, least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM n a JOIN n b ON a.layout = b.layout AND (b.i = (a.i + 1) % a.n OR b.i = (a.i + 2) % a.n) AND a.id <> b.id")
for _name in ("barabasi_albert", "forest_fire", "price", "holme_kim"):
    query(_name, lambda s, d, f=getattr(random_models, _name): f(plane_by_label(s, d)))


def _even(spark: SparkSession, folder: str) -> DataFrame:
    return random_models.random_regular(plane_by_label(spark, folder), d=4)


query("random_regular", _even)

_CONE = f"SELECT *, CAST(least({CONES - 1}, floor(CASE WHEN atan2(yb-ya, xb-xa) < 0 THEN atan2(yb-ya, xb-xa) + 2*{PI}e0 ELSE atan2(yb-ya, xb-xa) END / (2*{PI}e0/{CONES}))) AS INTEGER) AS cone FROM dpairs"
query("yao", lambda s, d: spanners.yao(plane(s, d), CONES),
      f"WITH {PTS}, {DPAIRS}, c AS ({_CONE}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, cone ORDER BY dist, dst) AS r FROM c) WHERE r = 1) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(min(dist), 6) AS weight, arg_min(cone, src) AS cone FROM b GROUP BY least(b.src, b.dst), greatest(b.src, b.dst)")
_WAYS = ", ".join(f"({c}, {__import__('math').cos((2 * c + 1) * __import__('math').pi / CONES)!r}e0, {__import__('math').sin((2 * c + 1) * __import__('math').pi / CONES)!r}e0)" for c in range(CONES)).replace("e-17e0", "e-17").replace("e-16e0", "e-16")
query("theta", lambda s, d: spanners.theta(plane(s, d), CONES),
      f"WITH {PTS}, {DPAIRS}, c AS ({_CONE}), ways(cone, cx, cy) AS (VALUES {_WAYS}), q AS (SELECT c.*, (xb-xa)*cx+(yb-ya)*cy AS proj FROM c JOIN ways USING (cone)), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, cone ORDER BY proj, dst) AS r FROM q WHERE proj > 0) WHERE r = 1) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(min(dist), 6) AS weight, round(arg_min(proj, src), 6) AS projection_distance, arg_min(cone, src) AS cone FROM b GROUP BY least(b.src, b.dst), greatest(b.src, b.dst)")
for _name in ("greedy_spanner", "t_spanner", "wspd_spanner"):
    query(_name, lambda s, d, f=getattr(spanners, _name): f(plane_by_label(s, d)))

for _name in ("nsw", "hnsw", "vamana"):
    query(_name, lambda s, d, f=getattr(ann, _name): f(tables.embedding_points(s, d, 64, by_label=True)))
query("nn_descent", lambda s, d: ann.nn_descent(whole(s, d)))
query("rp_forest", lambda s, d: ann.rp_forest(whole(s, d)))
_CODES = ", ".join("(" + " || ".join("CASE WHEN " + "+".join(f"f[{j + 1}]*({x!r}e0)" if "e" not in repr(float(x)) else f"f[{j + 1}]*({float(x)!r})" for j, x in enumerate(map(float, n))) + " >= 0 THEN '1' ELSE '0' END" for n in t) + ")" for t in LSH)
query("lsh", lambda s, d: ann.lsh(whole(s, d), LSH, K),
      f"""WITH {PTS64}, codes AS (SELECT id, f, [{_CODES}] AS c FROM pts), coded AS (SELECT id, unnest(range(1, 11)) AS t, unnest(c) AS code FROM codes),
met AS MATERIALIZED (SELECT DISTINCT a.id AS src, b.id AS dst FROM coded a JOIN coded b ON a.t = b.t AND a.code = b.code AND a.id < b.id),
alone AS (SELECT id FROM pts WHERE id NOT IN (SELECT src FROM met UNION SELECT dst FROM met)),
drawn AS (SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {U.format(seed=247)}, dst) AS r FROM (SELECT a.id AS src, b.id AS dst FROM alone a JOIN pts b ON a.id <> b.id)) WHERE r <= {K}),
cand AS (SELECT src, dst FROM met UNION SELECT least(src, dst), greatest(src, dst) FROM drawn),
w AS (SELECT src, dst, list_distance(a.f, b.f) AS dist FROM cand JOIN pts a ON a.id = src JOIN pts b ON b.id = dst),
both_ AS (SELECT src, dst, dist FROM w UNION ALL SELECT dst, src, dist FROM w),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM both_) WHERE r <= {K})
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(min(dist), 6) AS weight FROM top GROUP BY least(top.src, top.dst), greatest(top.src, top.dst)""")

query("gaussian_rbf", lambda s, d: kernel.gaussian_rbf(plane(s, d)), f"WITH {PTS}, {PAIRS}, m AS (SELECT quantile_cont(dist, 0.5) AS s FROM pairs), k AS (SELECT src, dst, exp(-(dist*dist)/(2*s*s)) AS w FROM pairs, m) SELECT src, dst, round(w, 6) AS weight FROM k WHERE w >= 0.1e0 AND w > 0", lengths_rounded)
_COS = "greatest(-1.0e0, least(1.0e0, (xa*xb+ya*yb)/(greatest(sqrt(xa*xa+ya*ya), 1e-12)*greatest(sqrt(xb*xb+yb*yb), 1e-12))))"
query("cosine", lambda s, d: kernel.cosine(plane(s, d)), f"WITH {PTS}, {PAIRS}, k AS (SELECT src, dst, {_COS} AS w FROM pairs) SELECT src, dst, round(w, 6) AS weight FROM k WHERE w >= 0.8e0")
_POW = "pow(({0})+1.0e0, 3.0e0)"
_MEASURES = {
    "laplacian": (0.9, "exp(-dist/1.0e0)"),
    "gaussian": (0.98, "exp(-(dist*dist)/2.0e0)"),
    "cosine": (0.9, _COS),
    "polynomial": (0.99, f"{_POW.format('xa*xb+ya*yb')}/(greatest(sqrt({_POW.format('xa*xa+ya*ya')}), 1e-12)*greatest(sqrt({_POW.format('xb*xb+yb*yb')}), 1e-12))"),
    "sigmoid": (0.5, "(tanh(0.1e0*(xa*xb+ya*yb)+0.0e0)+1)/2"),
    "inverse_distance": (0.9, "1/(1+dist)"),
}
for _name, (_t, _sql) in _MEASURES.items():
    query(f"thresholded_{_name}", lambda s, d, m=_name, t=_t: kernel.thresholded(plane(s, d), m, t), f"WITH {PTS}, {PAIRS}, k AS (SELECT src, dst, {_sql} AS w FROM pairs) SELECT src, dst, round(w, 6) AS weight FROM k WHERE w >= {_t}e0 AND w > 0")
query("adaptive_bandwidth", lambda s, d: kernel.adaptive_bandwidth(plane(s, d)), f"WITH {knn(7)}, {PAIRS}, s AS (SELECT src AS id, greatest(dist, 1e-10) AS s FROM knn WHERE rank = 7), k AS (SELECT src, dst, exp(-(dist*dist)/(2*a.s*b.s)) AS w FROM pairs JOIN s a ON a.id = src JOIN s b ON b.id = dst) SELECT src, dst, round(w, 6) AS weight FROM k WHERE w >= 0.05e0 AND w > 0")
_JAC = "sizes AS (SELECT id, count(*) AS n FROM m GROUP BY 1), j AS (SELECT a.id AS src, b.id AS dst, count(*) AS n FROM m a JOIN m b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2) SELECT src, dst, round(j.n / CAST(a.n + b.n - j.n AS DOUBLE), 6) AS weight FROM j JOIN sizes a ON a.id = src JOIN sizes b ON b.id = dst WHERE j.n / CAST(a.n + b.n - j.n AS DOUBLE) >= 0.3e0"
query("jaccard_neighbor_fingerprint", lambda s, d: kernel.jaccard(plane(s, d), "neighbor_fingerprint", 0.3), f"WITH {knn(5)}, m AS (SELECT src AS id, dst AS item FROM knn), {_JAC}")
query("jaccard_spatial_bin", lambda s, d: kernel.jaccard(plane(s, d), "spatial_bin", 0.3, digits=6), finish=lambda f: f, sql=f"WITH {PTS}, box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts), u AS (SELECT id, (x-x0)/(x1-x0)*7 AS px, (y-y0)/(y1-y0)*7 AS py, unnest(range(0, 64)) AS item FROM pts, box), m AS (SELECT id, item FROM u WHERE sqrt((px-(item//8))*(px-(item//8))+(py-(item%8))*(py-(item%8))) <= 1.5e0), {_JAC}")
query("jaccard_suppliers", lambda s, d: kernel.jaccard_of_sets(tables.table(s, d, "lineitem").join(tables.table(s, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), F.col("p_type").alias("item")), (), 0.3), f"WITH m AS (SELECT DISTINCT l_suppkey AS id, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey), {_JAC}")

_SER = "ser AS (SELECT user_id AS layout, event_id AS id, epoch_us(ts)/1e6 AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events), p AS (SELECT a.layout, a.seq AS i, b.seq AS j, a.id AS si, b.id AS di, a.t AS ta, b.t AS tb, a.v AS va, b.v AS vb FROM ser a JOIN ser b ON a.layout = b.layout AND a.seq < b.seq)"
_OUT = "SELECT layout, least(si, di) AS src, greatest(si, di) AS dst, round(abs(tb-ta), 6) AS weight, CAST(j-i AS INTEGER) AS time_gap FROM m"
_FRAME = "OVER (PARTITION BY layout, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
query("natural_visibility", lambda s, d: visibility.natural_visibility(tables.event_series(s, d)), f"WITH {_SER}, q AS (SELECT *, CASE WHEN tb-ta >= 1e-15 THEN (vb-va)/(tb-ta) END AS slope FROM p), m AS (SELECT *, max(slope) {_FRAME} AS top FROM q) {_OUT} WHERE j = i+1 OR slope > top")
query("horizontal_visibility", lambda s, d: visibility.horizontal_visibility(tables.event_series(s, d)), f"WITH {_SER}, m AS (SELECT *, max(vb) {_FRAME} AS top FROM p) {_OUT} WHERE j = i+1 OR top < least(va, vb)")


def _cross(a: str, b: str, c: str) -> str:
    return f"(({b[0]}-{a[0]})*({c[1]}-{a[1]})-({b[1]}-{a[1]})*({c[0]}-{a[0]}))"


_P = [("xa", "ya"), ("xb", "yb"), ("x1", "y1"), ("x2", "y2")]
_APART = "(({0} > 1e-10 AND {1} < -1e-10) OR ({0} < -1e-10 AND {1} > 1e-10))"
_HIT = _APART.format(_cross(_P[2], _P[3], _P[0]), _cross(_P[2], _P[3], _P[1])) + " AND " + _APART.format(_cross(_P[0], _P[1], _P[2]), _cross(_P[0], _P[1], _P[3]))
_WALLS = ", ".join(str(tuple(map(float, o))) for o in OBSTACLES)
query("geometric_visibility", lambda s, d: visibility.geometric_visibility(plane(s, d), s.createDataFrame([tuple(map(float, o)) for o in OBSTACLES], "x1 double, y1 double, x2 double, y2 double")), f"WITH {PTS}, {PAIRS}, w AS (SELECT CAST(a AS DOUBLE) AS x1, CAST(b AS DOUBLE) AS y1, CAST(c AS DOUBLE) AS x2, CAST(d AS DOUBLE) AS y2 FROM (VALUES {_WALLS}) AS v(a, b, c, d)) SELECT src, dst, {W} FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM w WHERE {_HIT})", lengths_rounded)


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))


_OBS = "o AS (SELECT vec_id AS id, unnest(range(0, 64)) AS v, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"
query("correlation", lambda s, d: data_driven.correlation(observations(s, d), 64, 0.1), f"WITH {_OBS}, r AS (SELECT a.v AS src, b.v AS dst, corr(a.x, b.x) AS r FROM o a JOIN o b ON a.id = b.id AND a.v < b.v GROUP BY 1, 2) SELECT src, dst, round(abs(r), 6) AS weight, round(r, 6) AS correlation, CASE WHEN r > 0 THEN 1 ELSE -1 END AS sign FROM r WHERE abs(r) >= 0.1e0")
query("partial_correlation", lambda s, d: data_driven.partial_correlation(observations(s, d), 64, 0.1))
query("glasso", lambda s, d: data_driven.glasso(observations(s, d), 64, alpha=0.002, max_iter=20))
_LIM = "lim AS (SELECT v, min(x) AS lo, max(x) AS hi, count(*) AS n FROM o GROUP BY 1), b AS (SELECT id, v, CAST(least(19, floor((x-lo)/(hi-lo)*20)) AS BIGINT) AS b, n FROM o JOIN lim USING (v)), one AS (SELECT v, b, count(*) AS n FROM b GROUP BY 1, 2), joint AS (SELECT p.v AS src, q.v AS dst, p.b AS x, q.b AS y, count(*) AS c, min(p.n) AS n FROM b p JOIN b q ON p.id = q.id AND p.v < q.v GROUP BY 1, 2, 3, 4), mi AS (SELECT src, dst, greatest(0.0e0, sum(c/CAST(joint.n AS DOUBLE)*ln(c*CAST(joint.n AS DOUBLE)/(a.n*e.n)))) AS w FROM joint JOIN one a ON a.v = src AND a.b = x JOIN one e ON e.v = dst AND e.b = y GROUP BY 1, 2)"
query("mutual_information", lambda s, d: data_driven.mutual_information(observations(s, d), 64, 0.1, estimator="histogram"), f"WITH {_OBS}, {_LIM} SELECT src, dst, round(w, 6) AS weight, round(w, 6) AS mutual_information FROM mi WHERE w >= 0.1e0")
query("mutual_information_ksg", lambda s, d: data_driven.mutual_information(observations(s, d), 64, 0.0, estimator="ksg"))
query("expansion_percentile", lambda s, d: data_driven.expansion(plane(s, d), "percentile"), f"WITH {PTS}, {PAIRS}, {DPAIRS}, a AS (SELECT src AS id, quantile_cont(dist, 0.2) AS q FROM dpairs GROUP BY 1), b AS (SELECT src AS id, quantile_cont(dist, 0.2) AS q FROM (SELECT src, dist FROM dpairs UNION ALL SELECT id, 0.0 FROM pts) GROUP BY 1) SELECT src, dst, {W} FROM pairs JOIN a ON a.id = src JOIN b ON b.id = dst WHERE dist <= a.q OR dist <= b.q")
query("expansion_diffusion", lambda s, d: data_driven.expansion(plane(s, d), "diffusion", diffusion_threshold=0.0123), f"WITH {knn(5)}, {PAIRS}, g AS (SELECT quantile_cont(dist, 0.5) AS s FROM pairs WHERE dist > 0), e AS (SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j, dist FROM knn), w AS (SELECT i, j, exp(-(dist*dist)/(2*s*s)) AS w FROM e, g), s AS (SELECT i, j, w FROM w UNION ALL SELECT j, i, w FROM w), p AS MATERIALIZED (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS p FROM s), p2 AS (SELECT a.i, b.j, sum(a.p*b.p) AS p FROM p a JOIN p b ON a.j = b.i GROUP BY 1, 2), p3 AS (SELECT a.i, b.j, sum(a.p*b.p) AS p FROM p2 a JOIN p b ON a.j = b.i GROUP BY 1, 2), f AS (SELECT least(i, j) AS src, greatest(i, j) AS dst, sum(p)/2 AS w FROM p3 WHERE i <> j GROUP BY 1, 2) SELECT src, dst, round(w, 6) AS weight, round(w, 6) AS diffusion_affinity FROM f WHERE w >= 0.0123e0")

query("kdtree_neighbor", lambda s, d: misc.kdtree_neighbor(plane(s, d), K), f"WITH {knn(K)} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(min(dist), 6) AS weight FROM knn GROUP BY least(knn.src, knn.dst), greatest(knn.src, knn.dst)")
query("balltree_neighbor_knn", lambda s, d: misc.balltree_neighbor(plane(s, d), K), ORACLES["kdtree_neighbor"])
query("balltree_neighbor_radius", lambda s, d: misc.balltree_neighbor(plane(s, d), radius=EPS, mode="radius"), ORACLES["epsilon"])
query("disk_uniform", lambda s, d: misc.disk(plane(s, d), EPS / 2), ORACLES["epsilon"])
query("disk_adaptive", lambda s, d: misc.disk(plane(s, d), mode="adaptive"), f"WITH {knn(3)}, {PAIRS}, r AS (SELECT src AS id, greatest(dist*0.5e0, 1e-10) AS r FROM knn WHERE rank = 3) SELECT src, dst, {W} FROM pairs JOIN r a ON a.id = src JOIN r b ON b.id = dst WHERE dist <= a.r + b.r")


def _draw(axis: int, mean: float, deviation: float) -> str:
    total = "+".join(f"CAST(('0x' || substr(md5('443:{axis}:{k}:' || id), 1, 8)) AS BIGINT)/4294967296.0e0" for k in range(12))
    return f"greatest(abs({mean}e0+{deviation}e0*(({total})-6.0e0)), 0.05e0)"


_EXT = f"ext AS MATERIALIZED (SELECT id, {_draw(0, 0.02, 0.03)} AS ex, {_draw(1, 0.02, 0.03)} AS ey FROM pts)"
query("intersection_circle", lambda s, d: misc.intersection(plane(s, d), "circle", 0.02, 0.03), f"WITH {PTS}, {PAIRS}, {_EXT} SELECT src, dst, {W}, round(a.ex+b.ex-dist, 6) AS overlap FROM pairs JOIN ext a ON a.id = src JOIN ext b ON b.id = dst WHERE dist <= a.ex+b.ex")
query("intersection_rectangle", lambda s, d: misc.intersection(plane(s, d), "rectangle", 0.02, 0.03), f"WITH {PTS}, {PAIRS}, {_EXT}, q AS (SELECT src, dst, dist, a.ex+b.ex-abs(xa-xb) AS ox, a.ey+b.ey-abs(ya-yb) AS oy FROM pairs JOIN ext a ON a.id = src JOIN ext b ON b.id = dst) SELECT src, dst, {W}, round(ox*oy, 6) AS overlap_area FROM q WHERE ox >= 0 AND oy >= 0")


def _graph(name: str, points: tables.Points, **params) -> Graph:
    return get_operator(*name.split("/")).build(points, **params)


_KNN_EDGES = f"{knn(K)}, e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, dist FROM knn)"
query("graph_summary", lambda s, d: _graph("proximity/symmetric_knn", plane(s, d), k=K).summary(), f"WITH {_KNN_EDGES}, n AS (SELECT count(*) AS n FROM pts), m AS (SELECT count(*) AS m FROM e) SELECT n AS n_nodes, m AS n_edges, round(m / (n * (n - 1) / 2.0e0), 6) AS density FROM n, m")
query("node_degrees", lambda s, d: _graph("proximity/symmetric_knn", plane(s, d), k=K).degrees(), f"WITH {_KNN_EDGES}, x AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) SELECT pts.id, count(x.id) AS degree FROM pts LEFT JOIN x ON x.id = pts.id GROUP BY pts.id")
query("normalized_weights", lambda s, d: _graph("proximity/symmetric_knn", plane(s, d), k=K).normalized_weights(), f"WITH {_KNN_EDGES}, r AS (SELECT min(dist) AS lo, max(dist) AS hi FROM e) SELECT src, dst, {W}, round((dist - lo) / (hi - lo), 6) AS normalized FROM e, r")
_MUTUAL = f"{knn(K)}, e AS (SELECT a.src AS a, a.dst AS b FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src)"
query("graph_components", lambda s, d: _graph("proximity/mutual_knn", plane(s, d), k=K).components(), f"WITH RECURSIVE {_MUTUAL}, reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), l AS (SELECT a, min(b) AS b FROM reach GROUP BY a) SELECT id, coalesce(least(id, b), id) AS component FROM pts LEFT JOIN l ON l.a = id")
query("similarity_stats", lambda s, d: kernel.similarity_stats(kernel.thresholded(plane(s, d), "laplacian", 0.0)), f"WITH {PTS}, {PAIRS}, k AS (SELECT exp(-dist/1.0e0) AS w FROM pairs) SELECT round(avg(w), 6) AS mean, round(quantile_cont(w, 0.5), 6) AS median, round(stddev_pop(w), 6) AS std, round(min(w), 6) AS min, round(max(w), 6) AS max, round(count(*) FILTER (abs(w) < 1e-12) / CAST(count(*) AS DOUBLE), 6) AS sparsity, count(*) FILTER (abs(w) >= 1e-12) AS nnz FROM k")
query("bounding_box", lambda s, d: tables.bounding_box(plane_by_label(s, d)), f"WITH {PTSL} SELECT layout, round(min(x) - 0.5e0, 6) AS x_min, round(max(x) + 0.5e0, 6) AS x_max, round(min(y) - 0.5e0, 6) AS y_min, round(max(y) + 0.5e0, 6) AS y_max FROM pts GROUP BY layout")
