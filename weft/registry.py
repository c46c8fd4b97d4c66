"""The constructions by category and slug, with their parameters and flags."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .graph import Graph, recorded
from .operators import ann, data_driven, kernel, misc, proximity, random_models, spanners, spanning, triangulation, visibility
from .sources.tables import Points

MODULES = {
    "proximity": (proximity, "complete symmetric_knn mutual_knn epsilon gabriel rng beta_skeleton influence"),
    "triangulation": (triangulation, "delaunay constrained_delaunay"),
    "spanning": (spanning, "mst_prim mst_kruskal mst_boruvka emst random_spanning k_mst_overlay"),
    "random_models": (random_models, "erdos_renyi_gnp erdos_renyi_gnm watts_strogatz barabasi_albert random_geometric sbm configuration chung_lu kronecker forest_fire price holme_kim random_regular"),
    "spanners": (spanners, "greedy_spanner t_spanner yao theta wspd_spanner"),
    "ann": (ann, "nsw hnsw vamana nn_descent rp_forest lsh"),
    "kernel": (kernel, "gaussian_rbf cosine thresholded adaptive_bandwidth jaccard"),
    "visibility": (visibility, "natural_visibility horizontal_visibility geometric_visibility"),
    "data_driven": (data_driven, "correlation partial_correlation glasso mutual_information expansion"),
    "misc": (misc, "kdtree_neighbor balltree_neighbor disk intersection"),
}
#: What a category is called in tables and reports.
TITLES = {
    "proximity": "Proximity", "triangulation": "Triangulation", "spanning": "Spanning structures", "random_models": "Random models", "spanners": "Geometric spanners",
    "ann": "Approximate nearest neighbours", "kernel": "Kernels and similarity", "visibility": "Visibility", "data_driven": "Data-driven", "misc": "Spatial indexes and overlap",
}
DIRECTED = {"price"}
SAMPLED = {"random_spanning", "k_mst_overlay", "intersection", *MODULES["random_models"][1].split(), *MODULES["ann"][1].split()} - {"random_geometric"}


@dataclass(frozen=True)
class Operator:
    category: str
    slug: str
    run: Callable
    is_directed: bool
    is_deterministic: bool

    @property
    def is_spatial(self) -> bool:
        """Whether edges depend on where the points are."""
        return self.takes == "points" and (self.category != "random_models" or self.slug == "random_geometric")

    @property
    def takes(self) -> str:
        """What the first argument is: points, series, observations or degrees."""
        return next(iter(inspect.signature(self.run).parameters))

    def parameters(self) -> list[tuple[str, str, str]]:
        """(name, type, default) of each parameter after the input; a required one has no default."""
        found = list(inspect.signature(self.run).parameters.values())[1:]
        return [(p.name, str(p.annotation), "" if p.default is p.empty else repr(p.default)) for p in found if p.kind is not p.VAR_KEYWORD]

    def describe(self) -> str:
        text = inspect.getdoc(self.run) or ""
        rows = "".join(f"\n| {n} | {t} | {d} |" for n, t, d in self.parameters())
        return f"{self.category}/{self.slug}: {text}\n\n| parameter | type | default |\n|-|-|-|{rows}"

    def build(self, points: Points, *inputs, **params) -> Graph:
        """A graph whose edges are a plan; nothing runs but what the construction must know first."""
        return Graph(points.frame, self.run(points, *inputs, **params), self.slug, self.category, self.is_directed, points.keys, params)

    def build_and_record(self, points: Points, **params) -> Graph:
        return recorded(self.slug, self.category, self.run, points, self.is_directed, params)


_operators: dict[str, dict[str, Operator]] = {}


def register(category: str, slug: str, run: Callable, directed: bool = False, deterministic: bool = True) -> Operator:
    """Add a construction of one's own."""
    out = _operators.setdefault(category, {})[slug] = Operator(category, slug, run, directed, deterministic)
    return out


for _category, (_module, _slugs) in MODULES.items():
    for _slug in _slugs.split():
        register(_category, _slug, getattr(_module, _slug), _slug in DIRECTED, _slug not in SAMPLED)
register("proximity", "urquhart", triangulation.urquhart)


def registry() -> dict[str, dict[str, Operator]]:
    return {c: dict(o) for c, o in _operators.items()}


def get_operator(category: str, slug: str) -> Operator:
    if category not in _operators:
        raise KeyError(f"no category {category}; there are {', '.join(sorted(_operators))}")
    if slug not in _operators[category]:
        raise KeyError(f"no {slug} in {category}; there are {', '.join(sorted(_operators[category]))}")
    return _operators[category][slug]


def all_operators() -> list[Operator]:
    return [o for _, own in sorted(_operators.items()) for _, o in sorted(own.items())]


def list_categories() -> list[str]:
    return sorted(_operators)


def list_algorithms(category: str) -> list[str]:
    if category not in _operators:
        raise KeyError(f"no category {category}; there are {', '.join(sorted(_operators))}")
    return sorted(_operators[category])


def operators_table(spark: SparkSession) -> DataFrame:
    """The registry as a table, also registered as the view `operators`."""
    rows = [(o.category, o.slug, o.takes, o.is_directed, o.is_deterministic, [f"{n}={d}" for n, _, d in o.parameters()]) for o in all_operators()]
    frame = spark.createDataFrame(rows, "category string, slug string, takes string, is_directed boolean, is_deterministic boolean, parameters array<string>")
    frame.createOrReplaceTempView("operators")
    return frame
