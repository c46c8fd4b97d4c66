"""What a construction gives: nodes, edges, parameters, and measures of the graph as plans."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.layouts import each_layout  # noqa: F401  (sequential constructions are built with it)
from .plans.scratch import components
from .sources.tables import Points


@dataclass
class Graph:
    """Lazy nodes and edges, with what made them. Measures are plans; numbers run one."""

    nodes: DataFrame
    edges: DataFrame
    name: str = ""
    category: str = ""
    directed: bool = False
    keys: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    build_time_ms: float | None = None

    def summary(self) -> DataFrame:
        """For each layout: n_nodes, n_edges and density."""
        nodes = self.nodes.groupBy(*self.keys).agg(F.count("*").alias("n_nodes"))
        edges = self.edges.groupBy(*self.keys).agg(F.count("*").alias("n_edges"))
        both = nodes.join(edges, [*self.keys], "left") if self.keys else nodes.crossJoin(edges)  # one row each
        pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / (1 if self.directed else 2)
        both = both.withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
        return both.select(*self.keys, "n_nodes", "n_edges", F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(0.0).alias("density"))

    def degrees(self) -> DataFrame:
        """Each node's number of edges (directed: in and out), zeros included."""
        ends = self.edges.select(*self.keys, F.col("src").alias("id")).unionByName(self.edges.select(*self.keys, F.col("dst").alias("id")))
        n = ends.groupBy(*self.keys, "id").agg(F.count("*").alias("degree"))
        return self.nodes.select(*self.keys, "id").join(n, [*self.keys, "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def components(self) -> DataFrame:
        """Each node's component: the smallest id in it (for graphs of one layout)."""
        found = components(self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        return self.nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("component"))

    def normalized_weights(self) -> DataFrame:
        """Edges with weights from 0 to 1 within each layout; all equal: 0.5."""
        from pyspark.sql import Window

        w = Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))
        low, high = F.min("weight").over(w), F.max("weight").over(w)
        return self.edges.withColumn("normalized", F.when(high > low, (F.col("weight") - low) / (high - low)).otherwise(0.5))

    def contains(self, other: DataFrame) -> bool:
        """Whether all edges of another table are edges here."""
        return not other.join(self.edges, [*self.keys, "src", "dst"], "left_anti").limit(1).count()

    def write(self, folder: str, format: str = "parquet") -> None:
        """Sink: nodes and edges as two tables. CSV takes flat columns only."""
        self.nodes.write.mode("overwrite").format(format).option("header", True).save(f"{folder}/nodes")
        self.edges.write.mode("overwrite").format(format).option("header", True).save(f"{folder}/edges")


def recorded(name: str, category: str, run, points: Points, directed: bool, params: dict) -> Graph:
    """Build, and measure the time of a whole build: the edges are computed once to a sink that keeps nothing."""
    edges = run(points, **params)
    began = time.perf_counter()
    edges.write.format("noop").mode("overwrite").save()
    took = (time.perf_counter() - began) * 1000
    return Graph(points.frame, edges, name, category, directed, points.keys, params, took)


def write_points_csv(points: Points, path: str) -> None:
    """Sink: index, x, y, cluster with six decimals."""
    x = lambda d: F.format_string("%.6f", F.get("features", F.lit(d)))
    points.frame.select(F.col("id").alias("index"), x(0).alias("x"), x(1).alias("y"), F.col("label").alias("cluster")).write.mode("overwrite").option("header", True).csv(path)


def read_points_csv(spark, path: str) -> Points:
    """Source: the same."""
    frame = spark.read.schema("index long, x double, y double, cluster int").option("header", True).csv(path)
    return Points(frame.select(F.col("index").alias("id"), F.array("x", "y").alias("features"), F.col("cluster").alias("label")), 2)
